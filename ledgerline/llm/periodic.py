"""Detection of periodic runs of words (Kolpakov and Kucherov).

A run is a stretch of words with period q (words q apart are the same) that no
neighbouring word extends. All runs of a text are found in time in proportion to
its length:

1. A suffix automaton gives the LZ factorisation: each factor is the longest
   stretch from its start that also begins further left, or a new word.
2. A run that crosses or touches the start of a factor begins less than one
   factor and one period before it. Main's algorithm finds these runs: common
   extensions to both sides of the boundary, for all periods at once, from two Z arrays.
3. All other runs lie strictly within a factor and are copied from its earlier occurrence.

Only runs of at least four periods are of use here, so words that cannot belong
to any are set aside beforehand without loss (``candidates``).
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.runtime import small_batches

#: A run has at least so many periods and so many words.
PERIODS, WORDS = 4, 6
#: Words of texts that are looked through together, and rounds of splitting before stretches are searched as they are.
TOGETHER, ROUNDS = 500_000, 12


class SuffixAutomaton:
    """States in arrays; most have one way on, further ones are kept aside."""

    def __init__(self, symbols: list[int]):
        n = 2 * len(symbols) + 2
        self.length, self.link, self.first_end = array("i", [0]) * n, array("i", [-1]) * n, array("i", [-1]) * n
        self.symbol, self.to = array("i", [-1]) * n, array("i", [-1]) * n
        self.more: dict[int, dict[int, int]] = {0: {}}
        self.size, last = 1, 0
        for i, c in enumerate(symbols):
            last = self._extend(c, i, last)

    def go(self, state: int, c: int) -> int:
        if self.symbol[state] == c:
            return self.to[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(c, -1)

    def _set(self, state: int, c: int, to: int) -> None:
        if self.symbol[state] in (-1, c):
            self.symbol[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _extend(self, c: int, i: int, last: int) -> int:
        new, length, link = self.size, self.length, self.link
        self.size += 1
        length[new], self.first_end[new] = length[last] + 1, i
        p = last
        while p >= 0 and self.go(p, c) < 0:
            self._set(p, c, new)
            p = link[p]
        if p < 0:
            link[new] = 0
            return new
        q = self.go(p, c)
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        twin = self.size
        self.size += 1
        length[twin], link[twin], self.first_end[twin] = length[p] + 1, link[q], self.first_end[q]
        self.symbol[twin], self.to[twin] = self.symbol[q], self.to[q]
        if q in self.more:
            self.more[twin] = dict(self.more[q])
        while p >= 0 and self.go(p, c) == q:
            self._set(p, c, twin)
            p = link[p]
        link[q] = link[new] = twin
        return new


def factors(symbols: list[int]) -> Iterator[tuple[int, int, int]]:
    """LZ factors as (start, end, start of an earlier occurrence or -1), end exclusive; an earlier occurrence can overlap its factor."""
    automaton, n = SuffixAutomaton(symbols), len(symbols)
    start = 0
    while start < n:
        state, end, source = 0, start, -1
        while end < n:
            state = automaton.go(state, symbols[end])
            if automaton.first_end[state] >= end:
                break
            source = automaton.first_end[state] - (end - start)
            end += 1
        end = max(end, start + 1)
        yield start, end, source
        start = end


def _z(s: list[int]) -> list[int]:
    """Length of the longest common prefix of ``s`` and each of its suffixes."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _across(w: list[int], before: int, at: int, end: int, periods: int, fewest: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, end, period) that hold or touch position ``at`` and end by ``end``; ``before`` is where the factor before ``at`` starts.

    A run that goes on to the right of ``at`` starts less than a period before ``before``, since otherwise the factor
    that starts there would have reached further; so ``periods - 1`` of its periods fit in between.
    """
    most = (end - before) // (periods - 1) + 1
    low = max(0, before - most)
    t, u = w[low:at], w[at:end]
    most = min(most, len(t) + len(u))
    right, left = min(most, len(u)), min(most, len(t))
    ahead = _z([*u, -1, *t[len(t) - left :], *u])
    back_t = t[::-1]
    back = _z([*back_t, -1, *reversed(u[:right]), *back_t])
    n_u, n_t, n = len(u), len(t), len(w)
    for p in range(1, most + 1):
        found = []
        if p <= right:  # the words from ``at`` on against those p further on, and to the left likewise
            f = ahead[p] if p < n_u else 0
            found.append((at - min(back[n_t + 1 + right - p], n_t), at + p + min(f, n_u - p)))
        if p <= left:
            f = min(ahead[n_u + 1 + left - p], n_u)
            found.append((at - p - (back[p] if p < n_t else 0), at + f))
        for x, y in found:
            if y - x >= fewest and y - x >= periods * p and not (x and w[x - 1] == w[x - 1 + p]) and not (y < n and w[y] == w[y - p]):
                yield x, y, p


def find_runs(symbols: list[int], periods: int = 2, fewest: int = 2) -> list[tuple[int, int, int]]:
    """All runs of at least ``periods`` (2 or more) periods and ``fewest`` symbols: (start, length, smallest period), by start, then period.

    Symbols are numbers from 0.
    """
    by_start: dict[int, dict[int, int]] = {}  # start, end, period

    def add(x: int, y: int, p: int) -> None:
        ends = by_start.setdefault(x, {})
        ends[y] = min(p, ends.get(y, p))

    before = 0
    for start, end, source in factors(symbols):
        for run in _across(symbols, before, start, end, periods, fewest):
            add(*run)
        if source >= 0 and end - start > max(fewest, periods):
            shift = start - source
            for x in range(source + 1, source + end - start - 1):
                for y, p in list(by_start.get(x, {}).items()):
                    if y + shift < end:
                        add(x + shift, y + shift, p)
        before = start
    if symbols:
        for run in _across(symbols, before, len(symbols), len(symbols), periods, fewest):
            add(*run)
    return sorted(((x, y - x, p) for x, ends in by_start.items() for y, p in ends.items()), key=lambda r: (r[0], r[2]))


def candidates(ids: np.ndarray, text: np.ndarray, periods: int = PERIODS, fewest: int = WORDS) -> list[tuple[int, int]]:
    """Stretches (start, end) of word numbers that hold all runs of at least four periods of texts that follow each other.

    In a run every two neighbouring words stand together at least ``periods - 1`` times, so a text is split where two words
    meet that do so less often within their stretch; and again within the stretches that are left, until none splits.
    """
    n = len(ids)
    if n < fewest:
        return []
    pair = np.unique(ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1].astype(np.int64)
    at = np.flatnonzero(text[:-1] == text[1:])  # a pair by its first word
    stretch = text[at].astype(np.int64)
    for _ in range(ROUNDS if len(at) else 0):
        key = stretch * n + pair[at]
        _, where, often = np.unique(key, return_inverse=True, return_counts=True)
        good = often[where] >= periods - 1
        kept, old = at[good], stretch[good]
        if not len(kept):
            return []
        new = np.cumsum(np.concatenate(([True], (np.diff(kept) != 1) | (np.diff(old) != 0))))
        enough = np.bincount(new)[new] >= fewest - 1
        done = len(kept) == len(at) and enough.all()
        at, stretch = kept[enough], new[enough]
        if done:
            break
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate(([True], np.diff(stretch) != 0)))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return [(int(at[i]), int(at[j]) + 2) for i, j in zip(first, last, strict=True)]


def text_runs(texts: list[list[bytes]], periods: int = PERIODS, fewest: int = WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    known: dict[bytes, int] = {}
    number = [[known.setdefault(w, len(known)) for w in words] for words in texts]
    sizes = [len(x) for x in number]
    begin = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    ids = np.fromiter((i for x in number for i in x), np.int32, int(begin[-1]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for x, y in candidates(ids, np.repeat(np.arange(len(texts)), sizes), periods, fewest):
        k = int(np.searchsorted(begin, x, side="right")) - 1
        own: dict[int, int] = {}
        symbols = [own.setdefault(i, len(own)) for i in ids[x:y].tolist()]
        out[k] += [(x - int(begin[k]) + s, length, p) for s, length, p in find_runs(symbols, periods, fewest)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that stand in a run after its first period."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    kept = np.cumsum(edges[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def _batches(texts: pd.Series) -> Iterator[list[list[bytes]]]:
    """Words of texts, some texts at a time. ``bytes.split`` cuts at the ASCII white space that words are defined by."""
    some, size = [], 0
    for t in texts:
        some.append((t or "").encode("utf-8", "replace").split())
        size += len(some[-1])
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


RUNS = "array<struct<start: long, length: long, period: long>>"


def with_runs(docs: DataFrame, text_col: str = "text", periods: int = PERIODS, fewest: int = WORDS) -> DataFrame:
    """Add to every row the ``runs`` of its text and its ``collapsed`` text; columns of these names are replaced.

    Runs have at least ``periods`` (four or more) periods and ``fewest`` words (six or more) and are numbered in words; a
    word that stands in any run after its first period is left out of the collapsed text. Row by row, without a shuffle.
    Defined cases: a null text counts as empty, and an empty text has no run and collapses to itself; white space of
    any kind becomes one space in the collapsed text; very long texts are searched whole; repeated rows each get their
    result; an empty table gives an empty result.
    """
    if periods < PERIODS or fewest < WORDS:
        raise ValueError(f"runs have at least {PERIODS} periods and {WORDS} words")
    small_batches(docs.sparkSession)

    @F.pandas_udf(f"runs {RUNS}, collapsed string")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for some in _batches(texts):
                for words, runs in zip(some, text_runs(some, periods, fewest), strict=True):
                    found = [{"start": s, "length": n, "period": p} for s, n, p in runs]
                    rows.append((found, collapse(words, runs).decode("utf-8")))
            yield pd.DataFrame(rows, columns=["runs", "collapsed"])

    own = [c for c in docs.columns if c not in ("runs", "collapsed")]
    return docs.withColumn("__found", search(F.col(text_col).cast("string"))).select(*own, "__found.runs", "__found.collapsed")


def digest(found: DataFrame) -> DataFrame:
    """Of rows with ``doc_id``, ``runs`` and ``collapsed``: number of runs, the strongest run, and digests of all runs and of the collapsed text."""
    # Of two runs the one with the greater exact length / period comes first, then the earlier start, then the smaller period.
    stronger = lambda a, b: (
        (a.length * b.period > b.length * a.period)
        | ((a.length * b.period == b.length * a.period) & ((a.start < b.start) | ((a.start == b.start) & (a.period <= b.period))))
    )
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(stronger(a, b), a).otherwise(b))
    line = lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))
    listed: Column = F.array_join(F.transform("runs", line), "")
    out = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` in which one text of ten, by the checksum of its ``doc_id``, becomes periodic from some word on; a null id changes nothing.

    With h = crc32 of the decimal id and g = h div 10, a text of n words with h % 10 = 0 goes on from word a = g % n with
    the p = 1 + (n - a) div (3 + g % 8) words from there, again and again.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumn("__w", F.when(h % 10 == 0, words)).withColumns({"__n": F.size("__w"), "__g": F.floor(h / 10)})
    rows = rows.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")))
    rows = rows.withColumn("__p", F.expr("1 + (__n - __a) div (3 + __g % 8)"))
    turned = F.expr("transform(__w, (w, i) -> if(i < __a, w, __w[cast(__a + (i - __a) % __p as int)]))")
    text = F.when(F.col("__n") > 0, F.array_join(turned, " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(docs.columns)
