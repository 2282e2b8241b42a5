"""Similarity of short texts by tokens: the only per-pair Python of the library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (Hyyro 2004)."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return (row ^ full).bit_count()


def _indel(a: str, b: str) -> float:
    """Share of characters kept by the shortest edit of insertions and deletions, in percent."""
    n = len(a) + len(b)
    return 100.0 if n == 0 else 100.0 * 2 * _common_subsequence(a, b) / n


def token_sort_ratio(a: str, b: str) -> float:
    return _indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best of comparing common and own tokens: 100 where one side's tokens are all common."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    common, own_a, own_b = ta & tb, " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))
    if common and (not own_a or not own_b):
        return 100.0
    n, gap = len(" ".join(sorted(common))), 1 if common else 0
    len_a, len_b = n + gap + len(own_a), n + gap + len(own_b)
    apart = len(own_a) + len(own_b) - 2 * _common_subsequence(own_a, own_b)
    best = 100.0 - 100.0 * apart / (len_a + len_b)
    if common:  # the common tokens against either whole
        best = max(best, 100.0 - 100.0 * (len_a - n) / (n + len_a), 100.0 - 100.0 * (len_b - n) / (n + len_b))
    return best


def similarity(a: str, b: str) -> float:
    """Score of two prepared texts from 0 to 1, not rounded."""
    return 1.0 if a == b else max(token_set_ratio(a, b), token_sort_ratio(a, b)) / 100.0


def description_score(a: str | None, b: str | None) -> float:
    """Score of two descriptions, without regard to case and outer white space, rounded to two places; null counts as empty."""
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    return 1.0 if a == b else round(similarity(a, b), 2)


#: Longest text, of the shorter ones of pairs, whose common subsequence is found for many pairs at once: the bits of a word less one.
WORD = 63


def _common_subsequences(pairs: list[tuple[str, str]]) -> list[int]:
    """``_common_subsequence`` of many pairs: the rows of all of them go forward together, a character at a time."""
    turned = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    out = [0] * len(pairs)
    short = []
    for i, (a, b) in enumerate(turned):
        if len(a) <= WORD and len(b) <= 4 * WORD and "\0" not in a and "\0" not in b:
            short.append(i)
        else:
            out[i] = _common_subsequence(a, b)
    if not short:
        return out
    codes = lambda texts, n: np.array(texts, dtype=f"<U{n}").view("<u4").reshape(len(texts), n)
    longest = [max(1, *(len(turned[i][k]) for i in short)) for k in (0, 1)]
    a, b = codes([turned[i][0] for i in short], -(-longest[0] // 8) * 8), codes([turned[i][1] for i in short], longest[1])
    sizes = np.array([len(turned[i][0]) for i in short], np.uint64)
    full = (np.uint64(1) << sizes) - np.uint64(1)
    row, mask = full.copy(), np.zeros((len(short), 8), np.uint8)
    for j in range(longest[1]):
        mask[:, : a.shape[1] // 8] = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little")
        u = row & mask.view("<u8")[:, 0]
        row = (row + u | row - u) & full
    for i, n in zip(short, np.bitwise_count(row ^ full).tolist(), strict=True):
        out[i] = n
    return out


def similarities(pairs: list[tuple[str, str]]) -> list[float]:
    """``similarity`` of many pairs of prepared texts."""
    known: dict[str, tuple[set, str]] = {}
    for pair in pairs:
        for t in pair:
            if t not in known:
                tokens = t.split()
                known[t] = set(tokens), " ".join(sorted(tokens))
    out: list[float | None] = []
    open_, asked = [], []
    for i, (a, b) in enumerate(pairs):
        (ta, sa), (tb, sb) = known[a], known[b]
        common = ta & tb
        if a == b or (common and (len(common) == len(ta) or len(common) == len(tb))):
            out.append(1.0)
            continue
        out.append(None)
        n, gap = len(" ".join(common)), 1 if common else 0
        own = (" ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))) if ta and tb else ("", "")
        open_.append((i, n, gap, len(sa) + len(sb), len(own[0]), len(own[1]), bool(ta and tb)))
        asked += [(sa, sb), own]
    found = _common_subsequences(asked)
    for k, (i, n, gap, whole, own_a, own_b, both) in enumerate(open_):
        best = 100.0 if whole == 0 else 100.0 * 2 * found[2 * k] / whole
        if both:
            len_a, len_b = n + gap + own_a, n + gap + own_b
            best = max(best, 100.0 - 100.0 * (own_a + own_b - 2 * found[2 * k + 1]) / (len_a + len_b))
            if n:
                best = max(best, 100.0 - 100.0 * (len_a - n) / (n + len_a), 100.0 - 100.0 * (len_b - n) / (n + len_b))
        out[i] = best / 100.0
    return out


@F.pandas_udf(T.DoubleType())
def text_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """``description_score`` of two columns; pairs that repeat within a batch are scored once."""
    clean = lambda t: (t or "").strip().lower()
    rows = [(clean(x), clean(y)) for x, y in zip(a, b, strict=True)]
    pairs = list(dict.fromkeys(rows))
    known = dict(zip(pairs, (round(s, 2) for s in similarities(pairs)), strict=True))
    return pd.Series([known[p] for p in rows], dtype="float64")


def with_text_score(pairs: DataFrame, a: str, b: str, name: str = "desc_score") -> DataFrame:
    """Add the score of two text columns of stored ``pairs``: equal texts have 1, of the others each distinct pair is compared once."""
    clean = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", ""))
    marked = pairs.withColumns({"__a": clean(a), "__b": clean(b)})
    same: Column = F.col("__a") == F.col("__b")
    others = marked.filter(~same)
    scores = others.select("__a", "__b").distinct().withColumn(name, text_score("__a", "__b"))
    out = marked.filter(same).withColumn(name, F.lit(1.0)).unionByName(others.join(scores, ["__a", "__b"]))
    return out.drop("__a", "__b")
