"""Periodic runs against a plain search, and the cases that the docstrings define."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from ledgerline.llm import periodic

DOCS = "doc_id long, text string, runs long"


def brute_runs(w, periods, fewest):
    """For every period, the stretches in which words so far apart are the same."""
    out = {}
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            x = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - x >= max(fewest, periods * p):
                out.setdefault((x, i + p), p)
    return sorted(((x, y - x, p) for (x, y), p in out.items()), key=lambda r: (r[0], r[2]))


def some_words(rng, longest):
    n, kinds = rng.randint(0, longest), rng.choice([1, 2, 3, 8, 20])
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 2)):
        start, p = rng.randrange(n or 1), rng.randint(1, 8)
        for i in range(start + p, n):
            w[i] = w[i - p] if rng.random() < 0.98 else rng.randrange(kinds)
    return w


def test_all_runs_are_found():
    rng = random.Random(1)
    for _ in range(3000):
        w = some_words(rng, 45)
        for periods, fewest in ((2, 2), (3, 2), (4, 6)):
            assert periodic.find_runs(w, periods, fewest) == brute_runs(w, periods, fewest), w


def test_factors_are_longest_earlier_stretches():
    rng = random.Random(2)
    for _ in range(300):
        w, at = some_words(rng, 30), 0
        for start, end, source in periodic.factors(w):
            earlier = lambda e, s=start: any(w[j : j + e - s] == w[s:e] for j in range(s))
            assert start == at and (source < 0 or w[source : source + end - start] == w[start:end] and source < start)
            assert (end == start + 1 and not earlier(end)) or (earlier(end) and (end == len(w) or not earlier(end + 1)))
            at = end
        assert at == len(w)


def test_setting_words_aside_loses_no_run():
    rng = random.Random(3)
    for _ in range(1000):
        texts = [[str(x).encode() for x in some_words(rng, 60)] for _ in range(rng.randint(1, 6))]
        assert periodic.text_runs(texts) == [brute_runs(x, 4, 6) for x in texts]


def brute_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w, 4, 6)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_digests_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in some_words(rng, 120))) for i in range(400)]
    rows += [(7, None), (8, ""), (None, "a b " * 9), (9, " \t\n"), (10, "x " * 6), (11, "x " * 5), (12, "a b c " * 9), (13, "\x1c \x1d " * 9), (13, "\x1c \x1d " * 9)]
    rows += [(14, "same line of words\n" * 1_000), (15, "z" * 300_000)]
    planted = [d for d in range(20, 200) if zlib.crc32(str(d).encode()) % 10 == 0]
    rows += [(d, " ".join(str(rng.randrange(9**6)) for _ in range(rng.randint(1, 400)))) for d in planted]
    docs = spark.createDataFrame([(*r, 5) for r in rows], DOCS).repartition(3)
    found = periodic.with_runs(periodic.with_planted_runs(docs))
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    got = [tuple(r) for r in periodic.digest(found).collect()]
    assert sorted(got, key=str) == sorted((brute_digest(*r) for r in rows), key=str)
    assert any(r[1] > 0 for r in got if r[0] in planted)
    assert periodic.digest(periodic.with_runs(docs.filter("false"))).count() == 0
