"""Word hashes in numpy, shared by operators that work on word n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: ASCII letters and digits in lower case, bytes of other scripts as they are, all else to spaces.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)
#: ASCII letters in lower case and ASCII white space to spaces; all else as it is.
SPACED = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b" \t\n\v\f\r" else c for c in range(256))
#: Odd multipliers that mix the words of an n-gram.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
               dtype=np.uint64)


def finish(x: np.ndarray) -> np.ndarray:
    """Spread mixed values over all 64 bits."""
    x = x ^ (x >> np.uint64(29))
    x = x * MIX[3]
    return x ^ (x >> np.uint64(32))


#: Texts are worked through in slices of about so many bytes.
SLICE = 1 << 20
_WORD = re.compile(rb"[^ ]+")
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + SLICE // 8)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _back(b: bytes, start: int, end: int, words: int) -> int:
    """Where the last ``words`` words of ``b[start:end]`` begin."""
    at = end
    for _ in range(words):
        at = len(b[start:at].rstrip(b" ")) + start
        at = b.rfind(b" ", start, at) + 1 or start
    return at


def slices(texts: Iterable[str | None], table: bytes = PLAIN, overlap: int = 2) -> Iterator[tuple[list[int], list[bytes]]]:
    """Bytes of the texts by ``table``, gathered to slices, with the index of the text of each part.

    A long text is cut at spaces into parts that overlap by ``overlap`` words, so
    that n-grams of up to one word more are all seen. A part of a text with more
    words than these has more than these as well.
    """
    at, parts, size = [], [], 0
    for i, text in enumerate(texts):
        b = (text or "").encode("utf-8", "replace").translate(table)
        o = 0
        while True:
            end = len(b) if len(b) - o <= SLICE else b.find(b" ", o + SLICE)
            end = end if end >= 0 else len(b)
            while end < len(b) and (back := _back(b, o, end, overlap)) <= o:  # giant words or white space: one word more
                word = _WORD.search(b, end)
                end = word.end() if word else len(b)
            at.append(i)
            parts.append(b[o:end])
            size += end - o
            if size >= SLICE:
                yield at, parts
                at, parts, size = [], [], 0
            if end == len(b):
                break
            o = back
    if parts:
        yield at, parts


def slice_words(parts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes of the words of all parts, the part of each word, and hashes of the words' first bytes."""
    b = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(b != 32)) + 1
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(b))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * power[: len(b)], dtype=np.uint64)))
    begin = np.cumsum([1, *(len(p) + 1 for p in parts)])
    part = np.repeat(np.arange(len(parts)), np.diff(np.searchsorted(starts, begin)))
    low, back = sums[starts], inverse[starts]
    words = finish((sums[ends] - low) * back)
    cuts = [finish((sums[np.minimum(starts + k, ends)] - low) * back + MIX[k % len(MIX)]) for k in prefixes]
    return words, part, cuts
