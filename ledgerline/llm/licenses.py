"""License scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs (lines, and windows of neighbouring sentences that may hold a wrapped
notice) are classified by softmax regression over hashed word n-grams that occur
in license notices; all other n-grams carry no weight. The class ``unknown`` is
learned from paragraphs of the documents, and a threshold on the probability of
a notice is calibrated on paragraphs kept out. The classifier names the family;
a template of that family then confirms it when enough of its words stand in the
window, and its name and version. Windows that hold too few words of every template cannot be confirmed and are not classified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.runtime import small_batches
from ledgerline.llm.toxicity import features
from ledgerline.llm.words import PLAIN

#: Short public notices by license family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
FAMILIES = ("unknown", *TEMPLATES)
#: What names each family (and its version) in a text of lower-case words; one space between words.
NAMES = {
    "apache-2.0": r"apache license (version |v )?2 0|apache license v2 0",
    "mit": r"mit license|associated documentation files",
    "bsd": r"bsd \d clause|bsd license|redistribution and use in source and binary",
    "gpl-3.0": r"gnu general public license (as published by the free software foundation )?(either )?(version 3|v3|3)",
    "lgpl": r"gnu lesser general public license",
    "mpl-2.0": r"mozilla public license (version |v )?2 0|mozilla public license v2 0",
    "cc-by-nc": r"(cc by nc|creative commons attribution noncommercial) 4 0",
    "cc-by-sa": r"(cc by sa|creative commons attribution sharealike) 4 0",
    "cc-by": r"(cc by|creative commons attribution) 4 0",
    "unlicense": r"free and unencumbered software",
}
_NAMED = {k: re.compile(rf"\b({v})\b".encode()) for k, v in NAMES.items()}
#: Where a line parts into sentences.
_SENTENCE = re.compile(r"(?<=[.;!?])\s+(?=[A-Z])")
#: Bounds of the training sample: documents whose paragraphs serve as unknown ones, characters of such a document,
#: paragraphs, and words that are put around notices.
MAX_DOCS, MAX_TEXT, MAX_PARAGRAPHS, MAX_FILLER = 400, 50_000, 3_000, 20_000
#: Share of a template's words that confirms a prediction.
CONFIRM = 0.75
#: Share of kept-out unknown paragraphs that may pass the calibrated threshold.
FALSE_RATE = 0.001


@dataclass
class LicenseModel:
    features: np.ndarray  # sorted uint32
    weights: np.ndarray  # features x families
    bias: np.ndarray
    threshold: float = 0.5


def paragraphs(text: str | None) -> list[str]:
    return [p for p in (text or "").split("\n") if p.strip()]


def _word_list(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(PLAIN).split()


def _hits(known: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in ``known``) of the known features, once for each text."""
    maybe = np.zeros(1 << 16, bool)
    maybe[known & 0xFFFF] = True
    docs, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for doc, f in features(texts):
        some = maybe[f & 0xFFFF]
        doc, f = doc[some], f[some]
        place = np.minimum(np.searchsorted(known, f), len(known) - 1)
        own = known[place] == f
        pairs = np.unique(doc[own] * len(known) + place[own])
        docs.append(pairs // len(known))
        at.append(pairs % len(known))
    pairs = np.unique(np.concatenate(docs) * len(known) + np.concatenate(at))
    return pairs // len(known), pairs % len(known)


def _softmax(z):
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(unknown: list[str], seed: int = 13, epochs: int = 300) -> LicenseModel:
    """Softmax regression on notices, whole and worn (words lost, words of documents around them), and unknown paragraphs."""
    rng = np.random.default_rng(seed)
    filler = [w for p in unknown for w in p.split()][:MAX_FILLER] or ["text"]
    texts, y = [], []
    for k, name in enumerate(FAMILIES[1:], 1):
        for template in TEMPLATES[name]:
            words = template.split()
            for n in range(40):
                kept = [w for w in words if n < 8 or rng.random() > 0.08]
                around = [filler[rng.integers(len(filler))] for _ in range(0 if n < 8 else rng.integers(0, 12))]
                texts.append(" ".join([*around[::2], *kept, *around[1::2]]))
                y.append(k)
    vocabulary = [t for ts in TEMPLATES.values() for t in ts]
    known = np.unique(np.concatenate([f for _, f in features(vocabulary)]))
    pool = [w for t in vocabulary for w in t.split()]
    for p in unknown:
        texts.append(p)
        y.append(0)
        if len(texts) % 4 == 0:  # stray words of notices do not make one
            texts.append(" ".join([p, *(pool[rng.integers(len(pool))] for _ in range(4))]))
            y.append(0)
    y = np.array(y)
    x = np.zeros((len(texts), len(known)), np.float32)
    x[_hits(known, texts)] = 1
    kept_out = rng.random(len(y)) < 0.2
    w, b = np.zeros((len(known), len(FAMILIES))), np.zeros(len(FAMILIES))
    xt, target = x[~kept_out], np.eye(len(FAMILIES))[y[~kept_out]]
    for step in range(epochs):
        p = _softmax(xt @ w + b) - target
        rate = 4.0 * (1 - step / epochs)
        w -= rate * (xt.T @ p / len(xt))
        w = np.sign(w) * np.maximum(np.abs(w) - rate * 2e-5, 0)  # L1
        b -= rate * p.mean(0)
    best = _softmax(x[kept_out & (y == 0)] @ w + b)[:, 1:].sum(1)
    threshold = float(max(0.5, np.quantile(best, 1 - FALSE_RATE))) if len(best) else 0.5
    return LicenseModel(known, w, b, min(threshold, 0.95))


def classify(model: LicenseModel, texts: list[str]) -> list[tuple[str, float]]:
    """The likeliest family (or ``unknown``) of each paragraph, and the probability that it is a notice."""
    out = [("unknown", 0.0)] * len(texts)
    doc, at = _hits(model.features, texts)
    if not len(doc):
        return out
    some, row = np.unique(doc, return_inverse=True)
    z = np.tile(model.bias, (len(some), 1))
    np.add.at(z, row, model.weights[at])
    p = _softmax(z)
    for i, q in zip(some, p, strict=True):
        notice = float(1 - q[0])
        if notice >= model.threshold:
            out[i] = (FAMILIES[int(q[1:].argmax()) + 1], notice)
    return out


_WORDS = {w: 1 << n for n, w in enumerate(sorted({w for ts in TEMPLATES.values() for t in ts for w in _word_list(t)}))}
_MASKS = [(k, sum(_WORDS[w] for w in set(_word_list(t)))) for k, ts in TEMPLATES.items() for t in ts]
#: A window takes lines until it has twice the words of the longest template.
_LONGEST = 2 * max(len(_word_list(t)) for ts in TEMPLATES.values() for t in ts)


def _like(mask: int) -> set[str]:
    """Families of which enough of a template's words are in ``mask``."""
    return {k for k, t in _MASKS if (mask & t).bit_count() >= CONFIRM * t.bit_count()}


def sentences(text: str | None) -> list[tuple[int, int, list[bytes]]]:
    """(line, block, words) of every sentence; lines are numbered as in ``paragraphs``, blocks are parted by blank lines."""
    out, line, block = [], 0, 0
    for t in (text or "").split("\n"):
        if not t.strip():
            block += 1
            continue
        out += [(line, block, words) for s in _SENTENCE.split(t) if (words := _word_list(s))]
        line += 1
    return out


def windows(text: str | None) -> list[tuple[int, int, bytes]]:
    """(first sentence, end, words) of all windows of neighbouring sentences that hold enough words of any template to be confirmed.

    Windows do not go over a blank line and are at most about as long as two templates. Which family a window
    is of, if any, is for the classifier to say.
    """
    parts = sentences(text)
    masks = []
    for _, _, words in parts:
        mask = 0
        for w in set(words):
            mask |= _WORDS.get(w, 0)
        masks.append(mask)
    whole = 0
    for mask in masks:
        whole |= mask
    if not _like(whole):
        return []
    out = []
    for i in range(len(parts)):
        if not masks[i]:
            continue
        mask, words = 0, []
        for j in range(i, len(parts)):
            if parts[j][1] != parts[i][1] or (j > i and len(words) >= _LONGEST):
                break
            mask, words = mask | masks[j], words + parts[j][2]
            if masks[j] and _like(mask):
                out.append((i, j + 1, b" ".join(words)))
    return out


def confirmed(family: str, words: bytes) -> bool:
    """Whether a window agrees with a template of its predicted family, and its name and version are that family's."""
    mask = 0
    for w in set(words.split()):
        mask |= _WORDS.get(w, 0)
    alike = any((mask & t).bit_count() >= CONFIRM * t.bit_count() for k, t in _MASKS if k == family)
    return alike and bool(_NAMED[family].search(words))


def notices(found: list[tuple[int, int, bytes]], families: list[str]) -> list[tuple[str, int, int]]:
    """(family, first sentence, end) of the windows whose predicted family is confirmed; of windows of a family that overlap the shortest stands."""
    sure = [(k, i, j) for (i, j, words), k in zip(found, families, strict=True) if k != "unknown" and confirmed(k, words)]
    out, taken = [], set()
    for k, i, j in sorted(sure, key=lambda f: (f[2] - f[1], f[1])):
        if taken.isdisjoint(own := [(k, n) for n in range(i, j)]):
            taken.update(own)
            out.append((k, i, j))
    return sorted(out, key=lambda f: (f[1], f[0]))


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_text: int = MAX_TEXT, max_paragraphs: int = MAX_PARAGRAPHS) -> LicenseModel:
    """Train on notices and on at most ``max_paragraphs`` paragraphs of a bounded sample of documents (smallest hashes of
    their ids; longer texts than ``max_text`` do not count)."""
    docs = docs.filter("doc_id is not null and text is not null").filter(F.length("text") <= max_text)
    ids = docs.select("doc_id").distinct()
    ids = ids.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_docs).select("doc_id")
    sample = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    notice = {w for ts in TEMPLATES.values() for t in ts for w in _word_list(t)}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [p for t in rows.sort_values("doc_id")["text"] for p in paragraphs(t)]
        # a paragraph mostly of notices' words may be a notice and is no example of an unknown one
        plain = [p for p in found if len(notice & set(ws := _word_list(p))) < 0.4 * max(len(set(ws)), 1)][:max_paragraphs]
        m = train(plain)
        return pd.DataFrame([[m.features.tobytes(), m.weights.tobytes(), m.bias.tobytes(), m.threshold]], columns=["f", "w", "b", "t"])

    got = sample.groupBy().applyInPandas(run, "f binary, w binary, b binary, t double").collect()
    if not got:
        return train([])
    r = got[0]
    return LicenseModel(
        np.frombuffer(r.f, np.uint32), np.frombuffer(r.w).reshape(-1, len(FAMILIES)), np.frombuffer(r.b), r.t
    )


def scan(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """Licenses named in every document: ``doc_id``, ``n_paragraphs``, ``n_predicted``, ``n_confirmed``, ``licenses``.

    ``licenses`` lists the confirmed families in alphabetical order, joined by
    commas. ``n_paragraphs`` and ``n_predicted`` count lines, of which those of a confirmed
    notice are predicted; ``n_confirmed`` counts notices, each with its family. Defined cases: null and empty texts have no paragraphs and no
    license; rows with a null id and repeated rows are each scanned; ties between
    families go to the one listed first; an empty table gives an empty result;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias, model.threshold))

    @F.pandas_udf("n_paragraphs long, n_predicted long, n_confirmed long, licenses string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = LicenseModel(*shared.value)
        for texts in batches:
            parts = [paragraphs(t) for t in texts]
            found = [windows(t) for t in texts]
            lines = iter(classify(m, [p for ps in parts for p in ps]))
            read = iter(classify(m, [words.decode("utf-8", "replace") for fs in found for _, _, words in fs]))
            out = []
            for text, ps, fs in zip(texts, parts, found, strict=True):
                predicted = {n for n in range(len(ps)) if next(lines)[0] != "unknown"}
                sure = notices(fs, [next(read)[0] for _ in fs])
                if sure:
                    at = [line for line, _, _ in sentences(text)]
                    predicted.update(at[n] for _, i, j in sure for n in range(i, j))
                out.append((len(ps), len(predicted), len(sure), ",".join(sorted({k for k, _, _ in sure}))))
            yield pd.DataFrame(out, columns=["n_paragraphs", "n_predicted", "n_confirmed", "licenses"])

    return docs.select("doc_id", run("text").alias("s")).select("doc_id", "s.*")
