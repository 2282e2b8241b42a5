"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes);
a linear layer and softmax give the languages. Embeddings and layer are trained
together by stochastic gradient descent in numpy. A temperature and a rejection
threshold are calibrated on rows kept out of the descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.runtime import small_batches
from ledgerline.llm.toxicity import fold

GRAMS = (2, 3, 4)
BUCKETS = 1 << 13
DIM = 16
#: Bounds of the training sample: texts, and characters of each.
MAX_TRAIN, MAX_TEXT = 2_500, 50_000
#: Texts are worked through in pieces of so many bytes.
PIECE = 1 << 20
#: Share of rightly labelled calibration rows that rejection may turn away.
REJECT = 0.01


@dataclass
class LanguageModel:
    languages: list[str]
    embeddings: np.ndarray  # BUCKETS x DIM
    layer: np.ndarray  # DIM x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


def _lower(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()


def _buckets(b: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the n-grams that start at each byte of ``b``."""
    size = len(b) - n + 1
    h = np.full(size, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF), np.uint32)
    for k in range(n):
        h = (h ^ b[k : k + size]) * np.uint32(0x01000193)
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts cut and gathered into lists of about PIECE bytes; a cut text overlaps by what n-grams need."""
    at, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for o in range(0, max(len(t), 1), PIECE):
            at.append(i)
            parts.append(t[o : o + PIECE + max(GRAMS) - 1])
            size += len(parts[-1])
            if size >= PIECE:
                yield at, parts
                at, parts, size = [], [], 0
    if parts:
        yield at, parts


def bag_sums(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of ``table`` rows over its n-grams, and the number of n-grams."""
    sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for at, parts in _pieces(texts):
        b = np.frombuffer(b"".join(parts) + b"\0" * max(GRAMS), np.uint8).astype(np.uint32)
        lengths = np.array([len(p) for p in parts])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        whole = np.array([min(len(p), PIECE) for p in parts])
        for n in GRAMS:
            idx = _buckets(b, n)
            grams = np.minimum(np.maximum(lengths - n + 1, 0), whole)
            np.add.at(counts, at, grams)
            for c in range(table.shape[1]):
                run = np.concatenate(([0.0], np.cumsum(table[:, c][idx], dtype=np.float64)))
                np.add.at(sums[:, c], at, run[starts + grams] - run[starts])
    return sums, counts


def _counts(text: bytes) -> np.ndarray:
    """Mean n-gram counts of one text, for training."""
    out = np.zeros(BUCKETS, np.float32)
    for o in range(0, len(text), PIECE):
        part = np.frombuffer(text[o : o + PIECE + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        for n in GRAMS:
            if len(part) >= n:
                out += np.bincount(_buckets(part, n)[:PIECE], minlength=BUCKETS)
    return out / max(out.sum(), 1)


def train(texts: list[str], langs: list[str], epochs: int = 12, rate: float = 8.0, batch: int = 32,
          seed: int = 11) -> LanguageModel:
    """Minibatch descent with a decaying rate; one row in five is kept for calibration."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    x = np.stack([_counts(_lower(t)) for t in texts])
    y = np.array([names.index(v) for v in langs])
    kept = np.arange(len(y)) % 5 == 4
    e = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    w, bias = (rng.standard_normal((DIM, len(names))) * 0.3).astype(np.float32), np.zeros(len(names), np.float32)
    rows = np.flatnonzero(~kept)
    steps, total = 0, epochs * max(1, -(-len(rows) // batch))
    for _ in range(epochs):
        order = rng.permutation(rows)
        for k in range(0, len(order), batch):
            i = order[k : k + batch]
            lr = rate * (1 - steps / total)
            steps += 1
            mean = x[i] @ e
            p = _softmax(mean @ w + bias)
            p[np.arange(len(i)), y[i]] -= 1
            p /= len(i)
            grad_w, grad_mean = mean.T @ p, p @ w.T
            bias -= 0.05 * lr * p.sum(0)
            w -= 0.5 * lr * grad_w
            e -= lr * 20 * (x[i].T @ grad_mean)
    model = LanguageModel(names, e, w, bias)
    if kept.any():
        logits = x[kept] @ e @ w + bias
        best = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: -np.log(_softmax(logits / t)[np.arange(kept.sum()), y[kept]] + 1e-12).mean())
        p = _softmax(logits / best)
        right = p.max(1)[p.argmax(1) == y[kept]]
        model.temperature = best
        model.threshold = float(np.quantile(right, REJECT)) if len(right) else 0.0
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def training_sample(docs: DataFrame, max_train: int = MAX_TRAIN, max_text: int = MAX_TEXT) -> DataFrame:
    """Bounded sample outside fold 0: the rows with the smallest hashes of their ids; longer texts than ``max_text`` do not count."""
    rows = docs.filter("doc_id is not null and text is not null and lang is not null").filter(fold(F.col("doc_id")) != 0)
    rows = rows.filter(F.length("text") <= max_text)
    ids = rows.select("doc_id").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_train)
    # at most max_train ids are broadcast; of rows that share an id one is taken
    chosen = rows.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")
    return chosen.groupBy("doc_id").agg(F.max(F.struct("text", "lang")).alias("r")).select("doc_id", "r.text", "r.lang")


def fit(docs: DataFrame, **options) -> LanguageModel:
    """Train on the bounded sample, in one task; rows are ordered by id so that reruns agree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        m = train(rows["text"].tolist(), rows["lang"].tolist(), **options)
        parts = [np.asarray(a, np.float32).tobytes() for a in (m.embeddings, m.layer, m.bias)]
        return pd.DataFrame([[m.languages, *parts, m.temperature, m.threshold]], columns=["names", "e", "w", "b", "t", "r"])

    found = training_sample(docs).groupBy().applyInPandas(
        run, "names array<string>, e binary, w binary, b binary, t double, r double"
    ).collect()
    if not found:
        return train([], [])
    r = found[0]
    e, w, b = (np.frombuffer(x, np.float32) for x in (r.e, r.w, r.b))
    return LanguageModel(list(r.names), e.reshape(BUCKETS, DIM), w.reshape(DIM, len(r.names)), b, r.t, r.r)


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Predict the language of every row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected``.

    Learns from ``text`` and ``lang`` of rows outside fold 0 unless a model is
    given. ``rejected`` marks scores under the calibrated threshold; the best
    language is still named there. Defined cases: a null text, or one without a
    letter, gives ``und`` with score 0 and is rejected; a row with a null id
    counts as held out; without any language to learn from all rows are
    ``und``; repeated rows are each predicted; a text of any length is read whole; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = model or fit(docs)
    # the mean of embeddings times the layer is the mean of their product
    table = (model.embeddings @ model.layer / model.temperature).astype(np.float64)
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, table, np.asarray(model.bias) / model.temperature, model.threshold)
    )

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, table, bias, threshold = shared.value
        for texts in batches:
            lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
            out = pd.DataFrame({"lang_pred": "und", "score": 0.0, "rejected": True}, index=range(len(texts)))
            at = [i for i, ok in enumerate(lettered) if ok] if names else []
            if at:
                picked = texts.iloc[at]
                sums, counts = bag_sums([_lower(t) for t in picked], table)
                p = _softmax(sums / np.maximum(counts, 1)[:, None] + bias)
                best = p.argmax(1)
                out.loc[at, "lang_pred"] = [names[k] for k in best]
                out.loc[at, "score"] = p.max(1)
                out.loc[at, "rejected"] = p.max(1) < threshold
            yield out

    return docs.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), predict("text").alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
