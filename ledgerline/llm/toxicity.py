"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate and an L1 term, so most weights end at
exactly zero; the rest, a few thousand, are broadcast to score whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.runtime import cut, small_batches
from ledgerline.llm.words import MIX, finish, slice_words, slices

#: Bounds of the training sample: so many labelled texts of either class at most.
MAX_TOXIC, MAX_CLEAN = 2_500, 4_000
#: Bound of the features of the sample, each four bytes in the training task.
MAX_FEATURES = 24_000_000
#: Words also count by their first so many bytes, for inflected forms.
PREFIXES = (4, 5, 6)


@dataclass
class ToxicityModel:
    features: np.ndarray  # sorted uint32
    weights: np.ndarray
    bias: float


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def training_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """A bounded sample of labelled texts outside fold 0: those with the smallest hashes of their ids."""
    marked = (
        labels.filter("doc_id is not null and toxic is not null")
        .filter(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    pick = lambda c, n: marked.filter(c).orderBy("h", "doc_id").limit(n)
    chosen = pick(F.col("toxic") > 0, max_toxic).unionByName(pick(F.col("toxic") <= 0, max_clean))
    # at most max_toxic + max_clean rows of numbers are broadcast; of rows that share an id one text is taken
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return joined.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))


def features(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of (index of the text, 32-bit feature): words and their beginnings, neighbours, and pairs that skip a word."""
    for at, parts in slices(texts):
        w, part, cuts = slice_words(parts, PREFIXES)
        doc = np.asarray(at)[part]
        near, skip = part[:-1] == part[1:], part[:-2] == part[2:]
        hashed = [w, *cuts, finish(w[:-1] * MIX[0] + w[1:] * MIX[1])[near], finish(w[:-2] * MIX[2] + w[2:] * MIX[0])[skip]]
        yield (
            np.concatenate([doc] * (1 + len(cuts)) + [doc[1:][near], doc[2:][skip]]),
            (np.concatenate(hashed) >> np.uint64(32)).astype(np.uint32),
        )


def text_features(texts) -> list[np.ndarray]:
    """Sorted distinct features of each text, of which a text of any length is worked through in slices."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for doc, f in features(texts):
        pairs = np.unique(doc.astype(np.uint64) << np.uint64(32) | f)
        own, first = np.unique((pairs >> np.uint64(32)).astype(np.int64), return_index=True)
        for i, part in zip(own, np.split(pairs.astype(np.uint32), first[1:]), strict=True):
            found[i].append(part)
    return [np.empty(0, np.uint32) if not f else f[0] if len(f) == 1 else np.unique(np.concatenate(f)) for f in found]


def train(rows: list[np.ndarray], labels: list[int], alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0,
          l2: float = 0.1, updates: int = 15_000, seed: int = 7) -> ToxicityModel:
    """FTRL-proximal in a fixed shuffled order over the features of each text (``text_features``), one update per text:
    three epochs, or more until ``updates``."""
    if not rows:
        return ToxicityModel(np.empty(0, np.uint32), np.empty(0, np.float32), 0.0)
    # a feature of a single text says nothing about other texts; counts stop at two, by the low bits
    slot = np.uint32((1 << 25) - 1)
    often = np.zeros(1 << 25, np.uint8)
    for f in rows:
        at = np.unique(f & slot)
        often[at] = np.minimum(often[at] + 1, 2)
    rows = [f[often[f & slot] > 1] for f in rows]
    del often
    known = np.unique(np.concatenate(rows))
    rows = [np.searchsorted(known, f).astype(np.int32) for f in rows]
    z, n = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    lam = np.full(len(known) + 1, l1)
    lam[-1] = 0.0  # the last coordinate is the bias

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= lam[i], 0.0, -(zi - np.sign(zi) * lam[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(max(3, min(20, updates // len(rows)))):
        for k in order.permutation(len(rows)):
            i = np.append(rows[k], len(known))
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - (labels[k] > 0)
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(len(known) + 1))
    keep = np.flatnonzero(w[:-1])
    return ToxicityModel(known[keep], w[keep].astype(np.float32), float(w[-1]))


def sample_features(docs: DataFrame, labels: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """``toxic`` and ``f`` (distinct features, four bytes each) of the training sample.

    Features are taken out of the texts by many tasks. Texts count in the order of their ids' hashes; one that brings
    the sum above ``max_features`` is left out, and so are those after it, but a text of more than a hundredth of them
    does not count at all.
    """

    @F.pandas_udf("binary")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([f.tobytes() for f in text_features(list(texts))])

    small_batches(docs.sparkSession)
    found = training_sample(docs, labels).select("doc_id", "toxic", extract.asNondeterministic()("text").alias("f"))
    found = cut(found.withColumn("n", F.length("f") / 4).filter(F.col("n") <= max_features / 100))
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    # ids and numbers of a bounded sample in one task
    ids = found.select("doc_id", F.sum("n").over(order).alias("upto")).filter(F.col("upto") <= max_features)
    return found.join(F.broadcast(ids.select("doc_id")), "doc_id").select("doc_id", "toxic", "f")


def fit(docs: DataFrame, labels: DataFrame, max_features: int = MAX_FEATURES, **options) -> ToxicityModel:
    """Train on the bounded sample, in one task; rows are ordered by id so that reruns agree."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        m = train([np.frombuffer(f.as_buffer(), np.uint32) for f in rows["f"]], rows["toxic"].to_pylist(), **options)
        return pa.table({"features": [m.features.tobytes()], "weights": [m.weights.tobytes()], "bias": [m.bias]})

    sample = sample_features(docs, labels, max_features)
    found = sample.groupBy().applyInArrow(run, "features binary, weights binary, bias double").collect()
    if not found:
        return train([], [])
    return ToxicityModel(np.frombuffer(found[0].features, np.uint32), np.frombuffer(found[0].weights, np.float32), found[0].bias)


def score_texts(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    """Scores of the texts; a bitmap of the features' low bits lets most features pass without a search."""
    low = np.uint32((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)
    maybe[model.features & low] = True
    hits = [np.empty(0, np.uint64)]
    for doc, f in features(texts):
        at = np.flatnonzero(maybe[f & low])
        hits.append(np.unique(doc[at].astype(np.uint64) << np.uint64(32) | f[at]))
    pairs = np.unique(np.concatenate(hits))
    total = np.full(len(texts), model.bias)
    if len(pairs) and len(model.features):
        f = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = np.minimum(np.searchsorted(model.features, f), len(model.features) - 1)
        own = model.features[at] == f
        doc = (pairs[own] >> np.uint64(32)).astype(np.int64)
        total += np.bincount(doc, model.weights[at[own]].astype(np.float64), minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def scorer(docs: DataFrame, model: ToxicityModel):
    """A column function text -> score with the model's weights broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = ToxicityModel(*shared.value)
        for texts in batches:
            yield pd.Series(score_texts(model, list(texts)), dtype="float64")

    return score


def score_documents(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """Score every row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Learns from ``labels`` (``doc_id``, ``toxic``) outside fold 0 unless a model
    is given. Defined cases: null and empty texts get the score of the bias
    alone; a row with a null id is scored and counts as held out; several labels
    of one id count as toxic if one does; rows repeated in ``docs`` are each
    scored; without any label every score is 0.5; a text of
    any length is read whole, in slices; an empty table gives an empty result; further columns are ignored.
    """
    model = model or fit(docs, labels)
    score = scorer(docs, model)
    return docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """The rows of ``docs``, in their own columns, whose score is below 0.5. Null and empty texts stay as long as the
    bias alone is below 0.5; without any label all rows score 0.5, so none is judged and all stay."""
    model = model or fit(docs, labels)
    if not len(model.features) and model.bias == 0:
        return docs
    return docs.withColumn("__toxicity", scorer(docs, model)("text")).filter("__toxicity < 0.5").drop("__toxicity")
