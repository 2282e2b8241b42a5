"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct five-word shingles. Circulant MinHash
needs two permutations: the first (``sigma``) scatters the shingles over D
places, the second (``pi``), shifted by k places, gives coordinate k of the
signature. Shifted values lie side by side in memory, so a shingle's values for
all coordinates are one contiguous read. Bands of the signature propose pairs;
every link is confirmed on the full shingle sets.

Pairs within a bucket are never listed. Members are compared with a few centres
of their buckets, and links are merged to components. Only buckets that then
still hold several components are compared in full, block by block within tasks,
and give no more links than join their components.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.runtime import HOT_ROWS, cut, join_unique, small_batches
from ledgerline.llm.words import MIX, SPACED, finish, slice_words, slices

SHINGLE = 5
#: A link needs 100 * |intersection| >= PERCENT * |union|.
PERCENT = 85
BANDS, ROWS = 20, 5
#: Places of the permutations, a power of two.
PLACES = 1 << 20
#: Centres that a bucket names.
CENTRES = 4
#: Members and shingles of a block at most (about), and shingles counted at a time.
BLOCK, WEIGHT, TOKENS = 512, 1_000_000, 4096
#: Ids are broadcast up to so many rows; beyond it they are joined by shuffle.
BROADCAST_ROWS = 500_000
#: A centre is copied for each so many members that it is compared with.
PAIRS = 2_000


def shingle_sets_of(texts: Sequence[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; words in lower-case ASCII, split at ASCII white space."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    shorts: dict[int, np.ndarray] = {}
    for at, parts in slices(texts, SPACED, size - 1):
        words, part, _ = slice_words(parts)
        n = max(len(words) - size + 1, 0)
        grams = np.zeros(n, np.uint64)
        for k in range(size):
            grams = grams * MIX[0] + finish(words[k : k + n] + MIX[k])
        grams = finish(grams)
        first = np.searchsorted(part, np.arange(len(parts) + 1))
        for p, i in enumerate(at):
            a, b = first[p], first[p + 1]
            if b - a >= size:
                found[i].append(grams[a : b - size + 1])
            elif b > a:  # a short text is one shingle; a longer one has a part with shingles
                short = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    short = finish(short * MIX[1] + w)
                shorts[i] = short
    return [np.unique(np.concatenate(f)) if f else shorts.get(i, np.empty(0, np.uint64)) for i, f in enumerate(found)]


@lru_cache(1)
def _pi(places: int, coords: int) -> np.ndarray:
    """All windows of ``coords`` neighbours in the second permutation, taken round."""
    pi = np.random.default_rng(20).permutation(places).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coords]]), coords)


def signature(sh: np.ndarray, coords: int = BANDS * ROWS, places: int = PLACES) -> np.ndarray:
    """Circulant MinHash of a non-empty shingle set; ``sigma`` is an affine permutation of the places."""
    sigma = (sh * np.uint64(0x2545F4914F6CDD1D) + np.uint64(0x632BE5AB)) & np.uint64(places - 1)
    windows, out = _pi(places, coords), None
    for o in range(0, len(sigma), 4096):
        low = windows[sigma[o : o + 4096].astype(np.int64)].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def band_keys(sigs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket key for each band of each signature."""
    cells = sigs.reshape(-1, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * MIX[1], cells.shape[:2])
    for k in range(rows):
        key = finish(key * MIX[0] + cells[:, :, k] + MIX[2])
    return key.view(np.int64)


def _fingerprint(sh: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(sh.tobytes())


def sketch(docs: DataFrame, carry: Sequence[Column] = (), bands: int = BANDS) -> DataFrame:
    """``doc_id``, ``carry``, ``n_shingles``, ``print`` (128-bit hash of the set, null if empty) and ``bands``."""

    @F.pandas_udf("n_shingles long, print binary, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = shingle_sets_of(texts)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(np.stack([signature(s, bands * ROWS) for s in full]), bands)) if full else iter(())
            yield pd.DataFrame(
                {
                    "n_shingles": [len(s) for s in sets],
                    "print": [_fingerprint(s) if len(s) else None for s in sets],
                    "bands": [next(keys) if len(s) else None for s in sets],
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, run("text").alias("__s"))
    return rows.select(*rows.columns[:-1], "__s.*")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``print`` and ``shingles`` (sorted) of each non-empty document."""

    @F.pandas_udf("print binary, shingles array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = shingle_sets_of(texts)
            yield pd.DataFrame(
                {"print": [_fingerprint(s) if len(s) else None for s in sets], "shingles": [s.view(np.int64) for s in sets]}
            )

    # not marked deterministic, or a filter on its result would be moved before a join and run it on all rows
    return docs.select(run.asNondeterministic()("text").alias("s")).select("s.*").filter("print is not null")


def components(edges: DataFrame, n_edges: int) -> DataFrame:
    """Smallest node of each connected component: ``node``, ``label`` for the nodes of ``edges`` (``a``, ``b``).

    Each round every node takes the smallest label among itself and its
    neighbours, and then the label of that label. Rounds are stored. ``n_edges``
    tells whether a node can have so many edges or followers that joins must
    treat it apart.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.first("a"), F.min("b")).alias("label"), F.count(F.lit(1)).alias("degree")
    )
    many = n_edges * 2 > HOT_ROWS
    labels = cut(labels)
    while True:
        named = labels.withColumnRenamed("node", "b")
        near = join_unique(both, named, ["b"], "degree") if many else both.join(named, "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", "degree", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        if many:
            hooked = cut(hooked)
            up = cut(up.join(hooked.groupBy("low").agg(F.count(F.lit(1)).alias("followers")), "low"))
            met = join_unique(hooked, up, ["low"], "followers")
        else:
            met = hooked.join(up, "low")
        moved = cut(met.select("node", "label", "degree", F.least("low", "up").alias("new")))
        changed = not moved.filter("new < label").isEmpty()
        labels = moved.select("node", F.col("new").alias("label"), "degree")
        if not changed:
            return labels.select("node", "label")


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingle sets of the classes in ``wanted`` (``node``), read again from one document of each."""
    chosen = cut(classes.join(wanted, "node", "left_semi").select("node", "print", "rep"))
    ids = chosen.select(F.col("rep").alias("doc_id"))
    if chosen.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("d").join(
        ids.alias("i"), F.expr("d.doc_id <=> i.doc_id"), "left_semi"
    )
    sets = shingle_sets(picked).join(chosen, "print").select("node", "shingles")
    return cut(sets.dropDuplicates(["node"]))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (centre ``a``, member ``b``) whose full sets meet the threshold.

    A centre with many members is copied so that each copy meets about PAIRS of them.
    """
    fans = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("fan")).withColumn("copies", F.ceil(F.col("fan") / PAIRS))
    spread = pairs.join(fans, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).alias("copy"))
    hubs = sets.join(fans, F.col("node") == F.col("a")).select(
        "a", F.col("shingles").alias("sa"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    )
    members = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = spread.join(members, "b").join(hubs, ["a", "copy"])
    inter = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - inter
    return both.filter(inter * 100 >= union * percent).select("a", "b")


def block_links(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between nodes of different labels, as few as join all that links join. Every pair is counted in full."""
    size = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), size)
    token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    some = often[token] > 1  # a shingle of one set only is in no intersection
    doc, token = doc[some], np.unique(token[some], return_inverse=True)[1]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(token, kind="stable")
    doc, token = doc[order], token[order]
    for start in range(0, int(token[-1]) + 1 if len(token) else 0, TOKENS):
        at = slice(*np.searchsorted(token, [start, start + TOKENS]))
        part = np.zeros((len(sets), TOKENS), np.float32)
        part[doc[at], token[at] - start] = 1
        inter += part @ part.T
    inter = inter.astype(np.int64)
    linked = inter * 100 >= (size[:, None] + size[None, :] - inter) * percent
    linked &= (labels[:, None] != labels[None, :]) & (nodes[:, None] < nodes[None, :])
    root = {v: v for v in labels.tolist()}

    def find(v):
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    out = []
    for i, j in np.argwhere(linked).tolist():
        a, b = find(int(labels[i])), find(int(labels[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their labels, of the buckets that hold several labels; ``blocks`` tells into how many a bucket is cut."""
    named = members.drop("members").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("key").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight")
    ).filter("lo <> hi")
    mixed = cut(
        mixed.select("key", "members", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("weight") / WEIGHT)).cast("int").alias("blocks"))
    )
    return join_unique(cut(named), mixed, ["key"], "members")


def _link_mixed(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across labels in mixed buckets: each pair of blocks of a bucket is compared in one task, in memory of fixed size."""
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = mixed.select("key", "node", "label", own.alias("own"), other.alias("other"))
    dealt = dealt.select("key", "node", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        found = block_links(rows["node"].to_numpy(), rows["label"].to_numpy(), list(rows["shingles"]), percent)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return dealt.join(sets, "node").groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def link_classes(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Components of the classes (``node``, ``n_shingles``, ``bands``, ``print``, ``rep``): ``node``, ``label``.

    First every bucket names a few centres, the same in all buckets of the same
    documents, with which all its members are compared; that joins most. In
    buckets that still hold several components, all pairs across components are
    compared block by block.
    """
    entries = classes.select(
        "node", F.col("n_shingles").alias("n"), F.xxhash64("node").alias("turn"), F.explode("bands").alias("key")
    )
    shared = cut(entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    members = cut(join_unique(entries, shared, ["key"], "members"))
    alone = classes.select("node", F.col("node").alias("label"))
    if members.isEmpty():
        return alone
    sets = _sets_of(docs, classes, members.select("node").distinct())
    slot = F.pmod("turn", F.lit(CENTRES)).cast("int").alias("slot")
    best = members.groupBy("key", slot).agg(F.min(F.struct("turn", "node", "n")).alias("c"), F.max("members").alias("members"))
    hubs = cut(best.groupBy("key").agg(F.collect_list("c").alias("hubs"), F.max("members").alias("members")))
    met = join_unique(members.drop("members"), hubs, ["key"], "members").select("node", "n", F.explode("hubs").alias("h"))
    pairs = cut(
        met.filter("h.node <> node")
        .filter(F.least("n", "h.n") * 100 >= F.greatest("n", "h.n") * percent)
        .select(F.col("h.node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    edges = cut(_confirm(pairs, sets, percent))
    n_edges = edges.count()
    labels = components(edges, n_edges) if n_edges else alone
    more = cut(_link_mixed(_mixed_buckets(members, labels), sets, percent).distinct())
    n_more = more.count()
    if n_more:
        labels = components(edges.union(more), n_edges + n_more)
    elif not n_edges:
        return alone
    return classes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def near_dedup(docs: DataFrame, percent: int = PERCENT, carry: Sequence[Column] = (), bands: int = BANDS) -> DataFrame:
    """Group near-duplicate rows: ``doc_id``, ``carry``, ``n_shingles``, ``component_id``, ``kept``.

    Documents whose shingle sets agree in at least ``percent`` per cent of their
    union are linked; a component is all that links reach and its id is the
    smallest doc_id in it. Documents with the same set form one class, and only
    classes are compared. Defined cases: null texts and texts without words have
    no shingles, are linked with nothing and kept; a text of fewer than five
    words is one shingle; null ids are passed over as component ids, and a
    component of null ids only has a null id and keeps all its rows; rows
    repeated with one id are one document if their sets agree (all of them are
    kept or dropped); an empty table gives an empty result; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    rows = cut(sketch(docs, carry, bands))
    grouped = rows.filter("print is not null").groupBy("print").agg(
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
        F.min("doc_id").alias("rep"),
        F.count(F.lit(1)).alias("copies"),
    )
    classes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    labels = link_classes(docs, classes, percent)
    placed = cut(labels.join(classes.select("node", "print", "rep", "copies"), "node"))
    ids = placed.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members"))
    ids = cut(ids)
    by_print = cut(join_unique(placed, ids, ["label"], "members").select("print", "component_id", "copies"))
    own = [c for c in rows.columns if c not in ("print", "bands")]
    some = rows.filter("print is not null").select(*own, "print")
    out = join_unique(some, by_print, ["print"], "copies").select(*own, "component_id")
    none = rows.filter("print is null").select(*own, F.col("doc_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
