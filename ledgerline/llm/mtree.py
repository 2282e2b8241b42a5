"""Exact top-k inner products by best-first search of M-trees.

An M-tree needs a metric. Vectors get one more coordinate that makes all their
norms equal (to the largest norm); queries get a zero there. Then a smaller
Euclidean distance is a larger inner product, and the nearest neighbours of the
metric are the answers.

The table is dealt to pages: each vector goes to the nearest of a fixed number
of pivots, and a pivot with many vectors is split into several pages, so that a
page has a bounded number of vectors. Every page holds a small tree: nodes with
a routing vector, a covering radius and the distance to the parent's routing
vector. A search takes nodes in the order of their lower bounds; with the
stored distances the triangle inequality rules nodes out before their distance
is computed. Queries first search their own page, and carry the score that they
have to beat. They are then sent to the pages that their balls do not rule out:
what is moved is a query's vector for each such page, and a page's tree once for
each TILE of queries.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.runtime import cut

K = 5
QUERY_STEP = 50
SCALE = 256
#: Pivots at most, vectors of a page at most (about), vectors of a leaf, children of a node.
PIVOTS, PAGE, LEAF, FANOUT = 16, 4096, 1024, 4
#: Queries that meet a page at a time (about).
TILE = 4096
#: Bounds of pages are broadcast up to so many bytes; beyond it they are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Products are exact in doubles up to this squared norm, in 64-bit integers up to the next, beyond it in Python's whole numbers.
EXACT_NORM, LARGEST_NORM = 1 << 53, 1 << 62
#: Scores and scaled components that 64 bits do not hold count as the nearest number that they do (LARGEST is the greatest such double).
LEAST, MOST = -(1 << 63), (1 << 63) - 1
LARGEST = float((1 << 63) - 1024)


def quantized(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``v`` (floor(256 x) of each component), ``dim`` and ``norm`` (squared, as a double).

    Rows with null or non-finite components are left out; all others take part, whatever the size of their components.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fits = lambda x: F.greatest(F.least(x.cast("double") * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
    whole = vectors.filter(F.col("embedding").isNotNull() & ~bad & F.col("vec_id").isNotNull())
    rows = whole.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(fits(x)).cast("long")).alias("v"),
    )
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.withColumns({"dim": F.size("v"), "norm": square})


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column])


def _lift(m: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that brings their squared norms to ``top``."""
    f = m.astype(np.float64)
    return np.concatenate([f, np.sqrt(np.maximum(top - (f * f).sum(1), 0))[:, None]], axis=1)


def build_tree(ids: np.ndarray, m: np.ndarray, top: float) -> dict:
    """An M-tree over one page, bulk loaded: nodes in one list, the root first.

    A node is (routing vector, covering radius, distance to the parent's routing vector, children)
    or, as a leaf, rows in place of children, with each row's distance to the routing vector.
    """
    order = np.argsort(ids, kind="stable")
    # products of whole numbers are exact in doubles as long as they stay below 2**53
    ids, m = ids[order], m[order].astype(np.float64 if top <= EXACT_NORM else np.int64 if top <= LARGEST_NORM else object)
    lifted = _lift(m, top)
    nodes: list = []

    def grow(rows: np.ndarray, parent) -> int:
        centre = lifted[rows].mean(0)
        to_centre = np.sqrt(((lifted[rows] - centre) ** 2).sum(1))
        up = 0.0 if parent is None else float(np.sqrt(((centre - parent) ** 2).sum()))
        at = len(nodes)
        nodes.append(None)
        radius = float(to_centre.max())
        if len(rows) <= LEAF or radius == 0.0:
            by = np.argsort(to_centre, kind="stable")
            nodes[at] = (centre, radius, up, None, (rows[by], to_centre[by]))
            return at
        # children gather round rows far from each other
        seeds = [rows[int(to_centre.argmax())]]
        near = np.sqrt(((lifted[rows] - lifted[seeds[0]]) ** 2).sum(1))
        which = np.zeros(len(rows), np.int64)
        while len(seeds) < FANOUT and near.max() > 0:
            seeds.append(rows[int(near.argmax())])
            d = np.sqrt(((lifted[rows] - lifted[seeds[-1]]) ** 2).sum(1))
            which = np.where(d < near, len(seeds) - 1, which)
            near = np.minimum(near, d)
        kids = [grow(rows[which == s], centre) for s in range(len(seeds)) if (which == s).any()]
        nodes[at] = (centre, radius, up, kids, None)
        return at

    grow(np.arange(len(ids)), None)
    return {"ids": ids, "m": m, "nodes": nodes, "top": top}


def search_tree(tree: dict, own: int, q: np.ndarray, k: int, floor: int | None = None) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, vec_id) of a page for one query, scores from ``floor`` up, and the distances computed."""
    nodes, ids, m = tree["nodes"], tree["ids"], tree["m"]
    q = q.astype(m.dtype)
    lq = np.append(q.astype(np.float64), 0.0)
    norm = float(lq @ lq) + tree["top"]
    slack = 1e-6 * (1 + norm) ** 0.5

    def reach(score) -> float:
        """Distance within which scores of at least ``score`` lie."""
        return float(np.sqrt(max(norm - 2.0 * score, 0.0))) + slack

    best: list[tuple[int, int]] = []  # heap of (score, -vec_id)
    limit = np.inf if floor is None else reach(floor)
    root = nodes[0]
    d = float(np.sqrt(((lq - root[0]) ** 2).sum()))
    computed, queue = 1, [(max(d - root[1], 0.0), 0, d)]
    while queue:
        low, at, d = heapq.heappop(queue)
        if low > limit:
            break
        _, _, _, kids, leaf = nodes[at]
        if kids is not None:
            for c in kids:
                centre, radius, up, _, _ = nodes[c]
                if abs(d - up) - radius > limit:  # ruled out by stored distances alone
                    continue
                dc = float(np.sqrt(((lq - centre) ** 2).sum()))
                computed += 1
                if dc - radius <= limit:
                    heapq.heappush(queue, (max(dc - radius, 0.0), c, dc))
            continue
        rows, to_centre = leaf
        rows = rows[np.searchsorted(to_centre, d - limit) : np.searchsorted(to_centre, d + limit, side="right")]
        if not len(rows):
            continue
        computed += len(rows)
        scores = m[rows] @ q
        if scores.dtype == object:
            scores = np.array([min(max(s, LEAST), MOST) for s in scores], np.int64)
        others = ids[rows] != own
        if not others.all():
            rows, scores = rows[others], scores[others]
        least = -np.inf if floor is None else floor
        if len(best) == k:
            least = max(least, best[0][0])
        elif len(scores) > 2 * k:  # its own best can be held against the rest
            least = max(least, np.partition(scores, -k)[-k])
        good = np.flatnonzero(scores >= least)
        for s, i in zip(scores[good].astype(np.int64).tolist(), ids[rows[good]].tolist(), strict=True):
            if len(best) < k:
                heapq.heappush(best, (s, -i))
            elif (s, -i) > best[0]:
                heapq.heapreplace(best, (s, -i))
        if len(best) == k:
            limit = min(limit, reach(best[0][0]))
    return [(s, -i) for s, i in best], computed


def _pages(vectors: DataFrame, pivots: int, page: int) -> DataFrame:
    """``page`` (a number) and ``pivot`` of each row of the stored ``vectors``; a page holds vectors of one length.

    Rows of a pivot are dealt to its pages by their own numbers, so that rows of one id or one vector spread as well.
    """
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots)
    centres = [np.asarray(v, np.float64) for v in chosen.toPandas()["v"]]  # at most ``pivots`` rows
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        length = v.map(len).to_numpy()
        for n in np.unique(length):
            own = [(k, c) for k, c in enumerate(shared.value) if len(c) == n]
            if own:
                c, x = np.stack([c for _, c in own]), _matrix(v[length == n]).astype(np.float64)
                near = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)
                out[length == n] = np.array([k for k, _ in own])[near]
        return pd.Series(out)

    placed = cut(vectors.withColumn("pivot", nearest("v")).withColumn("row", F.monotonically_increasing_id()))
    sizes = placed.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / page).alias("split"))  # at most ``pivots`` rows a length
    split = placed.join(sizes, ["dim", "pivot"])
    return split.withColumn("page", F.xxhash64("dim", "pivot", F.pmod(F.xxhash64("row"), F.col("split")))).drop("row")


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, pivots: int = PIVOTS, page: int = PAGE) -> DataFrame:
    """For each query (``vec_id`` divisible by ``query_step``) the k rows of highest inner product.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties go to the
    smaller vec_id; a query is no candidate of its own. Defined cases: vectors
    (or ids) that are null, or hold null or non-finite components, take no part; scaled components and
    scores beyond 64 bits are given and ranked as the nearest 64-bit number;
    with fewer candidates all are returned; rows that share a vec_id are each a
    candidate; of queries that share a vec_id the answers share the k ranks, so a
    row that answers several of them has as many, as in the SQL; a query meets vectors of its own length only; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ready = cut(quantized(vectors))
    schema = "query_id long, rank int, vec_id long, score long"
    if ready.isEmpty():
        return spark.createDataFrame([], schema)
    top = float(ready.agg(F.max("norm")).first()[0])
    placed = cut(_pages(ready, pivots, page))
    queries = placed.filter(F.col("vec_id") % query_step == 0)

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"]), top)
        centre, radius = tree["nodes"][0][:2]
        return pd.DataFrame({"page": [rows["page"].iloc[0]], "dim": [rows["dim"].iloc[0]], "centre": [centre.tolist()], "radius": [radius], "tree": [pickle.dumps(tree, 5)]})

    trees = cut(placed.groupBy("page").applyInPandas(index, "page long, dim int, centre array<double>, radius double, tree binary"))

    def search(batches):
        for rows in batches:
            out = []
            for tree, packed in zip(rows["tree"], rows["queries"], strict=True):
                t = pickle.loads(tree)
                for own, q, floor in pickle.loads(packed):
                    got, computed = search_tree(t, own, q, k, floor)
                    out += [(own, i, s, computed) for s, i in got]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score", "computed"]).astype("int64")

    def meet(sent: DataFrame, tiles: int) -> DataFrame:
        """Answers of the pages that queries (``vec_id``, ``v``, ``floor``, ``page``) are sent to; a page meets about TILE queries in one task."""

        def gather(rows: pd.DataFrame) -> pd.DataFrame:
            packed = [(int(i), np.asarray(v, np.int64), None if pd.isna(f) else int(f)) for i, v, f in zip(rows["vec_id"], rows["v"], rows["floor"], strict=True)]
            return pd.DataFrame({"page": [rows["page"].iloc[0]], "tile": [rows["tile"].iloc[0]], "queries": [pickle.dumps(packed, 5)]})

        dealt = sent.withColumn("tile", F.pmod(F.xxhash64("vec_id", "v"), F.lit(tiles)).cast("int"))
        groups = dealt.groupBy("page", "tile").applyInPandas(gather, "page long, tile int, queries binary")
        met = groups.join(trees.select("page", "tree"), "page").select("queries", "tree")
        return met.mapInPandas(search, "query_id long, vec_id long, score long, computed long")

    n_queries = queries.count()
    # first the own page, for a score to beat
    first = meet(queries.select("vec_id", "v", F.lit(None).cast("long").alias("floor"), "page"), max(1, n_queries // TILE))
    floors = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    ready_queries = cut(queries.join(floors, queries.vec_id == floors.query_id, "left").select("vec_id", "v", "dim", "norm", F.col("low").alias("floor")))
    bounds = trees.select("page", "dim", "centre", "radius")
    if (bounds.agg(F.sum(F.size("centre") * 8 + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        bounds = F.broadcast(bounds)
    # of a page all products with a query stay below the bound that its ball gives
    apart = F.sqrt(F.aggregate(F.zip_with(F.concat("v", F.array(F.lit(0).cast("long"))), "centre", lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x))
    reach = F.sqrt(F.greatest(F.col("norm") + F.lit(top) - 2.0 * F.col("floor"), F.lit(0.0))) + 1e-6 * F.sqrt(1.0 + F.col("norm") + F.lit(top))
    sent = ready_queries.join(bounds, "dim").filter(F.col("floor").isNull() | (apart - F.col("radius") <= reach))
    found = meet(sent.select("vec_id", "v", "floor", "page"), max(1, n_queries // TILE)).select("query_id", "vec_id", "score")
    # each page gives k rows for a query at most; the page results are merged in two steps of bounded groups
    ranked = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(
        F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("vec_id")).alias("neg"))), asc=False), 1, k).alias("best")
    )
    final = ranked.groupBy("query_id").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best")
    )
    return final.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), (-F.col("b.neg")).alias("vec_id"), F.col("b.score").alias("score")
    )


SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM pairs
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 5
"""
