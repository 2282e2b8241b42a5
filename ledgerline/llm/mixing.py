"""Mixing sources to target weights by exponential-key (Efraimidis-Spirakis) sampling.

A document's key is ``-ln(u) / w`` with ``u`` a fixed hash of its id and ``w`` its
quality; the smallest keys of a source are a weighted sample without
replacement. A source whose target is several times its size is first taken
whole that many times (complete epochs); what is left of the target is filled in
the order of the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.runtime import cut, join_unique

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that prose hardly holds; their share lowers a document's quality weight.
JUNK = "#$%&*|<>{}[]^~_=+@"
MIN_QUALITY = 0.05
#: A document is taken at most so many times.
MAX_REPEATS = 3
#: Keys are ranked within ranges of about so many rows.
ROWS_PER_RANGE = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Share of characters that are no junk, at least MIN_QUALITY; 1 for empty texts."""
    n = F.length(text)
    share = F.length(F.translate(text, JUNK, "")) / n
    return F.when(n > 0, F.greatest(share, F.lit(MIN_QUALITY))).otherwise(F.lit(1.0))


def sampling_key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _targets(sizes: DataFrame) -> DataFrame:
    """Targets of the sources (``skey``, ``source``, ``source_size``): shares by weight, held to MAX_REPEATS sizes.

    The table has one row per source. Sorted by cap over weight, the sources held to their
    caps come first, so that one pass of prefix sums finds all that hold.
    """
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    dec = lambda c: c.cast("decimal(38,0)")
    ranked = sizes.withColumn(
        "w", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1
    ).withColumn("cap", F.col("source_size") * MAX_REPEATS)
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("skey")).rowsBetween(W.unboundedPreceding, -1)
    seen = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("all_w", F.sum("w").over(whole))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
    )
    held = dec(F.col("w")) * dec(F.col("total") - F.col("caps_before")) >= dec(F.col("cap")) * dec(
        F.col("all_w") - F.col("w_before")
    )
    free = seen.withColumn("held", held)
    rest = F.col("total") - F.sum(F.when(F.col("held"), F.col("cap")).otherwise(F.lit(0))).over(whole)
    weights = F.sum(F.when(F.col("held"), F.lit(0)).otherwise(F.col("w"))).over(whole)
    share = (F.col("w") * rest).cast("double") / weights.cast("double")
    return free.withColumn("target", F.when(F.col("held"), F.col("cap").cast("double")).otherwise(share)).select(
        "skey", "source_size", "target", "held", "n_docs"
    )


def mixing_plan(base: DataFrame) -> DataFrame:
    """For each source: target, complete epochs and the key up to which documents are taken once more.

    ``base`` is a stored table with ``skey``, ``source``, ``size`` and ``key``.
    Sources are cut into ranges of the key, so that a source that holds most
    rows is still sorted and summed by many tasks; offsets of the ranges turn
    the sums within ranges into prefix sums of the source.
    """
    rows = base.count()
    scale = max(16, rows // ROWS_PER_RANGE)
    ranged = base.withColumn("range", F.least(F.floor(F.col("key") * scale), F.lit(16 * scale)).cast("int"))
    keys = cut(
        ranged.groupBy("skey", "range", "key").agg(
            F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.first("source").alias("source")
        )
    )
    ranges = keys.groupBy("skey", "range").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.first("source").alias("source")
    )
    sizes = ranges.groupBy("skey").agg(
        F.first("source").alias("source"), F.sum("s").alias("source_size"), F.sum("n").alias("n_docs")
    )
    targets = cut(_targets(sizes))
    size, target = F.col("source_size"), F.col("target")
    epochs = F.when(F.col("held"), F.lit(MAX_REPEATS)).when(size > 0, F.floor(target / size)).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.when(F.col("held"), F.lit(0.0)).otherwise(target - F.col("epochs") * size)
    )
    up_to = W.partitionBy("skey").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("s").over(up_to), F.lit(0))).select("skey", "range", "offset")
    offsets = offsets.join(targets.select("skey", "rest"), "skey")
    within = W.partitionBy("skey", "range").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    prefix = (
        keys.withColumn("inside", F.coalesce(F.sum("s").over(within), F.lit(0)))
        .join(offsets, ["skey", "range"])
        .filter(F.col("rest") > 0)
        .filter(F.col("offset") + F.col("inside") + F.col("s") / 2 <= F.col("rest"))
    )
    cutoff = prefix.groupBy("skey").agg(F.max("key").alias("cutoff"))
    return targets.join(cutoff, "skey", "left").select(
        "skey", "source_size", "target", "epochs", "cutoff", "n_docs"
    )


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    text = F.col(text_col)
    return [
        source_key(F.col(source_col)).alias("skey"),
        word_count(text).alias("size"),
        sampling_key(F.col(id_col), quality(text), seed).alias("key"),
    ]


def _repeats() -> Column:
    return F.col("epochs") + F.coalesce((F.col("key") <= F.col("cutoff")).cast("long"), F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = "mix") -> DataFrame:
    """Decide how often each document enters the mix.

    Returns one row per input row: ``doc_id``, ``size`` (words), ``source_size``,
    ``target`` (of its source), ``taken`` (words taken, repeats counted) and
    ``repeats`` (times the document is taken, 0 to 3). Reruns agree, since keys
    depend on the ids alone. Defined cases: null and empty texts have size 0 and
    add nothing; a null source is a source of its own, ordered last; rows with
    the same id share a key and, within a source, are taken or left together; an
    empty table gives an empty result; other columns are ignored.
    """
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            *_keyed(docs, id_col, text_col, source_col, seed),
        )
    )
    plan = cut(mixing_plan(base))
    joined = join_unique(base, plan, ["skey"], "n_docs")
    return joined.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _repeats()).alias("taken"), _repeats().alias("repeats")
    )


#: Plans of up to so many sources are broadcast to the documents.
BROADCAST_SOURCES = 100_000


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, in their own columns, each as often as ``mix`` takes it.

    What a source takes comes down to its epochs and one key, so documents meet a table with one row
    per source and are not shuffled; a table too large to broadcast is joined on its key.
    """
    keys = _keyed(docs, id_col, text_col, source_col, seed)
    plan = cut(mixing_plan(cut(docs.select(F.col(source_col).alias("source"), *keys))))
    small = plan.select("skey", "epochs", "cutoff")
    if plan.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    held = F.struct(*[F.col(c) for c in docs.columns]).alias("__doc")
    met = docs.select(held, keys[0], keys[2]).join(small, "skey")
    return met.select("__doc", F.explode(F.array_repeat(F.lit(1), _repeats().cast("int")))).select("__doc.*")


SQL = """
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE)
         / CASE WHEN length(text) > 0
                THEN greatest(length(translate(text, '#$%&*|<>{}[]^~_=+@', ''))::DOUBLE / length(text), 0.05::DOUBLE)
                ELSE 1.0::DOUBLE END AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::HUGEINT AS s FROM base GROUP BY source),
ranked AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w FROM sizes),
seen AS (
  SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(3 * s) OVER b, 0) AS caps_before, coalesce(sum(w) OVER b, 0) AS w_before
  FROM ranked
  WINDOW b AS (ORDER BY (3 * s)::DOUBLE / w::DOUBLE, coalesce('s' || source, 'null') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT *, w * (total - caps_before) >= 3 * s * (all_w - w_before) AS held FROM seen),
shared AS (
  SELECT source, s, held,
         CASE WHEN held THEN (3 * s)::DOUBLE
              ELSE (w * (total - sum(CASE WHEN held THEN 3 * s ELSE 0 END) OVER ()))::DOUBLE
                   / (sum(CASE WHEN held THEN 0 ELSE w END) OVER ())::DOUBLE END AS target
  FROM held),
targets AS (
  SELECT *, CASE WHEN held THEN 3 WHEN s > 0 THEN floor(target / s::DOUBLE) ELSE 0 END::BIGINT AS epochs FROM shared),
summed AS (
  SELECT b.*, t.s, t.target, t.epochs, CASE WHEN t.held THEN 0 ELSE t.target - t.epochs * t.s::DOUBLE END AS rest,
         sum(size) OVER (PARTITION BY b.source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY b.source, key) AS own
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, s::BIGINT AS source_size, target,
       (size * (epochs + CASE WHEN rest > 0 AND upto - own + own::DOUBLE / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken,
       (epochs + CASE WHEN rest > 0 AND upto - own + own::DOUBLE / 2 <= rest THEN 1 ELSE 0 END)::BIGINT AS repeats
FROM summed
"""
