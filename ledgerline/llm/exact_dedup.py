"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are
sorted and numbered; then adjacent numbers are paired, the distinct pairs are
sorted and numbered again, and so on, until each document is left with a single
number. Two documents have the same (level, number) exactly when their texts are
equal: numbers stand for distinct blocks or pairs and never for hash values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.runtime import cut, join_unique


def _blocks(block_bytes: int):
    return F.expr(
        f"transform(sequence(0, greatest(int(ceil(length(__bytes) / {block_bytes}D)) - 1, 0)),"
        f" i -> substring(__bytes, i * {block_bytes} + 1, {block_bytes}))"
    )


def _route(block, seed: int):
    """A 128-bit routing key of a block; checked to be one-to-one before it is used."""
    return F.struct(F.xxhash64(F.lit(seed), block).alias("k1"), F.xxhash64(block, F.lit(seed)).alias("k2"))


def _numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number the distinct ``keys``, sorted within each partition; ``__n`` counts their rows."""
    distinct = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).sortWithinPartitions(*keys)
    return distinct.withColumn("__name", F.monotonically_increasing_id())


def _block_names(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Names of the distinct blocks by routing key, and a seed under which no two blocks share a key."""
    seed = 0
    while True:
        blocks = docs.select(F.explode(_blocks(block_bytes)).alias("__block"))
        names = cut(
            _numbered(blocks, ["__block"])
            .select("__name", "__n", _route(F.col("__block"), seed).alias("r"))
            .select("__name", "__n", "r.k1", "r.k2")
        )
        clash = names.groupBy("k1", "k2").count().filter("count > 1")
        if clash.isEmpty():
            return names, seed
        seed += 1


def name_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """Give each row of ``docs`` the identity of its text.

    Returns ``__row`` (a number of the row), ``doc_id``, ``text_sha256``,
    ``__level`` and ``__name``; equal texts, and only those, agree in the last
    two. A null text counts as empty. The text itself is shuffled once, with
    copies of a block combined before the shuffle.
    """
    raw = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__bytes"),
    )
    names, seed = _block_names(raw, block_bytes)
    rows = cut(
        raw.select(
            F.monotonically_increasing_id().alias("__row"),
            "doc_id",
            F.sha2("__bytes", 256).alias("text_sha256"),
            F.transform(_blocks(block_bytes), lambda b: _route(b, seed)).alias("__keys"),
        )
    )
    longest = rows.agg(F.coalesce(F.max(F.size("__keys")), F.lit(0))).first()[0]
    cells = rows.select("__row", F.size("__keys").alias("__cells"), F.posexplode("__keys").alias("__pos", "__k"))
    cells = cells.select("__row", "__cells", "__pos", "__k.k1", "__k.k2")
    cells = join_unique(cells, names, ["k1", "k2"], "__n").select("__row", "__cells", "__pos", "__name")
    if longest > 1:
        cells = cut(cells)
    level, done = 0, []
    while True:
        done.append(cells.filter("__cells = 1").select("__row", F.lit(level).alias("__level"), "__name"))
        if longest <= 1:
            break
        half = F.col("__pos") % 2
        pairs = cut(
            cells.filter("__cells > 1")
            .groupBy("__row", "__cells", F.floor(F.col("__pos") / 2).cast("int").alias("__pos"))
            .agg(
                F.max(F.when(half == 0, F.col("__name"))).alias("a"),
                F.coalesce(F.max(F.when(half == 1, F.col("__name"))), F.lit(-1)).alias("b"),
            )
            .withColumn("__cells", F.ceil(F.col("__cells") / 2).cast("int"))
        )
        names = cut(_numbered(pairs, ["a", "b"]))
        cells = join_unique(pairs, names, ["a", "b"], "__n").select("__row", "__cells", "__pos", "__name")
        longest = (longest + 1) // 2
        if longest > 1:
            cells = cut(cells)
        level += 1
    named = done[0]
    for part in done[1:]:
        named = named.unionByName(part)
    return rows.select("__row", "doc_id", "text_sha256").join(named, "__row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """Group the rows with identical texts and keep the one with the largest id.

    Returns one row per input row: ``doc_id``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``. Defined cases: a null text counts as empty, and
    empty texts form a group like any other; a null id is smaller than any
    other, so it stays only where the whole group has null ids (``keep_id`` is
    then null); of rows repeated with the same id and text one stays; an empty
    table gives an empty result; further columns of the input are not read.
    """
    named = cut(name_texts(docs, id_col, text_col, block_bytes))
    groups = cut(
        named.groupBy("__level", "__name").agg(
            F.max(F.struct("doc_id", "__row")).alias("__keep"), F.count(F.lit(1)).alias("group_size")
        )
    )
    out = join_unique(named, groups, ["__level", "__name"], "group_size")
    return out.select(
        "doc_id",
        F.col("__keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("__row") == F.col("__keep.__row")).alias("kept"),
        "text_sha256",
    )


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
