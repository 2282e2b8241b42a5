"""Corpus pipeline: from raw documents to tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.runtime import ensure_checkpoint_dir
from ledgerline.llm import bpe, exact_dedup, mixing, near_dedup, toxicity

#: Stages take word shingles from a similarity of 0.8 (op2 has its own 85 per cent); 30 bands of 5 miss 7e-6 of pairs there.
NEAR_PERCENT, NEAR_BANDS = 80, 30


def _key(docs: DataFrame):
    """A row's id and text in one string, so that rows that share an id are told apart."""
    return F.concat_ws(":", F.coalesce(docs.doc_id.cast("string"), F.lit("null")), F.sha2(F.coalesce(docs.text, F.lit("")), 256))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts are judged like any other and stay unless the bias rejects;
    repeated rows share their fate; without labels nothing is judged and all stay; an empty table stays empty."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays; of rows repeated with one id and text, one. Null counts as
    empty; of a group of null ids one stays; an empty table stays empty."""
    kept = exact_dedup.exact_dedup(docs).filter("kept")
    keys = kept.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256").alias("__key"))
    keyed = docs.withColumn("__key", _key(docs))
    return keyed.join(keys, "__key", "left_semi").dropDuplicates(["__key"]).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word shingles alike by 80 per cent) stays: the one with the smallest id.
    Null, empty and blank texts have no shingles and stay; a text of fewer than five words is one shingle; rows that share
    an id are told apart by their texts; an empty table stays empty."""
    gone = near_dedup.near_dedup(docs, NEAR_PERCENT, [_key(docs).alias("__key")], NEAR_BANDS).filter("not kept").select("__key")
    return docs.withColumn("__key", _key(docs)).join(gone, "__key", "left_anti").drop("__key")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it leaves out go. Null and empty texts add
    nothing to a target and follow the key of their id; a null source is one of its own; an empty table stays empty."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text for each row of the mix. A null text counts
    as empty and has no tokens; a row that the mix repeats is listed as often; an empty table gives an empty result."""
    return bpe.digest_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity model and MinHash have no SQL form; the run is tested against a plain version.
ORACLE_SQL = None
