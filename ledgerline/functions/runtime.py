"""Cutting lineage and joining on skewed keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only in local mode where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerline-ckpt-"))


#: Rows of an Arrow batch, where the session has Spark's own default: texts can be long, and each batch is held several times.
BATCH_ROWS, BATCH_SETTING = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of the session's Arrow batches to BATCH_ROWS, unless the user has set a number."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    What is stored survives a lost executor, and columns such as
    ``monotonically_increasing_id`` keep their values in every later use.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and go on from there.

    As ``cut``, but the rows are computed once (a checkpoint computes its last stage twice), later steps read only the columns
    that they use, and Spark knows the table's size when it picks a join. The tables go when the application ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/steps"
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)  # a folder that is there, and once however often it is named
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot when it holds more than HOT_ROWS rows and more than one row in HOT_SHARE; at most HOT_SHARE keys can be.
HOT_ROWS, HOT_SHARE = 100_000, 1000


def join_unique(left: DataFrame, right: DataFrame, on: list[str], count_col: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per key.

    ``right[count_col]`` is the number of left rows with that key. Hot keys, at
    most ``HOT_SHARE`` of them, are broadcast and their left rows are not
    shuffled; all other keys are joined by shuffle, where no key can be large.
    Both inputs may be read more than once, so pass stored tables.
    """
    seen = right.agg(F.sum(count_col).alias("total"), F.max(count_col).alias("most")).first()
    bound = max(HOT_ROWS, (seen.total or 0) // HOT_SHARE)
    if (seen.most or 0) <= bound:
        return left.join(right, on)
    hot = F.col(count_col) > bound
    marked = left.join(F.broadcast(right.filter(hot).withColumn("__hot", F.lit(True))), on, "left")
    names = list(dict.fromkeys([*left.columns, *right.columns]))
    of_hot = marked.filter("__hot").select(names)
    of_rest = marked.filter("__hot is null").select(left.columns).join(right.filter(~hot), on).select(names)
    return of_hot.unionByName(of_rest)


def rank_within(df: DataFrame, keys: list[str], order: str, name: str, most: int | None = None) -> DataFrame:
    """Add the place (from 1) of each row among those of its key by ``order``, which is unique in a key.

    ``most`` is the number of rows of the largest key; it is counted if not given. Up to HOT_ROWS, keys are ranked by a
    window. Where a key has more, rows are dealt to ranges of key and order, and ranked by the sizes of the ranges before theirs.
    """
    if most is None:
        df = cut(df)
        most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= HOT_ROWS:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    dealt = cut(df.repartitionByRange(*keys, order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*keys, "__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    turn = F.row_number().over(W.partitionBy(*keys, "__range").orderBy(order))
    ranked = dealt.withColumn(name, turn).join(before, [*keys, "__range"])
    return ranked.withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")
