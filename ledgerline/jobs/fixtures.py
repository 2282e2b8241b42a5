"""Statements, ledgers and raw files derived from the given ``orders`` and ``customer`` tables.

The SQL is common to Spark and DuckDB, so that queries and their oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BASE = """
base AS (
  SELECT o_orderkey AS k, o_orderkey % 10 AS cls, cast(floor(o_orderkey / 10) AS bigint) % 2 AS odd,
         'REC_' || cast(o_custkey % 16 AS string) AS reconciliation_id, cast(o_orderdate AS date) AS d,
         cast(o_totalprice AS decimal(18,2)) AS amt, CASE WHEN o_orderstatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS type,
         'NEFT ' || c_mktsegment || ' ' || c_name AS bank_text, c_mktsegment || ' payment ' || c_name AS l1,
         'Settlement ' || c_name AS l2, 'UTR' || cast(o_orderkey AS string) AS ref
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_BANK = """
bank AS (
  SELECT 'B' || cast(k AS string) AS id, reconciliation_id, 'SRC_BANK' AS source_id, 'BANK_STATEMENT' AS source_type, d AS date,
         bank_text AS description, amt AS amount, type, CASE WHEN cls IN (4, 5) THEN NULL ELSE ref END AS reference,
         cast(k AS int) AS source_row
  FROM base
  UNION ALL
  SELECT 'D' || cast(k AS string), reconciliation_id, 'SRC_BANK', 'BANK_STATEMENT', d + 1, bank_text, amt, type, ref, cast(k AS int)
  FROM base WHERE cls = 9)"""

_LEDGER = """
ledger AS (
  SELECT 'C' || cast(k AS string) AS id, reconciliation_id, 'SRC_LEDGER' AS source_id, 'ACCOUNTING_LEDGER' AS source_type,
         CASE WHEN cls IN (3, 5) THEN d + 4 ELSE d END AS date,
         CASE WHEN cls = 4 OR (cls = 5 AND odd = 0) THEN l2 WHEN cls = 5 THEN 'Customer receipt, unallocated' ELSE l1 END AS description,
         CASE WHEN cls = 6 AND odd = 0 THEN cast(amt * 1.03 AS decimal(18,2)) WHEN cls = 6 THEN cast(amt * 1.004 AS decimal(18,2))
              ELSE amt END AS amount,
         type, CASE WHEN cls IN (4, 5) THEN NULL ELSE ref END AS reference, cast(k AS int) AS source_row
  FROM base WHERE cls NOT IN (7, 8)
  UNION ALL
  SELECT 'P' || cast(k AS string), reconciliation_id, 'SRC_LEDGER', 'ACCOUNTING_LEDGER', d, l1, cast(amt * 0.4 AS decimal(18,2)), type,
         'PA' || cast(k AS string), cast(k AS int) FROM base WHERE cls = 8
  UNION ALL
  SELECT 'Q' || cast(k AS string), reconciliation_id, 'SRC_LEDGER', 'ACCOUNTING_LEDGER', d, l1,
         cast(amt - cast(amt * 0.4 AS decimal(18,2)) AS decimal(18,2)), type, 'PB' || cast(k AS string), cast(k AS int) FROM base WHERE cls = 8
  UNION ALL
  SELECT 'X' || cast(k AS string), reconciliation_id, 'SRC_LEDGER', 'ACCOUNTING_LEDGER', d, l2, cast(amt + 7 AS decimal(18,2)), type,
         'X' || cast(k AS string), cast(k AS int) FROM base WHERE k % 97 = 0
  UNION ALL
  SELECT 'Y' || cast(k AS string), reconciliation_id, 'SRC_LEDGER', 'ACCOUNTING_LEDGER', d + 1, l1, amt, type,
         cast(NULL AS string), cast(k AS int) FROM base WHERE k % 40 = 1)"""

_RAW = """
raw AS (
  SELECT 'JOB_' || cast(o_custkey % 8 AS string) AS parse_job_id, cast(o_orderkey AS int) AS row_no,
         lpad(cast(extract(day FROM o_orderdate) AS string), 2, '0') AS dd, lpad(cast(extract(month FROM o_orderdate) AS string), 2, '0') AS mm,
         cast(extract(year FROM o_orderdate) AS string) AS yyyy, cast(cast(o_totalprice AS decimal(18,2)) AS string) AS a,
         o_orderkey % 6 AS v, o_orderkey % 7 AS w, o_orderstatus AS s, o_orderkey AS k, c_name
  FROM orders JOIN customer ON o_custkey = c_custkey),
raw_rows AS (
  SELECT parse_job_id, row_no,
         CASE v WHEN 0 THEN dd || '/' || mm || '/' || yyyy WHEN 1 THEN dd || '-' || mm || '-' || yyyy || ' 10:15:00'
                WHEN 2 THEN yyyy || '-' || mm || '-' || dd WHEN 3 THEN dd || '/' || mm || '/' || substr(yyyy, 3, 2)
                WHEN 4 THEN ' ' || yyyy || '/' || mm || '/' || dd || ' ' ELSE 'not a date' END AS raw_date,
         CASE WHEN k % 23 = 0 THEN '   ' ELSE '  pay   to  ' || c_name END AS raw_description,
         CASE WHEN w IN (0, 1) AND s = 'F' THEN a WHEN w = 6 THEN a END AS raw_debit,
         CASE WHEN w IN (0, 1) AND s <> 'F' THEN a WHEN w = 6 THEN a END AS raw_credit,
         CASE w WHEN 2 THEN '₹ ' || a || ' CR' WHEN 3 THEN '(' || a || ')' WHEN 4 THEN '-' || a WHEN 5 THEN CASE WHEN k % 2 = 0 THEN 'n/a' ELSE a END END AS raw_amount,
         CASE WHEN w = 5 AND k % 4 = 1 THEN 'Deposit' END AS raw_type,
         CASE WHEN k % 5 = 0 THEN 'N/A' WHEN k % 5 = 1 THEN cast(k AS string) || '.0' ELSE 'UTR' || cast(k AS string) END AS raw_reference,
         CASE WHEN k % 3 <> 0 THEN a END AS raw_balance
  FROM raw)"""

BOTH = f"WITH {_BASE},{_BANK},{_LEDGER}"
RAW_ROWS = f"WITH {_RAW}"


def write_folder(files: DataFrame, folder: str) -> None:
    """Write ``files`` (``name``, ``content``) as they are below a folder that driver and executors share."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as filesystems

        where = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder
        fs, top = filesystems.FileSystem.from_uri(where)
        fs.create_dir(top, recursive=True)
        for batch in batches:
            for name, content in zip(*(batch.column(c).to_pylist() for c in ("name", "content")), strict=True):
                with fs.open_output_stream(f"{top}/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, pa.schema([("n", pa.int64())]))

    files.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _views(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(
        query,
        orders=spark.read.parquet(f"{sf_dir}/orders.parquet"),
        customer=spark.read.parquet(f"{sf_dir}/customer.parquet"),
    )


def _named(query: str) -> str:
    return query.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bank = _views(spark, sf_dir, _named(f"WITH {_BASE},{_BANK}") + " SELECT * FROM bank")
    return bank, _views(spark, sf_dir, _named(f"WITH {_BASE},{_LEDGER}") + " SELECT * FROM ledger")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped raw rows as ``validate.normalize_rows`` takes them."""
    return _views(spark, sf_dir, _named(RAW_ROWS) + " SELECT * FROM raw_rows").withColumns(
        {"file_id": F.concat(F.lit("FILE_"), "parse_job_id"), "filename": F.lit("orders.csv")}
    )


#: Delimiter of a customer's file by ``c_custkey % 4``, and its header names by ``c_custkey % 3``.
FILE_DELIMITERS = (",", ";", "|", "\t")
FILE_HEADERS = (
    ("Txn Date", "Particulars", "Ref No", "Debit", "Credit", "Balance"),
    ("Date", "Narration", "Chq/Ref No", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"),
    ("Transact Date", "Narrative Details", "UTR", "Money Out Dr", "Money In Cr", "Net Bal"),
)


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delimited text for each customer: a preamble, a header row, and a line for each order."""
    o, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("o_custkey") % n + 1).cast("int"))
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    cells = F.array(
        F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.lit('"Pay, '), "c_name", F.lit('"')), F.concat(F.lit("UTR"), "o_orderkey"),
        F.when(F.col("o_orderstatus") != "F", amount).otherwise(""), F.when(F.col("o_orderstatus") == "F", amount).otherwise(""), F.lit(""),
    )
    lines = o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("sep", pick(FILE_DELIMITERS, 4)).select(
        "o_custkey", "sep", "o_orderkey", F.array_join(cells, "\x1f").alias("line")
    ).withColumn("line", F.replace("line", F.lit("\x1f"), F.col("sep")))
    files = lines.groupBy("o_custkey", "sep").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))).alias("rows"))
    heads = [F.array(*map(F.lit, h)) for h in FILE_HEADERS]
    head = F.when(F.col("o_custkey") % 3 == 0, heads[0]).when(F.col("o_custkey") % 3 == 1, heads[1]).otherwise(heads[2])
    preamble = F.concat(F.lit("Bank of Orders\nCustomer "), F.col("o_custkey").cast("string"), F.lit("\n\nStatement of account\n"))
    body = F.array_join(F.transform("rows", lambda r: r.line), "\n")
    header = F.replace(F.array_join(head, "\x1f"), F.lit("\x1f"), F.col("sep"))
    return files.select(
        F.concat(F.lit("FILE_"), F.col("o_custkey").cast("string")).alias("file_id"),
        F.concat(preamble, header, F.lit("\n"), body).alias("text"),
    )
