"""Reading statement files of any layout into one table of raw rows, and writing jobs' output."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.runtime import stored
from ledgerline.sources.store import read_parts, write_parts

#: Accepted extensions, size limit, delimiters in order of preference, header keywords.
EXTENSIONS = (".csv", ".tsv", ".xlsx", ".xls", ".pdf")
MAX_BYTES = 25 * 1024 * 1024
DELIMITERS = (",", "\t", ";", "|")
HEADER_KEYWORDS = ("date", "txn date", "transaction date", "value date", "particulars", "description", "narration", "details",
                   "debit", "credit", "withdrawal", "deposit", "amount", "balance", "ref", "utr", "chq")
DEFAULT_HEADERS = ("Date", "Description", "Debit", "Credit", "Balance")
SNIFF_LINES, CSV_HEADER_LINES, TEXT_HEADER_LINES, MIN_PDF_TEXT, MAX_EXPORT = 15, 25, 30, 50, 50_000
#: Account and currency where a statement names none.
CURRENCY, ACCOUNT = "INR", "DEFAULT_ACC"
ROWS = "file_id string, row_no int, cells map<string,string>"
#: Rows that are handed back to Spark together.
BATCH_ROWS = 5_000
#: The only cell of a row, numbered 0, that stands for a file that could not be read: the reason.
UNREAD = "\x00unread"


def describe_files(files: DataFrame) -> DataFrame:
    """``files`` (``path``, ``content``) with name, extension, size, hash, and the reason for which a file is rejected."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    size = F.length("content")
    out = files.select(
        "*", name.alias("filename"), ext.alias("ext"), size.cast("long").alias("size"), F.sha2("content", 256).alias("sha256")
    )
    reason = F.when(~F.col("ext").isin(*EXTENSIONS), "UNSUPPORTED_EXTENSION").when(F.col("size") > MAX_BYTES, "TOO_LARGE")
    return out.withColumn("rejected", reason)


def read_statement_files(spark: SparkSession, directory: str) -> DataFrame:
    """All files below a folder, described; ``file_id`` is the hash of a file's path.

    Files above the size limit are listed without being read: the source skips them by their length.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    read = describe_files(listed.filter(F.col("length") <= MAX_BYTES).select("path", "content"))
    large = listed.filter(F.col("length") > MAX_BYTES).select("path", F.lit(None).cast("binary").alias("content"), "length")
    large = describe_files(large).withColumn("size", F.col("length")).withColumn("rejected", F.coalesce("rejected", F.lit("TOO_LARGE"))).drop("length")
    return read.unionByName(large).withColumn("file_id", F.concat(F.lit("FILE_"), F.upper(F.substring(F.sha2("path", 256), 1, 16))))


def flag_duplicate_files(files: DataFrame) -> DataFrame:
    """``is_duplicate``: the same bytes came earlier in the same reconciliation. Pass metadata without ``content``."""
    turn = F.row_number().over(W.partitionBy("reconciliation_id", "sha256").orderBy("uploaded_seq"))
    return files.withColumn("is_duplicate", turn > 1)


def flag_and_remember_files(files: DataFrame, path: str) -> DataFrame:
    """``flag_duplicate_files`` of a batch against all batches before it, whose hashes are kept in a table at ``path``; the batch is added to it.

    Old files are not read again: of the stored hashes only those meet the batch that it holds too. Batches come in the
    order of their ``uploaded_seq``. A batch that is flagged again gives the same flags: a file meets only earlier ones.
    """
    spark, keys = files.sparkSession, ["reconciliation_id", "sha256"]
    batch = stored(files)
    firsts = batch.groupBy(*keys).agg(F.min("uploaded_seq").alias("first_seq"))
    try:
        known = spark.read.parquet(path).join(firsts.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.min("first_seq").alias("known_seq"))
    except AnalysisException:  # the first batch
        known = firsts.select(*keys, F.col("first_seq").alias("known_seq"))
    out = stored(flag_duplicate_files(batch).join(known, keys, "left").withColumn(
        "is_duplicate", F.col("is_duplicate") | F.coalesce(F.col("known_seq") < F.col("uploaded_seq"), F.lit(False))).select(*files.columns, "is_duplicate"))
    firsts.coalesce(1).write.mode("append").parquet(path)
    return out


def detect_format(content: Column, filename: Column) -> Column:
    """PDF, XLSX, CSV or UNKNOWN by the first bytes, the extension, or a delimiter in the first line."""
    name = F.lower(filename)
    ends = lambda *e: F.greatest(*[name.endswith(x) for x in e]) if len(e) > 1 else name.endswith(e[0])
    first = F.substring_index(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "\n", 1)
    return (
        F.when((F.substring(content, 1, 5) == F.lit(b"%PDF-")) | ends(".pdf"), "PDF")
        .when((F.substring(content, 1, 4) == F.lit(b"PK\x03\x04")) | ends(".xlsx", ".xlsm"), "XLSX")
        .when(ends(".csv", ".tsv", ".txt"), "CSV")
        .when(first.rlike(r"[,\t;|]"), "CSV")
        .otherwise("UNKNOWN")
    )


def classify_pdf_text(files: DataFrame, pages: DataFrame) -> DataFrame:
    """``pdf_kind`` of each file from its page texts (``file_id``, ``page``, ``text``): PDF_OCR where the first three hold little text."""
    text = pages.filter("page <= 3").groupBy("file_id").agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    kind = F.when(F.coalesce("chars", F.lit(0)) < MIN_PDF_TEXT, "PDF_OCR").otherwise("PDF_TEXT")
    return files.join(text, "file_id", "left").withColumn("pdf_kind", kind).drop("chars")


def text_lines(files: DataFrame) -> DataFrame:
    """Non-blank lines of text files (``file_id``, ``text``): ``line_no`` from 0."""
    lines = files.select("file_id", F.posexplode(F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")).alias("line_no", "line"))
    return lines


def sniff_delimiter(lines: DataFrame) -> DataFrame:
    """The most frequent delimiter of each file's first lines; ties by order of preference, none gives a comma."""
    count = lambda d: F.sum(F.length("line") - F.length(F.replace(F.col("line"), F.lit(d), F.lit(""))))
    seen = lines.filter(F.col("line_no") < SNIFF_LINES).groupBy("file_id").agg(*[count(d).alias(f"n{i}") for i, d in enumerate(DELIMITERS)])
    most = F.greatest(*[f"n{i}" for i in range(len(DELIMITERS))])
    best = F.lit(DELIMITERS[0])
    for i in reversed(range(len(DELIMITERS))):
        best = F.when((F.col(f"n{i}") == most) & (most > 0), DELIMITERS[i]).otherwise(best)
    return seen.select("file_id", best.alias("delimiter"))


def _keywords_in(text: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, HEADER_KEYWORDS)), lambda k: F.contains(F.lower(text), k)))


def find_header_line(lines: DataFrame, limit: int = TEXT_HEADER_LINES) -> DataFrame:
    """The first line of each file with the most header keywords; line 0 where none has any."""
    seen = lines.filter(F.col("line_no") < limit).withColumn("hits", _keywords_in(F.col("line")))
    return seen.groupBy("file_id").agg(F.max_by("line_no", F.struct("hits", -F.col("line_no"))).alias("header_line"))


def find_header_row(grid: DataFrame, limit: int = CSV_HEADER_LINES) -> DataFrame:
    """As ``find_header_line`` for rows of cells (``file_id``, ``line_no``, ``cells`` array): counts cells that hold a keyword."""
    hits = F.size(F.filter("cells", lambda x: _keywords_in(F.coalesce(x, F.lit(""))) > 0))
    seen = grid.filter(F.col("line_no") < limit).withColumn("hits", hits)
    return seen.groupBy("file_id").agg(F.max_by("line_no", F.struct("hits", -F.col("line_no"))).alias("header_line"))


def _parse_delimited(text: str) -> list[dict[str, str]]:
    """Rows of one delimited text, from its header row down; short rows are filled with empty cells. Lines end as in any text file."""
    lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
    head = "\n".join(lines[:SNIFF_LINES])
    delimiter = max(DELIMITERS, key=lambda d: (head.count(d), -DELIMITERS.index(d)))
    if not head.count(delimiter):
        delimiter = ","
    parsed = list(csv.reader(io.StringIO("\n".join(lines)), delimiter=delimiter))
    hits = [sum(any(k in c.lower() for k in HEADER_KEYWORDS) for c in row) for row in parsed[:CSV_HEADER_LINES]]
    at = hits.index(max(hits)) if hits else 0
    names = [c.strip() for c in parsed[at]] if parsed else []
    out = []
    for row in parsed[at + 1 :]:
        cells = {n: (row[i].strip() if i < len(row) else "") for i, n in enumerate(names) if n}
        if any(cells.values()):
            out.append(cells)
    return out


def extract_delimited_rows(files: DataFrame) -> DataFrame:
    """Raw rows of delimited files (``file_id``, ``text``): one file in a row, quoted cells of any length, own dialect for each file.

    A file that cannot be parsed gives one row with the cell UNREAD, from which validation makes a FATAL error.
    """

    kinds = (("file_id", pa.string()), ("row_no", pa.int32()), ("cells", pa.map_(pa.string(), pa.string())))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        out: list[tuple] = []
        for files_ in batches:
            for file_id, text in zip(files_.column("file_id").to_pylist(), files_.column("text").to_pylist(), strict=True):
                first = 1
                try:
                    rows = _parse_delimited(text or "")
                except csv.Error as e:
                    rows, first = [{UNREAD: f"The file could not be read: {e}"}], 0
                out += [(file_id, n, list(cells.items())) for n, cells in enumerate(rows, first)]
                if len(out) >= BATCH_ROWS:  # rows of many files go back together
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return files.select("file_id", "text").mapInArrow(run, ROWS)


def extract_file_rows(files: DataFrame, lines: DataFrame | None = None, grid: DataFrame | None = None) -> DataFrame:
    """Raw rows of described files (``file_id``, ``filename``, ``content``, ``rejected``), by the format that each is found to have.

    Delimited and unknown files are decoded as UTF-8, bad bytes replaced. Page texts and sheets come from ``lines`` (``file_id``, ``line_no``,
    ``line``; ``pdf_kind`` of the file tells scanned ones) and ``grid``. A file that is rejected, or of which no lines or
    sheets are given, has one row with the cell UNREAD: the reason. Contents are never shuffled.
    """
    found = files.withColumn("format", detect_format(F.coalesce("content", F.lit(b"")), F.col("filename")))
    if "pdf_kind" in files.columns:
        found = found.withColumn("format", F.when(F.col("format") == "PDF", F.coalesce("pdf_kind", F.lit("PDF"))).otherwise(F.col("format")))
    taken = F.col("rejected").isNull()
    paged = F.col("format").isin("PDF", "PDF_TEXT", "PDF_OCR", "XLSX")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    out = extract_delimited_rows(found.filter(taken & ~paged).select("file_id", text.alias("text")))
    named = found.select("file_id", "format", "rejected")
    of = lambda *kinds: named.filter(taken & F.col("format").isin(*kinds)).select("file_id")
    given = []
    if lines is not None:
        out = out.unionByName(extract_text_rows(lines.join(of("PDF", "PDF_TEXT"), "file_id", "left_semi")))
        out = out.unionByName(extract_ocr_rows(lines.join(of("PDF_OCR"), "file_id", "left_semi")))
        given.append(lines.select("file_id"))
    if grid is not None:
        out = out.unionByName(extract_grid_rows(grid.join(of("XLSX"), "file_id", "left_semi")))
        given.append(grid.select("file_id"))
    absent = named.filter(taken & paged)
    for known in given:
        absent = absent.join(known, "file_id", "left_anti")
    reason = lambda df, why: df.select("file_id", F.lit(0).alias("row_no"), F.create_map(F.lit(UNREAD), why).alias("cells"))
    out = out.unionByName(reason(named.filter(~taken), F.concat(F.lit("The file was rejected: "), "rejected")))
    return out.unionByName(reason(absent, F.concat(F.lit("No lines or sheets are given of a file of format "), "format")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Number the rows of each file from 1 in the order of their lines."""
    turn = F.row_number().over(W.partitionBy("file_id").orderBy("line_no"))
    return rows.select("file_id", turn.cast("int").alias("row_no"), "cells")


def _zip(headers: Column, cells: Column) -> Column:
    """Map of named headers to cells by position; missing cells are empty, and of columns with one name the last one counts."""
    names = F.array_distinct(F.filter(headers, lambda h: h != ""))
    last = lambda h: (F.size(headers) - F.array_position(F.reverse(headers), h)).cast("int")
    return F.map_from_arrays(names, F.transform(names, lambda h: F.coalesce(F.get(cells, last(h)), F.lit(""))))


def extract_text_rows(lines: DataFrame) -> DataFrame:
    """Rows of text lines whose columns stand two spaces or a tab apart; blank cells are lost and later ones move up."""
    split = lambda c: F.filter(F.split(F.trim(c), r"\s{2,}|\t"), lambda x: F.trim(x) != "")
    head = lines.join(find_header_line(lines), "file_id")
    named = head.filter("line_no = header_line").select("file_id", split(F.col("line")).alias("h"))
    default = F.array(*map(F.lit, DEFAULT_HEADERS))
    named = named.select("file_id", F.when(F.size("h") < 2, default).otherwise(F.col("h")).alias("h"))
    body = head.filter("line_no > header_line").select("file_id", "line_no", split(F.col("line")).alias("t")).filter("size(t) >= 2")
    return _numbered(body.join(named, "file_id").select("file_id", "line_no", _zip(F.col("h"), F.col("t")).alias("cells")))


def extract_ocr_rows(lines: DataFrame) -> DataFrame:
    """Rows of recognised lines: at least three tokens and a digit in the first; amount before the last token."""
    t = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    rows = lines.select("file_id", "line_no", F.upper("line").alias("u"), t.alias("t"), F.size(t).alias("n"))
    rows = rows.filter((F.col("n") >= 3) & F.get("t", F.lit(0)).rlike(r"\d"))
    text = F.when(F.col("n") == 3, F.get("t", F.lit(1))).otherwise(F.array_join(F.slice("t", F.lit(2), F.greatest(F.col("n") - 3, F.lit(1))), " "))
    amount = F.element_at("t", -2)
    debit = F.col("u").contains("DR")
    credit = F.col("u").contains("CR") | ~debit
    e = F.lit("")
    cells = F.create_map(
        F.lit("Date"), F.get("t", F.lit(0)), F.lit("Description"), text, F.lit("Debit"), F.when(debit, amount).otherwise(e),
        F.lit("Credit"), F.when(credit, amount).otherwise(e), F.lit("Balance"), e,
        F.lit("Reference"), F.when(F.col("n") > 4, F.element_at("t", -1)).otherwise(e),
    )
    return _numbered(rows.select("file_id", "line_no", cells.alias("cells")))


def extract_grid_rows(grid: DataFrame) -> DataFrame:
    """Rows of spreadsheets given as arrays of cells; cells keep their columns where a header is blank."""
    full = grid.filter(F.exists("cells", lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    head = full.join(find_header_row(full), "file_id")
    clean = lambda c: F.transform(c, lambda x: F.trim(F.coalesce(x, F.lit(""))))
    named = head.filter("line_no = header_line").select("file_id", clean("cells").alias("h"))
    body = head.filter("line_no > header_line").select("file_id", "line_no", clean("cells").alias("t"))
    rows = body.join(named, "file_id").select("file_id", "line_no", _zip(F.col("h"), F.col("t")).alias("cells"))
    return _numbered(rows.filter(F.exists(F.map_values("cells"), lambda v: v != "")))


def extract_rows(files: DataFrame, lines: DataFrame, grid: DataFrame) -> DataFrame:
    """One table of raw rows of all files, each read by its format.

    ``files`` has ``file_id``, ``format`` and ``text``; ``lines`` (``file_id``, ``line_no``, ``line``) are the lines of page
    texts, and ``grid`` (``file_id``, ``line_no``, ``cells``) the rows of sheets. Files of other formats are read as delimited.
    """
    kind = F.coalesce(F.upper("format"), F.lit(""))
    of = lambda *names: files.filter(kind.isin(*names)).select("file_id")
    routed = ("XLSX", "PDF_TEXT", "PDF", "PDF_OCR", "SCANNED_PDF")
    parts = (
        extract_delimited_rows(files.filter(~kind.isin(*routed))), extract_text_rows(lines.join(of("PDF_TEXT", "PDF"), "file_id", "left_semi")),
        extract_ocr_rows(lines.join(of("PDF_OCR", "SCANNED_PDF"), "file_id", "left_semi")), extract_grid_rows(grid.join(of("XLSX"), "file_id", "left_semi")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def write_job_output(df: DataFrame, path: str, jobs: DataFrame | None = None) -> None:
    """Write rows under their job; a job that runs again replaces exactly its own rows, all or nothing.

    ``jobs`` (``parse_job_id``) are the jobs that have run, those without rows too; by default the jobs of ``df``.
    """
    write_parts(df, path, "parse_job_id", jobs)


def read_job_output(spark: SparkSession, path: str, jobs: DataFrame | None = None) -> DataFrame:
    """The rows that the last run of each job has written, of all jobs or of ``jobs``."""
    return read_parts(spark, path, only=None if jobs is None else jobs.select(F.concat(F.lit("p_"), "parse_job_id").alias("store_part")))


def _nested(rows: DataFrame, name: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """Rows of each job, nested in parts of MAX_EXPORT in ``order``, and the number of rows of each job.

    Rows are ranked by prefix sums over ranges, so that a job of any size is ranked by many tasks.
    """
    own = [c for c in rows.columns if c not in ("parse_job_id", *order)]
    dealt = rows.select("parse_job_id", F.struct(*order, *own).alias("r")).repartitionByRange("parse_job_id", "r")
    dealt = stored(dealt.withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy("parse_job_id", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("parse_job_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("parse_job_id", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    turn = F.row_number().over(W.partitionBy("parse_job_id", "range").orderBy("r"))
    ranked = dealt.withColumn("turn", turn).join(before, ["parse_job_id", "range"])
    part = F.floor((F.col("before") + F.col("turn") - 1) / MAX_EXPORT).cast("int").alias("part")
    nested = ranked.groupBy("parse_job_id", part).agg(F.sort_array(F.collect_list("r")).alias(name))
    return nested, sizes.groupBy("parse_job_id").agg(F.sum("n").alias(f"n_{name}"))


def export_statement_package(transactions: DataFrame, errors: DataFrame, totals: DataFrame, jobs: DataFrame) -> DataFrame:
    """One nested row for each job and part: file and counts, totals, transactions by row, errors by row (at most MAX_EXPORT of either), metadata.

    ``jobs`` has the counters of ``validate.job_counters`` with ``reconciliation_id``, ``source_id``, ``source_type``,
    ``filename``, ``file_type`` and ``sha256``. Parts are numbered from 0; counts, totals and status are those of the
    whole job and stand in each part. A job passes if no error but warnings stands against it; one without
    transactions has no totals.
    """
    rows, n_rows = _nested(transactions, "transactions", "source_row")
    errors = errors.select("parse_job_id", "row_number", "page_number", "field", "severity", "raw_value", "message")
    bad, n_bad = _nested(errors, "errors", "row_number", "field", "severity", "raw_value", "message")
    kept = F.struct(*[c for c in totals.columns if c != "parse_job_id"]).alias("control_totals")
    met = jobs.join(totals.select("parse_job_id", kept), "parse_job_id", "left").join(n_rows, "parse_job_id", "left").join(n_bad, "parse_job_id", "left")
    parts = F.ceil(F.greatest("n_transactions", "n_errors", F.lit(1)) / MAX_EXPORT).cast("int").alias("parts")
    status = F.when(F.col("error_count") == 0, "PASSED").otherwise("PARTIAL_ERRORS")
    own = F.coalesce("control_totals.status", F.lit("NOT_APPLICABLE"))
    metadata = F.struct(
        F.col("filename").alias("source_file"), F.lower(F.coalesce("file_type", F.lit("csv"))).alias("parser"), F.col("total_rows").alias("total_transactions"),
        F.col("valid_rows").alias("valid_transactions"), own.alias("control_status"), status.alias("validation_status"),
    ).alias("metadata")
    named = ("reconciliation_id", "source_id", "source_type", "filename", "sha256", "total_rows", "valid_rows", "warning_count", "error_count", "control_totals")
    met = met.select("parse_job_id", parts, F.concat(F.lit("STMT_"), "parse_job_id").alias("statement_id"), *named, F.coalesce("file_type", F.lit("UNKNOWN")).alias("file_type"),
                     F.lit(ACCOUNT).alias("account"), F.lit(CURRENCY).alias("currency"), metadata)
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.join(rows, ["parse_job_id", "part"], "left").join(bad, ["parse_job_id", "part"], "left")


def write_statement_packages(packages: DataFrame, path: str, jobs: DataFrame | None = None) -> None:
    """Write packages as JSON lines under their jobs; a job that is exported again replaces exactly its own, all or nothing."""
    write_parts(packages, path, "parse_job_id", jobs, "json")


def read_statement_packages(spark: SparkSession, path: str) -> DataFrame:
    return read_parts(spark, path, "json")
