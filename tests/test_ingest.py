from pyspark.sql import functions as F

from ledgerline.operators import ingest as I
from ledgerline.operators import mapping as M
from ledgerline.operators import validate as V
from ledgerline.sources import statements as T

TEXT = """Some Bank
Account 1

Txn Date,Particulars,Ref No,Debit,Credit,Balance
01-Oct-2026,"Rent, flat",U1,"₹1,500.00",,"98,500.00"
02-Oct-2026,Salary,,,5000,103500.00
bad date,Fee,U3,10,,103490
03-Oct-2026,Tea,U4,5
"""


def ingest(spark, text):
    files = spark.createDataFrame([("f1", text)], "file_id string, text string")
    rows = T.extract_delimited_rows(files)
    heads = rows.filter("row_no = 1").select("file_id", F.posexplode(F.map_keys("cells")).alias("position", "header"))
    maps = M.infer_column_mappings(M.header_candidates(heads, M.header_samples(rows)))
    mapped = M.apply_mapping(rows, maps).withColumns({"parse_job_id": F.lit("J"), "filename": F.lit("f.csv")})
    return maps, V.normalize_rows(mapped)


def jobs_of(rows):
    own = {c: F.lit(c) for c in ("reconciliation_id", "source_id", "source_type", "filename", "file_type", "sha256")}
    return V.job_counters(rows).withColumns(own)


def test_file_to_transactions(spark):
    maps, rows = ingest(spark, TEXT)
    assert {m.source_column: m.target_field for m in maps.collect()} == {
        "Txn Date": "date", "Particulars": "description", "Ref No": "reference", "Debit": "debit", "Credit": "credit", "Balance": "balance",
    }
    assert M.mapping_confidence(maps).first().status == "READY_FOR_EXECUTION"
    counts = V.job_counters(rows).first()
    assert (counts.total_rows, counts.valid_rows, counts.warning_count, counts.error_count) == (4, 3, 1, 1)
    good = V.canonical_transactions(rows)
    totals = V.control_totals(good).first()
    assert str(totals.opening_balance) == "100000.00"
    assert str(totals.difference) == "5.00" and totals.status == "CONTROL_TOTAL_MISMATCH"  # the last row has no balance
    errors = {(e.row_number, e.field, e.severity) for e in V.validate_rows(rows).collect()}
    assert errors == {(2, "reference", "WARNING"), (3, "date", "ERROR")}
    package = T.export_statement_package(good, V.validate_rows(rows), V.control_totals(good), jobs_of(rows)).first()
    assert package.metadata.validation_status == "PARTIAL_ERRORS" and [t.source_row for t in package.transactions] == [1, 2, 4]
    assert (package.statement_id, package.error_count, package.warning_count, len(package.errors)) == ("STMT_J", 1, 1, 2)


def test_fuzzy_headers_and_empty_files(spark):
    maps, _ = ingest(spark, "Transact Date;Narrative Details;Money Out Dr;Money In Cr;Net Bal\n01/10/2026;x;1;;2\n")
    assert [m.target_field for m in maps.orderBy("position").collect()] == ["date", "description", "debit", "credit", "balance"]
    assert T.extract_delimited_rows(spark.createDataFrame([("f", ""), ("g", None)], "file_id string, text string")).count() == 0


def test_of_equal_headers_the_last_counts(spark):
    lines = spark.createDataFrame([("f", 0, "Date  Ref  Description  Ref  Debit"), ("f", 1, "01/10/2026  R1  Tea  R2  5"), ("f", 2, "02/10/2026  R3  Rent")], "file_id string, line_no int, line string")
    got = {r.row_no: r.cells for r in T.extract_text_rows(lines).collect()}
    assert got[1] == {"Date": "01/10/2026", "Ref": "R2", "Description": "Tea", "Debit": "5"}
    assert got[2] == {"Date": "02/10/2026", "Ref": "", "Description": "Rent", "Debit": ""}
    grid = spark.createDataFrame([("s", 0, ["Date", "Amount", None, "Amount"]), ("s", 1, ["d", "1", "x", "2"]), ("s", 2, ["e", "3"])], "file_id string, line_no int, cells array<string>")
    assert [r.cells for r in T.extract_grid_rows(grid).orderBy("row_no").collect()] == [{"Date": "d", "Amount": "2"}, {"Date": "e", "Amount": ""}]
    assert T._parse_delimited("Date,Amount,Amount\nd,1,2\n") == [{"Date": "d", "Amount": "2"}]


def test_of_columns_with_one_target_the_rightmost_counts(spark):
    rows = spark.createDataFrame([("f", 1, {"A": "1", "B": "2", "C": "3"})], T.ROWS)
    maps = spark.createDataFrame([("f", 0, "B", "debit"), ("f", 1, "A", "debit"), ("f", 2, "C", None)], "file_id string, position int, source_column string, target_field string")
    assert M.apply_mapping(rows, maps).first().raw_debit == "1"
    user = maps.filter("target_field is not null").drop("position")
    assert M.apply_mapping(rows, maps, user).first().raw_debit == "2"


def test_learned_rules_and_output(spark, tmp_path):
    maps = spark.createDataFrame([("BANK", " Foo ", None, 0.0, "manual")], "source_type string, source_column string, target_field string, confidence double, method string")
    rules = spark.createDataFrame([("BANK", "foo", "debit", 1.0, 1), ("BANK", "foo", "credit", 1.0, 2)], "source_type string, source_column string, target_field string, confidence double, created_seq int")
    got = M.overlay_learned_rules(maps, rules).first()
    assert (got.target_field, got.method, got.confidence) == ("credit", "learned", 1.0)
    out = str(tmp_path / "out")
    T.write_job_output(spark.createDataFrame([(1, "a"), (2, "b")], "x int, parse_job_id string"), out)
    T.write_job_output(spark.createDataFrame([(3, "b")], "x int, parse_job_id string"), out)
    assert sorted(r.x for r in T.read_job_output(spark, out).collect()) == [1, 3]


def test_formats_and_lines(spark):
    files = spark.createDataFrame([(b"%PDF-1", "a.bin"), (b"PK\x03\x04", "b"), (b"x", "c.tsv"), (b"a;b\n", "d"), (b"ab", "e")], "content binary, filename string")
    assert [r[0] for r in files.select(T.detect_format(F.col("content"), F.col("filename"))).collect()] == ["PDF", "XLSX", "CSV", "CSV", "UNKNOWN"]
    lines = spark.createDataFrame([("f", 0, "01/10/2026 PAID SHOP 50.00 DR REF9"), ("f", 1, "Total 5")], "file_id string, line_no int, line string")
    row = T.extract_ocr_rows(lines).first()
    assert (row.cells["Description"], row.cells["Debit"], row.cells["Credit"], row.cells["Reference"]) == ("PAID SHOP 50.00", "DR", "", "REF9")


def test_package_holds_every_row(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(T, "MAX_EXPORT", 2)
    rows = spark.createDataFrame([("A", 100_000 + n, f"t{n}") for n in range(5)] + [("B", 7, "x")], "parse_job_id string, source_row int, description string")
    bad = [("A", n, 1, "date", "ERROR", None, "m") for n in range(3)] + [("B", 1, 1, "reference", "WARNING", "v", "m"), ("C", 1, 1, "date", "ERROR", "v", "m")]
    errors = spark.createDataFrame(bad, "parse_job_id string, row_number int, page_number int, field string, severity string, raw_value string, message string")
    totals = rows.groupBy("parse_job_id").agg(F.count("*").alias("transaction_count"), F.lit("VERIFIED").alias("status"))
    counts = [("A", 8, 5, 0, 3), ("B", 1, 1, 1, 0), ("C", 1, 0, 0, 1)]
    jobs = spark.createDataFrame(counts, "parse_job_id string, total_rows long, valid_rows long, warning_count long, error_count long")
    jobs = jobs.withColumns({c: F.lit(None).cast("string") for c in ("reconciliation_id", "source_id", "source_type", "filename", "file_type", "sha256")})
    packages = T.export_statement_package(rows, errors, totals, jobs)
    got = packages.orderBy("parse_job_id", "part").collect()
    assert [(p.parse_job_id, p.part, p.parts, [t.description for t in p.transactions or []], [e.row_number for e in p.errors or []], p.metadata.validation_status) for p in got] == [
        ("A", 0, 3, ["t0", "t1"], [0, 1], "PARTIAL_ERRORS"), ("A", 1, 3, ["t2", "t3"], [2], "PARTIAL_ERRORS"), ("A", 2, 3, ["t4"], [], "PARTIAL_ERRORS"),
        ("B", 0, 1, ["x"], [1], "PASSED"), ("C", 0, 1, [], [1], "PARTIAL_ERRORS"),
    ]
    assert [p.control_totals and p.control_totals.transaction_count for p in got] == [5, 5, 5, 1, None]
    T.write_statement_packages(packages, str(tmp_path / "p"))
    T.write_statement_packages(packages.filter("parse_job_id = 'B'"), str(tmp_path / "p"))
    back = T.read_statement_packages(spark, str(tmp_path / "p"))
    assert back.count() == 5 and back.columns == packages.columns and back.filter("parse_job_id = 'A'").select("part").distinct().count() == 3


HDFC = """BANK STATEMENT OF ACCOUNT
ACCOUNT NUMBER: 1
BRANCH: X
CURRENCY: INR
Date,Narration,Chq/Ref No,Withdrawal Amt.,Deposit Amt.,Closing Balance
""" + "\n".join(f"0{n + 1}/10/2026,entry {n},R{n},{d},{c},{b}" for n, (d, c, b) in enumerate([
    ("1250.00", "", "98750.00"), ("", "85000.00", "183750.00"), ("480.50", "", "183269.50"), ("48500.00", "", "134769.50"), ("10000.00", "", "124769.50"),
    ("", "3400.00", "128169.50"), ("2450.00", "", "125719.50")]))
SBI = """State Bank - E-Statement
Customer Name: X
Account No: 1
Txn Date,Particulars,Ref No,Debit,Credit,Balance
01-Oct-2026,shop,UTR991827,"₹1,250.00",,"₹54,200.00"
02-Oct-2026,rent,,"₹25,000.00",,"₹29,200.00"
03-Oct-2026,invoice,UTR771628,,"₹1,50,000.00","₹1,79,200.00"
INVALID_DATE_ROW,corrupt,REF999,"₹500.00",,"₹1,78,700.00"
05-Oct-2026,cloud,GCLD88192,"₹4,200.00",,"₹1,74,500.00"
"""


def test_statements_with_known_totals(spark):
    _, rows = ingest(spark, HDFC)
    t = V.control_totals(V.canonical_transactions(rows)).first()
    got = [str(x) for x in (t.opening_balance, t.total_debits, t.total_credits, t.closing_balance, t.status, t.transaction_count)]
    assert got == ["100000.00", "62680.50", "88400.00", "125719.50", "VERIFIED", "7"]
    _, rows = ingest(spark, SBI)
    t = V.control_totals(V.canonical_transactions(rows)).first()
    got = [str(x) for x in (t.opening_balance, t.total_debits, t.total_credits, t.expected_closing, t.closing_balance, t.difference, t.status)]
    assert got == ["55450.00", "30450.00", "150000.00", "175000.00", "174500.00", "-500.00", "CONTROL_TOTAL_MISMATCH"]
    c = V.job_counters(rows).first()
    assert (c.total_rows, c.valid_rows, c.warning_count, c.error_count) == (5, 4, 1, 1)
    first = V.canonical_transactions(rows).orderBy("source_row").first()
    assert first.provenance.asDict() == {"file_id": "f1", "filename": "f.csv", "page": 1, "row": 1} and first.source_type == "BANK_STATEMENT" and first.vendor is None


def test_giant_cells_and_files_that_cannot_be_read(spark, monkeypatch):
    giant = "Date,Narration,Debit\n01/10/2026," + "x" * 200_000 + ",5\n"
    open_quote = 'Date,Narration,Debit\n01/10/2026,"never closed,5\n' + "02/10/2026,y,6\n" * 20_000
    files = spark.createDataFrame([("a", giant), ("b", open_quote)], "file_id string, text string")
    got = {r.file_id: r.cells["Narration"] for r in T.extract_delimited_rows(files).collect()}
    assert len(got["a"]) == 200_000 and got["b"].startswith("never closed,5")
    rows = spark.createDataFrame([("f", 0, {T.UNREAD: "bad"}), ("g", 1, {"Date": "01/10/2026"})], T.ROWS)
    maps = spark.createDataFrame([("g", "date", "Date")], "file_id string, target_field string, source_column string")
    out = V.normalize_rows(M.apply_mapping(rows, maps).withColumns({"parse_job_id": F.col("file_id"), "filename": F.lit("f.csv")}))
    errors = V.validate_rows(out).filter("parse_job_id = 'f'").collect()
    assert [(e.row_number, e.field, e.severity, e.message) for e in errors] == [(0, "file", "FATAL", "bad")]


def test_files_of_one_layout_are_mapped_once(spark):
    text = "Date,Narration,Debit\n01/10/2026,x,5\n"
    files = spark.createDataFrame([("a", text), ("b", text.replace("x", "y")), ("c", "")], "file_id string, text string")
    rows = T.extract_delimited_rows(files)
    heads = rows.filter("row_no = 1").select("file_id", F.posexplode(F.map_keys("cells")).alias("position", "header"))
    maps = M.infer_column_mappings(M.header_candidates(heads, M.header_samples(rows)))
    assert {(m.file_id, m.target_field, tuple(m.sample_values)) for m in maps.collect()} == {
        (f, t, v) for f, n in (("a", "x"), ("b", "y")) for t, v in (("date", ("01/10/2026",)), ("description", (n,)), ("debit", ("5",)))}


def test_a_folder_to_canonical_rows_and_reasons(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "bad.csv").write_bytes(b"My Bank\r\nDate,Narration,Ref No,Debit,Credit\r\n01/10/2026,Caf\xe9 \xff,U1,5.00,\r\n02/10/2026,Tea,,6.00,\r\n")
    (folder / "deep" / "T.TSV").write_bytes("Date\tParticulars\tAmount\r03/10/2026\tRent – München\t-7.50\r".encode())
    (folder / "notes.docx").write_bytes(b"Date,Narration,Debit\n01/10/2026,x,1\n")
    (folder / "large.csv").write_bytes(b"Date,Narration,Debit\n" + b"01/10/2026,x,1\n" * (26 * 1024 * 1024 // 15))
    (folder / "page.pdf").write_bytes(b"%PDF-1.4 ...")
    (folder / "sheet.xlsx").write_bytes(b"PK\x03\x04 ...")
    files = T.read_statement_files(spark, str(folder)).withColumn("source_type", F.lit("BANK_STATEMENT"))
    seen = {r.filename: (r.rejected, r.size > 0, r.sha256 is None) for r in files.drop("content").collect()}
    assert seen["large.csv"] == ("TOO_LARGE", True, True) and seen["notes.docx"][0] == "UNSUPPORTED_EXTENSION" and seen["bad.csv"] == (None, True, False)
    lines = files.filter("filename = 'page.pdf'").select("file_id", F.explode(F.array(
        F.struct(F.lit(0).alias("line_no"), F.lit("Date  Description  Debit").alias("line")), F.struct(F.lit(1).alias("line_no"), F.lit("04/10/2026  Coal  8.00").alias("line")))).alias("l")).select("file_id", "l.*")
    good, errors, _ = I.ingest_files(files, lines=lines)
    got = {(str(t.date), t.description, str(t.amount), t.type, t.reference) for t in good.collect()}
    assert got == {("2026-10-01", "Caf� �", "5.00", "DEBIT", "U1"), ("2026-10-02", "Tea", "6.00", "DEBIT", None),
                   ("2026-10-03", "Rent – München", "7.50", "DEBIT", None), ("2026-10-04", "Coal", "8.00", "DEBIT", None)}
    fatal = sorted((e.raw_value, e.message) for e in errors.filter("severity = 'FATAL'").collect())
    assert fatal == [("large.csv", "The file was rejected: TOO_LARGE"), ("notes.docx", "The file was rejected: UNSUPPORTED_EXTENSION"),
                     ("sheet.xlsx", "No lines or sheets are given of a file of format XLSX")]
    assert errors.filter("severity = 'WARNING'").count() == 3


def test_a_second_job_is_mapped_by_what_the_first_saved(spark, tmp_path):
    def files(name, text):
        return spark.createDataFrame([(name, f"{name}.csv", text.encode(), None, "BANK_STATEMENT")], "file_id string, filename string, content binary, rejected string, source_type string")

    text = "Date,Narration,Foo,Bar\n01/10/2026,Tea,12,xx\n"
    good, _, maps = I.ingest_files(files("a", text.replace("12", "?")))
    assert good.count() == 0 and {m.source_column for m in maps.filter("target_field is null").collect()} == {"Foo", "Bar"}
    chosen = spark.createDataFrame([("a", "date", "Date"), ("a", "description", "Narration"), ("a", "debit", "Bar"), ("a", "reference", "Foo")], "file_id string, target_field string, source_column string")
    rules = str(tmp_path / "rules")
    I.save_rules(chosen.withColumn("source_type", F.lit("BANK_STATEMENT")), rules)
    turned = spark.createDataFrame([("BANK_STATEMENT", " foo", "debit"), ("BANK_STATEMENT", "BAR ", "reference")], "source_type string, source_column string, target_field string")
    I.save_rules(turned, rules)
    assert I.read_rules(spark, rules).count() == 4
    good, _, maps = I.ingest_files(files("b", text), rules=I.read_rules(spark, rules))
    assert [(str(t.amount), t.type, t.reference) for t in good.collect()] == [("12.00", "DEBIT", "xx")]
    assert {m.source_column: m.method for m in maps.collect()} == {"Date": "learned", "Narration": "learned", "Foo": "learned", "Bar": "learned"}


def test_a_file_without_dates_needs_review(spark):
    files = spark.createDataFrame([("a", "Narration,Debit\nTea,5\n"), ("b", "Date,Narration,Debit\n01/10/2026,Tea,5\n")], "file_id string, text string")
    rows = T.extract_delimited_rows(files)
    origin = files.select("file_id", F.lit("BANK_STATEMENT").alias("source_type"))
    _, whole = I.suggest_mappings(rows, origin)
    assert {(r.file_id, r.confidence, r.status) for r in whole.collect()} == {("a", 0.6, "NEEDS_REVIEW"), ("b", 1.0, "READY_FOR_EXECUTION")}
