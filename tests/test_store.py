"""Tables whose parts are replaced as a whole, and runs of reconciliations side by side."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.jobs.queries import QUERIES
from ledgerline.operators import anomalies as A
from ledgerline.operators import matching as R
from ledgerline.operators import reports as Q
from ledgerline.sources import statements as T
from ledgerline.sources import store as S

JOBS = "parse_job_id string, x int"


def xs(spark, out):
    return sorted((r.parse_job_id, r.x) for r in T.read_job_output(spark, out).collect())


def test_a_rerun_replaces_its_jobs_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    T.write_job_output(spark.createDataFrame([("007", 1), ("007", 2), ("b", 3), ("c d/=%", 4)], JOBS), out)
    assert xs(spark, out) == [("007", 1), ("007", 2), ("b", 3), ("c d/=%", 4)]
    none = spark.createDataFrame([], JOBS)
    T.write_job_output(none, out, spark.createDataFrame([("007",)], "parse_job_id string"))
    assert xs(spark, out) == [("b", 3), ("c d/=%", 4)]
    T.write_job_output(spark.createDataFrame([("b", 9)], JOBS), out)
    T.write_job_output(none, out)
    assert xs(spark, out) == [("b", 9), ("c d/=%", 4)]
    one = spark.createDataFrame([("b",), ("zz",)], "parse_job_id string")
    assert [r.x for r in T.read_job_output(spark, out, one).collect()] == [9]
    assert S.drop_replaced(spark, out) == 1 and xs(spark, out) == [("b", 9), ("c d/=%", 4)]
    T.write_job_output(none, out, T.read_job_output(spark, out).select("parse_job_id"))
    assert xs(spark, out) == []


def test_a_write_that_fails_half_way_leaves_the_old_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    T.write_job_output(spark.createDataFrame([("a", 1), ("b", 2)], JOBS), out)
    broken = spark.range(200).repartition(4).select(F.lit("a").alias("parse_job_id"), F.when(F.col("id") < 199, 5).otherwise(F.raise_error(F.lit("lost")).cast("int")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        T.write_job_output(broken, out)
    assert xs(spark, out) == [("a", 1), ("b", 2)]
    # all rows are written, but the job ends before they are logged
    spark.createDataFrame([("a", 7)], JOBS).withColumn("store_part", F.lit("p_a")).write.partitionBy("store_part").parquet(f"{out}/data/store_generation=unlogged")
    assert xs(spark, out) == [("a", 1), ("b", 2)]


ROWS = ("id string, reconciliation_id string, source_id string, source_type string, date date, description string,"
        " amount decimal(18,2), type string, reference string, source_row int")


def side(spark, kind, rows):
    day = datetime.date(2026, 10, 1)
    return spark.createDataFrame([(i, rec, kind, kind, day + datetime.timedelta(d), t, Decimal(a), "DEBIT", ref, n) for n, (i, rec, d, t, a, ref) in enumerate(rows)], ROWS)


def test_runs_side_by_side(spark, tmp_path):
    path = str(tmp_path / "runs")
    bank = side(spark, "BANK", [("B1", "R1", 0, "rent", "100.00", "U1"), ("B2", "R1", 0, "wood", "50.00", "U2"), ("B3", "R2", 0, "tea", "5.00", "U3")])
    first = side(spark, "LEDGER", [("C1", "R1", 2, "zzz", "100.00", "U1"), ("C3", "R2", 0, "tea", "5.00", "U3")])
    second = first.unionByName(side(spark, "LEDGER", [("C2", "R1", 0, "wood", "50.00", "U2")]))
    recs = bank.select("reconciliation_id")
    for at, ledger, which in (("2026-10-05 10:00:00", first, recs), ("2026-10-06 10:00:00", second, recs.filter("reconciliation_id = 'R1'"))):
        runs = S.new_runs(which, at)
        mine = lambda d, w=which: d.join(w.distinct(), "reconciliation_id", "left_semi")
        matches, left = R.match_pipeline(mine(bank), mine(ledger))
        found = A.investigate(A.detect_anomalies(mine(bank), mine(ledger), matches, left))
        S.save_runs(path, runs, matches, found, ledger)
    runs = S.read_runs(spark, path)
    assert runs.count() == 3
    latest = {r.reconciliation_id: r for r in Q.latest_run(runs).collect()}
    assert (latest["R1"].matched_count, latest["R1"].probable_count, latest["R1"].unmatched_count, latest["R1"].company_rows) == (1, 1, 0, 2)
    assert (latest["R2"].run_status, latest["R1"].run_status) == ("COMPLETED", "REVIEW_REQUIRED")
    matches = S.read_of_runs(spark, path, "matches")
    assert matches.count() == 5 and matches.select("id").distinct().count() == 5
    of_latest = S.read_of_runs(spark, path, "matches", Q.latest_run(runs))
    assert sorted((m.bank_transaction_id, m.status) for m in of_latest.collect()) == [("B1", "PROBABLE_MATCH"), ("B2", "MATCHED"), ("B3", "MATCHED")]
    anomalies = S.read_of_runs(spark, path, "anomalies")
    assert sorted((a.type, a.transaction_id) for a in anomalies.collect()) == [("DATE_MISMATCH", "B1"), ("DATE_MISMATCH", "B1"), ("MISSING_IN_COMPANY", "B2")]
    # a confirmation in one run makes the pair sure in both; a later other action does not undo it
    one = anomalies.filter("type = 'DATE_MISMATCH'").orderBy("id").first()
    missing = anomalies.filter("type = 'MISSING_IN_COMPANY'").first()
    S.append_events(spark.createDataFrame([(one.id, "CONFIRM_MATCH", 1), (missing.id, "CONFIRM_MATCH", 2)], "anomaly_id string, action string, review_seq long"), path, "reviews")
    S.append_events(spark.createDataFrame([(one.id, "MARK_RESOLVED", 3)], "anomaly_id string, action string, review_seq long"), path, "reviews")
    seen, sure = A.apply_anomaly_reviews(anomalies, matches, spark.read.parquet(f"{path}/reviews"))
    assert {(a.id, a.status) for a in seen.collect()} >= {(one.id, "RESOLVED"), (missing.id, "CONFIRMED")}
    assert [(m.status, m.confidence) for m in sure.filter("bank_transaction_id = 'B1'").collect()] == [("MATCHED", 1.0)] * 2
    report = Q.summary_of_runs(Q.latest_run(runs), of_latest, S.read_of_runs(spark, path, "anomalies", Q.latest_run(runs)))
    got = {r.reconciliation_id: (r.matched, r.probable, r.anomalies, r.company_rows, r.headline) for r in report.collect()}
    assert got == {"R1": (1, 1, 1, 2, "REVIEW REQUIRED"), "R2": (1, 0, 0, 1, "RECONCILIATION COMPLETE")}
    S.save_runs(path, S.new_runs(recs.filter("reconciliation_id = 'R2'"), "2026-10-07 10:00:00"), matches.filter("false"), anomalies.filter("false"), second)
    assert S.read_of_runs(spark, path, "matches", Q.latest_run(S.read_runs(spark, path))).count() == 2


def test_ids_of_a_page_are_cut_as_they_are(spark):
    rows = spark.createDataFrame([("J.1_TXN_A", "J.1", 1), ("Jx1_TXN_B", "J.1", 2)], "id string, parse_job_id string, source_row int")
    assert [r.id for r in Q.transactions_page(rows, "J.1").collect()] == ["TXN_A", "Jx1_TXN_B"]


def test_files_meet_the_hashes_of_earlier_batches(spark, tmp_path):
    rows = [("f1", "R", "h1", 1), ("f2", "R", "h1", 2), ("f3", "Q", "h1", 3), ("f4", "R", "h2", 4), ("f5", "R", "h1", 5), ("f6", "R", "h2", 6), ("f7", None, "h2", 7)]
    files = spark.createDataFrame(rows, "file_id string, reconciliation_id string, sha256 string, uploaded_seq long")
    whole = {r.file_id: r.is_duplicate for r in T.flag_duplicate_files(files).collect()}
    path, got = str(tmp_path / "hashes"), {}
    for low, high in ((0, 3), (3, 5), (5, 9)):
        batch = files.filter(f"uploaded_seq > {low} and uploaded_seq <= {high}")
        for _ in range(2):  # flagging a batch again changes nothing
            got |= {r.file_id: r.is_duplicate for r in T.flag_and_remember_files(batch, path).collect()}
    assert got == whole == {"f1": False, "f2": True, "f3": False, "f4": False, "f5": True, "f6": True, "f7": False}


def test_a_deep_page_reads_few_ranges(spark, tmp_path):
    rows = spark.range(3000).select(F.concat(F.lit("J"), (F.col("id") % 3).cast("string")).alias("parse_job_id"), (F.col("id") * 7919 % 3000).cast("int").alias("source_row"))
    rows = rows.unionByName(spark.createDataFrame([("J1", 1500)] * 40, "parse_job_id string, source_row int")).withColumn("id", F.concat("parse_job_id", F.lit("_T"), "source_row"))
    rows.repartitionByRange(8, "parse_job_id", "source_row").sortWithinPartitions("parse_job_id", "source_row").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    index = Q.page_index(rows, 50)
    for job in ("J0", "J1", "J2", "none"):
        for limit, offset in ((10, 0), (100, 475), (30, 990), (5, 5000), (2000, 0)):
            page = Q.indexed_page(rows, index, job, limit, offset)
            assert [(r.id, r.source_row) for r in page.collect()] == [(r.id, r.source_row) for r in Q.transactions_page(rows, job, limit, offset).collect()]
    plan = Q.indexed_page(rows, index, "J1", 20, 700)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(source_row" in plan


def test_the_package_query_tells_whole_jobs_of_several_parts(spark, monkeypatch):
    one = QUERIES["s_statement_package"](spark, "/root/testdata/sf0.001").drop("parts").orderBy("parse_job_id").collect()
    monkeypatch.setattr(T, "MAX_EXPORT", 50)
    several = QUERIES["s_statement_package"](spark, "/root/testdata/sf0.001").orderBy("parse_job_id")
    assert [(r.part, r.parts > 1, r.n_transactions) for r in several.collect()] == [(0, True, r.valid_rows) for r in one]
    assert several.drop("parts").collect() == one


def test_an_index_of_small_ranges_takes_few_tasks(spark, monkeypatch):
    dealt, kind = [], type(spark.range(1))
    orig = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, n, *cols: (dealt.append(n), orig(df, n, *cols))[1])
    rows = spark.range(2000).select(F.concat(F.lit("J"), (F.col("id") % 2).cast("string")).alias("parse_job_id"), F.col("id").cast("int").alias("source_row"))
    index = Q.page_index(rows, 10).orderBy("parse_job_id", "first_row").collect()
    assert dealt == [1] and len(index) == 200 and all(r.n == 10 for r in index)
    assert [r.before for r in index if r.parse_job_id == "J1"] == list(range(0, 1000, 10))
