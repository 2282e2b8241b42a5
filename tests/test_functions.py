import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import normalize as N
from ledgerline.functions import scoring as S
from ledgerline.functions import text as X
from ledgerline.functions.text import description_score

D = datetime.date


def values(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(column(F.col("x"))).collect()]


def test_dates(spark):
    cases = {
        "03/04/2026": D(2026, 4, 3), "10/25/2026": D(2026, 10, 25), "01-OCT-2026": D(2026, 10, 1), "01/10/95": D(1995, 10, 1),
        "01/10/70": None, "01/10/68": D(2068, 10, 1), "2026-1-5": D(2026, 1, 5), "Oct 5, 2026": D(2026, 10, 5), "5  March  2026": D(2026, 3, 5),
        "01/02/2026 10:15 PM": D(2026, 2, 1), "31/02/2026": None, "x": None, "": None, None: None, "5-Sept-2026": None, "01/01/0026": None,
    }
    assert values(spark, N.normalize_date, cases) == list(cases.values())


def test_amounts(spark):
    cases = {
        "₹1,50,000.00": ("150000.00", None), "(1,250.00)": ("1250.00", "DEBIT"), "-5": ("5.00", "DEBIT"), "500 Cr": ("500.00", "CREDIT"),
        "500 DR": ("500.00", "DEBIT"), "2.345": ("2.34", None), "Rs.500": ("0.50", None), "Rs. 1,000.00": (None, None), "1250.00-": (None, None),
        "n/a": (None, None), "-": (None, None), "": (None, None), None: (None, None), "INR 12": ("12.00", None),
    }
    got = values(spark, N.clean_amount, cases)
    assert [(None if g.amount is None else str(g.amount), g.hint) for g in got] == list(cases.values())
    strict = values(spark, lambda c: N.clean_amount(c, True), ["Rs. 1,000.00"])
    assert strict[0].amount == Decimal("1000.00")


def test_amount_and_type(spark):
    rows = [("5", "", None, None), ("", "7", None, None), ("5", "7", None, None), (None, None, "9", None), (None, None, "9", "Deposit"),
            (None, None, "(9)", None), (None, None, "0", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "d string, c string, a string, t string")
    got = [r[0] for r in df.select(N.resolve_amount_type(*map(F.col, "dcat"))).collect()]
    assert [g.type for g in got] == ["DEBIT", "CREDIT", None, "DEBIT", "CREDIT", "DEBIT", None, None]
    assert got[2].error == N.AMBIGUOUS and got[7].error == N.NO_VALID_AMOUNT


def test_texts(spark):
    assert values(spark, N.normalize_reference, ["123.0", "N/A", "0", " U1 ", None]) == ["123", None, None, "U1", None]
    assert values(spark, N.normalize_description, [" a \t b\n", None]) == ["a b", ""]


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [("AMAZON WEB SERVICES INDIA", "AWS Cloud Services", 0.62), ("ABC LOGISTICS", "ABC Logistics Services", 1.0),
     ("UPI-ZOMATO-ORDER-9812", "Zomato Meals Expense", 0.34), ("x", " X ", 1.0), (None, "", 1.0), ("a", "", 0.0)],
)
def test_similarity(a, b, score):
    assert description_score(a, b) == score


def test_scores(spark):
    row = spark.range(1).select(
        S.amount_score(F.lit(Decimal("100.00")), F.lit(Decimal("100.50"))).alias("a"), S.date_score(F.lit(5)).alias("d"),
        S.reference_score(F.lit("utr1"), F.lit("UTR12")).alias("r"), S.reference_score(F.lit(None).cast("string"), F.lit("x")).alias("n"),
        S.match_score(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("m"),
        S.match_score(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit("a"), F.lit("a")).alias("capped"),
    ).first()
    assert (row.a, row.d, row.r, row.n, row.m, row.capped) == (0.95, 0.4, 0.85, 0.0, 0.7647, 0.45)


def test_many_texts_are_compared_as_one_by_one(spark):
    rng = random.Random(3)
    words = ["a", "b", "ab", "ba", "é", "ßx", "zz", "日本", "q" * 40, "w" * 70, "\0", "customer#000041", "customer#000014", "payment"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(7)))
    pairs = [(text(), text()) for _ in range(1500)]
    assert X.similarities(pairs) == [X.similarity(a, b) for a, b in pairs]
    df = spark.createDataFrame([(a, b) for a, b in pairs if "\0" not in a + b] + [(None, "x"), (None, None), (" A ", "a")], "a string, b string")
    assert all(r.s == X.description_score(r.a, r.b) for r in df.select("a", "b", X.text_score("a", "b").alias("s")).collect())
