"""Duplicates, mismatches and missing entries, findings about them, and the effect of reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.runtime import stored
from ledgerline.functions.scoring import money
from ledgerline.functions.text import with_text_score

#: Thresholds of severity.
LARGE, LARGE_DIFFERENCE, FEW_DAYS = 10_000, 500, 2


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _anomaly(df: DataFrame, kind: str, severity: Column, diff: Column, days: Column, evidence: Column) -> DataFrame:
    """Rows of the common schema; ``df`` has ``reconciliation_id``, ``transaction_id`` and ``candidate_transaction_id``."""
    key = F.concat_ws("|", "reconciliation_id", F.lit(kind), "transaction_id", F.coalesce("candidate_transaction_id", F.lit("")))
    return df.select(
        F.concat(F.lit("ANOM_"), F.upper(F.substring(F.sha2(key, 256), 1, 10))).alias("id"),
        "reconciliation_id", "transaction_id", "candidate_transaction_id", F.lit(kind).alias("type"),
        severity.alias("severity"), F.lit("PENDING").alias("status"), diff.cast("decimal(18,2)").alias("amount_difference"),
        days.cast("int").alias("date_difference_days"), evidence.alias("evidence"),
    )


_TWIN = ("reconciliation_id", "type", "amount", "date", "description")


def _twins(side: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their class ``cls`` (equal rows of one day), the classes with their numbers of rows, and links between
    classes of one amount and type, at most a day apart, whose descriptions agree to ``threshold``.

    A class meets classes of its own day and the next, so a pair is found once by an equi-join; texts are compared by classes.
    """
    name = F.concat_ws(":", *[F.xxhash64(F.lit(seed), *[F.col(c).isNull() for c in _TWIN], *_TWIN).cast("string") for seed in (1, 2)])
    rows = stored(side.select(*_TWIN, "id", F.struct("date", "source_row", "id").alias("ord"), name.alias("cls")))
    classes = stored(rows.groupBy("cls", *_TWIN).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")))
    cols = list(_TWIN[:3])
    named = lambda k: [F.col("cls").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("description").alias(f"t{k}"), F.col("date").alias(f"d{k}")]
    a = classes.select(*cols, *named(1), F.explode(F.array("date", F.date_add("date", 1))).alias("day"))
    b = classes.select(*cols, *named(2), F.col("date").alias("day"))
    near = a.join(b, [*cols, "day"]).filter("d1 < d2 or c1 < c2")
    links = with_text_score(stored(near), "t1", "t2").filter(F.col("desc_score") >= threshold)
    return rows, classes, stored(links.select("c1", "c2", "n1", "n2", "desc_score", F.abs(F.date_diff("d2", "d1")).alias("days")))


def duplicate_pairs(side: DataFrame, threshold: float) -> DataFrame:
    """Pairs of rows of one amount and type, at most a day apart, whose descriptions agree to ``threshold``: all of them, so that k equal
    rows give k (k - 1) / 2. ``duplicate_groups`` tells the same by membership."""
    rows, classes, links = _twins(side, threshold)
    own = classes.filter("n > 1").select(F.col("cls").alias("c1"), F.col("cls").alias("c2"), F.lit(1.0).alias("desc_score"), F.lit(0).alias("days"))
    met = links.select(own.columns).unionByName(own)
    first = rows.select(*_TWIN[:3], F.col("cls").alias("c1"), F.struct("ord", "id", "date").alias("x"))
    second = rows.select(F.col("cls").alias("c2"), F.struct("ord", "id", "date").alias("y"))
    both = met.join(first, "c1").join(second, "c2").filter("c1 <> c2 or x.ord < y.ord")
    turned = F.col("x.ord") < F.col("y.ord")
    one, two = F.when(turned, F.col("x")).otherwise(F.col("y")), F.when(turned, F.col("y")).otherwise(F.col("x"))
    return both.select(*_TWIN[:3], one["id"].alias("id1"), one["date"].alias("d1"), two["id"].alias("id2"), two["date"].alias("d2"), "desc_score", "days")


def duplicate_groups(side: DataFrame, threshold: float) -> DataFrame:
    """Membership in groups of duplicates: ``id``, ``group_id`` (the first row of the group), ``group_size`` and ``n_links`` (rows that the
    row itself agrees with), for every row that agrees with any. Rows that are joined through others are one group.

    Work goes by classes of equal rows, so any number of equal rows gives as many rows and no pairs.
    """
    rows, classes, links = _twins(side, threshold)
    both = links.select("c1", "c2", "n2").unionByName(links.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), F.col("n1").alias("n2")))
    others = both.groupBy(F.col("c1").alias("cls")).agg(F.sum("n2").alias("n_others"))
    known = classes.join(others, "cls", "left").withColumn("n_links", F.coalesce("n_others", F.lit(0)) + F.col("n") - 1).filter("n_links > 0")
    label = stored(known.select("cls", "first", "n", "n_links", F.col("cls").alias("label")))
    while True:  # labels spread to neighbours and jump to the label of their label, so that chains shorten by half
        near = both.join(label.select(F.col("cls").alias("c2"), F.col("label").alias("other")), "c2").groupBy(F.col("c1").alias("cls")).agg(F.min("other").alias("other"))
        spread = label.join(near, "cls", "left").withColumn("new", F.least("label", F.coalesce("other", "label"))).drop("other")
        spread = stored(spread)
        jump = spread.select(F.col("cls").alias("new"), F.col("new").alias("further"))
        moved = stored(spread.join(jump, "new").select("cls", "first", "n", "n_links", F.least("new", "further").alias("label"), (F.col("label") != F.least("new", "further")).alias("changed")))
        label = moved.drop("changed")
        if moved.filter("changed").isEmpty():
            break
    groups = label.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
    of_class = label.select("cls", "label", "n_links").join(groups, "label").select("cls", F.col("first.id").alias("group_id"), "group_size", "n_links")
    return rows.select("id", "cls").join(of_class, "cls").select("id", "group_id", "group_size", "n_links")


def _duplicates(side: DataFrame, threshold: float, severity: str, evidence: list[Column]) -> DataFrame:
    pairs = duplicate_pairs(side, threshold).withColumns(
        {"transaction_id": F.col("id1"), "candidate_transaction_id": F.col("id2")}
    )
    return _anomaly(pairs, "DUPLICATE_TRANSACTION", F.lit(severity), F.lit(0), F.col("days"), F.array(*evidence))


def bank_duplicates(bank: DataFrame, threshold: float = 0.80) -> DataFrame:
    percent = (F.col("desc_score") * 100).cast("int")
    return _duplicates(bank, threshold, "HIGH", [
        _text("Identical amount of ₹", money(F.col("amount")), " appears twice in Bank Statement"),
        _text("Dates are ", F.col("d1"), " and ", F.col("d2"), " (", F.col("days"), " days apart)"),
        _text("Description similarity: ", percent, "%"),
        F.lit("Possible double billing or duplicate payment"),
    ])


def company_duplicates(company: DataFrame, threshold: float = 0.85) -> DataFrame:
    return _duplicates(company, threshold, "MEDIUM", [
        _text("Identical entry of ₹", money(F.col("amount")), " recorded twice in Company Accounts"),
        _text("Dates: ", F.col("d1"), " and ", F.col("d2")),
        F.lit("Possible double ledger journal posting"),
    ])


def match_anomalies(matches: DataFrame, bank: DataFrame, company: DataFrame) -> DataFrame:
    """Of probable matches: composite, else an amount that differs, else a date that differs. Sure matches raise none."""
    b = bank.select(F.col("id").alias("bank_transaction_id"), F.col("amount").alias("ba"), F.col("date").alias("bd"))
    c = company.select(F.col("id").alias("c_id"), F.col("amount").alias("ca"), F.col("date").alias("cd"))
    m = matches.filter("status = 'PROBABLE_MATCH'").withColumn("c_id", F.get("company_ids", F.lit(0)))
    m = m.join(b, "bank_transaction_id").join(c, "c_id").withColumns(
        {"transaction_id": F.col("bank_transaction_id"), "candidate_transaction_id": F.col("company_transaction_id")}
    )
    diff, days = F.col("amount_difference"), F.col("date_difference_days")
    composite = _anomaly(m.filter("match_type = 'COMPOSITE'"), "COMPOSITE_MATCH", F.lit("LOW"), F.lit(0), days, F.col("reasons"))
    single = m.filter("match_type <> 'COMPOSITE'")
    amounts = _anomaly(
        single.filter(diff > 0), "AMOUNT_MISMATCH", F.when(diff > LARGE_DIFFERENCE, "HIGH").otherwise("MEDIUM"), diff, days,
        F.array(
            _text("Bank amount is ₹", money(F.col("ba")), " but Company record is ₹", money(F.col("ca"))),
            _text("Deterministic discrepancy of ₹", money(diff)),
            _text("Description match: ", (F.col("description_score") * 100).cast("int"), "%"),
        ),
    )
    dates = _anomaly(
        single.filter((diff <= 0) & (days > 0)), "DATE_MISMATCH", F.when(days <= FEW_DAYS, "LOW").otherwise("MEDIUM"), F.lit(0), days,
        F.array(
            _text("Amount matches exactly (₹", money(F.col("ba")), ")"),
            _text("Bank date is ", F.col("bd"), " vs Company date ", F.col("cd")),
            _text("Timing gap of ", days, " day(s) (likely clearing/settlement delay)"),
        ),
    )
    return composite.unionByName(amounts).unionByName(dates)


def _missing(rows: DataFrame, kind: str, evidence: Column) -> DataFrame:
    rows = rows.withColumns({"transaction_id": F.col("id"), "candidate_transaction_id": F.lit(None).cast("string")})
    severity = F.when(F.col("amount") >= LARGE, "HIGH").otherwise("MEDIUM")
    return _anomaly(rows, kind, severity, F.col("amount"), F.lit(0), evidence)


def missing_in_company(matches: DataFrame, bank: DataFrame) -> DataFrame:
    rows = bank.join(matches.filter("status = 'UNMATCHED'").select(F.col("bank_transaction_id").alias("id")), "id", "left_semi")
    return _missing(rows, "MISSING_IN_COMPANY", F.array(
        _text("Bank record ₹", money(F.col("amount")), " (", F.col("description"), ") has no ledger match"),
        _text("Transaction date: ", F.col("date")),
        F.lit("Requires investigation: possible unrecorded bank charge, fee, or missing entry"),
    ))


def missing_in_bank(unmatched_company: DataFrame) -> DataFrame:
    return _missing(unmatched_company, "MISSING_IN_BANK", F.array(
        _text("Company ledger shows ₹", money(F.col("amount")), " (", F.col("description"), ") with no bank statement record"),
        _text("Entry date: ", F.col("date")),
        F.lit("Possible unpresented cheque, delayed deposit, or omitted entry"),
    ))


def detect_anomalies(bank: DataFrame, company: DataFrame, matches: DataFrame, unmatched_company: DataFrame) -> DataFrame:
    """All kinds in one schema."""
    parts = [
        bank_duplicates(bank), company_duplicates(company), match_anomalies(matches, bank, company),
        missing_in_company(matches, bank), missing_in_bank(unmatched_company),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Type, confidence, risk (null: by severity or difference), finding, conclusion, action; {d} days, {a} amount.
FINDINGS = [
    ("DATE_MISMATCH", 0.94, "LOW", "Likely timing difference ({d} days)",
     "Transaction matches in amount and description; posting lag of {d} day(s) is typical for inter-bank clearing cycles (RTGS/NEFT/UPI).",
     "Confirm match (legitimate timing mismatch)"),
    ("AMOUNT_MISMATCH", 0.86, None, "Amount mismatch of ₹{a}",
     "Primary payee and date correlate, but net amount diverges by ₹{a}. Possible bank processing surcharge, GST deduction, or currency exchange fee.",
     "Inspect invoice and bank surcharge line items before confirming"),
    ("DUPLICATE_TRANSACTION", 0.91, None, "Potential duplicate transaction detected",
     "Identical monetary amount appears in close proximity. High risk of vendor double-payment or inadvertent dual batch entry.",
     "Mark duplicate and request immediate accounts verification"),
    ("COMPOSITE_MATCH", 0.89, "LOW", "Composite / Split payment matched",
     "The single bank transaction equals the combined sum of two distinct company ledger records.", "Confirm composite match"),
    ("MISSING_IN_COMPANY", 0.92, "HIGH", "Unrecorded bank withdrawal / transaction",
     "Bank statement shows a transaction that has no corresponding ledger entry in internal company books. Possible unrecorded direct debit, standing order, or core banking fee.",
     "Create journal entry in accounting ledger or investigate counterparty"),
    ("MISSING_IN_BANK", 0.88, "MEDIUM", "Outstanding company ledger entry",
     "Company accounts show an entry with no settlement on the bank statement. Typical of unpresented cheques or pending customer deposit clearance.",
     "Monitor next statement cycle for bank clearing"),
]
OTHER_FINDING = (0.80, "MEDIUM", "Financial exception identified", "Transaction requires human auditor verification.", "Review transaction details")


def investigate(anomalies: DataFrame) -> DataFrame:
    """Add ``finding``, ``conclusion``, ``finding_confidence``, ``risk`` and ``recommended_action`` from a table of six rules."""
    rules = anomalies.sparkSession.createDataFrame(
        FINDINGS, "type string, finding_confidence double, rule_risk string, finding string, conclusion string, recommended_action string"
    )
    filled = lambda c: F.replace(
        F.replace(F.col(c), F.lit("{d}"), F.col("date_difference_days").cast("string")), F.lit("{a}"), money(F.col("amount_difference"))
    )
    by_case = F.when(F.col("type") == "AMOUNT_MISMATCH", F.when(F.col("amount_difference") > LARGE_DIFFERENCE, "HIGH").otherwise("MEDIUM")).when(
        F.col("type") == "DUPLICATE_TRANSACTION", F.when(F.col("severity") == "HIGH", "CRITICAL").otherwise("HIGH")
    )
    confidence, risk, finding, conclusion, action = OTHER_FINDING
    out = anomalies.join(F.broadcast(rules), "type", "left")  # six rows
    return out.select(
        *anomalies.columns, F.coalesce(filled("finding"), F.lit(finding)).alias("finding"),
        F.coalesce(filled("conclusion"), F.lit(conclusion)).alias("conclusion"),
        F.coalesce("finding_confidence", F.lit(confidence)).alias("finding_confidence"),
        F.coalesce("rule_risk", by_case, F.lit(risk)).alias("risk"),
        F.coalesce("recommended_action", F.lit(action)).alias("recommended_action"),
    )


def apply_anomaly_reviews(anomalies: DataFrame, matches: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlay reviews: the latest one gives the anomaly's status; any confirmation with a candidate makes that pair's matches sure."""
    latest = reviews.groupBy("anomaly_id").agg(
        F.max_by("action", "review_seq").alias("action"), F.max(F.col("action") == "CONFIRM_MATCH").alias("confirmed")
    )
    seen = anomalies.join(latest, anomalies.id == latest.anomaly_id, "left").drop("anomaly_id")
    status = F.when(F.col("action") == "CONFIRM_MATCH", "CONFIRMED").when(F.col("action").isNotNull(), "RESOLVED").otherwise(F.col("status"))
    pairs = seen.filter("confirmed and candidate_transaction_id is not null").select(
        F.col("transaction_id").alias("bank_transaction_id"), F.col("candidate_transaction_id").alias("company_transaction_id")
    ).distinct().withColumn("sure", F.lit(True))
    marked = matches.join(pairs, ["bank_transaction_id", "company_transaction_id"], "left")
    out = marked.withColumn("status", F.when(F.col("sure"), "MATCHED").otherwise(F.col("status"))).withColumn(
        "confidence", F.when(F.col("sure"), 1.0).otherwise(F.col("confidence"))
    )
    return seen.withColumn("status", status).select(anomalies.columns), out.select(matches.columns)


def apply_match_decisions(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions`` (``match_id``, ``decision`` confirm or reject, ``seq``): the last one of a match holds."""
    last = decisions.groupBy("match_id").agg(F.max_by("decision", "seq").alias("decision"))
    met = matches.join(last, matches.id == last.match_id, "left")
    status = F.when(F.col("decision") == "confirm", "MATCHED").when(F.col("decision") == "reject", "UNMATCHED").otherwise(F.col("status"))
    sure = F.when(F.col("decision") == "confirm", 1.0).when(F.col("decision") == "reject", 0.0).otherwise(F.col("confidence"))
    return met.withColumn("status", status).withColumn("confidence", sure).select(matches.columns)
