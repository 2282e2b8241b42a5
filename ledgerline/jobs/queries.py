"""Registered queries over statements and ledgers derived from the given tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import normalize as N
from ledgerline.functions import scoring as S
from ledgerline.functions.runtime import ensure_checkpoint_dir, stored
from ledgerline.jobs import fixtures as X
from ledgerline.jobs import oracles as O
from ledgerline.operators import anomalies as A
from ledgerline.operators import ingest as I
from ledgerline.operators import mapping as M
from ledgerline.operators import matching as R
from ledgerline.operators import reports as Q
from ledgerline.operators import validate as V
from ledgerline.sources import statements as T
from ledgerline.sources import store as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Normalization. DuckDB reads the formats that the derived rows hold; years out of range are tried no further there.
_DATE = """
coalesce(
  CASE WHEN regexp_full_match(t, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN try_strptime(t, '%d/%m/%Y') END,
  CASE WHEN regexp_full_match(t, '\\d{1,2}-\\d{1,2}-\\d{4}') THEN try_strptime(t, '%d-%m-%Y') END,
  CASE WHEN regexp_full_match(t, '\\d{4}-\\d{1,2}-\\d{1,2}') THEN try_strptime(t, '%Y-%m-%d') END,
  CASE WHEN regexp_full_match(t, '\\d{1,2}/\\d{1,2}/\\d{2}') THEN
    CASE WHEN substr(t, -2) BETWEEN '69' AND '89' THEN NULL ELSE try_strptime(t, '%d/%m/%y') END END,
  CASE WHEN regexp_full_match(t, '\\d{4}/\\d{1,2}/\\d{1,2}') THEN try_strptime(t, '%Y/%m/%d') END)::DATE"""
_NORMAL = f"""
{X.RAW_ROWS},
texts AS (SELECT *, trim(regexp_replace(trim(raw_date), '\\s+\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?', '')) AS t FROM raw_rows),
nums AS (
  SELECT *, {_DATE} AS date, trim(regexp_replace(coalesce(raw_description, ''), '\\s+', ' ', 'g')) AS description,
         try_cast(raw_debit AS decimal(18,2)) AS dv, try_cast(raw_credit AS decimal(18,2)) AS cv,
         abs(try_cast(regexp_replace(raw_amount, '[^0-9.\\-]', '', 'g') AS decimal(18,2))) AS av,
         CASE WHEN lower(raw_reference) = 'n/a' THEN NULL ELSE regexp_replace(raw_reference, '\\.0$', '') END AS reference,
         try_cast(raw_balance AS decimal(18,2)) AS balance
  FROM texts),
money AS (
  SELECT *,
         CASE WHEN dv > 0 AND coalesce(cv, 0) = 0 THEN dv WHEN cv > 0 AND coalesce(dv, 0) = 0 THEN cv WHEN dv > 0 AND cv > 0 THEN NULL WHEN av > 0 THEN av END AS amount,
         CASE WHEN dv > 0 AND coalesce(cv, 0) = 0 THEN 'DEBIT' WHEN cv > 0 AND coalesce(dv, 0) = 0 THEN 'CREDIT' WHEN dv > 0 AND cv > 0 THEN NULL
              WHEN av > 0 THEN CASE WHEN raw_type = 'Deposit' THEN 'CREDIT' WHEN raw_amount LIKE '%CR' THEN 'CREDIT' ELSE 'DEBIT' END END AS type,
         CASE WHEN dv > 0 AND cv > 0 THEN '{N.AMBIGUOUS}'
              WHEN coalesce(dv, 0) = 0 AND coalesce(cv, 0) = 0 AND coalesce(av, 0) = 0 THEN '{N.NO_VALID_AMOUNT}' END AS error
  FROM nums)"""


@query(f"{_NORMAL} SELECT parse_job_id, row_no, date::VARCHAR AS date, description, reference, balance::DOUBLE AS balance FROM money")
def n_normalize_fields(spark, sf_dir):
    """N1, N4, N5, N6."""
    rows = X.raw_rows(spark, sf_dir)
    return rows.select(
        "parse_job_id", "row_no", N.normalize_date(F.col("raw_date")).cast("string").alias("date"),
        N.normalize_description(F.col("raw_description")).alias("description"),
        N.normalize_reference(F.col("raw_reference")).alias("reference"),
        N.normalize_balance(F.col("raw_balance")).cast("double").alias("balance"),
    )


@query(f"{_NORMAL} SELECT parse_job_id, row_no, amount::DOUBLE AS amount, type, error FROM money")
def n_resolve_amounts(spark, sf_dir):
    """N2, N3."""
    money = N.resolve_amount_type(*[F.col(f"raw_{c}") for c in ("debit", "credit", "amount", "type")])
    return X.raw_rows(spark, sf_dir).select("parse_job_id", "row_no", money.alias("m")).select(
        "parse_job_id", "row_no", F.col("m.amount").cast("double").alias("amount"), "m.type", "m.error"
    )


def _normalized(spark, sf_dir):
    return V.normalize_rows(X.raw_rows(spark, sf_dir))


_ERRORS = f"""{_NORMAL},
errs AS (
  SELECT parse_job_id, row_no, 'date' AS field, raw_date AS raw_value, 'ERROR' AS severity, 'Missing or unparseable date.' AS message FROM money WHERE date IS NULL
  UNION ALL SELECT parse_job_id, row_no, 'description', raw_description, 'ERROR', 'Missing or empty transaction narration.' FROM money WHERE description = ''
  UNION ALL SELECT parse_job_id, row_no, 'amount',
    'debit=' || coalesce(raw_debit, 'None') || ', credit=' || coalesce(raw_credit, 'None') || ', amount=' || coalesce(raw_amount, 'None'), 'ERROR', error
    FROM money WHERE error IS NOT NULL
  UNION ALL SELECT parse_job_id, row_no, 'reference', coalesce(raw_reference, 'None'), 'WARNING', 'Reference / UTR / Cheque number is absent or blank.'
    FROM money WHERE reference IS NULL)"""


@query(f"{_ERRORS} SELECT parse_job_id, row_no AS row_number, 1 AS page_number, field, raw_value, severity, message FROM errs")
def v_validate_rows(spark, sf_dir):
    """V1."""
    return V.validate_rows(_normalized(spark, sf_dir))


_CANON = f"""{_NORMAL},
good AS (SELECT * FROM money WHERE date IS NOT NULL AND description <> '' AND error IS NULL),
canon AS (
  SELECT *, 'TXN_' || upper(substr(sha256('DEFAULT_ACC|' || date::VARCHAR || '|' || amount::VARCHAR || '|' || type || '|' || coalesce(reference, '')
         || '|' || upper(description) || '|' || row_no::VARCHAR), 1, 16)) AS transaction_id
  FROM good)"""


@query(f"""{_CANON} SELECT parse_job_id || '_' || transaction_id AS id, parse_job_id, date::VARCHAR AS date, description, amount::DOUBLE AS amount, type, reference,
       'INR' AS currency, balance::DOUBLE AS balance, transaction_id, 'FILE_' || parse_job_id AS file_id, row_no AS source_row FROM canon""")
def v_canonical_transactions(spark, sf_dir):
    """V2, V3, V4."""
    out = V.canonical_transactions(_normalized(spark, sf_dir))
    return out.select(
        "id", "parse_job_id", F.col("date").cast("string").alias("date"), "description", F.col("amount").cast("double").alias("amount"), "type", "reference", "currency",
        F.col("balance").cast("double").alias("balance"), "transaction_id", "provenance.file_id", "source_row",
    )


@query(f"""{_ERRORS},
e AS (SELECT parse_job_id, count(*) FILTER (severity = 'WARNING') AS warning_count, count(*) FILTER (severity <> 'WARNING') AS error_count FROM errs GROUP BY 1)
SELECT m.parse_job_id, count(*) AS total_rows, count(*) FILTER (date IS NOT NULL AND description <> '' AND error IS NULL) AS valid_rows,
       max(warning_count) AS warning_count, max(error_count) AS error_count
FROM money m JOIN e USING (parse_job_id) GROUP BY 1""")
def v_job_counters(spark, sf_dir):
    """V5."""
    return V.job_counters(_normalized(spark, sf_dir))


@query(f"""{_CANON},
t AS (
  SELECT parse_job_id, coalesce(sum(amount) FILTER (type = 'DEBIT'), 0) AS deb, coalesce(sum(amount) FILTER (type = 'CREDIT'), 0) AS cre, count(*) AS n,
         arg_min(balance + CASE WHEN type = 'DEBIT' THEN amount ELSE -amount END, row_no) FILTER (balance IS NOT NULL) AS opening,
         arg_max(balance, row_no) FILTER (balance IS NOT NULL) AS closing
  FROM canon GROUP BY 1)
SELECT parse_job_id, deb::DOUBLE AS total_debits, cre::DOUBLE AS total_credits, n AS transaction_count, opening::DOUBLE AS opening_balance,
       closing::DOUBLE AS closing_balance, (opening + cre - deb)::DOUBLE AS expected_closing, (closing - (opening + cre - deb))::DOUBLE AS difference,
       CASE WHEN opening IS NULL THEN 'NOT_APPLICABLE' WHEN abs(closing - (opening + cre - deb)) < 0.01 THEN 'VERIFIED' ELSE 'CONTROL_TOTAL_MISMATCH' END AS status
FROM t""")
def c_control_totals(spark, sf_dir):
    """C1."""
    out = V.control_totals(V.canonical_transactions(_normalized(spark, sf_dir)))
    return out.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in out.dtypes])


# Scores, on pairs that share a reference.
@query(f"""{X.BOTH},
p AS (SELECT b.id AS b_id, c.id AS c_id, b.amount AS x, c.amount AS y, abs(b.amount - c.amount) AS diff, greatest(b.amount, c.amount) AS top,
             abs(date_diff('day', b.date, c.date)) AS days
      FROM bank b JOIN ledger c ON b.reconciliation_id = c.reconciliation_id AND b.type = c.type AND b.reference = c.reference)
SELECT b_id, c_id, days::INT AS days, diff::DOUBLE AS diff, 1.0::DOUBLE AS reference_score,
       CASE WHEN diff = 0 THEN 1.0 WHEN diff * 200 <= top THEN 0.95 WHEN diff * 50 <= top THEN 0.85 WHEN diff * 20 <= top THEN 0.60
            WHEN diff * 10 <= top THEN 0.30 ELSE 0 END::DOUBLE AS amount_score,
       CASE days WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 WHEN 4 THEN 0.4 WHEN 5 THEN 0.4 ELSE 0 END::DOUBLE AS date_score
FROM p""")
def p_pair_scores(spark, sf_dir):
    """P1, P2, P4 on the pairs of its SQL, which share a reference; p_match_scores has the other cases of P4."""
    bank, ledger = X.sides(spark, sf_dir)
    own = lambda d, p: d.select("reconciliation_id", "type", "reference", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "amount", "date", "reference")])
    b, c = own(bank, "b"), own(ledger, "c")
    days = S.days_apart(F.col("b_date"), F.col("c_date"))
    return b.join(c, ["reconciliation_id", "type", "reference"]).select(
        "b_id", "c_id", days.alias("days"), F.abs(F.col("b_amount") - F.col("c_amount")).cast("double").alias("diff"),
        S.reference_score(F.col("b_reference"), F.col("c_reference")).alias("reference_score"),
        S.amount_score(F.col("b_amount"), F.col("c_amount")).alias("amount_score"), S.date_score(days).alias("date_score"),
    )


@query(f"""{O.SCORED}
SELECT min(b) AS b_id, min(c) AS c_id, count(DISTINCT b) AS n_bank, count(DISTINCT c) AS n_company, any_value(days) AS days, any_value(amt) AS amount_score, any_value(dat) AS date_score,
       any_value(ref) AS reference_score, any_value(descr) AS desc_score, any_value(conf) AS confidence, any_value(why1 || ' | ' || why2 || why3) AS reasons
FROM scored WHERE could >= 0.75 GROUP BY reconciliation_id, type, ba, ca, bd, cd, bt, ct, bref, cref""")
def p_match_scores(spark, sf_dir):
    """P1 to P6 on all pairs of classes that can reach the fuzzy threshold, whatever their references; a class stands by its first id and its size."""
    bank, ledger = X.sides(spark, sf_dir)
    scored = R.score_pairs(R.fuzzy_candidates(bank, ledger))
    for p, side, name in (("b", bank, "n_bank"), ("c", ledger, "n_company")):
        members = R._rows(side, p).groupBy(f"{p}_cls").agg(F.min(f"{p}_id").alias(f"{p}_id"), F.count(F.lit(1)).alias(name))
        scored = scored.join(members, f"{p}_cls")
    return scored.select("b_id", "c_id", "n_bank", "n_company", "days", "amount_score", "date_score", "reference_score", "desc_score", "confidence", F.array_join("reasons", " | ").alias("reasons"))


@query(f"""{X.BOTH}
SELECT reconciliation_id, count(*) FILTER (source_type = 'BANK_STATEMENT') AS bank_count, count(*) FILTER (source_type = 'ACCOUNTING_LEDGER') AS company_count,
       true AS bank_ready, true AS company_ready, true AS can_start
FROM (SELECT reconciliation_id, source_type FROM bank UNION ALL SELECT reconciliation_id, source_type FROM ledger) GROUP BY 1""")
def r_input_status(spark, sf_dir):
    """R2."""
    bank, ledger = X.sides(spark, sf_dir)
    return R.input_status(bank.unionByName(ledger))


@query(f"""{X.BOTH} SELECT source_type, reconciliation_id, count(*) AS rows, sum(amount)::DOUBLE AS amount
FROM (SELECT * FROM bank UNION ALL SELECT * FROM ledger) GROUP BY ALL""")
def r_split_sides(spark, sf_dir):
    """R1."""
    bank, ledger = X.sides(spark, sf_dir)
    b, c = R.split_sides(bank.unionByName(ledger))
    return b.unionByName(c).groupBy("source_type", "reconciliation_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").cast("double").alias("amount")
    )


_MATCH = ["bank_transaction_id", "company_transaction_id", "status", "match_type"]


@query(f"""{X.BOTH}
SELECT b.id AS bank_transaction_id, c.id AS company_transaction_id, 'MATCHED' AS status, 'EXACT' AS match_type, true AS sure
FROM bank b JOIN ledger c ON b.reconciliation_id = c.reconciliation_id AND b.type = c.type AND b.amount = c.amount AND b.date = c.date AND b.reference = c.reference""")
def r_exact(spark, sf_dir):
    """R3. The derived rows that agree in amount and date have references that occur once, so an equi-join is its SQL."""
    bank, ledger = X.sides(spark, sf_dir)
    return R.match_exact(bank, ledger).select(*_MATCH, (F.col("confidence") >= 0.95).alias("sure"))


@query(f"""{X.BOTH},
p AS (SELECT b.id AS b, c.id AS c, b.amount AS x, c.amount AS y, abs(date_diff('day', b.date, c.date)) AS days,
             row_number() OVER (PARTITION BY c.id ORDER BY b.date, b.source_row, b.id) AS turn
      FROM bank b JOIN ledger c ON b.reconciliation_id = c.reconciliation_id AND b.type = c.type AND b.reference = c.reference)
SELECT b AS bank_transaction_id, c AS company_transaction_id, 'REFERENCE' AS match_type, days::INT AS date_difference_days, abs(x - y)::DOUBLE AS amount_difference
FROM p WHERE turn = 1""")
def r_reference(spark, sf_dir):
    """R4 on whole sides: a reference names one ledger row, which goes to the first bank row."""
    bank, ledger = X.sides(spark, sf_dir)
    out = R.match_reference(bank, ledger)
    return out.select(*_MATCH[:2], "match_type", "date_difference_days", F.col("amount_difference").cast("double").alias("amount_difference"))


def _shown(matches: DataFrame, *more: str) -> DataFrame:
    """Match results with lists as texts and amounts as doubles."""
    texts = {"company_ids": F.array_join("company_ids", "+"), "reasons": F.array_join("reasons", " | "), "amount_difference": F.col("amount_difference").cast("double")}
    names = [c.split(" AS ")[-1] for c in O.SHOWN.split(", ")]
    return matches.withColumns(texts).select(*more, *names)


@query(f"{O.stage_alone('exact', O.EXACT)} SELECT {O.SHOWN} FROM results")
def r_exact_results(spark, sf_dir):
    """R3 with scores, confidence and reasons."""
    return _shown(R.match_exact(*X.sides(spark, sf_dir)))


@query(f"{O.stage_alone('reference', O.REFERENCE)} SELECT {O.SHOWN} FROM results")
def r_reference_results(spark, sf_dir):
    """R4 with scores, confidence, status and reasons."""
    return _shown(R.match_reference(*X.sides(spark, sf_dir)))


@query(f"{O.stage_alone('fuzzy', O.FUZZY)} SELECT {O.SHOWN} FROM results")
def r_fuzzy(spark, sf_dir):
    """R5 on whole sides."""
    return _shown(R.match_fuzzy(*X.sides(spark, sf_dir)))


@query(f"{O.stage_alone('tolerant', O.TOLERANT)} SELECT {O.SHOWN} FROM results")
def r_date_tolerance(spark, sf_dir):
    """R6 on whole sides."""
    return _shown(R.match_date_tolerance(*X.sides(spark, sf_dir)))


@query(f"{O.COMPOSITE} SELECT {O.SHOWN} FROM two_results")
def r_composite(spark, sf_dir):
    """R7 on whole sides."""
    return _shown(R.match_composite(*X.sides(spark, sf_dir)))


@query(f"{O.MATCHED} SELECT id, {O.SHOWN} FROM {O.NAMED_MATCHES}")
def r_match_pipeline(spark, sf_dir):
    """R3 to R10: one result for each bank row."""
    return _shown(R.match_pipeline(*X.sides(spark, sf_dir))[0], "id")


@query(f"""{X.BOTH} SELECT b.id AS bank_transaction_id, b.amount::DOUBLE AS amount_difference, 'UNMATCHED' AS status
FROM bank b WHERE NOT EXISTS (SELECT 1 FROM ledger c WHERE c.reconciliation_id = b.reconciliation_id AND c.type = b.type AND c.amount = b.amount
  AND c.date = b.date AND c.reference = b.reference)""")
def r_unmatched_bank(spark, sf_dir):
    """R8 after the exact stage."""
    bank, ledger = X.sides(spark, sf_dir)
    left = R.unmatched_bank(bank, R.match_exact(bank, ledger))
    return left.select("bank_transaction_id", F.col("amount_difference").cast("double").alias("amount_difference"), "status")


@query(f"""{X.BOTH} SELECT c.id, c.amount::DOUBLE AS amount
FROM ledger c WHERE NOT EXISTS (SELECT 1 FROM bank b WHERE c.reconciliation_id = b.reconciliation_id AND c.type = b.type AND c.amount = b.amount
  AND c.date = b.date AND c.reference = b.reference)""")
def r_unmatched_company(spark, sf_dir):
    """R9 after the exact stage."""
    bank, ledger = X.sides(spark, sf_dir)
    return R.unmatched_company(ledger, R.match_exact(bank, ledger)).select("id", F.col("amount").cast("double").alias("amount"))


def _run(spark, sf_dir):
    bank, ledger = (stored(s) for s in X.sides(spark, sf_dir))
    matches, left = R.match_pipeline(bank, ledger)
    matches = stored(matches)
    return bank, ledger, matches, A.detect_anomalies(bank, ledger, matches, left)


@query(f"""{O.ANOMALIES},
counted AS (SELECT reconciliation_id, count(*) AS total_bank, count(*) FILTER (status = 'MATCHED') AS matched_count, count(*) FILTER (status = 'PROBABLE_MATCH') AS probable_count,
                   count(*) FILTER (status = 'UNMATCHED') AS unmatched_count FROM results GROUP BY 1),
odd AS (SELECT reconciliation_id, count(*) AS n FROM anomalies GROUP BY 1)
SELECT c.*, coalesce(n, 0) AS anomaly_count, CASE WHEN coalesce(n, 0) = 0 AND matched_count = total_bank THEN 'COMPLETED' ELSE 'REVIEW_REQUIRED' END AS run_status
FROM counted c LEFT JOIN odd USING (reconciliation_id)""")
def r_run_summary(spark, sf_dir):
    """R11."""
    _, _, matches, found = _run(spark, sf_dir)
    return R.run_summary(matches, found)


@query(f"""{X.BOTH}
SELECT a.id AS transaction_id, b.id AS candidate_transaction_id, abs(date_diff('day', a.date, b.date))::INT AS date_difference_days, 'HIGH' AS severity
FROM bank a JOIN bank b ON a.reconciliation_id = b.reconciliation_id AND a.type = b.type AND a.amount = b.amount AND abs(date_diff('day', a.date, b.date)) <= 1
 AND (a.date, a.source_row, a.id) < (b.date, b.source_row, b.id) AND a.description = b.description""")
def a_bank_duplicates(spark, sf_dir):
    """A1. Derived duplicates have equal texts."""
    return A.bank_duplicates(X.sides(spark, sf_dir)[0]).select("transaction_id", "candidate_transaction_id", "date_difference_days", "severity")


@query(f"""{X.BOTH}
SELECT a.id AS transaction_id, b.id AS candidate_transaction_id, abs(date_diff('day', a.date, b.date))::INT AS date_difference_days, 'MEDIUM' AS severity
FROM ledger a JOIN ledger b ON a.reconciliation_id = b.reconciliation_id AND a.type = b.type AND a.amount = b.amount AND abs(date_diff('day', a.date, b.date)) <= 1
 AND (a.date, a.source_row, a.id) < (b.date, b.source_row, b.id) AND a.description = b.description""")
def a_company_duplicates(spark, sf_dir):
    """A2."""
    return A.company_duplicates(X.sides(spark, sf_dir)[1]).select("transaction_id", "candidate_transaction_id", "date_difference_days", "severity")


@query(f"""{X.BOTH.replace('WITH', 'WITH RECURSIVE', 1)},
pairs AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM bank a JOIN bank b ON a.reconciliation_id = b.reconciliation_id AND a.type = b.type AND a.amount = b.amount
  AND abs(date_diff('day', a.date, b.date)) <= 1 AND a.id <> b.id AND a.description = b.description),
reach AS (SELECT x AS id, x AS other FROM pairs UNION SELECT id, y FROM reach JOIN pairs ON other = x),
links AS (SELECT x AS id, count(*) AS n_links FROM pairs GROUP BY 1)
SELECT r.id, arg_min(other, (b.date, b.source_row, b.id)) AS group_id, count(*) AS group_size, any_value(n_links) AS n_links
FROM reach r JOIN bank b ON b.id = other JOIN links l ON l.id = r.id GROUP BY r.id""")
def a_duplicate_groups(spark, sf_dir):
    """A1 by membership. Derived duplicates have equal texts."""
    return A.duplicate_groups(X.sides(spark, sf_dir)[0], 0.80)


@query(f"""{X.BOTH}
SELECT id AS transaction_id, 'MISSING_IN_BANK' AS type, CASE WHEN amount >= 10000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, amount::DOUBLE AS amount_difference
FROM ledger c WHERE reference IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bank b WHERE b.reference = c.reference AND b.reconciliation_id = c.reconciliation_id AND b.type = c.type)""")
def a_missing_in_bank(spark, sf_dir):
    """A5, with R9 after the reference stage."""
    bank, ledger = X.sides(spark, sf_dir)
    left = R.unmatched_company(ledger, R.match_reference(bank, ledger)).filter("reference is not null")
    return A.missing_in_bank(left).select("transaction_id", "type", "severity", F.col("amount_difference").cast("double").alias("amount_difference"))


def _evidence(found: DataFrame, *more: str) -> DataFrame:
    """Anomalies with evidence as one text and amounts as doubles."""
    texts = {"evidence": F.array_join("evidence", " | "), "amount_difference": F.col("amount_difference").cast("double")}
    return found.withColumns(texts).select(*O.ANOMALY.split(", "), *more)


@query(f"{O.ANOMALIES} SELECT {O.ANOMALY} FROM anomalies")
def a_detect_anomalies(spark, sf_dir):
    """A1 to A6."""
    return _evidence(_run(spark, sf_dir)[3])


_FOUND = O.findings(A.FINDINGS, A.OTHER_FINDING, A.LARGE_DIFFERENCE)
_FINDING = "finding, conclusion, finding_confidence, risk, recommended_action"


@query(f"{O.ANOMALIES}{_FOUND} SELECT {O.ANOMALY}, {_FINDING} FROM found_out")
def a_investigate(spark, sf_dir):
    """A7."""
    return _evidence(A.investigate(_run(spark, sf_dir)[3]), *_FINDING.split(", "))


def _last_character(c: str):
    return F.ascii(F.right(F.col(c), F.lit(1)))


def _reviews(found: DataFrame) -> DataFrame:
    """Reviews of every anomaly, by its id: two of each third, so that the latest one counts."""
    n = _last_character("id") % 3
    actions = F.array(F.lit("CONFIRM_MATCH"), F.lit("REJECT_MATCH"), F.lit("MARK_RESOLVED"))
    first = found.select(F.col("id").alias("anomaly_id"), F.element_at(actions, n + 1).alias("action"), F.lit(1).alias("review_seq"))
    again = found.filter(n == 0).select(F.col("id").alias("anomaly_id"), F.lit("MARK_RESOLVED").alias("action"), F.lit(2).alias("review_seq"))
    return first.unionByName(again)


@query(f"""{O.ANOMALIES},
sure AS (SELECT DISTINCT transaction_id AS b, candidate_transaction_id AS c FROM anomalies WHERE candidate_transaction_id IS NOT NULL AND ascii(right(id, 1)) % 3 = 0)
SELECT m.id, m.bank_transaction_id, m.company_transaction_id, CASE WHEN s.b IS NOT NULL THEN 'MATCHED' ELSE m.status END AS status,
       CASE WHEN s.b IS NOT NULL THEN 1.0::DOUBLE ELSE m.confidence END AS confidence
FROM {O.NAMED_MATCHES} m LEFT JOIN sure s ON s.b = m.bank_transaction_id AND s.c = m.company_transaction_id""")
def a_apply_reviews(spark, sf_dir):
    """A8, its matches: a confirmation of a pair holds although a later review of the anomaly is another action."""
    _, _, matches, found = _run(spark, sf_dir)
    found = stored(found)
    out = A.apply_anomaly_reviews(found, matches, _reviews(found))[1]
    return out.select("id", "bank_transaction_id", "company_transaction_id", "status", "confidence")


@query(f"{O.ANOMALIES} SELECT id, type, 'RESOLVED' AS status FROM anomalies")
def a_reviewed_anomalies(spark, sf_dir):
    """A8, its anomalies: the latest action of each review is none that confirms."""
    _, _, matches, found = _run(spark, sf_dir)
    found = stored(found)
    return A.apply_anomaly_reviews(found, matches, _reviews(found))[0].select("id", "type", "status")


@query(f"""{O.MATCHED}
SELECT id, CASE WHEN m.status <> 'PROBABLE_MATCH' THEN m.status WHEN ascii(right(id, 1)) % 2 = 0 THEN 'MATCHED' ELSE 'UNMATCHED' END AS status,
       CASE WHEN m.status <> 'PROBABLE_MATCH' THEN confidence WHEN ascii(right(id, 1)) % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM {O.NAMED_MATCHES} m""")
def a_apply_decisions(spark, sf_dir):
    """A9."""
    matches = _run(spark, sf_dir)[2]
    decided = matches.filter("status = 'PROBABLE_MATCH'").select(
        F.col("id").alias("match_id"), F.when(_last_character("id") % 2 == 0, "confirm").otherwise("reject").alias("decision"), F.lit(1).alias("seq")
    )
    return A.apply_match_decisions(matches, decided).select("id", "status", "confidence")


def _runs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.concat(F.lit("REC_"), (F.col("o_custkey") % 16).cast("string")).alias("reconciliation_id"),
        F.concat(F.lit("RUN_"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderdate").alias("started_at"),
    )


@query("""
SELECT reconciliation_id, run_id, started_at::VARCHAR AS started_at FROM (
  SELECT 'REC_' || (o_custkey % 16)::VARCHAR AS reconciliation_id, 'RUN_' || o_orderkey::VARCHAR AS run_id, o_orderdate AS started_at FROM orders)
QUALIFY row_number() OVER (PARTITION BY reconciliation_id ORDER BY started_at DESC, run_id DESC) = 1""")
def q_latest_run(spark, sf_dir):
    """Q1."""
    return Q.latest_run(_runs(spark, sf_dir)).withColumn("started_at", F.col("started_at").cast("string"))


@query(f"""{O.ANOMALIES},
m AS (SELECT reconciliation_id, count(*) AS total_bank_transactions, count(*) FILTER (status = 'MATCHED') AS matched, count(*) FILTER (status = 'PROBABLE_MATCH') AS probable,
             count(*) FILTER (status = 'UNMATCHED') AS unmatched FROM results GROUP BY 1),
x AS (SELECT reconciliation_id, count(*) AS anomalies, count(*) FILTER (type = 'DUPLICATE_TRANSACTION') AS duplicates, sum(amount_difference::DECIMAL(18,2))::DOUBLE AS total_difference
      FROM anomalies GROUP BY 1),
l AS (SELECT reconciliation_id, count(*) AS company_rows FROM ledger GROUP BY 1)
SELECT m.*, coalesce(x.anomalies, 0) AS anomalies, coalesce(duplicates, 0) AS duplicates, coalesce(total_difference, 0) AS total_difference, coalesce(company_rows, 0) AS company_rows,
       matched + probable AS total_company_transactions, CASE WHEN coalesce(x.anomalies, 0) = 0 AND probable = 0 THEN 'RECONCILIATION COMPLETE' ELSE 'REVIEW REQUIRED' END AS headline
FROM m LEFT JOIN x USING (reconciliation_id) LEFT JOIN l USING (reconciliation_id)""")
def q_reconciliation_summary(spark, sf_dir):
    """Q2."""
    _, ledger, matches, found = _run(spark, sf_dir)
    return Q.reconciliation_summary(matches, found, ledger).withColumn("total_difference", F.col("total_difference").cast("double"))


@query(f"""{O.MATCHED}
SELECT m.id, {O.SHOWN.replace("reconciliation_id,", "m.reconciliation_id,", 1)}, b.description AS bank_description, b.amount::DOUBLE AS bank_amount, b.date::VARCHAR AS bank_date,
       c.description AS company_description, c.amount::DOUBLE AS company_amount, c.date::VARCHAR AS company_date
FROM {O.NAMED_MATCHES} m LEFT JOIN bank b ON b.id = m.bank_transaction_id LEFT JOIN ledger c ON c.id = m.company_transaction_id""")
def q_matches_report(spark, sf_dir):
    """Q3."""
    bank, ledger, matches, _ = _run(spark, sf_dir)
    out = Q.matches_report(matches, bank, ledger)
    both = [f"{p}_{c}" for p in ("bank", "company") for c in ("description", "amount", "date")]
    plain = {c: F.col(c).cast("string" if c.endswith("date") else "double") for c in both if not c.endswith("description")}
    return _shown(out.withColumns(plain), "id", *both)


@query(f"""{O.ANOMALIES}{_FOUND},
both_sides AS (SELECT * FROM bank UNION ALL SELECT * FROM ledger)
SELECT f.id, f.reconciliation_id, transaction_id, candidate_transaction_id, f.type, severity, amount_difference, date_difference_days, evidence, {_FINDING},
       t.description AS transaction_description, t.amount::DOUBLE AS transaction_amount, t.date::VARCHAR AS transaction_date,
       c.description AS candidate_description, c.amount::DOUBLE AS candidate_amount, c.date::VARCHAR AS candidate_date
FROM found_out f LEFT JOIN both_sides t ON t.id = transaction_id LEFT JOIN both_sides c ON c.id = candidate_transaction_id""")
def q_anomalies_report(spark, sf_dir):
    """Q4."""
    bank, ledger, _, found = _run(spark, sf_dir)
    out = Q.anomalies_report(A.investigate(found), bank.unionByName(ledger))
    both = [f"{p}_{c}" for p in ("transaction", "candidate") for c in ("description", "amount", "date")]
    plain = {c: F.col(c).cast("string" if c.endswith("date") else "double") for c in both if not c.endswith("description")}
    return _evidence(out.withColumns(plain), *_FINDING.split(", "), *both)


# Two stored runs of every reconciliation.
_STARTS = ("2026-10-05 10:00:00", "2026-10-06 10:00:00")


def _stored_runs(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/runs-{uuid.uuid4().hex}"
    bank, ledger, matches, found = _run(spark, sf_dir)
    found = stored(A.investigate(found))
    for at in _STARTS:
        P.save_runs(path, P.new_runs(bank, at), matches, found, ledger)
    return path, bank, ledger


_RUNS = f"""
runs AS MATERIALIZED (SELECT reconciliation_id, began, 'RECON_' || upper(substr(sha256(reconciliation_id || '|' || began), 1, 10)) AS run_id
  FROM (SELECT DISTINCT reconciliation_id FROM bank), (VALUES ('{_STARTS[0]}'), ('{_STARTS[1]}')) v(began)),
run_matches AS MATERIALIZED (SELECT r.run_id, m.*, 'MATCH_' || upper(substr(sha256(r.run_id || '|' || match_type || '|' || bank_transaction_id || '|' || coalesce(company_transaction_id, '')), 1, 10)) AS run_match
  FROM results m JOIN runs r USING (reconciliation_id))"""
_RUN_ANOMALIES = """,
run_anomalies AS MATERIALIZED (SELECT r.run_id, r.began, a.*, 'ANOM_' || upper(substr(sha256(r.run_id || '|' || type || '|' || transaction_id || '|' || coalesce(candidate_transaction_id, '')), 1, 10)) AS run_anomaly
  FROM anomalies a JOIN runs r USING (reconciliation_id))"""


@query(f"""{O.MATCHED},{_RUNS}
SELECT run_id, run_match AS id, m.reconciliation_id, bank_transaction_id, company_transaction_id, m.status, confidence, b.amount::DOUBLE AS bank_amount, c.amount::DOUBLE AS company_amount
FROM run_matches m LEFT JOIN bank b ON b.id = bank_transaction_id LEFT JOIN ledger c ON c.id = company_transaction_id""")
def q_matches_of_all_runs(spark, sf_dir):
    """Q3 over the store: the matches of two runs side by side."""
    path, bank, ledger = _stored_runs(spark, sf_dir)
    out = Q.matches_report(P.read_of_runs(spark, path, "matches"), bank, ledger)
    money = [F.col(c).cast("double").alias(c) for c in ("bank_amount", "company_amount")]
    return out.select("run_id", "id", "reconciliation_id", "bank_transaction_id", "company_transaction_id", "status", "confidence", *money)


@query(f"""{O.ANOMALIES},{_RUNS}{_RUN_ANOMALIES},
latest AS (SELECT reconciliation_id, max_by(run_id, began) AS run_id FROM runs GROUP BY 1),
m AS (SELECT run_id, count(*) AS total_bank_transactions, count(*) FILTER (status = 'MATCHED') AS matched, count(*) FILTER (status = 'PROBABLE_MATCH') AS probable, count(*) FILTER (status = 'UNMATCHED') AS unmatched
      FROM run_matches GROUP BY 1),
x AS (SELECT run_id, count(*) AS anomalies, count(*) FILTER (type = 'DUPLICATE_TRANSACTION') AS duplicates, sum(amount_difference::DECIMAL(18,2))::DOUBLE AS total_difference FROM run_anomalies GROUP BY 1),
l AS (SELECT reconciliation_id, count(*) AS company_rows FROM ledger GROUP BY 1)
SELECT latest.*, coalesce(company_rows, 0) AS company_rows, total_bank_transactions, matched, probable, unmatched, coalesce(anomalies, 0) AS anomalies, coalesce(duplicates, 0) AS duplicates,
       coalesce(total_difference, 0) AS total_difference, matched + probable AS total_company_transactions,
       CASE WHEN coalesce(anomalies, 0) = 0 AND probable = 0 THEN 'RECONCILIATION COMPLETE' ELSE 'REVIEW REQUIRED' END AS headline
FROM latest JOIN m USING (run_id) LEFT JOIN x USING (run_id) LEFT JOIN l USING (reconciliation_id)""")
def q_summary_of_latest_run(spark, sf_dir):
    """Q1 and Q2 over the store: of two runs the later one counts."""
    path, _, _ = _stored_runs(spark, sf_dir)
    latest = stored(Q.latest_run(P.read_runs(spark, path)))
    out = Q.summary_of_runs(latest, P.read_of_runs(spark, path, "matches", latest), P.read_of_runs(spark, path, "anomalies", latest))
    return out.withColumn("total_difference", F.col("total_difference").cast("double"))


@query(f"""{O.ANOMALIES},{_RUNS}{_RUN_ANOMALIES},
sums AS (SELECT run_id, count(*) AS total_bank, count(*) FILTER (status = 'MATCHED') AS matched_count, count(*) FILTER (status = 'PROBABLE_MATCH') AS probable_count,
                count(*) FILTER (status = 'UNMATCHED') AS unmatched_count FROM run_matches GROUP BY 1),
odd AS (SELECT run_id, count(*) AS n FROM run_anomalies GROUP BY 1)
SELECT r.reconciliation_id, s.*, coalesce(n, 0) AS anomaly_count, CASE WHEN coalesce(n, 0) = 0 AND matched_count = total_bank THEN 'COMPLETED' ELSE 'REVIEW_REQUIRED' END AS run_status
FROM runs r JOIN sums s USING (run_id) LEFT JOIN odd USING (run_id)""")
def r_stored_run_summaries(spark, sf_dir):
    """R11 over the store: a row for each run."""
    return P.read_runs(spark, _stored_runs(spark, sf_dir)[0]).drop("started_at", "company_rows")


def _reviewed_runs(spark, sf_dir):
    """Reviews of the first runs' anomalies, a third confirmed and a third rejected, laid over both runs."""
    path, _, _ = _stored_runs(spark, sf_dir)
    found = P.read_of_runs(spark, path, "anomalies")
    first = P.read_runs(spark, path).filter(F.col("started_at") == F.lit(_STARTS[0]).cast("timestamp")).select("run_id")
    n = _last_character("id") % 3
    action = F.when(n == 0, "CONFIRM_MATCH").otherwise("REJECT_MATCH").alias("action")
    events = found.join(first, "run_id", "left_semi").filter(n < 2).select(F.col("id").alias("anomaly_id"), action, F.lit(1).alias("review_seq"))
    P.append_events(events, path, "reviews")
    return A.apply_anomaly_reviews(found, P.read_of_runs(spark, path, "matches"), spark.read.parquet(f"{path}/reviews"))


@query(f"""{O.ANOMALIES},{_RUNS}{_RUN_ANOMALIES},
sure AS (SELECT DISTINCT transaction_id AS b, candidate_transaction_id AS c FROM run_anomalies WHERE began = '{_STARTS[0]}' AND candidate_transaction_id IS NOT NULL AND ascii(right(run_anomaly, 1)) % 3 = 0)
SELECT run_id, run_match AS id, bank_transaction_id, CASE WHEN s.b IS NOT NULL THEN 'MATCHED' ELSE status END AS status, CASE WHEN s.b IS NOT NULL THEN 1.0::DOUBLE ELSE confidence END AS confidence
FROM run_matches m LEFT JOIN sure s ON s.b = m.bank_transaction_id AND s.c = m.company_transaction_id""")
def a_confirmed_in_all_runs(spark, sf_dir):
    """A8 over the store: what is confirmed in one run is sure in every run."""
    return _reviewed_runs(spark, sf_dir)[1].select("run_id", "id", "bank_transaction_id", "status", "confidence")


@query(f"""{O.ANOMALIES},{_RUNS}{_RUN_ANOMALIES}
SELECT run_id, run_anomaly AS id, type, CASE WHEN began <> '{_STARTS[0]}' OR ascii(right(run_anomaly, 1)) % 3 = 2 THEN 'PENDING' WHEN ascii(right(run_anomaly, 1)) % 3 = 0 THEN 'CONFIRMED' ELSE 'RESOLVED' END AS status
FROM run_anomalies""")
def a_statuses_of_all_runs(spark, sf_dir):
    """A8 over the store: a review is of an anomaly of one run."""
    return _reviewed_runs(spark, sf_dir)[0].select("run_id", "id", "type", "status")


@query(f"{_CANON} SELECT transaction_id AS id, source_row, description FROM (SELECT *, row_no AS source_row FROM canon WHERE parse_job_id = 'JOB_3') ORDER BY source_row LIMIT 50 OFFSET 20")
def q_transactions_page(spark, sf_dir):
    """Q5. The limit is the page."""
    rows = V.canonical_transactions(_normalized(spark, sf_dir))
    return Q.transactions_page(rows, "JOB_3", 50, 20).select("id", "source_row", "description")


@query(f"{_CANON} SELECT transaction_id AS id, source_row, description FROM (SELECT *, row_no AS source_row FROM canon WHERE parse_job_id = 'JOB_3') ORDER BY source_row LIMIT 50 OFFSET 500")
def q_indexed_page(spark, sf_dir):
    """Q5 by an index of ranges, on stored rows. The limit is the page."""
    rows = stored(V.canonical_transactions(_normalized(spark, sf_dir)).repartitionByRange("parse_job_id", "source_row").sortWithinPartitions("parse_job_id", "source_row"))
    return Q.indexed_page(rows, Q.page_index(rows, 100), "JOB_3", 50, 500).select("id", "source_row", "description")


@query(f"{_ERRORS} SELECT row_no AS row_number, field, severity, message FROM errs WHERE parse_job_id = 'JOB_5'")
def q_errors_report(spark, sf_dir):
    """Q6."""
    return Q.errors_report(V.validate_rows(_normalized(spark, sf_dir)), "JOB_5").select("row_number", "field", "severity", "message")


@query(f"""{_NORMAL} SELECT parse_job_id, 'FILE_' || parse_job_id AS file_id, 'orders.csv' AS filename, count(*) AS total_rows
FROM money GROUP BY 1""")
def q_job_status(spark, sf_dir):
    """Q7."""
    rows = _normalized(spark, sf_dir)
    files = rows.select("file_id", "filename").distinct()
    jobs = V.job_counters(rows).withColumn("file_id", F.concat(F.lit("FILE_"), "parse_job_id"))
    return Q.job_status(jobs, files).select("parse_job_id", "file_id", "filename", "total_rows")


# Sources and mapping, on one delimited text for each customer.
@query("""
SELECT 'FILE_' || k::VARCHAR AS file_id, CASE k % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE chr(9) END AS delimiter, 3::INT AS header_line
FROM (SELECT DISTINCT o_custkey AS k FROM orders JOIN customer ON o_custkey = c_custkey)""")
def s_sniff_and_header(spark, sf_dir):
    """S5, S6."""
    lines = T.text_lines(X.raw_files(spark, sf_dir))
    return T.sniff_delimiter(lines).join(T.find_header_line(lines, T.CSV_HEADER_LINES), "file_id")


@query("""
SELECT 'FILE_' || o_custkey::VARCHAR AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS row_no,
       'Pay, ' || c_name AS text, 'UTR' || o_orderkey::VARCHAR AS ref
FROM orders JOIN customer ON o_custkey = c_custkey""")
def s_delimited_rows(spark, sf_dir):
    """S7."""
    rows = T.extract_delimited_rows(X.raw_files(spark, sf_dir))
    of = lambda *names: F.coalesce(*[F.try_element_at("cells", F.lit(n)) for n in names])
    return rows.select("file_id", "row_no", of("Particulars", "Narration", "Narrative Details").alias("text"), of("Ref No", "Chq/Ref No", "UTR").alias("ref"))


@query("""
SELECT DISTINCT 'FILE_' || o_custkey::VARCHAR AS file_id, 'CSV' AS format, 'statement.csv' AS filename, '.csv' AS ext
FROM orders JOIN customer ON o_custkey = c_custkey""")
def s_describe_files(spark, sf_dir):
    """S1, S3."""
    files = X.raw_files(spark, sf_dir).select("file_id", F.lit("/in/statement.csv").alias("path"), F.encode("text", "UTF-8").alias("content"))
    out = T.describe_files(files).filter("rejected is null")
    return out.select("file_id", T.detect_format(F.col("content"), F.col("filename")).alias("format"), "filename", "ext")


@query("""
SELECT o_orderkey AS file_id, row_number() OVER (PARTITION BY o_custkey % 16, sha256(o_custkey::VARCHAR) ORDER BY o_orderkey) > 1 AS is_duplicate FROM orders""")
def s_duplicate_files(spark, sf_dir):
    """S2, on uploads named by orders that hold their customer's number."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    files = o.select(
        F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 16).alias("reconciliation_id"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha256"), F.col("o_orderkey").alias("uploaded_seq"),
    )
    return T.flag_duplicate_files(files).select("file_id", "is_duplicate")


@query("""
SELECT o_orderkey AS file_id, row_number() OVER (PARTITION BY o_custkey % 16, sha256(o_custkey::VARCHAR) ORDER BY o_orderkey) > 1 AS is_duplicate FROM orders""")
def s_duplicates_of_batches(spark, sf_dir):
    """S2 over two batches: the second meets the hashes of the first, not its files."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/hashes-{uuid.uuid4().hex}"
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    files = o.select(
        F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 16).alias("reconciliation_id"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha256"), F.col("o_orderkey").alias("uploaded_seq"),
    )
    half = files.agg(F.expr("max(uploaded_seq) div 2")).first()[0] or 0
    first = T.flag_and_remember_files(files.filter(F.col("uploaded_seq") <= half), path)
    second = T.flag_and_remember_files(files.filter(F.col("uploaded_seq") > half), path)
    return first.unionByName(second).select("file_id", "is_duplicate")


def _page_lines(spark, sf_dir):
    """Lines of page texts: a heading and a line for each order, columns two spaces apart."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    body = o.select(
        F.concat(F.lit("PAGE_"), F.col("o_custkey").cast("string")).alias("file_id"), (F.col("o_orderkey") + 1).cast("int").alias("line_no"),
        F.concat_ws("  ", F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.lit("Order "), F.col("o_orderkey")), amount).alias("line"),
    )
    head = body.select("file_id").distinct().select("file_id", F.lit(0).alias("line_no"), F.lit("Date  Description  Debit  Credit").alias("line"))
    return head.unionByName(body)


@query("""
SELECT 'PAGE_' || o_custkey::VARCHAR AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS row_no,
       'Order ' || o_orderkey::VARCHAR AS description, o_totalprice::DECIMAL(18,2)::VARCHAR AS debit, '' AS credit FROM orders""")
def s_text_rows(spark, sf_dir):
    """S8."""
    rows = T.extract_text_rows(_page_lines(spark, sf_dir))
    of = lambda n: F.try_element_at("cells", F.lit(n))
    return rows.select("file_id", "row_no", of("Description").alias("description"), of("Debit").alias("debit"), of("Credit").alias("credit"))


@query("""
SELECT 'PAGE_' || o_custkey::VARCHAR AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS row_no,
       CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END AS debit,
       CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(18,2)::VARCHAR ELSE '' END AS credit,
       'REF' || o_orderkey::VARCHAR AS reference, 'PAID TO SHOP' AS description FROM orders""")
def s_ocr_rows(spark, sf_dir):
    """S9."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.when(F.col("o_orderstatus") == "F", "CR").otherwise("DR")
    line = F.concat_ws(
        " ", F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("PAID TO SHOP"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.concat(F.lit("REF"), F.col("o_orderkey").cast("string")),
    )
    line = F.when(kind == "DR", F.replace(line, F.lit("PAID"), F.lit("PAIDDR"))).otherwise(line)
    rows = T.extract_ocr_rows(o.select(F.concat(F.lit("PAGE_"), F.col("o_custkey").cast("string")).alias("file_id"), F.col("o_orderkey").cast("int").alias("line_no"), line.alias("line")))
    of = lambda n: F.try_element_at("cells", F.lit(n))
    return rows.select("file_id", "row_no", of("Debit").alias("debit"), of("Credit").alias("credit"), of("Reference").alias("reference"),
                       F.replace(of("Description"), F.lit("PAIDDR"), F.lit("PAID")).alias("description"))


@query("""
SELECT 'SHEET_' || o_custkey::VARCHAR AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS row_no,
       'Order ' || o_orderkey::VARCHAR AS narration, o_totalprice::DECIMAL(18,2)::VARCHAR AS amount FROM orders""")
def s_grid_rows(spark, sf_dir):
    """S10."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    file_id = F.concat(F.lit("SHEET_"), F.col("o_custkey").cast("string")).alias("file_id")
    s = lambda x: F.lit(x).cast("string")
    body = o.select(file_id, (F.col("o_orderkey") + 2).cast("int").alias("line_no"), F.array(
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), s(None),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("cells"))
    ids = o.select(file_id).distinct()
    top = ids.select("file_id", F.lit(0).alias("line_no"), F.array(s("Sheet"), s(""), s(None), s("")).alias("cells"))
    head = ids.select("file_id", F.lit(1).alias("line_no"), F.array(s("Date"), s("Narration"), s(""), s("Amount")).alias("cells"))
    rows = T.extract_grid_rows(top.unionByName(head).unionByName(body))
    of = lambda n: F.try_element_at("cells", F.lit(n))
    return rows.select("file_id", "row_no", of("Narration").alias("narration"), of("Amount").alias("amount"))


@query("""
SELECT 'PAGE_' || o_custkey::VARCHAR AS file_id, CASE WHEN sum(CASE WHEN page <= 3 THEN len(o_orderpriority) ELSE 0 END) < 50 THEN 'PDF_OCR' ELSE 'PDF_TEXT' END AS pdf_kind
FROM (SELECT *, o_orderkey % 7 + 1 AS page FROM orders) GROUP BY o_custkey""")
def s_classify_pdf(spark, sf_dir):
    """S4."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pages = o.select(F.concat(F.lit("PAGE_"), F.col("o_custkey").cast("string")).alias("file_id"), (F.col("o_orderkey") % 7 + 1).alias("page"), F.col("o_orderpriority").alias("text"))
    return T.classify_pdf_text(pages.select("file_id").distinct(), pages)


@query(f"""{_CANON}{_ERRORS.split(_NORMAL)[1]},
t AS (SELECT parse_job_id, count(*) AS n, min(row_no) AS lo, max(row_no) AS hi, sum(amount)::DOUBLE AS amount FROM canon GROUP BY 1),
e AS (SELECT parse_job_id, count(*) AS errors, count(*) FILTER (severity = 'WARNING') AS warnings FROM errs GROUP BY 1),
m AS (SELECT parse_job_id, count(*) AS total_rows FROM money GROUP BY 1)
SELECT parse_job_id, 0 AS part, CASE WHEN greatest(n, errors) > 50000 THEN 2 ELSE 1 END AS parts, 'STMT_' || parse_job_id AS statement_id, 'orders.csv' AS filename, total_rows, n AS valid_rows,
       warnings AS warning_count, errors - warnings AS error_count, CASE WHEN errors > warnings THEN 'PARTIAL_ERRORS' ELSE 'PASSED' END AS validation_status,
       n AS n_transactions, lo AS first_row, hi AS last_row, amount, errors AS n_errors
FROM t JOIN e USING (parse_job_id) JOIN m USING (parse_job_id)""")
def s_statement_package(spark, sf_dir):
    """S13: what stands in the packages of each job, all its parts together."""
    rows = stored(_normalized(spark, sf_dir))
    good = V.canonical_transactions(rows)
    jobs = V.job_counters(rows).withColumns({
        "reconciliation_id": F.lit("REC"), "source_id": F.lit("SRC"), "source_type": F.lit("BANK_STATEMENT"), "filename": F.lit("orders.csv"), "file_type": F.lit("CSV"),
        "sha256": F.sha2("parse_job_id", 256)})
    packages = T.export_statement_package(good, V.validate_rows(rows), V.control_totals(good), jobs)
    t = F.col("transactions")
    own = ("parse_job_id", "parts", "statement_id", "filename", "total_rows", "valid_rows", "warning_count", "error_count", "validation_status")
    inside = packages.withColumn("validation_status", F.col("metadata.validation_status")).select(
        *own, "part", F.size(t).alias("n"), t[0]["source_row"].alias("first_row"), F.element_at(t, -1)["source_row"].alias("last_row"),
        F.aggregate(t, F.lit(0).cast("decimal(38,2)"), lambda a, r: (a + r.amount).cast("decimal(38,2)")).alias("amount"), F.size("errors").alias("bad"),
    )
    whole = inside.groupBy(*own).agg(
        F.min("part").alias("part"), F.sum("n").cast("int").alias("n_transactions"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"),
        F.sum("amount").cast("double").alias("amount"), F.sum("bad").cast("int").alias("n_errors"),
    )
    return whole.select(
        "parse_job_id", "part", "parts", "statement_id", "filename", "total_rows", "valid_rows", "warning_count", "error_count", "validation_status", "n_transactions",
        "first_row", "last_row", "amount", "n_errors",
    )


@query(f"{_CANON} SELECT parse_job_id, count(*) AS n, sum(CASE WHEN parse_job_id = 'JOB_1' THEN 2 ELSE 1 END * amount)::DOUBLE AS amount FROM canon GROUP BY 1")
def s_write_output(spark, sf_dir):
    """S12: all jobs are written, one is written again with doubled amounts, and the folder is read back."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/output-{uuid.uuid4().hex}"
    rows = stored(V.canonical_transactions(_normalized(spark, sf_dir)).select("parse_job_id", "id", "amount"))
    T.write_job_output(rows, path)
    T.write_job_output(rows.filter("parse_job_id = 'JOB_1'").withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)")), path)
    return T.read_job_output(spark, path).groupBy("parse_job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


@query("""
SELECT 'FILE_' || o_custkey::VARCHAR AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS row_no,
       CASE WHEN o_custkey % 4 < 2 THEN 'UTR' || o_orderkey WHEN o_custkey % 4 = 2 THEN 'Order ' || o_orderkey ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END AS value
FROM orders JOIN customer ON o_custkey = c_custkey""")
def s_extract_rows(spark, sf_dir):
    """S11: files of four formats by customer."""
    files = X.raw_files(spark, sf_dir)
    turn = F.regexp_extract("file_id", r"(\d+)$", 1).cast("long") % 4
    kinds = F.array(*map(F.lit, ("CSV", "PDF_OCR", "PDF_TEXT", "XLSX")))
    files = files.withColumn("format", F.element_at(kinds, (turn + 1).cast("int")))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    file_id = F.concat(F.lit("FILE_"), F.col("o_custkey").cast("string")).alias("file_id")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    scanned = F.concat_ws(" ", F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("PAID SHOP"), price, F.concat(F.lit("UTR"), "o_orderkey"))
    scanned = o.select(file_id, F.col("o_orderkey").cast("int").alias("line_no"), scanned.alias("line"))
    typed = _page_lines(spark, sf_dir).withColumn("file_id", F.replace("file_id", F.lit("PAGE"), F.lit("FILE")))
    lines = scanned.join(files.filter("format = 'PDF_OCR'"), "file_id", "left_semi").unionByName(typed.join(files.filter("format = 'PDF_TEXT'"), "file_id", "left_semi"))
    grid = o.select(file_id, (F.col("o_orderkey") + 1).cast("int").alias("line_no"), F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), price).alias("cells"))
    grid = grid.unionByName(grid.select("file_id").distinct().select("file_id", F.lit(0).alias("line_no"), F.array(F.lit("Date"), F.lit("Amount")).alias("cells")))
    of = lambda *names: F.coalesce(*[F.try_element_at("cells", F.lit(n)) for n in names])
    rows = T.extract_rows(files, lines, grid)
    return rows.select("file_id", "row_no", of("Ref No", "Chq/Ref No", "UTR", "Reference", "Description", "Amount").alias("value"))


@query(f"""{X.BOTH},
s AS (SELECT *, right(reconciliation_id, 1) IN ('0', '2', '4', '6', '8') AS even FROM (SELECT * FROM bank UNION ALL SELECT * FROM ledger))
SELECT CASE WHEN (source_id = 'SRC_BANK') = even THEN 'bank' ELSE 'company' END AS side, reconciliation_id, count(*) AS n, sum(amount)::DOUBLE AS amount FROM s GROUP BY ALL""")
def r_split_fallback(spark, sf_dir):
    """R1 without ledgers by type: the source that was made first is the bank, here the ledger's in odd reconciliations."""
    bank, ledger = X.sides(spark, sf_dir)
    even = F.right("reconciliation_id", F.lit(1)).isin("0", "2", "4", "6", "8")
    rows = bank.unionByName(ledger).withColumn("source_type", F.when((F.col("source_id") == "SRC_BANK"), "BANK").otherwise("INVOICES"))
    rows = rows.withColumn("source_seq", F.when((F.col("source_id") == "SRC_BANK") == even, 1).otherwise(2))
    b, c = R.split_sides(rows)
    both = b.withColumn("side", F.lit("bank")).unionByName(c.withColumn("side", F.lit("company")))
    return both.groupBy("side", "reconciliation_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


def _candidates(rows):
    heads = rows.filter("row_no = 1").select("file_id", F.posexplode(F.map_keys("cells")).alias("position", "header"))
    return M.header_candidates(heads, M.header_samples(rows))


def _mapped(spark, sf_dir):
    rows = stored(T.extract_delimited_rows(X.raw_files(spark, sf_dir)))
    return rows, M.infer_column_mappings(_candidates(rows))


def _unnamed(spark, sf_dir):
    """Rows of files whose headers say little: dates, notes, amounts and codes by content or keyword only."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    turn = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    cells = F.map_from_arrays(F.array(*map(F.lit, ("Posted", "My remark", "Worth", "Code"))), F.array(
        F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.lit("of status "), "o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderpriority")))
    return o.select(F.concat(F.lit("FILE_"), F.col("o_custkey").cast("string")).alias("file_id"), turn.cast("int").alias("row_no"), cells.alias("cells"))


@query("""
WITH files AS (SELECT DISTINCT o_custkey AS k FROM orders),
maps(source_column, target_field, confidence, method) AS (VALUES ('Posted', 'date', 0.9::DOUBLE, 'heuristic'), ('My remark', 'description', 0.92::DOUBLE, 'ai'), ('Worth', 'amount', 0.75::DOUBLE, 'heuristic'),
  ('Code', NULL, 0.0::DOUBLE, 'manual'))
SELECT 'FILE_' || k::VARCHAR AS file_id, source_column, target_field, confidence, method, 0.86::DOUBLE AS file_confidence, 'READY_FOR_EXECUTION' AS status FROM files, maps""")
def m_content_mappings(spark, sf_dir):
    """M5, M6, M8, M11."""
    maps = stored(M.infer_column_mappings(_candidates(stored(_unnamed(spark, sf_dir)))))
    whole = M.mapping_confidence(maps).withColumnRenamed("confidence", "file_confidence")
    return maps.join(whole, "file_id").select("file_id", "source_column", "target_field", "confidence", "method", "file_confidence", "status")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
v AS (SELECT o_custkey, 'Posted' AS header, strftime(o_orderdate, '%d/%m/%Y') AS value, n FROM r WHERE n <= 10 UNION ALL SELECT o_custkey, 'My remark', 'of status ' || o_orderstatus, n FROM r WHERE n <= 10
  UNION ALL SELECT o_custkey, 'Worth', o_totalprice::DECIMAL(18,2)::VARCHAR, n FROM r WHERE n <= 10 UNION ALL SELECT o_custkey, 'Code', trim(o_orderpriority), n FROM r WHERE n <= 10),
d AS (SELECT o_custkey, header, value, min(n) AS n FROM v WHERE value <> '' GROUP BY ALL)
SELECT 'FILE_' || o_custkey::VARCHAR AS file_id, header, string_agg(value, ' | ' ORDER BY n) AS samples FROM d GROUP BY ALL""")
def m_header_samples(spark, sf_dir):
    """M2."""
    return M.header_samples(_unnamed(spark, sf_dir)).select("file_id", "header", F.array_join("samples", " | ").alias("samples"))


_LAYOUTS = """
WITH files AS (SELECT DISTINCT o_custkey AS k FROM orders JOIN customer ON o_custkey = c_custkey),
maps(kind, source_column, target_field) AS (VALUES
  (0, 'Txn Date', 'date'), (0, 'Particulars', 'description'), (0, 'Ref No', 'reference'), (0, 'Debit', 'debit'), (0, 'Credit', 'credit'), (0, 'Balance', 'balance'),
  (1, 'Date', 'date'), (1, 'Narration', 'description'), (1, 'Chq/Ref No', 'reference'), (1, 'Withdrawal Amt.', 'debit'), (1, 'Deposit Amt.', 'credit'),
  (1, 'Closing Balance', 'balance'),
  (2, 'Transact Date', 'date'), (2, 'Narrative Details', 'description'), (2, 'UTR', 'reference'), (2, 'Money Out Dr', 'debit'), (2, 'Money In Cr', 'credit'), (2, 'Net Bal', 'balance'))"""


@query(f"""{_LAYOUTS}
SELECT 'FILE_' || k::VARCHAR AS file_id, source_column, target_field FROM files JOIN maps ON k % 3 = kind""")
def m_infer_mappings(spark, sf_dir):
    """M1 to M7."""
    return _mapped(spark, sf_dir)[1].select("file_id", "source_column", "target_field")


@query("SELECT DISTINCT 'FILE_' || o_custkey::VARCHAR AS file_id, 1.0::DOUBLE AS confidence, 'READY_FOR_EXECUTION' AS status FROM orders JOIN customer ON o_custkey = c_custkey")
def m_mapping_confidence(spark, sf_dir):
    """M8, M11."""
    return M.mapping_confidence(_mapped(spark, sf_dir)[1])


@query(f"{_LAYOUTS} SELECT 'FILE_' || k::VARCHAR AS file_id, source_column, target_field, 1.0::DOUBLE AS confidence, 'learned' AS method FROM files JOIN maps ON k % 3 = kind")
def m_learned_rules(spark, sf_dir):
    """M9, M10: the rules of the first customers' layouts laid over all files."""
    maps = stored(_mapped(spark, sf_dir)[1].withColumn("source_type", F.lit("BANK_STATEMENT")))
    rules = M.learn_rules(maps, 1).dropDuplicates(["source_type", "source_column"])
    return M.overlay_learned_rules(maps, rules).select("file_id", "source_column", "target_field", "confidence", "method")


@query("""
SELECT 'FILE_' || o_custkey::VARCHAR AS file_id, 'UTR' || o_orderkey::VARCHAR AS reference,
       CASE WHEN (o_orderstatus = 'F') = (o_custkey % 2 = 1) THEN 'CREDIT' ELSE 'DEBIT' END AS type, o_custkey % 2 = 1 AS described
FROM orders JOIN customer ON o_custkey = c_custkey""")
def w_user_mapping(spark, sf_dir):
    """M12: in files of even customers the user has debit and credit changed over and maps no description but the reference."""
    rows, maps = _mapped(spark, sf_dir)
    maps = stored(maps)
    even = F.regexp_extract("file_id", r"(\d+)$", 1).cast("long") % 2 == 0
    turned = F.when(F.col("target_field") == "debit", "credit").when(F.col("target_field") == "credit", "debit").otherwise(F.col("target_field"))
    user = maps.filter(even & F.col("target_field").isin("date", "debit", "credit", "reference")).withColumn("target_field", turned)
    out = V.normalize_rows(M.apply_mapping(rows, maps, user).withColumns({"parse_job_id": F.col("file_id"), "filename": F.lit("statement.csv")}))
    return out.select("file_id", "reference", "money.type", (F.col("description") != "").alias("described"))


@query("""
SELECT 'REC_' || (o_custkey % 16) AS reconciliation_id, 'UTR' || o_orderkey AS bank_reference, CASE WHEN o_orderkey % 10 <> 7 THEN 'UTR' || o_orderkey END AS company_reference,
       CASE WHEN o_orderkey % 10 = 7 THEN 'UNMATCHED' ELSE 'MATCHED' END AS status, CASE WHEN o_orderkey % 10 = 7 THEN 'NONE' ELSE 'EXACT' END AS match_type
FROM orders JOIN customer ON o_custkey = c_custkey""")
def w_files_to_matches(spark, sf_dir):
    """W1 into W2: bank and ledger files of every customer to canonical transactions, and these to matches; ledgers lack every tenth order."""
    bank = X.raw_files(spark, sf_dir).withColumns({"kind": F.lit("BANK_STATEMENT"), "source_id": F.lit("SRC_BANK")})
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"UTR\d*7([,;|\t]|$)")), "\n")
    ledger = bank.withColumns({"text": kept, "kind": F.lit("ACCOUNTING_LEDGER"), "source_id": F.lit("SRC_LEDGER"), "file_id": F.concat(F.lit("L"), "file_id")})
    files = stored(bank.unionByName(ledger))
    rows = stored(T.extract_delimited_rows(files))
    maps = M.infer_column_mappings(_candidates(rows))
    rec = F.concat(F.lit("REC_"), (F.regexp_extract("file_id", r"(\d+)$", 1).cast("long") % 16).cast("string"))
    origin = files.select("file_id", F.col("kind").alias("source_type"), "source_id", rec.alias("reconciliation_id"))
    mapped = M.apply_mapping(rows, maps).join(origin, "file_id").withColumns({"parse_job_id": F.col("file_id"), "filename": F.lit("statement.csv")})
    transactions = stored(V.canonical_transactions(V.normalize_rows(mapped)))
    matches = R.match_pipeline(*R.split_sides(transactions))[0]
    named = lambda p: transactions.select(F.col("id").alias(f"{p}_transaction_id"), F.col("reference").alias(f"{p}_reference"))
    out = matches.join(named("bank"), "bank_transaction_id").join(named("company"), "company_transaction_id", "left")
    return out.select("reconciliation_id", "bank_reference", "company_reference", "status", "match_type")


@query("""
SELECT 'FILE_' || o_custkey::VARCHAR AS file_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS row_no, o_orderdate::DATE::VARCHAR AS date,
       'Pay, ' || c_name AS description, o_totalprice::DECIMAL(18,2)::DOUBLE AS amount, CASE WHEN o_orderstatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS type,
       'UTR' || o_orderkey::VARCHAR AS reference
FROM orders JOIN customer ON o_custkey = c_custkey""")
def w_ingest(spark, sf_dir):
    """W1: files to canonical transactions (S5 to S7, M1 to M12, N, V)."""
    rows, maps = _mapped(spark, sf_dir)
    mapped = M.apply_mapping(rows, maps).withColumns({"parse_job_id": F.col("file_id"), "filename": F.lit("statement.csv")})
    out = V.canonical_transactions(V.normalize_rows(mapped))
    return out.select("provenance.file_id", F.col("source_row").alias("row_no"), F.col("date").cast("string").alias("date"), "description", F.col("amount").cast("double").alias("amount"), "type", "reference")


@query("""
WITH f AS (SELECT *, o_custkey % 5 AS kind FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'statement-' || o_custkey || CASE kind WHEN 3 THEN '.TSV' WHEN 4 THEN '.dat' ELSE '.csv' END AS filename, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS source_row,
       o_orderdate::DATE::VARCHAR AS date, 'Caf' || chr(65533) || ', ' || c_name AS description, o_totalprice::DECIMAL(18,2)::DOUBLE AS amount,
       CASE WHEN o_orderstatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS type, 'UTR' || o_orderkey::VARCHAR AS reference, NULL AS reason
FROM f WHERE kind <> 4
UNION ALL SELECT DISTINCT 'statement-' || o_custkey || '.dat', 0, NULL, NULL, NULL::DOUBLE, NULL, NULL, 'The file was rejected: UNSUPPORTED_EXTENSION' FROM f WHERE kind = 4""")
def w_folder_to_rows(spark, sf_dir):
    """W1 from a folder (S1, S3, S5 to S7, S11, M, N, V): a file for each customer, with bytes that are no UTF-8, of which one kind has an extension that is not accepted."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/folder-{uuid.uuid4().hex}"
    key = F.regexp_extract("file_id", r"(\d+)$", 1)
    kind = key.cast("long") % 5
    end = F.when(kind == 3, ".TSV").when(kind == 4, ".dat").otherwise(".csv")
    pieces = F.transform(F.split("text", "Pay, "), lambda p: p.cast("binary"))
    content = F.aggregate(pieces, F.unhex(F.lit("")), lambda a, p: F.when(F.octet_length(a) == 0, p).otherwise(F.concat(a, F.unhex(F.lit("436166E92C20")), p)))
    X.write_folder(X.raw_files(spark, sf_dir).select(F.concat(F.lit("statement-"), key, end).alias("name"), content.alias("content")), folder)
    good, errors, _ = I.ingest_files(T.read_statement_files(spark, folder))
    rows = good.select(
        "provenance.filename", "source_row", F.col("date").cast("string").alias("date"), "description", F.col("amount").cast("double").alias("amount"), "type", "reference", F.lit(None).cast("string").alias("reason"))
    none = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[2:7]]
    unread = errors.filter("severity = 'FATAL'").select(F.col("raw_value").alias("filename"), F.col("row_number").alias("source_row"), *none, F.col("message").alias("reason"))
    return rows.unionByName(unread)
