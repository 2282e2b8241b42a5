"""DuckDB SQL of the staged matching over the derived sides: all pairs are scored, and stages are settled in recursive rounds."""

from __future__ import annotations

from ledgerline.jobs import fixtures as X
from ledgerline.operators import matching as R


def _common(x: str, y: str) -> str:
    """Length of the longest common subsequence of two texts of up to 126 characters, by bit masks."""
    mask = f"list_sum(list_transform(generate_series(1, length({x})), lambda i: CASE WHEN substr({x}, i, 1) = substr({y}, j, 1) THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))"
    full = f"((1::HUGEINT << length({x})::INT) - 1)"
    step = f"((row_ + (row_ & m)) | (row_ - (row_ & m))) & {full}"
    masks = f"list_transform(generate_series(1, length({y})), lambda j: coalesce({mask}, 0)::HUGEINT)"
    return f"bit_count(xor({full}, list_reduce(list_prepend({full}, {masks}), lambda row_, m: {step})))"


#: Scores of the distinct pairs of unequal prepared texts in ``text_pairs`` (``a``, ``b``).
TEXT_SCORES = f"""
tokens AS (
  SELECT a, b, list_filter(string_split_regex(a, '\\s+'), lambda t: t <> '') AS la, list_filter(string_split_regex(b, '\\s+'), lambda t: t <> '') AS lb FROM text_pairs),
token_sets AS (
  SELECT *, array_to_string(list_sort(la), ' ') AS sa, array_to_string(list_sort(lb), ' ') AS sb,
         array_to_string(list_sort(list_filter(list_distinct(la), lambda t: list_contains(lb, t))), ' ') AS both_,
         array_to_string(list_sort(list_filter(list_distinct(la), lambda t: NOT list_contains(lb, t))), ' ') AS oa,
         array_to_string(list_sort(list_filter(list_distinct(lb), lambda t: NOT list_contains(la, t))), ' ') AS ob
  FROM tokens),
lengths AS (
  SELECT *, length(both_) AS n, length(both_) + CASE WHEN both_ = '' THEN 0 ELSE 1 END + length(oa) AS na,
         length(both_) + CASE WHEN both_ = '' THEN 0 ELSE 1 END + length(ob) AS nb,
         {_common('sa', 'sb')} AS ls, {_common('oa', 'ob')} AS lo
  FROM token_sets),
text_scores AS (
  SELECT a, b, format('{{:.2f}}', greatest(
      200.0::DOUBLE * ls / (length(sa) + length(sb)),
      CASE WHEN len(la) = 0 OR len(lb) = 0 THEN 0.0 WHEN both_ <> '' AND (oa = '' OR ob = '') THEN 100.0
           ELSE greatest(100.0::DOUBLE - 100.0::DOUBLE * (length(oa) + length(ob) - 2 * lo) / (na + nb),
                         CASE WHEN both_ <> '' THEN greatest(100.0::DOUBLE - 100.0::DOUBLE * (na - n) / (n + na), 100.0::DOUBLE - 100.0::DOUBLE * (nb - n) / (n + nb)) ELSE 0.0 END)
      END)::DOUBLE / 100.0::DOUBLE)::DOUBLE AS score
  FROM lengths)"""

_CONFIDENCE = """least(round(CASE WHEN amt = 0 THEN least({total}, 0.45::DOUBLE) ELSE {total} END, 4), 1.0::DOUBLE)"""
_TOTAL = """(CASE WHEN bref IS NULL AND cref IS NULL THEN (amt * 0.40::DOUBLE + dat * 0.20::DOUBLE + {desc} * 0.20::DOUBLE + 0.05::DOUBLE) / 0.85::DOUBLE
  ELSE amt * 0.40::DOUBLE + dat * 0.20::DOUBLE + {desc} * 0.20::DOUBLE + ref * 0.15::DOUBLE + 0.05::DOUBLE END)"""


def confidence(desc: str) -> str:
    return _CONFIDENCE.format(total=_TOTAL.format(desc=desc))


#: Every pair of the sides of one reconciliation and type that any stage for single rows can take, with its scores.
SCORED = f"""{X.BOTH.replace('WITH', 'WITH RECURSIVE', 1)},
ranked_bank AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date, source_row, id) AS br FROM bank),
ranked_ledger AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date, source_row, id) AS cr FROM ledger),
met AS (
  SELECT b.reconciliation_id, b.type, b.date AS bd, c.date AS cd, b.id AS b, c.id AS c, br, cr, b.amount AS ba, c.amount AS ca, b.description AS bt, c.description AS ct,
         b.reference AS bref, c.reference AS cref, abs(b.amount - c.amount) AS diff, greatest(b.amount, c.amount) AS top,
         abs(date_diff('day', b.date, c.date))::INT AS days, lower(trim(b.description)) AS a1, lower(trim(c.description)) AS b1
  FROM ranked_bank b JOIN ranked_ledger c ON b.reconciliation_id = c.reconciliation_id AND b.type = c.type),
parts AS (
  SELECT *, CASE WHEN diff = 0 THEN 1.0 WHEN diff * 200 <= top THEN 0.95 WHEN diff * 50 <= top THEN 0.85 WHEN diff * 20 <= top THEN 0.60
                 WHEN diff * 10 <= top THEN 0.30 ELSE 0 END::DOUBLE AS amt,
         CASE WHEN days = 0 THEN 1.0 WHEN days = 1 THEN 0.9 WHEN days = 2 THEN 0.8 WHEN days = 3 THEN 0.6 WHEN days <= 5 THEN 0.4 ELSE 0 END::DOUBLE AS dat,
         CASE WHEN bref IS NULL OR cref IS NULL THEN 0.0 WHEN upper(bref) = upper(cref) THEN 1.0
              WHEN contains(upper(bref), upper(cref)) OR contains(upper(cref), upper(bref)) THEN 0.85 ELSE 0.0 END::DOUBLE AS ref
  FROM met),
pairs AS MATERIALIZED (
  SELECT *, {confidence('1.0::DOUBLE')} AS could FROM parts
  WHERE diff = 0 OR ref = 1 OR {confidence('1.0::DOUBLE')} >= 0.75),
twins AS (
  SELECT lower(trim(x.description)) AS a, lower(trim(y.description)) AS b FROM bank x JOIN bank y USING (reconciliation_id, type, amount) WHERE abs(date_diff('day', x.date, y.date)) <= 1
  UNION ALL SELECT lower(trim(x.description)), lower(trim(y.description)) FROM ledger x JOIN ledger y USING (reconciliation_id, type, amount) WHERE abs(date_diff('day', x.date, y.date)) <= 1),
text_pairs AS MATERIALIZED (
  SELECT DISTINCT a, b FROM (SELECT a1 AS a, b1 AS b FROM pairs UNION ALL SELECT a, b FROM twins) WHERE a <> b),{TEXT_SCORES},
described AS (SELECT p.*, CASE WHEN a1 = b1 THEN 1.0::DOUBLE ELSE s.score END AS descr FROM pairs p LEFT JOIN text_scores s ON p.a1 = s.a AND p.b1 = s.b),
scored AS MATERIALIZED (
  SELECT *, {confidence('descr')} AS conf,
         CASE WHEN diff = 0 THEN 'Amount matched exactly' WHEN amt > 0 THEN 'Amount difference of ₹' || diff::VARCHAR
              ELSE 'Significant amount mismatch: ₹' || ba::VARCHAR || ' vs ₹' || ca::VARCHAR END AS why1,
         CASE WHEN days = 0 THEN 'Date matched exactly' WHEN days <= 2 THEN 'Date differs by ' || days || CASE WHEN days = 1 THEN ' day' ELSE ' days' END || ' (within tolerance)'
              ELSE 'Date differs by ' || days || ' days' END AS why2,
         CASE WHEN descr >= 0.90 THEN ' | Description strongly matched' WHEN descr >= 0.70 THEN ' | Description partially matched (' || trunc(descr * 100::DOUBLE)::INT || '%)' ELSE '' END
         || CASE WHEN ref = 1 THEN ' | Reference / UTR number matched exactly' ELSE '' END AS why3
  FROM described)"""


def _rounds(name: str, wish: str, edges: str) -> str:
    """One-to-one pairs ``name`` of the edges: a bank row keeps proposing to its best company row, which holds the first in order."""
    return f"""
{name}_edges AS MATERIALIZED ({edges}),
{name}_rounds AS (
  SELECT 0 AS turn, b, br, c, cr, {wish} AS wish FROM {name}_edges
  UNION ALL
  SELECT turn + 1, b, br, c, cr, wish FROM (
    SELECT *, min(CASE WHEN best THEN br END) OVER (PARTITION BY c) AS held
    FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY wish, cr) = 1 AS best FROM {name}_rounds WHERE turn < 15))
  WHERE held IS NULL OR br <= held),
{name} AS MATERIALIZED (
  SELECT e.* FROM {name}_edges e JOIN (SELECT b, c FROM {name}_rounds WHERE turn = 15 QUALIFY row_number() OVER (PARTITION BY b ORDER BY wish, cr) = 1) w USING (b, c))"""


_SAME_REF = "(bref IS NOT NULL AND cref IS NOT NULL AND upper(bref) = upper(cref))"
EXACT = f"diff = 0 AND days = 0 AND ({_SAME_REF} OR descr >= 0.85)"
REFERENCE = f"{_SAME_REF} AND (diff = 0 OR conf >= 0.80)"
FUZZY = "conf >= 0.75"
TOLERANT = "diff = 0 AND days BETWEEN 1 AND 5 AND conf >= 0.70"
_STATUS = {
    "exact": "'MATCHED'", "reference": "CASE WHEN conf >= 0.90 THEN 'MATCHED' ELSE 'PROBABLE_MATCH' END",
    "fuzzy": "CASE WHEN conf >= 0.90 AND days = 0 AND diff = 0 THEN 'MATCHED' ELSE 'PROBABLE_MATCH' END", "tolerant": "'PROBABLE_MATCH'",
}
_KIND = {
    "exact": f"CASE WHEN {_SAME_REF} AND descr < 0.85 THEN 'REFERENCE' ELSE 'EXACT' END", "reference": "'REFERENCE'",
    "fuzzy": "CASE WHEN days > 0 THEN 'DATE_TOLERANCE' ELSE 'FUZZY' END", "tolerant": "'DATE_TOLERANCE'",
}
_WHY = {
    "exact": "'Amount matched | Date matched | Direction matched | ' || why1 || ' | ' || why2",
    "reference": "'Reference / UTR matched exactly | ' || why1 || ' | ' || why2", "fuzzy": "why1 || ' | ' || why2 || why3",
    "tolerant": "'Amount matches; date differs by ' || days || ' days (timing window) | ' || why1 || ' | ' || why2",
}
_STAGE = {"exact": "EXACT", "reference": "REFERENCE", "fuzzy": "FUZZY", "tolerant": "DATE_TOLERANCE"}


def _results(name: str, stage: str) -> str:
    sure = "greatest(conf, 0.95::DOUBLE)" if stage == "exact" else "conf"
    return f"""SELECT reconciliation_id, '{_STAGE[stage]}' AS stage, b AS bank_transaction_id, c AS company_transaction_id, c AS company_ids, {_STATUS[stage]} AS status,
  {_KIND[stage]} AS match_type, {sure} AS confidence, diff AS amount_difference, days AS date_difference_days, amt AS amount_score, dat AS date_score,
  descr AS description_score, ref AS reference_score, 1.0::DOUBLE AS type_score, {_WHY[stage]} AS reasons FROM {name}"""


def stage_alone(stage: str, edges: str) -> str:
    """Results of one stage over whole sides."""
    wish = "-conf" if stage == "fuzzy" else "0.0::DOUBLE"
    return f"{SCORED},{_rounds('won', wish, f'SELECT * FROM scored WHERE {edges}')},\nresults AS ({_results('won', stage)})"


def _pairs_of_two(free_bank: str, free_ledger: str) -> str:
    """First pairs of company rows that add up to a bank amount; of bank rows that touch the same company row the first has it."""
    return f"""
twos AS MATERIALIZED (
  SELECT b.reconciliation_id, b.id AS b, b.br, x.id AS c1, y.id AS c2, x.cr AS r1, y.cr AS r2, b.amount AS ba, x.amount AS xa, y.amount AS ya,
         greatest(abs(date_diff('day', b.date, x.date)), abs(date_diff('day', b.date, y.date)))::INT AS days
  FROM {free_bank} b JOIN {free_ledger} x ON x.reconciliation_id = b.reconciliation_id AND x.type = b.type AND abs(date_diff('day', b.date, x.date)) <= 5 AND x.amount < b.amount
  JOIN {free_ledger} y ON y.reconciliation_id = b.reconciliation_id AND y.type = b.type AND y.amount = b.amount - x.amount AND abs(date_diff('day', b.date, y.date)) <= 5 AND x.cr < y.cr),
two_rounds AS (
  SELECT 0 AS turn, false AS taken, * FROM twos
  UNION ALL
  SELECT turn + 1, taken OR sure, reconciliation_id, b, br, c1, c2, r1, r2, ba, xa, ya, days FROM (
    SELECT *, (max(CASE WHEN sure THEN 1 ELSE 0 END) OVER (PARTITION BY b) = 1 AND NOT sure AND NOT taken) AS out_b,
           list_has_any([c1, c2], flatten(list(CASE WHEN sure THEN [c1, c2] ELSE [] END) OVER (PARTITION BY reconciliation_id))) AND NOT sure AND NOT taken AS out_c
    FROM (
      SELECT *, NOT taken AND row_number() OVER (PARTITION BY b ORDER BY taken, r1, r2) = 1 AND br = min(br) OVER (PARTITION BY c1) AND br = min(br) OVER (PARTITION BY c2) AS sure
      FROM two_rounds WHERE turn < 6))
  WHERE NOT out_b AND NOT out_c),
two_results AS (
  SELECT reconciliation_id, 'COMPOSITE' AS stage, b AS bank_transaction_id, c1 || '+' || c2 AS company_transaction_id, c1 || '+' || c2 AS company_ids, 'PROBABLE_MATCH' AS status,
         'COMPOSITE' AS match_type, {R.COMPOSITE_CONFIDENCE}::DOUBLE AS confidence, 0::DECIMAL(18,2) AS amount_difference, days AS date_difference_days, 1.0::DOUBLE AS amount_score,
         0.8::DOUBLE AS date_score, 0.0::DOUBLE AS description_score, 0.0::DOUBLE AS reference_score, 1.0::DOUBLE AS type_score,
         'Composite Match: Bank ₹' || format('{{:,.2f}}', ba::DOUBLE) || ' equals Company ₹' || format('{{:,.2f}}', xa::DOUBLE) || ' + ₹' || format('{{:,.2f}}', ya::DOUBLE)
         || ' | Matched across 2 split company accounting records' AS reasons
  FROM two_rounds WHERE turn = 6 AND taken)"""


#: R7 over whole sides. The derived rows make few pairs, of which hardly any meet.
COMPOSITE = f"{X.BOTH.replace('WITH', 'WITH RECURSIVE', 1)},\nranked_bank AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date, source_row, id) AS br FROM bank),\nranked_ledger AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date, source_row, id) AS cr FROM ledger),{_pairs_of_two('ranked_bank', 'ranked_ledger')}"


def _after(*stages: str) -> str:
    b = " AND ".join(f"b NOT IN (SELECT b FROM {s})" for s in stages)
    return b + " AND " + " AND ".join(f"c NOT IN (SELECT c FROM {s})" for s in stages)


#: R10: ``results`` has one row for each bank row, ``free_ledger`` what is left of the ledger.
MATCHED = f"""{SCORED},{_rounds('exact', '0.0::DOUBLE', f'SELECT * FROM scored WHERE {EXACT}')},
{_rounds('reference', '0.0::DOUBLE', f"SELECT * FROM scored WHERE {REFERENCE} AND {_after('exact')}")},
{_rounds('fuzzy', '-conf', f"SELECT * FROM scored WHERE {FUZZY} AND {_after('exact', 'reference')}")},
{_rounds('tolerant', '0.0::DOUBLE', f"SELECT * FROM scored WHERE {TOLERANT} AND {_after('exact', 'reference', 'fuzzy')}")},
singles AS MATERIALIZED ({' UNION ALL '.join(_results(s, s) for s in _STAGE)}),
left_bank AS MATERIALIZED (SELECT * FROM ranked_bank WHERE id NOT IN (SELECT bank_transaction_id FROM singles)),
left_ledger AS MATERIALIZED (SELECT * FROM ranked_ledger WHERE id NOT IN (SELECT company_transaction_id FROM singles)),{_pairs_of_two('left_bank', 'left_ledger')},
found AS MATERIALIZED (SELECT * FROM singles UNION ALL SELECT * FROM two_results),
results AS MATERIALIZED (
  SELECT * FROM found
  UNION ALL
  SELECT reconciliation_id, 'NONE', id, NULL, '', 'UNMATCHED', 'NONE', 0.0::DOUBLE, amount, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, '{R.NO_CANDIDATE}'
  FROM bank WHERE id NOT IN (SELECT bank_transaction_id FROM found)),
free_ledger AS MATERIALIZED (
  SELECT * FROM left_ledger WHERE id NOT IN (SELECT unnest(string_split(company_ids, '+')) FROM two_results))"""

#: How queries show results, so that both sides agree in type.
SHOWN = ("reconciliation_id, stage, bank_transaction_id, company_transaction_id, company_ids, status, match_type, confidence, amount_difference::DOUBLE AS amount_difference, "
         "date_difference_days, amount_score, date_score, description_score, reference_score, type_score, reasons")


_MONEY = "'₹' || format('{:,.2f}', %s::DOUBLE)"


def _duplicates(table: str, order: str, least: float, severity: str, evidence: str) -> str:
    return f"""SELECT reconciliation_id, a.id AS transaction_id, b.id AS candidate_transaction_id, 'DUPLICATE_TRANSACTION' AS type, '{severity}' AS severity, 0.0::DOUBLE AS amount_difference,
  abs(date_diff('day', a.date, b.date))::INT AS date_difference_days, {evidence} AS evidence
  FROM {table} a JOIN {table} b USING (reconciliation_id, type, amount)
  LEFT JOIN text_scores s ON s.a = lower(trim(a.description)) AND s.b = lower(trim(b.description))
  WHERE a.{order} < b.{order} AND abs(date_diff('day', a.date, b.date)) <= 1 AND (lower(trim(a.description)) = lower(trim(b.description)) OR s.score >= {least})"""


_PERCENT = "trunc(CASE WHEN lower(trim(a.description)) = lower(trim(b.description)) THEN 1.0::DOUBLE ELSE s.score END * 100::DOUBLE)::INT"
_DAYS = "abs(date_diff('day', a.date, b.date))"
BANK_TWICE = _duplicates("ranked_bank", "br", 0.80, "HIGH", f"'Identical amount of ' || {_MONEY % 'amount'} || ' appears twice in Bank Statement | Dates are ' || a.date || ' and ' || b.date || ' (' || {_DAYS} || ' days apart) | Description similarity: ' || {_PERCENT} || '% | Possible double billing or duplicate payment'")
LEDGER_TWICE = _duplicates("ranked_ledger", "cr", 0.85, "MEDIUM", f"'Identical entry of ' || {_MONEY % 'amount'} || ' recorded twice in Company Accounts | Dates: ' || a.date || ' and ' || b.date || ' | Possible double ledger journal posting'")
#: A1 to A6 after R10: ``anomalies`` with evidence as one text.
ANOMALIES = f"""{MATCHED},
probable AS (SELECT r.*, b.amount AS ba, b.date AS bd, c.amount AS ca, c.date AS cd FROM results r JOIN bank b ON b.id = r.bank_transaction_id LEFT JOIN ledger c ON c.id = r.company_transaction_id
  WHERE r.status = 'PROBABLE_MATCH'),
kinds AS (
  {BANK_TWICE}
  UNION ALL {LEDGER_TWICE}
  UNION ALL SELECT reconciliation_id, bank_transaction_id, company_transaction_id, 'COMPOSITE_MATCH', 'LOW', 0.0, date_difference_days, reasons FROM probable WHERE match_type = 'COMPOSITE'
  UNION ALL SELECT reconciliation_id, bank_transaction_id, company_transaction_id, 'AMOUNT_MISMATCH', CASE WHEN amount_difference > 500 THEN 'HIGH' ELSE 'MEDIUM' END, amount_difference::DOUBLE, date_difference_days,
    'Bank amount is ' || {_MONEY % 'ba'} || ' but Company record is ' || {_MONEY % 'ca'} || ' | Deterministic discrepancy of ' || {_MONEY % 'amount_difference'} || ' | Description match: ' || trunc(description_score * 100::DOUBLE)::INT || '%'
    FROM probable WHERE match_type <> 'COMPOSITE' AND amount_difference > 0
  UNION ALL SELECT reconciliation_id, bank_transaction_id, company_transaction_id, 'DATE_MISMATCH', CASE WHEN date_difference_days <= 2 THEN 'LOW' ELSE 'MEDIUM' END, 0.0, date_difference_days,
    'Amount matches exactly (' || {_MONEY % 'ba'} || ') | Bank date is ' || bd || ' vs Company date ' || cd || ' | Timing gap of ' || date_difference_days || ' day(s) (likely clearing/settlement delay)'
    FROM probable WHERE match_type <> 'COMPOSITE' AND amount_difference <= 0 AND date_difference_days > 0
  UNION ALL SELECT b.reconciliation_id, b.id, NULL, 'MISSING_IN_COMPANY', CASE WHEN amount >= 10000 THEN 'HIGH' ELSE 'MEDIUM' END, amount::DOUBLE, 0,
    'Bank record ' || {_MONEY % 'amount'} || ' (' || description || ') has no ledger match | Transaction date: ' || date || ' | Requires investigation: possible unrecorded bank charge, fee, or missing entry'
    FROM bank b JOIN results r ON r.bank_transaction_id = b.id AND r.status = 'UNMATCHED'
  UNION ALL SELECT reconciliation_id, id, NULL, 'MISSING_IN_BANK', CASE WHEN amount >= 10000 THEN 'HIGH' ELSE 'MEDIUM' END, amount::DOUBLE, 0,
    'Company ledger shows ' || {_MONEY % 'amount'} || ' (' || description || ') with no bank statement record | Entry date: ' || date || ' | Possible unpresented cheque, delayed deposit, or omitted entry'
    FROM free_ledger),
anomalies AS MATERIALIZED (
  SELECT 'ANOM_' || upper(substr(sha256(reconciliation_id || '|' || type || '|' || transaction_id || '|' || coalesce(candidate_transaction_id, '')), 1, 10)) AS id, * FROM kinds)"""
ANOMALY = "id, reconciliation_id, transaction_id, candidate_transaction_id, type, severity, amount_difference, date_difference_days, evidence"
NAMED_MATCHES = "(SELECT 'MATCH_' || upper(substr(sha256(reconciliation_id || '|' || match_type || '|' || bank_transaction_id || '|' || coalesce(company_transaction_id, '')), 1, 10)) AS id, * FROM results)"


def findings(rules, other, large: int) -> str:
    """A7 over ``anomalies``: ``found`` with the texts of the table of rules."""
    text = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    values = ", ".join(f"({text(k)}, {c}::DOUBLE, {text(r)}, {text(f)}, {text(z)}, {text(a)})" for k, c, r, f, z, a in rules)
    fill = lambda c, none: f"coalesce(replace(replace({c}, '{{d}}', date_difference_days::VARCHAR), '{{a}}', format('{{:,.2f}}', amount_difference)), {text(none)})"
    confidence_, risk, finding, conclusion, action = other
    return f""",
rules(type, sure, rule_risk, rule_finding, rule_conclusion, rule_action) AS (VALUES {values}),
found_out AS (
  SELECT x.*, {fill('rule_finding', finding)} AS finding, {fill('rule_conclusion', conclusion)} AS conclusion, coalesce(sure, {confidence_}::DOUBLE) AS finding_confidence,
         coalesce(rule_risk, CASE WHEN x.type = 'AMOUNT_MISMATCH' THEN CASE WHEN amount_difference > {large} THEN 'HIGH' ELSE 'MEDIUM' END
           WHEN x.type = 'DUPLICATE_TRANSACTION' THEN CASE WHEN severity = 'HIGH' THEN 'CRITICAL' ELSE 'HIGH' END END, '{risk}') AS risk,
         coalesce(rule_action, {text(action)}) AS recommended_action
  FROM anomalies x LEFT JOIN rules r ON r.type = x.type)"""
