"""The staged matching against a plain sequential pass, eight known rows on either side, and many equal rows."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import scoring as S
from ledgerline.functions.text import description_score
from ledgerline.jobs import queries as J
from ledgerline.operators import anomalies as A
from ledgerline.operators import assign
from ledgerline.operators import matching as R

SCHEMA = ("id string, reconciliation_id string, source_id string, source_type string, date date, description string,"
          " amount decimal(18,2), type string, reference string, source_row int")


def side(spark, rows, kind):
    day = datetime.date(2026, 10, 1)
    full = [(i, "R", kind, kind, day + datetime.timedelta(d), text, Decimal(a), t, ref, n) for n, (i, d, text, a, t, ref) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def score(b, c):
    if b.type != c.type:
        return 0.0, 0.0
    diff, top, days = abs(b.amount - c.amount), max(b.amount, c.amount), abs((b.date - c.date).days)
    amt = 1.0 if diff == 0 else next((s for f, s in ((200, 0.95), (50, 0.85), (20, 0.6), (10, 0.3)) if diff * f <= top), 0.0)
    date = (1.0, 0.9, 0.8, 0.6, 0.4, 0.4)[days] if days <= 5 else 0.0
    desc = description_score(b.description, c.description)
    x, y = (b.reference or "").upper(), (c.reference or "").upper()
    ref = 0.0 if not x or not y else 1.0 if x == y else 0.85 if x in y or y in x else 0.0
    core = amt * 0.4 + date * 0.2 + desc * 0.2
    total = (core + 0.05) / 0.85 if not x and not y else core + ref * 0.15 + 0.05
    return min(round(min(total, 0.45) if amt == 0 else total, 4), 1.0), desc


def sequential(bank, company):
    """Stage by stage, bank row by bank row."""
    out, used_b, used_c = [], set(), set()

    def run(name, ok, best=False):
        for b in bank:
            if b.id in used_b:
                continue
            fit = [(s, n, c) for n, c in enumerate(company) if c.id not in used_c and b.type == c.type for s in [ok(b, c)] if s]
            if fit:
                c = max(fit, key=lambda x: (x[0], -x[1]))[2] if best else fit[0][2]
                used_b.add(b.id), used_c.add(c.id), out.append((name, b.id, c.id))

    same_ref = lambda b, c: bool(b.reference and c.reference and b.reference.upper() == c.reference.upper())
    run("EXACT", lambda b, c: b.amount == c.amount and b.date == c.date and (same_ref(b, c) or score(b, c)[1] >= 0.85))
    run("REFERENCE", lambda b, c: same_ref(b, c) and (b.amount == c.amount or score(b, c)[0] >= 0.8))
    run("FUZZY", lambda b, c: s if (s := score(b, c)[0]) >= 0.75 else 0, True)
    run("DATE_TOLERANCE", lambda b, c: b.amount == c.amount and 1 <= abs((b.date - c.date).days) <= 5 and score(b, c)[0] >= 0.7)
    for b in bank:
        free = [c for c in company if c.id not in used_c and c.type == b.type and abs((c.date - b.date).days) <= 5]
        pair = next(((x, y) for i, x in enumerate(free) for y in free[i + 1 :] if x.amount + y.amount == b.amount), None)
        if b.id not in used_b and pair:
            used_b.add(b.id), used_c.update(p.id for p in pair), out.append(("COMPOSITE", b.id, "+".join(p.id for p in pair)))
    return set(out)


def test_random_rows_agree_with_a_sequential_pass(spark):
    rng = random.Random(4)
    texts = ["NEFT acme ltd", "acme ltd payment", "Rent October", "Cash withdrawal", "zomato meals"]
    rows = lambda p: [
        (f"{p}{i}", rng.randrange(9), rng.choice(texts), rng.choice(["100.00", "101.00", "60.00", "40.00", "97.00"]),
         rng.choice(["DEBIT", "DEBIT", "CREDIT"]), rng.choice([None, None, f"U{rng.randrange(12)}", f"U{rng.randrange(12)}X"]))
        for i in range(40)
    ]
    bank, company = side(spark, rows("B"), "BANK_STATEMENT"), side(spark, rows("C"), "LEDGER")
    order = lambda d: sorted(d.collect(), key=lambda r: (r.date, r.source_row, r.id))
    expected = sequential(order(bank), order(company))
    matches, left = R.match_pipeline(bank, company)
    got = matches.collect()
    assert {(m.stage, m.bank_transaction_id, m.company_transaction_id) for m in got if m.stage != "NONE"} == expected
    assert len(got) == 40 and len({m.bank_transaction_id for m in got}) == 40
    held = [c for m in got for c in m.company_ids]
    assert len(held) == len(set(held)) and len(held) + left.count() == 40


def test_priority_match_is_serial_choice(spark):
    rng = random.Random(1)
    edges = [(f"b{b}", b, f"c{c}", rng.random()) for b in range(30) for c in range(20) if rng.random() < 0.2]
    free, expected = set(), set()
    for b in range(30):
        fit = sorted((w, c) for x, r, c, w in edges if r == b and c not in free)
        if fit:
            free.add(fit[0][1]), expected.add((f"b{b}", fit[0][1]))
    df = spark.createDataFrame(edges, "b string, b_rank int, c string, wish double").withColumn("cls", F.col("b"))
    assert {(r.b, r.c) for r in assign.priority_match(df).collect()} == expected


def test_duplicates_and_missing(spark):
    bank = side(spark, [("B1", 0, "rent", "10000.00", "DEBIT", "U1"), ("B2", 1, "rent", "10000.00", "DEBIT", "U2"), ("B3", 5, "x", "5.00", "DEBIT", None)], "BANK")
    company = side(spark, [("C1", 0, "rent", "10000.00", "DEBIT", "U1")], "LEDGER")
    matches, left = R.match_pipeline(bank, company)
    found = A.investigate(A.detect_anomalies(bank, company, matches, left)).collect()
    assert sorted((f.type, f.severity, f.risk) for f in found) == [
        ("DUPLICATE_TRANSACTION", "HIGH", "CRITICAL"), ("MISSING_IN_COMPANY", "HIGH", "HIGH"), ("MISSING_IN_COMPANY", "MEDIUM", "HIGH"),
    ]
    summary = R.run_summary(matches, A.missing_in_company(matches, bank)).first()
    assert (summary.matched_count, summary.unmatched_count, summary.run_status) == (1, 2, "REVIEW_REQUIRED")
    empty = bank.filter(F.lit(False))
    assert R.match_pipeline(empty, company)[0].count() == 0


def test_stage_queries_take_whole_sides(spark, monkeypatch):
    bank = side(spark, [
        ("b1", 0, "rent north", "1000.00", "DEBIT", "UTR77"), ("b2", 0, "rent south", "2000.00", "DEBIT", "U2"), ("b3", 0, "tea", "300.00", "DEBIT", "U3"),
        ("b4", 0, "wood", "50.00", "DEBIT", "U4"), ("b5", 0, "coal", "70.00", "DEBIT", None),
    ], "BANK_STATEMENT")
    ledger = side(spark, [
        ("c1", 20, "rent north", "1000.00", "DEBIT", "XUTR77"), ("c2", 2, "rent south", "2000.00", "DEBIT", "Z9"), ("c3", 0, "x", "100.00", "DEBIT", "U3"),
        ("c4", 1, "y", "200.00", "DEBIT", None), ("c5", 0, "wood", "50.00", "DEBIT", "U4"), ("c6", 0, "coal", "70.00", "DEBIT", "U6"),
    ], "ACCOUNTING_LEDGER")
    monkeypatch.setattr(J.X, "sides", lambda *_: (bank, ledger))
    pairs = lambda name: {(r.bank_transaction_id, r.company_transaction_id) for r in J.QUERIES[name](spark, "").collect()}
    assert pairs("r_fuzzy") == {("b1", "c1"), ("b2", "c2"), ("b4", "c5"), ("b5", "c6")}
    assert pairs("r_date_tolerance") == {("b2", "c2")}
    assert pairs("r_composite") == {("b3", "c3+c4")}
    scores = {(r.b_id, r.c_id): r.reference_score for r in J.QUERIES["p_match_scores"](spark, "").collect()}
    assert scores == {("b1", "c1"): 0.85, ("b2", "c2"): 0.0, ("b4", "c5"): 1.0, ("b5", "c6"): 0.0}


def test_eight_known_rows(spark):
    bank = side(spark, [
        ("B1", 0, "UPI-AMAZON PAY INDIA-429182@okhdfc", "1250.00", "DEBIT", "UPI0092817"), ("B2", 1, "SALARY CREDIT OCT 2026 ACME CORP", "85000.00", "CREDIT", "SAL992810"),
        ("B3", 3, "NEFT-ABC LOGISTICS CORP-SERVICES", "48500.00", "DEBIT", "NEFT881920"), ("B4", 4, "ATM CASH WITHDRAWAL BKC BRANCH", "10000.00", "DEBIT", "ATM109281"),
        ("B5", 5, "AMAZON WEB SERVICES CLOUD HOSTING", "25000.00", "DEBIT", "AWS771920"), ("B6", 5, "AMAZON WEB SERVICES CLOUD HOSTING", "25000.00", "DEBIT", "AWS771920"),
        ("B7", 6, "OFFICE SUPPLIES INDIA PVT LTD", "4200.00", "DEBIT", "OFF99120"), ("B8", 7, "BULK VENDOR PAYMENT VEND-992", "25000.00", "DEBIT", "UTR9928")], "BANK_STATEMENT")
    company = side(spark, [
        ("C1", 0, "Amazon Seller Services India", "1250.00", "DEBIT", "UPI0092817"), ("C2", 1, "October Payroll Acme Corp", "85000.00", "CREDIT", "SAL992810"),
        ("C3", 1, "ABC Logistics Delivery Charges", "48500.00", "DEBIT", "NEFT881920"), ("C4", 5, "Amazon Web Services Hosting", "25000.00", "DEBIT", "AWS771920"),
        ("C5", 6, "Office Supplies India", "4000.00", "DEBIT", "OFF99120"), ("C6", 7, "Vendor Part A Payment", "10000.00", "DEBIT", "VEND-A"),
        ("C7", 7, "Vendor Part B Payment", "15000.00", "DEBIT", "VEND-B"), ("C8", 8, "Client Retainer Invoice #1042", "50000.00", "CREDIT", "INV1042")], "ACCOUNTING_LEDGER")
    matches, left = R.match_pipeline(bank, company)
    got = {m.bank_transaction_id: (m.company_transaction_id, m.match_type, m.status, m.confidence) for m in matches.collect()}
    assert got == {
        "B1": ("C1", "REFERENCE", "MATCHED", 0.95), "B2": ("C2", "REFERENCE", "MATCHED", 0.95), "B5": ("C4", "EXACT", "MATCHED", 1.0), "B3": ("C3", "REFERENCE", "PROBABLE_MATCH", 0.864),
        "B7": ("C5", "REFERENCE", "PROBABLE_MATCH", 0.84), "B6": ("C6+C7", "COMPOSITE", "PROBABLE_MATCH", 0.88), "B4": (None, "NONE", "UNMATCHED", 0.0), "B8": (None, "NONE", "UNMATCHED", 0.0)}
    found = A.detect_anomalies(bank, company, matches, left).collect()
    assert sorted((f.type, f.severity, f.transaction_id) for f in found) == [
        ("AMOUNT_MISMATCH", "MEDIUM", "B7"), ("COMPOSITE_MATCH", "LOW", "B6"), ("DATE_MISMATCH", "LOW", "B3"), ("DUPLICATE_TRANSACTION", "HIGH", "B5"),
        ("MISSING_IN_BANK", "HIGH", "C8"), ("MISSING_IN_COMPANY", "HIGH", "B4"), ("MISSING_IN_COMPANY", "HIGH", "B8")]
    assert sum(f.amount_difference for f in found) == Decimal("85200.00")


def test_equal_rows_are_paired_in_order_without_rounds(spark, monkeypatch):
    rows = lambda p, n, gap=0: side(spark, [(f"{p}{i:04d}", gap, "salary", "100.00", "DEBIT", None) for i in range(n)], "X")
    monkeypatch.setattr(R, "match_classes", lambda *a: assign.match_classes(*a))
    monkeypatch.setattr(assign, "priority_match", lambda *a: pytest.fail("no rounds are needed"))
    for stage, gap in ((R.match_exact, 0), (R.match_fuzzy, 0), (R.match_date_tolerance, 4)):
        got = stage(rows("B", 1000), rows("C", 900, gap)).collect()
        assert sorted((m.bank_transaction_id, m.company_transaction_id) for m in got) == [(f"B{i:04d}", f"C{i:04d}") for i in range(900)]


def test_ranks_over_ranges(spark, monkeypatch):
    from ledgerline.functions import runtime

    rows = spark.range(1000).selectExpr("id % 3 as k", "id * 7919 % 1000 as o")
    monkeypatch.setattr(runtime, "HOT_ROWS", 50)
    got = runtime.rank_within(rows, ["k"], "o", "turn").collect()
    for k in range(3):
        mine = sorted((r.o, r.turn) for r in got if r.k == k)
        assert [t for _, t in mine] == list(range(1, len(mine) + 1))


def classes_and_rows(spark, rng, n_bank, n_company, kinds, share):
    bank = [(f"b{i:02d}", rng.randrange(kinds)) for i in range(n_bank)]
    company = [(f"c{i:02d}", rng.randrange(kinds + 1)) for i in range(n_company)]
    edges = {(x, y): rng.choice([0.8, 0.9]) for x in range(kinds) for y in range(kinds + 1) if rng.random() < share}
    free, expected = set(), set()
    for b, x in bank:
        fit = sorted((-edges[x, y], c) for c, y in company if (x, y) in edges and c not in free)
        if fit:
            free.add(fit[0][1]), expected.add((b, fit[0][1]))

    def frame(rows, p):
        df = spark.createDataFrame(rows, f"{p}_id string, cls int")
        place = F.struct(F.lit(None).cast("date").alias("date"), F.lit(1).alias("source_row"), F.col(f"{p}_id").alias("id"))
        return df.select(f"{p}_id", place.alias(f"{p}_ord"), F.col("cls").cast("string").alias(f"{p}_cls"))

    e = spark.createDataFrame([(str(x), str(y), w) for (x, y), w in edges.items()], "b_cls string, c_cls string, w double")
    return frame(bank, "b"), frame(company, "c"), e, expected


@pytest.mark.parametrize("bound", [None, 0, 12])
def test_classes_are_serial_choice(spark, monkeypatch, bound):
    rng = random.Random(3)
    if bound is not None:  # groups beyond the bound: components, and rounds across those still beyond it
        monkeypatch.setattr(assign, "GROUP_ROWS", bound)
    for kinds, share in ((5, 0.4), (20, 0.05)):
        bank, company, e, expected = classes_and_rows(spark, rng, 40, 40, kinds, share)
        got = assign.match_classes(bank, company, e, F.lit(0), F.col("w"))
        assert {(r.b_id, r.c_id) for r in got.collect()} == expected


@pytest.mark.parametrize("bound", [10, 30])
def test_a_group_beyond_the_bound_is_settled_in_slices(spark, monkeypatch, bound):
    rng = random.Random(5)
    monkeypatch.setattr(assign, "GROUP_ROWS", bound)
    for name in ("_components", "priority_match"):
        monkeypatch.setattr(assign, name, lambda *a: pytest.fail("no rounds are needed"))
    for kinds, share in ((5, 0.5), (30, 0.2)):
        bank, company, e, expected = classes_and_rows(spark, rng, 40, 40, kinds, share)
        assert {(r.b_id, r.c_id) for r in assign.match_classes(bank, company, e, F.lit(0), F.col("w")).collect()} == expected


def test_a_group_beyond_the_bound_with_long_chains(spark, monkeypatch):
    monkeypatch.setattr(assign, "GROUP_ROWS", 10)
    monkeypatch.setattr(assign, "LABEL_ROUNDS", 2)
    name = lambda i: str(i)
    chain = [(name(i), name(j), 1.0) for i in range(14) for j in (i, i + 1)] + [(name(100), name(100), 1.0), (name(100), name(101), 1.0)]
    side_ = lambda p, ids: spark.createDataFrame([(f"{p}{i:03d}", i) for i in ids], f"{p}_id string, cls int").select(
        f"{p}_id", F.struct(F.lit(None).cast("date").alias("date"), F.lit(1).alias("source_row"), F.col(f"{p}_id").alias("id")).alias(f"{p}_ord"),
        F.col("cls").cast("string").alias(f"{p}_cls"))
    got = assign.match_classes(side_("b", [*range(14), 100]), side_("c", [*range(15), 100, 101]), spark.createDataFrame(chain, "b_cls string, c_cls string, w double"), F.lit(0))
    assert {(r.b_id, r.c_id) for r in got.collect()} == {(f"b{i:03d}", f"c{i:03d}") for i in [*range(14), 100]}


def stored_steps(monkeypatch):
    seen = []
    for module in (assign, R):
        monkeypatch.setattr(module, "stored", lambda df, f=module.stored: (seen.append(1), f(df))[1])
    return seen


def test_alike_texts_with_one_odd_pair_take_few_stored_steps(spark, monkeypatch):
    texts = [f"monthly salary payment of staff member {i:02d}" for i in range(24)]
    rows = lambda p, odd: side(spark, [(f"{p}{i:02d}", 0, t, "100.00", "DEBIT", None) for i, t in enumerate([*texts, odd])], "X")
    seen = stored_steps(monkeypatch)
    bank, company = rows("B", "rent"), rows("C", "monthly salary payment")
    got = {(m.bank_transaction_id, m.company_transaction_id) for m in R.match_exact(bank, company).collect()}
    assert len(seen) <= 8
    order = lambda d: sorted(d.collect(), key=lambda r: r.id)
    assert got == {(b, c) for stage, b, c in sequential(order(bank), order(company)) if stage == "EXACT"}


def test_many_equal_rows_and_an_odd_one_without_pairs_of_rows(spark, monkeypatch):
    monkeypatch.setattr(assign, "priority_match", lambda *a: pytest.fail("no rounds are needed"))
    n = 10_000
    rows = lambda p, odd: side(spark, [*[(f"{p}{i:05d}", 0, "salary october", "100.00", "DEBIT", None) for i in range(n)], (f"{p}{n}", 0, odd, "100.00", "DEBIT", None)], "X")
    seen = stored_steps(monkeypatch)
    got = R.match_exact(rows("B", "salary october staff"), rows("C", "october salary")).collect()
    assert sorted((m.bank_transaction_id, m.company_transaction_id) for m in got) == [(f"B{i:05d}", f"C{i:05d}") for i in range(n + 1)] and len(seen) <= 8


def test_duplicate_groups_are_components_of_pairs(spark):
    rng = random.Random(6)
    texts = ["monthly rent north", "rent monthly north", "monthly rents north", "tea", "teas", "wood and coal"]
    rows = side(spark, [(f"B{i:02d}", rng.randrange(12), rng.choice(texts), rng.choice(["5.00", "6.00"]), "DEBIT", None) for i in range(70)], "BANK")
    pairs = [(r.id1, r.id2) for r in A.duplicate_pairs(rows, 0.85).collect()]
    all_rows = sorted(rows.collect(), key=lambda r: (r.date, r.source_row, r.id))
    wanted = {(a.id, b.id) for i, a in enumerate(all_rows) for b in all_rows[i + 1 :]
              if a.amount == b.amount and abs((a.date - b.date).days) <= 1 and description_score(a.description, b.description) >= 0.85}
    assert len(pairs) == len(set(pairs)) and set(pairs) == wanted
    group = {r.id: r.id for r in all_rows}
    for _ in range(len(all_rows)):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b], key=lambda i: [r.id for r in all_rows].index(i))
    got = {r.id: (r.group_id, r.group_size, r.n_links) for r in A.duplicate_groups(rows, 0.85).collect()}
    linked = {i for p in pairs for i in p}
    assert got == {i: (group[i], sum(group[j] == group[i] for j in linked), sum(i in p for p in pairs)) for i in linked}


def test_many_equal_rows_are_a_group_without_pairs(spark):
    n = 10_000
    rows = side(spark, [(f"B{i:05d}", 0, "fee", "5.00", "DEBIT", None) for i in range(n)] + [("C", 1, "fees", "5.00", "DEBIT", None), ("D", 5, "fee", "5.00", "DEBIT", None)], "BANK")
    got = A.duplicate_groups(rows, 0.80).collect()
    assert len(got) == n + 1 and {(r.group_id, r.group_size, r.n_links) for r in got} == {("B00000", n + 1, n)}


def test_sums_of_two_are_told_before_rows_are_joined(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 3)
    rng = random.Random(7)
    bank = side(spark, [(f"B{i}", rng.randrange(20), "b", f"{rng.randrange(400, 4000)}.00", "DEBIT", f"X{i}") for i in range(60)], "BANK")
    company = side(spark, [(f"C{i}", rng.randrange(20), "c", f"{rng.randrange(1, 2500)}.00", "DEBIT", f"Y{i}") for i in range(80)], "LEDGER")
    order = lambda d: sorted(d.collect(), key=lambda r: (r.date, r.source_row, r.id))
    made = []
    monkeypatch.setattr(R, "priority_pairs", lambda e: (made.append(e.count()), assign.priority_pairs(e))[1])
    b, c = order(bank), order(company)
    used, expected = set(), set()
    for x in b:
        free = [y for y in c if y.id not in used and abs((x.date - y.date).days) <= 5]
        pair = next(((y, z) for i, y in enumerate(free) for z in free[i + 1 :] if y.amount + z.amount == x.amount), None)
        if pair:
            used.update(p.id for p in pair), expected.add((x.id, "+".join(p.id for p in pair)))
    assert {(m.bank_transaction_id, m.company_transaction_id) for m in R.match_composite(bank, company).collect()} == expected and expected


def test_fuzzy_candidates_are_all_pairs_that_can_reach_the_threshold(spark):
    rng = random.Random(8)
    refs = [None, None, "7", "41", "UTR7", "  ", "UTR123456", "utr123456", "XUTR123456/9", "123456", "23456", "PAY-998877-A", "998877-A", "Z9", "ABCDEFGHIJ", "EFGHIJ"]
    amounts = ["100.00", "100.50", "99.50", "102.00", "98.00", "105.00", "95.00", "95.24", "104.99", "100.01", "7.00", "900.00"]
    rows = lambda p: [(f"{p}{i}", rng.choice([0, 0, 1, 2, 3, 4, 5, 6, 9, 40]), "rent", rng.choice(amounts), rng.choice(["DEBIT", "CREDIT"]), rng.choice(refs)) for i in range(130)]
    bank, company = side(spark, rows("B"), "BANK_STATEMENT"), side(spark, rows("C"), "LEDGER")
    b, c = R._classes(bank, "b"), R._classes(company, "c")
    ref = S.reference_score(F.col("b_reference"), F.col("c_reference"))
    parts = (S.amount_score(F.col("b_amount"), F.col("c_amount")), S.date_score(S.days_apart(F.col("b_date"), F.col("c_date"))), F.lit(1.0), ref)
    every = b.join(c, ["reconciliation_id", "type"]).filter(S.match_score(*parts, F.col("b_reference"), F.col("c_reference")) >= R.FUZZY)
    pairs = lambda d: sorted((r.b_cls, r.c_cls) for r in d.select("b_cls", "c_cls").collect())
    assert pairs(R.fuzzy_candidates(bank, company)) == pairs(every)


def test_unrelated_references_of_far_dates_are_not_paired(spark):
    n = 400
    rows = lambda p, ref, far: [(f"{p}{i}", 9 * i + far, "rent", "100.00", "DEBIT", f"{ref}{i:06d}") for i in range(n)]
    pairs = R.fuzzy_candidates(side(spark, rows("B", "AA", 0), "BANK_STATEMENT"), side(spark, rows("C", "BB", 4), "LEDGER"))
    assert pairs.isEmpty()
    joins = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "contains(" in x.lower()]
    assert any("(g#" in x for x in joins)  # references that hold others are met by their characters, not by amounts alone
