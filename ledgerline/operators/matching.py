"""Staged one-to-one reconciliation of bank rows with company rows.

Transactions have ``id``, ``reconciliation_id``, ``source_id``, ``source_type``,
``date``, ``description``, ``amount`` (decimal), ``type``, ``reference`` and
``source_row``. All reconciliations are worked on at once; every key starts with
``reconciliation_id``. Each stage sees what the stages before it left.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import scoring as S
from ledgerline.functions.runtime import stored
from ledgerline.functions.text import with_text_score
from ledgerline.operators.assign import match_classes, priority_pairs

#: Source types of either side, thresholds, texts.
BANK_TYPES = ("BANK_STATEMENT", "BANK")
COMPANY_TYPES = ("ACCOUNTING_LEDGER", "COMPANY_ACCOUNTS", "LEDGER")
FUZZY, TOLERANT, REFERENCE, SURE = 0.75, 0.70, 0.80, 0.90
WINDOW_DAYS = 5
COMPOSITE_CONFIDENCE = 0.88
NO_CANDIDATE = "No corresponding candidate transaction found in company accounts"

def split_sides(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bank and company rows. Where a reconciliation has bank rows, no company rows and several sources,
    its first source is the bank and the second the company: by ``source_seq`` (order of creation) if there is one, then by id."""
    is_bank, is_company = F.col("source_type").isin(*BANK_TYPES), F.col("source_type").isin(*COMPANY_TYPES)
    sources = transactions.groupBy("reconciliation_id", "source_id").agg(
        F.max(is_bank).alias("bank"), F.max(is_company).alias("company"),
        F.min("source_seq" if "source_seq" in transactions.columns else F.lit(0)).alias("seq"),
    )
    per = W.partitionBy("reconciliation_id")
    sources = (
        sources.withColumn("turn", F.row_number().over(per.orderBy("seq", "source_id")))
        .withColumn("fall_back", F.max("bank").over(per) & ~F.max("company").over(per) & (F.count(F.lit(1)).over(per) >= 2))
        .select("reconciliation_id", "source_id", "turn", "fall_back")
    )
    marked = transactions.join(sources, ["reconciliation_id", "source_id"])
    bank = marked.filter(F.when(F.col("fall_back"), F.col("turn") == 1).otherwise(is_bank))
    company = marked.filter(F.when(F.col("fall_back"), F.col("turn") == 2).otherwise(is_company))
    return bank.drop("turn", "fall_back"), company.drop("turn", "fall_back")


def input_status(transactions: DataFrame) -> DataFrame:
    """Rows of either side and whether a run can start, for each reconciliation."""
    out = transactions.groupBy("reconciliation_id").agg(
        F.count_if(F.col("source_type").isin(*BANK_TYPES)).alias("bank_count"),
        F.count_if(F.col("source_type").isin(*COMPANY_TYPES)).alias("company_count"),
    )
    ready = lambda c: F.col(c) > 0
    return out.select(
        "*", ready("bank_count").alias("bank_ready"), ready("company_count").alias("company_ready"),
        (ready("bank_count") & ready("company_count")).alias("can_start"),
    )


#: What makes rows of a side alike for matching.
_CLASS = ("reconciliation_id", "type", "amount", "date", "description", "reference")


def _class_fields() -> list[Column]:
    """The fields of a class; absent texts are empty."""
    return [F.coalesce(c, F.lit("")).alias(c) if c in ("description", "reference") else F.col(c) for c in _CLASS]


def _class_name() -> Column:
    """A class by two 64-bit hashes of its fields and of which of them are null: 128 bits, whatever the length of the texts."""
    parts = [*[F.col(c).isNull() for c in _CLASS[:4]], *_class_fields()]
    return F.concat_ws(":", *[F.xxhash64(F.lit(seed), *parts).cast("string") for seed in (1, 2)])


def with_classes(side: DataFrame) -> DataFrame:
    """A stored side with the name of each row's class, ``cls``; one that has it already as it is."""
    return side if "cls" in side.columns else stored(side.withColumn("cls", _class_name()))


def _rows(side: DataFrame, p: str) -> DataFrame:
    """Id, place in the order and class of each row."""
    return with_classes(side).select(F.col("id").alias(f"{p}_id"), F.struct("date", "source_row", "id").alias(f"{p}_ord"), F.col("cls").alias(f"{p}_cls"))


def _classes(side: DataFrame, p: str) -> DataFrame:
    """The distinct classes of a side, their numbers of rows, and their fields: ``reconciliation_id``, ``type`` and the others by prefix."""
    classes = with_classes(side).select("cls", *_class_fields()).groupBy("cls", *_CLASS).agg(F.count(F.lit(1)).alias(f"{p}_n"))
    own = [F.col(c).alias(f"{p}_{c}") for c in _CLASS[2:]]
    return classes.select(F.col("cls").alias(f"{p}_cls"), f"{p}_n", "reconciliation_id", "type", *own)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Add scores, ``confidence``, differences and reasons to pairs of rows with ``b_`` and ``c_`` columns.

    Types are ``b_type`` and ``c_type`` or, of pairs that share it, ``type``.
    """
    days = S.days_apart(F.col("b_date"), F.col("c_date"))
    if "type" in pairs.columns:
        pairs = pairs.withColumns({"b_type": F.col("type"), "c_type": F.col("type")}).drop("type")
    out = with_text_score(stored(pairs), "b_description", "c_description").select(
        "*", S.amount_score(F.col("b_amount"), F.col("c_amount")).alias("amount_score"), days.alias("days"),
        S.reference_score(F.col("b_reference"), F.col("c_reference")).alias("reference_score"),
        F.abs(F.col("b_amount") - F.col("c_amount")).cast("decimal(18,2)").alias("diff"),
    )
    out = out.withColumn("date_score", S.date_score(F.col("days")))
    conf = S.match_score(*[F.col(c) for c in ("amount_score", "date_score", "desc_score", "reference_score", "b_reference", "c_reference")])
    why = S.match_reasons(*[F.col(c) for c in ("b_amount", "c_amount", "amount_score", "days", "desc_score", "reference_score")])
    same = F.col("b_type") == F.col("c_type")
    scores = ("amount_score", "date_score", "desc_score", "reference_score")
    out = out.withColumn("confidence", F.when(same, conf).otherwise(0.0))
    clash = F.concat(F.lit("Direction conflict: Bank is "), F.col("b_type"), F.lit(" but Company is "), F.col("c_type"))
    out = out.withColumn("reasons", F.when(same, why).otherwise(F.array(clash)))
    return out.withColumns({c: F.when(same, F.col(c)).otherwise(0.0) for c in scores})


def _assigned(bank: DataFrame, company: DataFrame, scored: DataFrame, keys: tuple[str, ...], prefer: Column | None = None) -> DataFrame:
    """One-to-one pairs of rows from the scored pairs of classes that may meet; by order alone, or the surest first.

    All pairs agree in ``keys``; that two values can share a number does no harm.
    """
    return match_classes(_rows(bank, "b"), _rows(company, "c"), scored, F.xxhash64("reconciliation_id", "b_type", *keys), prefer)


def _result(pairs: DataFrame, stage: str, status: Column, kind: Column, confidence: Column, reasons: Column) -> DataFrame:
    return pairs.select(
        "reconciliation_id", F.lit(stage).alias("stage"), F.col("b_id").alias("bank_transaction_id"),
        F.col("c_id").alias("company_transaction_id"), F.array("c_id").alias("company_ids"), status.alias("status"),
        kind.alias("match_type"), confidence.alias("confidence"), F.col("diff").alias("amount_difference"),
        F.col("days").alias("date_difference_days"), "amount_score", "date_score",
        F.col("desc_score").alias("description_score"), "reference_score", F.lit(1.0).alias("type_score"), reasons.alias("reasons"),
    )


def _first_two() -> Column:
    return F.slice("reasons", 1, 2)


def match_exact(bank: DataFrame, company: DataFrame) -> DataFrame:
    """Same type, amount and date, and equal references or descriptions of .85 and more: MATCHED, at least .95."""
    bank, company = with_classes(bank), with_classes(company)
    b, c = _classes(bank, "b"), _classes(company, "c")
    key = {"amount": "b_amount", "date": "b_date"}
    pairs = b.withColumns({k: F.col(v) for k, v in key.items()}).join(
        c.withColumns({k: F.col(v.replace("b_", "c_")) for k, v in key.items()}), ["reconciliation_id", "type", *key]
    ).drop(*key)
    same_ref = (F.col("b_reference") != "") & (F.upper("b_reference") == F.upper("c_reference"))
    won = _assigned(bank, company, score_pairs(pairs).filter(same_ref | (F.col("desc_score") >= 0.85)), ("b_amount", "b_date"))
    kind = F.when(same_ref & (F.col("desc_score") < 0.85), "REFERENCE").otherwise("EXACT")
    why = F.concat(F.array(F.lit("Amount matched"), F.lit("Date matched"), F.lit("Direction matched")), _first_two())
    return _result(won, "EXACT", F.lit("MATCHED"), kind, F.greatest("confidence", F.lit(0.95)), why)


def match_reference(bank: DataFrame, company: DataFrame) -> DataFrame:
    """Same type and reference, and equal amounts or a score of .80: MATCHED from .90, else PROBABLE_MATCH.

    A MATCHED pair can differ in amount or date.
    """
    bank, company = with_classes(bank), with_classes(company)
    keyed = lambda side, p: _classes(side, p).filter(f"{p}_reference <> ''").withColumn("key", F.upper(F.trim(f"{p}_reference")))
    pairs = keyed(bank, "b").join(keyed(company, "c"), ["reconciliation_id", "type", "key"])
    won = _assigned(bank, company, score_pairs(pairs).filter((F.col("diff") == 0) | (F.col("confidence") >= REFERENCE)), ("key",))
    why = F.concat(F.array(F.lit("Reference / UTR matched exactly")), _first_two())
    status = F.when(F.col("confidence") >= SURE, "MATCHED").otherwise("PROBABLE_MATCH")
    return _result(won, "REFERENCE", status, F.lit("REFERENCE"), F.col("confidence"), why)


#: Characters at the end of a reference by which references that hold it are found; shorter ones are met by amounts.
GRAM = 6


def _bucketed(b: DataFrame, c: DataFrame, share: float, days: int | None = None) -> tuple[DataFrame, DataFrame, list[str], Column]:
    """Classes with the buckets of amounts (above 0) that a ``share`` reaches and of dates within ``days``, the names of these, and what a pair then has to hold.

    Buckets are wider than the reach, so most bank classes stand in one or two of either kind.
    """
    reach = -math.log(1 - share) + 1e-9
    name = lambda p, shift: F.floor((F.log(f"{p}x") + shift) / (2.5 * reach))
    b, c = (d.filter(f"{p}_amount > 0").withColumn(f"{p}x", F.col(f"{p}_amount").cast("double")) for d, p in ((b, "b"), (c, "c")))
    b = b.withColumn("ka", F.explode(F.sequence(name("b", -reach), name("b", reach))))
    c, keys = c.withColumn("ka", name("c", 0)), ["ka"]
    met = F.abs(F.col("bx") - F.col("cx")) <= F.greatest("bx", "cx") * (share + 1e-9)
    if days is not None:
        day = lambda p, shift: F.floor((F.unix_date(f"{p}_date") + shift) / (2 * days + 2))
        b = b.withColumn("kd", F.explode(F.sequence(day("b", -days), day("b", days))))
        c, keys, met = c.withColumn("kd", day("c", 0)), ["ka", "kd"], met & (F.abs(F.date_diff("b_date", "c_date")) <= days)
    return b, c, keys, met


def _related(b: DataFrame, c: DataFrame) -> DataFrame:
    """Pairs of classes with references of which one holds the other and amounts within 5 per cent, near in date or within half a per cent.

    A reference of GRAM characters and more is met, by its last ones, with all that have these anywhere.
    """
    base = ["reconciliation_id", "type"]
    own = lambda d, p: d.filter(f"{p}_reference <> ''").withColumn(f"{p}r", F.upper(F.trim(f"{p}_reference")))
    b, c, cols = own(b, "b"), own(c, "c"), [*base, *[x for x in (*b.columns, *c.columns) if x not in base]]
    long = lambda p: F.length(f"{p}r") >= GRAM
    end = lambda p: F.right(F.col(f"{p}r"), F.lit(GRAM))
    every = lambda p: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(f"{p}r") - GRAM + 1), lambda i: F.substr(F.col(f"{p}r"), i, F.lit(GRAM)))))
    longer = F.length("br") >= F.length("cr")
    parts = []
    x, y, keys, met = _bucketed(b.filter(long("b")), c.filter(long("c")), 0.05)
    for of_b, of_c, holds in ((every("b"), end("c"), longer & F.col("br").contains(F.col("cr"))), (end("b"), every("c"), ~longer & F.col("cr").contains(F.col("br")))):
        parts.append(x.withColumn("g", of_b).join(y.withColumn("g", of_c), [*base, *keys, "g"]).filter(met & holds))
    holds = F.col("br").contains(F.col("cr")) | F.col("cr").contains(F.col("br"))
    for one, two in ((b.filter(~long("b")), c), (b.filter(long("b")), c.filter(~long("c")))):
        for share, days in ((0.05, WINDOW_DAYS), (0.005, None)):
            x, y, keys, met = _bucketed(one, two, share, days)
            far = F.lit(True) if days else F.abs(F.date_diff("b_date", "c_date")) > WINDOW_DAYS
            parts.append(x.join(y, [*base, *keys]).filter(met & far & holds))
    limit = F.when(F.col("br") == F.col("cr"), _upto(1.0)).otherwise(_upto(0.85))
    return reduce(DataFrame.unionByName, [p.filter(_apart() <= limit).select(cols) for p in parts])


def _apart() -> Column:
    return S.days_apart(F.col("b_date"), F.col("c_date"))


def _upto(ref: float | None) -> Column:
    """Days up to which a pair of classes can reach the fuzzy threshold: what it could have with equal descriptions settles most pairs without comparing texts."""
    return S.days_that_reach(FUZZY, F.col("b_amount"), F.col("c_amount"), ref)


def fuzzy_candidates(bank: DataFrame, company: DataFrame) -> DataFrame:
    """All pairs of classes of one type that can reach the fuzzy threshold, found by keys.

    Such a pair is (A) without references, within 5 days and 5 per cent or of equal amount; or (B) of related references, within
    5 days and 5 per cent or within half a per cent; or (C) of other references, within 3 days and 2 per cent. Each case is an equi-join
    on buckets; related references meet by their characters, so that no pair of others is looked at without near dates.
    """
    bank, company = with_classes(bank), with_classes(company)
    b, c = stored(_classes(bank, "b")), stored(_classes(company, "c"))
    base = ["reconciliation_id", "type"]
    cols = [*base, *[x for x in (*b.columns, *c.columns) if x not in base]]
    none = lambda p: F.col(f"{p}_reference") == ""
    x, y, keys, met = _bucketed(b.filter(none("b")), c.filter(none("c")), 0.05, WINDOW_DAYS)
    near = x.join(y, [*base, *keys]).filter(met)
    far = b.filter(none("b")).withColumn("k", F.col("b_amount")).join(c.filter(none("c")).withColumn("k", F.col("c_amount")), [*base, "k"])
    far = far.filter(_apart() > WINDOW_DAYS)
    alike = near.select(cols).unionByName(far.select(cols)).filter(_apart() <= _upto(None))
    x, y, keys, met = _bucketed(b, c, 0.02, 3)
    related = S.reference_score(F.col("b_reference"), F.col("c_reference")) > 0
    others = x.join(y, [*base, *keys]).filter(met).filter(_apart() <= _upto(0.0)).filter(~(none("b") & none("c")) & ~related)
    return alike.unionByName(others.select(cols)).unionByName(_related(b, c))


def match_fuzzy(bank: DataFrame, company: DataFrame) -> DataFrame:
    """The free company row of the highest score from .75: MATCHED from .90 with equal amount and date."""
    bank, company = with_classes(bank), with_classes(company)
    scored = score_pairs(fuzzy_candidates(bank, company)).filter(F.col("confidence") >= FUZZY)
    won = _assigned(bank, company, scored, (), F.col("confidence"))
    sure = (F.col("confidence") >= SURE) & (F.col("days") == 0) & (F.col("diff") == 0)
    status = F.when(sure, "MATCHED").otherwise("PROBABLE_MATCH")
    kind = F.when(F.col("days") > 0, "DATE_TOLERANCE").otherwise("FUZZY")
    return _result(won, "FUZZY", status, kind, F.col("confidence"), F.col("reasons"))


def match_date_tolerance(bank: DataFrame, company: DataFrame) -> DataFrame:
    """Same type and amount, 1 to 5 days apart, a score of .70: PROBABLE_MATCH."""
    bank, company = with_classes(bank), with_classes(company)
    b, c = _classes(bank, "b").withColumn("amount", F.col("b_amount")), _classes(company, "c").withColumn("amount", F.col("c_amount"))
    pairs = b.join(c, ["reconciliation_id", "type", "amount"]).drop("amount")
    pairs = pairs.filter(S.days_apart(F.col("b_date"), F.col("c_date")).between(1, WINDOW_DAYS))
    won = _assigned(bank, company, score_pairs(pairs).filter(F.col("confidence") >= TOLERANT), ("b_amount",))
    lead = F.concat(F.lit("Amount matches; date differs by "), F.col("days").cast("string"), F.lit(" days (timing window)"))
    return _result(won, "DATE_TOLERANCE", F.lit("PROBABLE_MATCH"), F.lit("DATE_TOLERANCE"), F.col("confidence"), F.concat(F.array(lead), _first_two()))


def _side(df: DataFrame, p: str) -> DataFrame:
    """Id, date, amount and place in the order of the rows of a side, with a prefix."""
    named = [F.col(c).alias(f"{p}_{c}") for c in ("id", "date", "amount")]
    return df.select("reconciliation_id", "type", *named, F.struct("date", "source_row", "id").alias(f"{p}_ord"))


#: Bank amounts of a window that one call looks through.
SLICE = 2_000


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("b", T.LongType()), T.StructField("small", T.LongType())])))
def _two_sums(wanted: pd.Series, there: pd.Series) -> pd.Series:
    """Of whole numbers, those ``wanted`` that are the sum of two of ``there`` (or twice one), with the smaller one."""
    out = []
    for w, t in zip(wanted, there, strict=True):
        have, found = np.unique(np.asarray(t, np.int64)), []
        for b in np.unique(np.asarray(w, np.int64)):
            small = have[: np.searchsorted(have, b // 2, side="right")]
            at = np.searchsorted(have, b - small)
            hit = small[(at < len(have)) & (have[np.minimum(at, len(have) - 1)] == b - small)]
            found += [{"b": int(b), "small": int(x)} for x in hit]
        out.append(found)
    return pd.Series(out)


def _sums(b: DataFrame, c: DataFrame) -> DataFrame:
    """``b_amount`` and ``small_amount`` by reconciliation, type and window of six days (``kd``): the bank amounts of the window that two
    company amounts of it and its neighbours add up to.

    Windows hold distinct amounts; a window with many bank amounts is split into slices of about SLICE.
    """
    keys = ["reconciliation_id", "type", "kd"]
    cents = lambda col: (F.col(col) * 100).cast("long")
    amounts = b.select(*keys, cents("b_amount").alias("a")).distinct()
    sizes = amounts.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices"))
    sliced = amounts.join(sizes, keys).groupBy(*keys, F.pmod(F.xxhash64("a"), F.col("slices")).alias("slice")).agg(F.collect_list("a").alias("wanted"))
    around = c.filter("c_amount > 0").select(*keys[:2], F.explode(F.sequence(F.col("kd") - 1, F.col("kd") + 1)).alias("kd"), cents("c_amount").alias("a")).distinct()
    there = around.groupBy(*keys).agg(F.collect_list("a").alias("there"))
    found = sliced.join(there, keys).select(*keys, F.explode(_two_sums("wanted", "there")).alias("f"))
    money = lambda n: (F.col(f"f.{n}").cast("decimal(20,0)") / 100).cast("decimal(18,2)")
    return found.select(*keys, money("b").alias("b_amount"), money("small").alias("small_amount")).distinct()


def match_composite(bank: DataFrame, company: DataFrame) -> DataFrame:
    """Two company rows of one type within 5 days whose amounts add up to the bank amount: PROBABLE_MATCH.

    Which bank amounts are the sum of two company amounts of their days is told first, by distinct amounts alone; only rows of
    these amounts are joined: the smaller of the two by its amount and days, the other by the amount that is missing.
    """
    b, c = _side(bank, "b"), _side(company, "c")
    part = lambda p: c.select("reconciliation_id", "type", *[F.col(f"c_{x}").alias(f"{p}_{x}") for x in ("id", "date", "amount", "ord")])
    within = lambda x: F.abs(F.date_diff("b_date", x)) <= WINDOW_DAYS
    day = lambda x: F.floor(F.unix_date(F.col(x)) / 6)
    sums = stored(_sums(b.withColumn("kd", day("b_date")), c.withColumn("kd", day("c_date"))))
    small = (
        b.withColumn("kd", day("b_date")).join(sums, ["reconciliation_id", "type", "kd", "b_amount"])
        .join(part("small"), ["reconciliation_id", "type", "small_amount"])
        .filter(within("small_date"))
        .withColumn("missing", (F.col("b_amount") - F.col("small_amount")).cast("decimal(18,2)"))
    )
    large = part("large").withColumn("missing", F.col("large_amount").cast("decimal(18,2)"))
    both = small.join(large, ["reconciliation_id", "type", "missing"]).filter(within("large_date"))
    first = F.col("small_ord") < F.col("large_ord")
    both = both.filter(first | ((F.col("small_amount") < F.col("large_amount")) & (F.col("small_id") != F.col("large_id"))))
    turned = lambda x, y: [F.when(first, F.col(f"{x}_{v}")).otherwise(F.col(f"{y}_{v}")) for v in ("id", "date", "amount", "ord")]
    named = [v.alias(f"{p}_{n}") for p, vs in (("one", turned("small", "large")), ("two", turned("large", "small")))
             for n, v in zip(("id", "date", "amount", "ord"), vs, strict=True)]
    both = both.select("reconciliation_id", "b_id", "b_ord", "b_date", "b_amount", *named)
    edges = both.select(
        "reconciliation_id", F.col("b_id").alias("b"), F.col("b_ord").alias("b_rank"), F.col("one_id").alias("c1"),
        F.col("two_id").alias("c2"), F.struct("one_ord", "two_ord").alias("wish"), "b_amount", "one_amount", "two_amount",
        F.greatest(F.abs(F.date_diff("b_date", "one_date")), F.abs(F.date_diff("b_date", "two_date"))).alias("days"),
    )
    lead = F.concat(
        F.lit("Composite Match: Bank ₹"), S.money(F.col("b_amount")), F.lit(" equals Company ₹"), S.money(F.col("one_amount")),
        F.lit(" + ₹"), S.money(F.col("two_amount")),
    )
    return priority_pairs(edges).select(
        "reconciliation_id", F.lit("COMPOSITE").alias("stage"), F.col("b").alias("bank_transaction_id"),
        F.concat_ws("+", "c1", "c2").alias("company_transaction_id"), F.array("c1", "c2").alias("company_ids"),
        F.lit("PROBABLE_MATCH").alias("status"), F.lit("COMPOSITE").alias("match_type"),
        F.lit(COMPOSITE_CONFIDENCE).alias("confidence"), F.lit(0).cast("decimal(18,2)").alias("amount_difference"),
        F.col("days").alias("date_difference_days"), F.lit(1.0).alias("amount_score"), F.lit(0.8).alias("date_score"),
        F.lit(0.0).alias("description_score"), F.lit(0.0).alias("reference_score"), F.lit(1.0).alias("type_score"),
        F.array(lead, F.lit("Matched across 2 split company accounting records")).alias("reasons"),
    )


def unmatched_bank(bank: DataFrame, matches: DataFrame) -> DataFrame:
    """Bank rows that no stage took, as results with status UNMATCHED."""
    left = bank.join(matches.select(F.col("bank_transaction_id").alias("id")), "id", "left_anti")
    zero = [F.lit(0.0).alias(c) for c in ("amount_score", "date_score", "description_score", "reference_score", "type_score")]
    return left.select(
        "reconciliation_id", F.lit("NONE").alias("stage"), F.col("id").alias("bank_transaction_id"),
        F.lit(None).cast("string").alias("company_transaction_id"), F.array().cast("array<string>").alias("company_ids"),
        F.lit("UNMATCHED").alias("status"), F.lit("NONE").alias("match_type"), F.lit(0.0).alias("confidence"),
        F.col("amount").alias("amount_difference"), F.lit(0).alias("date_difference_days"), *zero,
        F.array(F.lit(NO_CANDIDATE)).alias("reasons"),
    )


def unmatched_company(company: DataFrame, matches: DataFrame) -> DataFrame:
    """Company rows that no match holds."""
    used = matches.select(F.explode("company_ids").alias("id"))
    return company.join(used, "id", "left_anti")


STAGES = (match_exact, match_reference, match_fuzzy, match_date_tolerance, match_composite)


def match_pipeline(bank: DataFrame, company: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All stages: one result for each bank row, and the company rows left over."""
    free_b, free_c, found = with_classes(bank), with_classes(company), None
    for stage in STAGES:
        got = stored(stage(free_b, free_c))
        found = got if found is None else found.unionByName(got)
        free_b = stored(free_b.join(got.select(F.col("bank_transaction_id").alias("id")), "id", "left_anti"))
        free_c = stored(unmatched_company(free_c, got))
    rest = unmatched_bank(free_b, found)
    out = found.unionByName(rest)
    key = F.concat_ws("|", "reconciliation_id", "match_type", "bank_transaction_id", F.coalesce("company_transaction_id", F.lit("")))
    return out.withColumn("id", F.concat(F.lit("MATCH_"), F.upper(F.substring(F.sha2(key, 256), 1, 10)))), free_c.drop("cls")


def run_summary(matches: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Counts by status and the run's status, for each reconciliation."""
    of = lambda s: F.count_if(F.col("status") == s)
    counted = matches.groupBy("reconciliation_id").agg(
        F.count(F.lit(1)).alias("total_bank"), of("MATCHED").alias("matched_count"),
        of("PROBABLE_MATCH").alias("probable_count"), of("UNMATCHED").alias("unmatched_count"),
    )
    odd = anomalies.groupBy("reconciliation_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    out = counted.join(odd, "reconciliation_id", "left").withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0).cast("long")))
    clear = (F.col("anomaly_count") == 0) & (F.col("matched_count") == F.col("total_bank"))
    return out.withColumn("run_status", F.when(clear, "COMPLETED").otherwise("REVIEW_REQUIRED"))
