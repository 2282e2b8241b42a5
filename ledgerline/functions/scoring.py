"""Scores of a bank row against a ledger row, as column expressions over decimals and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of amount, date, description, reference and type.
W_AMOUNT, W_DATE, W_DESC, W_REF, W_TYPE = 0.40, 0.20, 0.20, 0.15, 0.05


def amount_score(a: Column, b: Column) -> Column:
    """1 for equal amounts, then by the difference relative to the larger: 0.5, 2, 5 and 10 per cent."""
    diff, top = F.abs(a - b), F.greatest(a, b)
    return (
        F.when(diff == 0, 1.0).when(diff * 200 <= top, 0.95).when(diff * 50 <= top, 0.85).when(diff * 20 <= top, 0.60)
        .when(diff * 10 <= top, 0.30).otherwise(0.0)
    )


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.date_diff(a, b))


def date_score(days: Column) -> Column:
    return (
        F.when(days == 0, 1.0).when(days == 1, 0.9).when(days == 2, 0.8).when(days == 3, 0.6).when(days <= 5, 0.4).otherwise(0.0)
    )


def _present(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def reference_score(a: Column, b: Column) -> Column:
    """1 for equal references without regard to case, .85 where one holds the other, 0 where one is missing."""
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    return F.when(~_present(a) | ~_present(b), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.85).otherwise(0.0)


def match_score(amt: Column, date: Column, desc: Column, ref: Column, ref_a: Column, ref_b: Column) -> Column:
    """Weighted score of rows of the same type; without references on both sides the rest is scaled up."""
    core = amt * W_AMOUNT + date * W_DATE + desc * W_DESC
    bare = (core + W_TYPE) / 0.85
    total = F.when(~_present(ref_a) & ~_present(ref_b), bare).otherwise(core + ref * W_REF + W_TYPE)
    return F.least(F.round(F.when(amt == 0, F.least(total, F.lit(0.45))).otherwise(total), 4), F.lit(1.0))


def days_that_reach(least: float, a: Column, b: Column, ref: float | None) -> Column:
    """Days up to which amounts can reach the score ``least`` with equal descriptions, by ``match_score``; -1 where they cannot.

    ``ref`` is the score of the references, or None if both are missing.
    """
    def upto(amt: float) -> int:
        core = lambda date: amt * W_AMOUNT + date * W_DATE + W_DESC
        total = lambda date: (core(date) + W_TYPE) / 0.85 if ref is None else core(date) + ref * W_REF + W_TYPE
        fits = [d for d, date in enumerate((1.0, 0.9, 0.8, 0.6, 0.4, 0.4, 0.0)) if round(total(date), 4) >= least]
        return -1 if not fits else 2**31 - 1 if fits[-1] == 6 else fits[-1]

    diff, top = F.abs(a - b), F.greatest(a, b)
    return (
        F.when(diff == 0, upto(1.0)).when(diff * 200 <= top, upto(0.95)).when(diff * 50 <= top, upto(0.85)).when(diff * 20 <= top, upto(0.60))
        .when(diff * 10 <= top, upto(0.30)).otherwise(-1)
    )


def money(c: Column) -> Column:
    """Amount with thousands separators and two places."""
    return F.format_number(c, 2)


def match_reasons(a: Column, b: Column, amt: Column, days: Column, desc: Column, ref: Column) -> Column:
    """Texts that explain a score, in a fixed order. The texts."""
    diff = F.abs(a - b)
    return F.array_compact(
        F.array(
            F.when(diff == 0, "Amount matched exactly")
            .when(amt > 0, F.concat(F.lit("Amount difference of ₹"), diff.cast("string")))
            .otherwise(F.concat(F.lit("Significant amount mismatch: ₹"), a.cast("string"), F.lit(" vs ₹"), b.cast("string"))),
            F.when(days == 0, "Date matched exactly")
            .when(days == 1, "Date differs by 1 day (within tolerance)")
            .when(days == 2, "Date differs by 2 days (within tolerance)")
            .otherwise(F.concat(F.lit("Date differs by "), days.cast("string"), F.lit(" days"))),
            F.when(desc >= 0.90, "Description strongly matched").when(
                desc >= 0.70, F.concat(F.lit("Description partially matched ("), (desc * 100).cast("int").cast("string"), F.lit("%)"))
            ),
            F.when(ref == 1.0, "Reference / UTR number matched exactly"),
        )
    )
