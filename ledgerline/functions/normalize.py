"""Dates, amounts, descriptions and references from raw strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats in the order in which they are tried, with the shape that a text must have.
DATE_FORMATS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", "d-MMM-yy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3,9} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
)
#: Years outside are taken as misread.
FIRST_YEAR, LAST_YEAR = 1990, 2099
#: Texts that stand for no amount or no reference.
NO_AMOUNT = ("", "-", "nil", "none", "n/a")
NO_REFERENCE = ("", "-", "none", "nil", "n/a", "0")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, expression) -> Column:
    """``expression`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), expression), F.lit(0))


def normalize_date(raw: Column) -> Column:
    """First format that gives a year in range; day before month. Two-digit years: 00-68 are 20yy, 69-99 are 19yy."""
    text = F.regexp_replace(strip(raw), r"(?i)\s+\d{1,2}:\d{2}(:\d{2})?(\s*[AP]M)?", "")
    text = F.regexp_replace(strip(text), r"(?U)\s+", " ")
    return let(text, _first_date)


def _first_date(text: Column) -> Column:
    century = F.when(F.right(text, F.lit(2)) <= "68", F.lit("20")).otherwise(F.lit("19"))
    long_year = F.concat(F.regexp_replace(text, r"\d{2}$", ""), century, F.right(text, F.lit(2)))
    tries = []
    for shape, form in DATE_FORMATS:
        value = text
        if form.endswith("yy") and not form.endswith("yyyy"):
            value, form = long_year, form + "yy"
        found = F.try_to_timestamp(F.when(text.rlike(shape), value), F.lit(form)).cast("date")
        tries.append(let(found, lambda d: F.when(F.year(d).between(FIRST_YEAR, LAST_YEAR), d)))
    return F.coalesce(*tries)


def clean_amount(raw: Column, strict_currency: bool = False) -> Column:
    """Struct of ``amount`` (two places, half to even, never negative) and ``hint`` (DEBIT, CREDIT or null).

    ``strict_currency`` takes ``Rs.`` off first; without it the dot stays, so that
    "Rs.500" reads as 0.50.
    """
    return let(strip(raw), lambda text: _amount(text, strict_currency))


def _amount(text: Column, strict_currency: bool) -> Column:
    upper = F.upper(text)
    negative = text.startswith("(") & text.endswith(")")
    body = F.regexp_replace(text, r"(?i)rs\.", "") if strict_currency else text
    digits = F.regexp_replace(body, r"[^0-9.\-]", "")
    number = F.when(digits.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), digits.try_cast("decimal(28,8)"))
    hint = (
        F.when(negative | digits.startswith("-"), "DEBIT")
        .when(upper.contains("DR") | upper.contains("DEBIT"), "DEBIT")
        .when(upper.contains("CR") | upper.contains("CREDIT"), "CREDIT")
    )
    amount = F.when(text.isNotNull() & ~F.lower(text).isin(*NO_AMOUNT), F.bround(F.abs(number), 2).cast("decimal(18,2)"))
    return let(amount, lambda a: F.struct(a.alias("amount"), F.when(a.isNotNull(), hint).alias("hint")))


#: Messages of rows without a usable amount.
AMBIGUOUS = "Ambiguous row: both Debit and Credit have non-zero amounts."
NO_VALID_AMOUNT = "No valid transaction amount or debit/credit found."


def resolve_amount_type(debit: Column, credit: Column, amount: Column, kind: Column) -> Column:
    """Struct of ``amount``, ``type`` and ``error`` from raw columns; a lone amount without sign or type is a DEBIT."""
    parts = F.struct(
        clean_amount(debit)["amount"].alias("d"), clean_amount(credit)["amount"].alias("c"), clean_amount(amount).alias("a"),
        F.upper(strip(kind)).alias("k"),
    )
    return let(parts, _resolved)


def _resolved(p: Column) -> Column:
    dv, cv, av = p["d"], p["c"], p["a"]["amount"]
    none = lambda v: F.coalesce(v == 0, F.lit(True))
    has = lambda *words: F.coalesce(F.greatest(*[p["k"].contains(w) for w in words]), F.lit(False))
    named = F.when(has("DR", "DEBIT", "WITHDRAWAL"), "DEBIT").when(has("CR", "CREDIT", "DEPOSIT"), "CREDIT")
    case = (
        F.when((dv > 0) & none(cv), "D").when((cv > 0) & none(dv), "C").when((dv > 0) & (cv > 0), "A").when(av > 0, "S").otherwise("N")
    )
    return F.struct(
        F.when(case == "D", dv).when(case == "C", cv).when(case == "S", av).alias("amount"),
        F.when(case == "D", "DEBIT").when(case == "C", "CREDIT").when(case == "S", F.coalesce(named, p["a"]["hint"], F.lit("DEBIT"))).alias("type"),
        F.when(case == "A", AMBIGUOUS).when(case == "N", NO_VALID_AMOUNT).alias("error"),
    )


def normalize_description(raw: Column) -> Column:
    """White space runs to one space, trimmed; null to an empty text."""
    return strip(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " "))


def normalize_reference(raw: Column) -> Column:
    """Null for placeholders; a trailing ``.0`` goes."""
    text = strip(raw)
    return F.when(~F.lower(text).isin(*NO_REFERENCE), F.regexp_replace(text, r"\.0$", ""))


def normalize_balance(raw: Column) -> Column:
    """The amount without its sign."""
    return clean_amount(raw)["amount"]
