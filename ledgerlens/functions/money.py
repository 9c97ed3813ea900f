"""Amounts: parsing by locale, whole cents, tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.binding import let
from ledgerlens.functions.refdata import AMOUNT

TOLERANCE_CENTS = 2
AMOUNT_CI = "(?i)" + AMOUNT


def cents(value: Column) -> Column:
    """Whole cents; doubles are rounded once, after the product. NaN and unparseable values count as missing."""
    return F.round(value * 100).cast("long")


def near(a: Column, b: Column, tolerance: int = TOLERANCE_CENTS) -> Column:
    return F.abs(a - b) <= tolerance


def share_cents(base: Column, percent: Column) -> Column:
    """`percent` of a base in cents, rounded half up."""
    return F.round(base * percent.cast("decimal(9,4)") / 100).cast("long")


def deduce_base(quota: Column, percent: Column) -> Column:
    """The base that gives a quota (cents); null where the percentage is missing or zero."""
    return F.round(quota * 100 / F.nullif(percent.cast("decimal(9,4)"), F.lit(0))).cast("long")


def parse_amount(text: Column) -> Column:
    """A locale-blind amount as decimal(18,4), null if it is none.

    Parentheses negate. Of two separators the right one is the decimal; a comma alone marks thousands where exactly
    three digits follow the last, a point alone where moreover more than three digits stand in all.
    """

    def of(raw: Column) -> Column:
        value = let(F.regexp_replace(raw, r"[^0-9,.\-]", ""), _plain_number)
        return F.when(raw.startswith("(") & raw.endswith(")"), -F.abs(value)).otherwise(value)

    return let(F.replace(F.trim(text), F.lit("−"), F.lit("-")), of)


def _plain_number(core: Column) -> Column:
    has = lambda sign: F.contains(core, F.lit(sign))
    after = lambda sign: F.length(F.substring_index(core, sign, -1))  # noqa: E731  how much stands after the last one
    digits = F.length(F.regexp_replace(core, "[^0-9]", ""))
    plain = (
        F.when(has(",") & has(".") & (after(",") < after(".")), F.translate(F.regexp_replace(core, r"\.", ""), ",", "."))
        .when(has(",") & has("."), F.regexp_replace(core, ",", ""))
        .when(has(","), F.when(after(",") == 3, F.regexp_replace(core, ",", "")).otherwise(F.translate(core, ",", ".")))
        .when(has("."), F.when((after(".") == 3) & (digits > 3), F.regexp_replace(core, r"\.", "")).otherwise(core))
        .otherwise(core)
    )
    return F.when(core.rlike("[0-9]"), plain.try_cast("decimal(18,4)"))


def is_bare_number(text: Column) -> Column:
    return text.rlike(r"^(?:-?\d{1,3}(?:\.\d{3})+|-?\d+(?:[.,]\d{1,3})?)$")


def inner_product(text: Column) -> Column:
    """struct(quantity, price) of a "(10x24,00€)" inside a description, fields null without one."""
    pattern = r"(?i)\((\d+(?:[.,]\d+)?)\s*[x×]\s*(" + AMOUNT + r")\)"
    return F.struct(parse_amount(F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))).alias("quantity"), parse_amount(F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))).alias("price"))
