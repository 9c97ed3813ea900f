"""Dates: parsing by country, ISO forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.binding import let
from ledgerlens.functions.refdata import COMMON_DATE_FORMATS, COUNTRIES, MONTHS
from ledgerlens.functions.text import norm

_CANDIDATE = r"(\d{1,4}[\s./-]\d{1,2}[\s./-]\d{2,4}|\d{1,2}\s+(?U:\w+)\s+\d{4})"
_LONG = r"(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})"


def _by_format(text: Column, pattern: str) -> Column:
    # yy means 1969 to 2068, as elsewhere; Spark's own pivot is 2000
    if pattern.endswith("yy") and not pattern.endswith("yyyy"):
        parsed = F.try_to_date(text, pattern)
        return F.when(text.rlike(r"\D\d{2}$"), F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed))
    shape = r"^\d{4}\D" if pattern.startswith("yyyy") else r"\D\d{4}$"
    return F.when(text.rlike(shape), F.try_to_date(text, pattern))


def parse_date(text: Column, country: Column) -> Column:
    """The first date in a text: the country's formats first, then common ones, then "d de month de yyyy"."""
    found = F.regexp_extract(text, _CANDIDATE, 1)
    return F.coalesce(let(F.when(found != "", found).otherwise(F.trim(text)), lambda raw: _numeric(raw, country)), let(norm(text), _named))


def _numeric(raw: Column, country: Column) -> Column:
    own = [F.when(country == c.code, F.coalesce(*[_by_format(raw, p) for p in c.date_formats])) for c in COUNTRIES]
    return F.coalesce(*own, *[_by_format(raw, p) for p in COMMON_DATE_FORMATS])


def _named(plain: Column) -> Column:
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    parts = [F.regexp_extract(plain, _LONG, 3), F.try_element_at(month, F.regexp_extract(plain, _LONG, 2)).cast("string"), F.regexp_extract(plain, _LONG, 1)]
    return F.when(plain.rlike(_LONG) & parts[1].isNotNull(), F.try_to_date(F.concat_ws("-", *parts), "yyyy-M-d"))


def iso_date(text: Column) -> Column:
    """A date from the first ten characters of an ISO string; null if they are none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))


def day_first_to_iso(text: Column) -> Column:
    return F.date_format(F.try_to_date(text, "dd/MM/yyyy"), "yyyy-MM-dd")


def format_date(day: Column, country: Column) -> Column:
    return F.when(country == "US", F.date_format(day, "MM/dd/yyyy")).when(country == "DE", F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
