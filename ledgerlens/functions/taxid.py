"""Tax identifiers of four countries: check digits, foreign prefixes, search in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import refdata as R
from ledgerlens.functions.binding import let


def _digit(text: Column, at: int) -> Column:
    return F.substring(text, at, 1).cast("int")


def _letter(table: str, index: Column) -> Column:
    return F.substr(F.lit(table), index + 1, F.lit(1))


def clean_id(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"[\s.\-]", ""))


def dni_letter(number: Column) -> Column:
    return _letter(R.DNI_LETTERS, F.pmod(number, F.lit(23)).cast("int"))


#: What a doubled digit adds to the sum of digits, and a step of ISO 7064 mod 11,10: looked up, so that a digit stands once.
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
_STEPS = [9, *(2 * total % 11 for total in range(1, 10))]


def _looked_up(table: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in table]), index)


def _digits_of_text(text: Column, first: int, n: int) -> list[Column]:
    return [_digit(text, at) for at in range(first, first + n)]


def _digits_of_number(number: Column, n: int) -> list[Column]:
    return [(F.floor(number / 10**place) % 10).cast("int") for place in reversed(range(n))]


def cif_digit(seven: list[Column]) -> Column:
    """Control digit of seven digits: those at odd places doubled, with the digits of the double added."""
    total = sum((d if at % 2 else _looked_up(_DOUBLED, d) for at, d in enumerate(seven)), F.lit(0))
    return F.pmod(10 - total % 10, F.lit(10))


def vat_uk_control(seven: list[Column]) -> Column:
    """Two digits that bring the weighted sum to a multiple of 97."""
    return 97 - sum((d * (8 - at) for at, d in enumerate(seven)), F.lit(0)) % 97


def ust_digit(eight: list[Column]) -> Column:
    """ISO 7064 mod 11,10 over eight digits."""
    return (11 - reduce(lambda product, d: _looked_up(_STEPS, (d + product) % 10), eight, F.lit(10))) % 10


def _valid_es(value: Column) -> Column:
    return let(F.when(value.startswith("ES"), F.substr(value, F.lit(3))).otherwise(value), _valid_bare_es)


def _valid_bare_es(bare: Column) -> Column:
    number = F.concat(F.translate(F.substring(bare, 1, 1), "XYZ", "012"), F.substring(bare, 2, 7))
    kind, control = F.substring(bare, 1, 1), F.substring(bare, 9, 1)
    digit = cif_digit(_digits_of_text(bare, 2, 7))
    by_digit, by_letter = control == digit.cast("string"), control == _letter(R.CIF_LETTERS, digit)
    return (
        F.when(bare.rlike(r"^(\d{8}|[XYZ]\d{7})[A-Z]$"), dni_letter(number.cast("int")) == control)
        .when(
            bare.rlike(r"^[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J]$"),
            F.when(kind.isin(*R.CIF_LETTER_ONLY), by_letter).when(kind.isin(*R.CIF_DIGIT_ONLY), by_digit).otherwise(by_digit | by_letter),
        )
        .otherwise(False)
    )


def _valid_uk(value: Column) -> Column:
    bare = F.when(value.startswith("GB"), F.substr(value, F.lit(3))).otherwise(value)
    total = sum((_digit(bare, at) * (9 - at) for at in range(1, 8)), F.substring(bare, 8, 2).cast("int"))
    return F.when(bare.rlike(r"^\d{9}$"), (total % 97).isin(0, 97 - 55)).otherwise(False)


def _valid_de(value: Column) -> Column:
    return F.when(value.rlike(r"^DE\d{9}$"), ust_digit(_digits_of_text(value, 3, 8)) == _digit(value, 11)).otherwise(False)


def _valid_us(value: Column) -> Column:
    return value.rlike(r"^\d{2}-?\d{7}$") & ~F.substring(value, 1, 2).isin(*R.EIN_UNASSIGNED)


def is_valid_tax_id(value: Column, country: Column) -> Column:
    """Whether the check digit holds, not just the form; false for null, empty and unknown countries."""
    return let(clean_id(value), lambda bare: is_valid_clean(bare, country))


def is_valid_clean(bare: Column, country: Column) -> Column:
    """is_valid_tax_id() of what `clean_id` gives."""
    code = F.upper(country)
    by_country = F.when(code == "ES", _valid_es(bare)).when(code == "UK", _valid_uk(bare)).when(code == "DE", _valid_de(bare)).when(code == "US", _valid_us(bare)).otherwise(False)
    return F.coalesce(by_country, F.lit(False))


def complete_tax_id(number: Column, country: Column) -> Column:
    """A valid identifier made from a whole number (generators): CIF of kind B, GB, DE or EIN."""
    last = lambda n, made: let(F.pmod(number, F.lit(10**n)), lambda d: made(d, F.lpad(d.cast("string"), n, "0")))
    return (
        F.when(country == "ES", last(7, lambda d, text: F.concat(F.lit("B"), text, cif_digit(_digits_of_number(d, 7)).cast("string"))))
        .when(country == "UK", last(7, lambda d, text: F.concat(F.lit("GB"), text, F.lpad(vat_uk_control(_digits_of_number(d, 7)).cast("string"), 2, "0"))))
        .when(country == "DE", last(8, lambda d, text: F.concat(F.lit("DE"), text, ust_digit(_digits_of_number(d, 8)).cast("string"))))
        .when(country == "US", F.concat(F.lit("12-"), F.lpad(F.pmod(number, F.lit(10**7)).cast("string"), 7, "0")))
    )


def _own_prefix(country: Column) -> Column:
    return F.coalesce(*[F.when(country == c.code, F.lit(c.own_prefix)) for c in R.COUNTRIES if c.own_prefix], F.lit("-"))


def foreign_prefix(value: Column, country: Column) -> Column:
    """The prefix of a VAT number of another country, else null; in the US every such prefix is foreign."""
    prefix = F.regexp_extract(clean_id(value), "^([A-Z]{2})[0-9A-Z]{8,12}$", 1)
    return F.when((prefix != "") & (prefix != _own_prefix(country)), prefix)


def is_foreign_clean(bare: Column, country: Column) -> Column:
    """Whether `foreign_prefix` finds one, of what `clean_id` gives."""
    return F.coalesce((F.substring(bare, 1, 2) != _own_prefix(country)) & bare.rlike("^[A-Z]{2}[0-9A-Z]{8,12}$"), F.lit(False))


#: Forms of the identifiers: fixed values.
_ID_ES = r"(?:ES)?(?:[XYZ]\d{7}[A-Z]|\d{8}[A-Z]|[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J])"
_ID_EU = "(?:" + "|".join(R.EU_PREFIXES) + r")[0-9][0-9A-Z]{7,11}"
_OWN = {"ES": _ID_ES, "UK": r"(?:GB)?[0-9]{9}", "US": r"[0-9]{2}-?[0-9]{7}", "DE": r"DE[0-9]{9}"}


def ids_in(text: Column, country: Column) -> Column:
    """Identifier-shaped strings from left to right, whether their check digit holds or not."""
    upper = F.upper(text)
    found = [F.when(country == code, F.regexp_extract_all(upper, F.lit(rf"(?<![A-Z0-9])(?:{own}|{_ID_EU})(?![A-Z0-9])"), F.lit(0))) for code, own in _OWN.items()]
    return F.coalesce(*found, F.array().cast("array<string>"))


def valid_ids_in(text: Column, country: Column) -> Column:
    """Identifiers whose check digit holds, each once, in order of first appearance."""
    shapes = {"ES": r"[A-Z][0-9]{8}", "UK": _OWN["UK"], "US": _OWN["US"], "DE": _OWN["DE"]}
    upper = F.upper(text)
    found = [F.when(country == code, F.regexp_extract_all(upper, F.lit(rf"\b(?:{own}|[A-Z]?\d{{7,8}}[A-Z]?)\b"), F.lit(0))) for code, own in shapes.items()]
    return F.array_distinct(F.filter(F.coalesce(*found, F.array().cast("array<string>")), lambda x: is_valid_tax_id(x, country)))


#: What `valid_ids_in` finds in any country, but for the numbers of the US that are written with a dash.
_ID_ANY = r"(?=[A-Z]{0,2}[0-9])\b(?:GB|DE|[A-Z])?[0-9]{7,9}[A-Z]?\b"
_ID_US = r"(?=[0-9])\b(?!" + "|".join(R.EIN_UNASSIGNED) + r")[0-9]{2}-?[0-9]{7}\b"


def holds_valid_ids(text: Column) -> Column:
    """struct(ES, UK, US, DE): whether `valid_ids_in` finds any in that country; the text is searched once for three of them."""
    tests = {"ES": _valid_es, "UK": _valid_uk, "DE": _valid_de}
    found = lambda ids, test: F.exists(ids, lambda x: F.coalesce(test(x), F.lit(False)))
    holds = lambda upper, ids: F.struct(*[(found(ids, tests[code]) if code in tests else upper.rlike(_ID_US)).alias(code) for code in R.CODES])
    return let(F.upper(text), lambda upper: let(F.regexp_extract_all(upper, F.lit(_ID_ANY), F.lit(0)), lambda ids: holds(upper, ids)))
