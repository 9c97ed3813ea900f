"""Text normalisation and formatting as Column functions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import refdata as R
from ledgerlens.functions.binding import let

#: Latin letters that decompose into a bare letter and marks, with that letter.
_PAIRS = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
MARKED, BARE = ("".join(x) for x in zip(*_PAIRS, strict=True))


#: What `strip_accents` changes; all of MARKED lies in this range.
MARKED_SIGN = r"(?=[^\x00-\x7f])[\u00c0-\u024f\p{Mn}]"
#: Runs of white space but single blanks, which stay as they are.
_RUNS = r"(?U) *[\s&&[^ ]]\s*| {2,}\s*"


def strip_accents(text: Column) -> Column:
    """Letters without their marks; combining marks that stand alone go too."""
    return let(text, lambda x: F.when((F.length(x) == F.octet_length(x)) | ~x.rlike(MARKED_SIGN), x).otherwise(F.regexp_replace(F.translate(x, MARKED, BARE), r"\p{Mn}", "")))


def norm(text: Column) -> Column:
    """Bare lower-case letters, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), _RUNS, " "))


def norm_label(text: Column) -> Column:
    """norm(), with all spellings of the numero sign alike."""
    return F.regexp_replace(norm(text), r"\bn\s*\.?\s*[º°]", "nº")


def compact(text: Column) -> Column:
    """Letters and digits only, for comparing company names."""
    return F.regexp_replace(F.lower(strip_accents(F.coalesce(text, F.lit("")))), "[^a-z0-9]", "")


def clean_name(text: Column) -> Column:
    """What stands before a dash between blanks, without ornaments."""
    bare = F.trim(text)
    return F.btrim(F.when(bare.rlike("[—–]"), F.get(F.split(bare, r"\s+[—–]\s+"), F.lit(0))).otherwise(bare), F.lit(" :|·ꞏ,"))


def _one_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(word) for word in words)


#: A word by itself, of letters, digits and underscores.
_ALONE = r"(?<![a-z0-9_])(?:{})(?![a-z0-9_])"
#: The first sign is a letter, and two more follow.
_LETTERS = "^[a-z](?:[^a-z]*+[a-z]){2}"
#: Blanks between eight words.
_EIGHT_WORDS = r"^\S*+(?:\s++\S++){6}\s"
#: What no company name has. An address begins with a kind of street, or has a post code (five digits by themselves), a house
#: number behind a comma, or a word that stands for one; a contact has its signs and words; a reference names a law or
#: holds a digest (sixteen signs or more by themselves, all of them hexadecimal).
_NO_NAME = "|".join(
    (
        f"^(?:{_one_of((*R.NOT_A_NAME, *R.STREET_WORDS))})",
        ", *[0-9]|s/n",
        _one_of(R.CONTACT_SIGNS),
        _ALONE.format("|".join(("[0-9]{5}", "[0-9a-f]{16,}", _one_of(("km", *R.CONTACT_WORDS, *R.LAW_WORDS))))),
    )
)


def looks_like_name(text: Column, amount_pattern: str) -> Column:
    """Whether a cell may be a company name: its first sign is a letter, it has three letters or more and at most seven words,
    no word of the form opens it, and it is neither address, contact, reference nor amount."""
    return let(norm(text), lambda plain: plain.rlike(_LETTERS) & ~plain.rlike(_NO_NAME) & ~F.trim(text).rlike(_EIGHT_WORDS) & ~text.rlike(amount_pattern))


def format_amount(value: Column, country: Column) -> Column:
    """1.234,56 for ES and DE, 1,234.56 for UK and US."""
    english = F.format_number(value, 2)
    return F.when(country.isin("ES", "DE"), F.translate(english, ",.", ".,")).otherwise(english)
