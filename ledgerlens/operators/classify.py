"""What a document is: type, country, mentions, legibility, verdict."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import refdata as R
from ledgerlens.functions.binding import let
from ledgerlens.functions.taxid import holds_valid_ids
from ledgerlens.functions.text import norm
from ledgerlens.operators.rules import ERROR, WARNING, finding, listed, with_counts

HEAD_CHARS = 900


#: All cues of a head, classes in order, so that the first class wins where two begin at one place.
_CUE = "(?<![a-z@.])(" + "|".join(re.escape(cue) for cues in R.HEADER_CUES.values() for cue in cues) + ")(?![a-z@])"


def document_type(text: Column, plain: Column | None = None) -> Column:
    """struct(kind, confidence): the class whose cue stands first, as a whole word, in the head of the text; classes
    go before one another in the order of the reference data where they tie. `plain` is norm(text), where it is known."""
    raw = F.coalesce(text, F.lit(""))
    begin = norm(F.substring(raw, 1, HEAD_CHARS))
    begin = begin if plain is None else F.when(F.length(raw) <= HEAD_CHARS, plain).otherwise(begin)

    def earliest(plain: Column) -> Column:
        head = F.when(F.contains(plain, F.lit("recibo ")), F.regexp_replace(plain, "recibo (?:domiciliado|bancario)", "")).otherwise(plain)
        return let(F.regexp_extract(head, _CUE, 1), lambda cue: F.coalesce(*[F.when(cue.isin(*cues), F.lit(kind)) for kind, cues in R.HEADER_CUES.items()]))

    return let(let(begin, earliest), lambda kind: F.struct(F.coalesce(kind, F.lit("factura")).alias("kind"), F.when(kind.isNull(), 0.3).otherwise(0.9).alias("confidence")))


def country_scores(text: Column, plain: Column | None = None, ids: Column | None = None) -> dict[str, Column]:
    raw = F.coalesce(text, F.lit(""))
    plain = norm(raw) if plain is None else plain
    ids = holds_valid_ids(raw) if ids is None else ids
    has = lambda sign: F.when(F.contains(raw, F.lit(sign)), 1).otherwise(0)
    signs = {"ES": has("€"), "UK": has("£") * 3, "US": has("$") * 3, "DE": has("€")}
    points = lambda words: lambda text: sum((F.when(F.contains(text, F.lit(w)), 2).otherwise(0) for w in words), F.lit(0))
    words = {code: let(plain, points(known)) for code, known in R.COUNTRY_WORDS.items()}
    return {code: F.when(ids[code], 3).otherwise(0) + signs[code] + words[code] for code in R.CODES}


def detect_country(text: Column, plain: Column | None = None) -> Column:
    """The country with most points; the first in the order of the reference data on a tie, ES without any. `plain` is norm(text), where it
    is known."""
    ranked = lambda scores: F.array_max(F.array(*[F.struct(score.alias("score"), F.lit(-rank).alias("rank"), F.lit(code).alias("code")) for rank, (code, score) in enumerate(scores.items())]))["code"]
    read = lambda raw: F.struct(raw.alias("raw"), (norm(raw) if plain is None else plain).alias("plain"), holds_valid_ids(raw).alias("ids"))
    return let(let(F.coalesce(text, F.lit("")), read), lambda x: ranked(country_scores(x["raw"], x["plain"], x["ids"])))


def mentions(lines: Column) -> Column:
    """struct(exencion, precios_con_iva, simplificada, rectificativa, rectifica_a) from an array of text lines."""
    return mentions_in(F.transform(lines, lambda x: F.struct(x.alias("text"), norm(x).alias("plain"))))


def mentions_in(lines: Column, plain: Column | None = None) -> Column:
    """mentions() of lines (text, plain). `plain` is a text that holds all their plain ones, where it is known: without a word of
    interest in it no line is read."""

    def read(rows: Column) -> Column:
        says = lambda pattern: F.exists(rows, lambda x: x["plain"].rlike(pattern))
        reference = r"(?i)rectifica\w*\s+(?:a\s+)?(?:la\s+)?factura\s+(?:n[º°]\s*)?([A-Za-z0-9][\w/\-.]*\d)(?:\s+de\s+(\d{1,2}/\d{1,2}/\d{2,4}))?"
        named = F.filter(rows, lambda x: x["plain"].rlike(R.RECTIFYING) & x["text"].rlike(reference))
        last = F.try_element_at(named, F.lit(-1))["text"]
        return F.struct(
            F.trim(F.try_element_at(F.filter(rows, lambda x: x["plain"].rlike(R.EXEMPTION)), F.lit(1))["text"]).alias("exencion"),
            says(R.TAX_INCLUDED).alias("precios_con_iva"),
            says(R.SIMPLIFIED).alias("simplificada"),
            says(R.RECTIFYING).alias("rectificativa"),
            F.when(last.isNotNull(), F.concat_ws(" de ", F.regexp_extract(last, reference, 1), F.nullif(F.regexp_extract(last, reference, 2), F.lit("")))).alias("rectifica_a"),
        )

    if plain is None:
        return let(lines, read)
    text, no = F.lit(None).cast("string"), F.lit(False)
    nothing = F.struct(text.alias("exencion"), no.alias("precios_con_iva"), no.alias("simplificada"), no.alias("rectificativa"), text.alias("rectifica_a"))
    hinted = reduce(Column.__or__, [F.contains(plain, F.lit(stem)) for stem in R.MENTION_STEMS])
    return F.when(hinted & plain.rlike("|".join((R.EXEMPTION, R.TAX_INCLUDED, R.SIMPLIFIED, R.RECTIFYING))), read(lines)).otherwise(nothing)


def illegible() -> Column:
    """Too little was read to judge: no text at all, neither base nor total, or neither tax nor total."""
    no_tax = F.coalesce(F.size("iva"), F.lit(0)) <= 0
    return (F.col("origen") == "vacio") | (F.col("base_imponible").isNull() & F.col("total").isNull()) | (no_tax & F.col("total").isNull())


def mark_illegible(audited: DataFrame) -> DataFrame:
    """For documents that were read from files: an unreadable one gets NO_LEGIBLE before all other findings."""
    first = listed(finding("NO_LEGIBLE", ERROR, "documento"))
    return with_counts(audited.withColumn("findings", F.when(illegible(), F.concat(first, F.col("findings"))).otherwise(F.col("findings"))))


def verdict() -> Column:
    has = lambda test: F.exists("findings", test)
    return (
        F.when(has(lambda f: f["code"] == "NO_LEGIBLE"), "no_legible")
        .when(has(lambda f: f["severity"] == ERROR), "no_conforme")
        .when(has(lambda f: f["severity"] == WARNING), "con_avisos")
        .otherwise("conforme")
    )


def origin(pages: DataFrame) -> DataFrame:
    """doc_id, origen over pages(doc_id, origin): none, the one there is, or mixed."""
    kinds = F.array_remove(F.collect_set("origin"), "vacio")
    return pages.groupBy("doc_id").agg(kinds.alias("kinds")).select("doc_id", F.when(F.size("kinds") == 0, "vacio").when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).otherwise("mixto").alias("origen"))


def mean_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id").agg(F.coalesce(F.round(F.avg(F.when(F.trim("text") != "", F.col("conf"))), 4), F.lit(0.0)).alias("confianza_media"))
