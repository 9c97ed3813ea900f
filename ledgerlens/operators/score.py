"""Scoring against known answers, benchmark metrics, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import day_first_to_iso
from ledgerlens.functions.refdata import DEFECT_CODES
from ledgerlens.functions.text import compact

BANK_TOLERANCE, OUTSIDE_TOLERANCE, SLOWER = 0.02, 0.01, 2.5


STATUSES = ("ok", "aviso", "fallo")


def worst_status(checks: DataFrame, status: str = "estado") -> DataFrame:
    """One row: the worst status of all checks, by the order of STATUSES; an unknown one counts as the worst."""
    rank = F.coalesce(*[F.when(F.col(status) == name, F.lit(k)) for k, name in enumerate(STATUSES)], F.lit(len(STATUSES) - 1))
    return checks.agg(F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.coalesce(F.max(rank), F.lit(0)) + 1).alias(status))


def fields_equal(field: Column, expected: Column, obtained: Column) -> Column:
    """Both as text: amounts within two cents, dates by ten characters, tax ids without dashes and blanks, other texts
    without case and repeated blanks; null equals null only."""
    a, b = expected.try_cast("decimal(18,4)"), obtained.try_cast("decimal(18,4)")
    plain_id = lambda c: F.upper(F.regexp_replace(c, "[- ]", ""))
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    same = (
        F.when(field.startswith("fecha"), F.substring(expected, 1, 10) == F.substring(obtained, 1, 10))
        .when(field.endswith("nif"), plain_id(expected) == plain_id(obtained))
        .when(field.isin("base_imponible", "total"), F.coalesce(F.abs(a - b) <= BANK_TOLERANCE, F.lit(False)))
        .otherwise(plain(expected) == plain(obtained))
    )
    return F.when(expected.isNull() | obtained.isNull(), expected.isNull() & obtained.isNull()).otherwise(same)


def unpivoted(df: DataFrame, id_col: str, fields: dict[str, Column], value: str) -> DataFrame:
    """doc_id, field, `value`: one row per field, values as text."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), column.cast("string").alias(value)) for name, column in fields.items()])
    return df.select(F.col(id_col).alias("doc_id"), F.inline(pairs))


def field_scores(expected: DataFrame, obtained: DataFrame) -> DataFrame:
    """expected(doc_id, field, expected), obtained(doc_id, field, obtained): adds hit and missing; fields without an
    expected value are not scored."""
    joined = expected.filter("expected is not null").join(obtained, ["doc_id", "field"], "left")
    return joined.withColumn("hit", fields_equal(F.col("field"), F.col("expected"), F.col("obtained"))).withColumn("missing", F.col("obtained").isNull())


def document_scores(scores: DataFrame) -> DataFrame:
    hits = F.count_if("hit")
    return scores.groupBy("doc_id").agg(
        hits.alias("hits"), F.count_if(~F.col("hit") & ~F.col("missing")).alias("wrong"), F.count_if("missing").alias("absent"), F.count("*").alias("evaluated"), F.round(hits / F.count("*"), 4).alias("precision")
    )


def failures_by_field(scores: DataFrame) -> DataFrame:
    return scores.filter("not hit").groupBy("field").agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "field")


def bank_metrics(results: DataFrame) -> DataFrame:
    """results(doc_id, precision, valid, n_findings): one row. A document without a score is a trap; a trap is caught by
    any finding at all."""
    trap = F.col("precision").isNull()
    return results.agg(
        F.round(F.avg("precision"), 4).alias("precision"),
        F.count_if(~trap & F.col("valid")).alias("conforming"),
        F.count_if(~trap).alias("normal"),
        F.count_if(trap & (F.col("n_findings") > 0)).alias("caught"),
        F.count_if(trap).alias("traps"),
        F.count_if(trap & (F.col("n_findings") == 0)).alias("n_escaped"),
    ).withColumn("perfect", (F.col("precision") == 1.0) & (F.col("conforming") == F.col("normal")) & (F.col("caught") == F.col("traps")))


def escaped_traps(results: DataFrame) -> DataFrame:
    """doc_id of each trap without a finding, one row per document."""
    return results.filter("precision is null and n_findings = 0").select("doc_id")


def regressions(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, value) each: the metrics that fell, or a time of over 2.5 times the baseline. Better is never reported."""
    joined = baseline.withColumnRenamed("value", "before").join(current.withColumnRenamed("value", "now"), "metric")
    slower = (F.col("metric") == "segundos") & (F.col("now") > SLOWER * F.col("before"))
    return joined.filter(F.when(F.col("metric") == "segundos", slower).otherwise(F.col("now") < F.col("before"))).select("metric", "before", "now")


def outside_equal(field: Column, expected: Column, obtained: Column) -> Column:
    number, other = expected.try_cast("decimal(18,4)"), obtained.try_cast("decimal(18,4)")
    amounts = field.isin("base", "cuota", "irpf", "recargo", "suplidos", "total")
    same = F.when(amounts, F.coalesce(F.abs(number - other) <= OUTSIDE_TOLERANCE, F.lit(False))).when(field == "emisor", compact(expected) == compact(obtained)).otherwise(F.upper(F.trim(expected)) == F.upper(F.trim(obtained)))
    return F.when(expected.isNull() | obtained.isNull(), expected.isNull() & obtained.isNull()).otherwise(same)


def expected_of_manifest(manifest: DataFrame) -> DataFrame:
    """Manifest rows to fichero, field, expected: declared values stand in for right ones; a missing number is expected
    to be missing, other fields without a value are not expected."""
    have = set(manifest.columns)
    col = lambda name: F.col(name) if name in have else F.lit(None)
    fields = {
        "numero": col("numero"),
        "fecha": day_first_to_iso(col("fecha").cast("string")),
        "emisor": col("emisor"),
        "nif_emisor": F.coalesce(col("nif_emisor").cast("string"), col("nif_declarado").cast("string")),
        "base": F.coalesce(col("base").cast("double"), col("base_declarada").cast("double")),
        "total": F.coalesce(col("total").cast("double"), col("total_declarado").cast("double")),
    }
    return unpivoted(manifest, "fichero", fields, "expected").withColumnRenamed("doc_id", "fichero").filter("expected is not null or field = 'numero'")


def outside_cases(expected: DataFrame, obtained: DataFrame, results: DataFrame) -> DataFrame:
    """expected(fichero, field, expected), obtained(fichero, field, obtained), results(fichero, estado, errores): per
    document its right fields, whether it fell for its own reason only, and whether it is judged correctly. The reason for
    which a document was made is told by the name of its file, in whatever folder."""
    scored = expected.join(obtained, ["fichero", "field"], "left").withColumn("hit", outside_equal(F.col("field"), F.col("expected"), F.col("obtained")))
    per_doc = scored.groupBy("fichero").agg(F.count_if("hit").alias("fields_ok"), F.count("*").alias("fields"))
    reason = F.create_map(*[F.lit(x) for pair in DEFECT_CODES.items() for x in pair])
    cases = results.join(per_doc, "fichero").withColumn("motivo", F.try_element_at(reason, F.regexp_extract("fichero", r"([^/]+?)(?:\.[a-z]+)?$", 1)))
    noise = F.filter("errores", lambda e: F.coalesce(e != F.col("motivo"), F.lit(True)))
    own = F.col("motivo").isNotNull() & F.array_contains("errores", F.col("motivo"))
    correct = (F.col("fields_ok") == F.col("fields")) & F.when(F.col("motivo").isNull(), F.col("estado") == "conforme").otherwise((F.col("estado") == "no_conforme") & own & (F.size(noise) == 0))
    return cases.select("fichero", "estado", "motivo", "fields_ok", "fields", F.size(noise).alias("noise"), F.coalesce(own, F.lit(False)).alias("own_reason"), F.coalesce(correct, F.lit(False)).alias("correct"))
