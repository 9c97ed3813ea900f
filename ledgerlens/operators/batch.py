"""Batch summaries over audited documents, history and the flat export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions.money import cents
from ledgerlens.operators.classify import verdict

RETAINED, TOP = 100, 10


def _by_code(findings: str = "findings") -> Column:
    """Structs (code, times, ord, severity) of one document: how often it has a code, and its first finding of that code."""
    # wrapped in arrays of one, what a lambda names is evaluated once
    once = lambda value, then: F.transform(F.array(value), then)[0]
    placed = F.transform(findings, lambda f, i: F.struct(f["code"].alias("code"), i.alias("ord"), f["severity"].alias("severity")))

    def counted(all_of: Column) -> Column:
        def of(code: Column) -> Column:
            mine = F.filter(all_of, lambda f: f["code"].eqNullSafe(code))
            return once(mine, lambda m: F.struct(m[0]["code"].alias("code"), F.size(m).cast("long").alias("times"), m[0]["ord"].alias("ord"), m[0]["severity"].alias("severity")))

        return F.transform(F.array_distinct(F.transform(all_of, lambda f: f["code"])), of)

    return once(placed, counted)


def top_findings(audited: DataFrame, order: str = "doc_id", limit: int = TOP) -> DataFrame:
    """code, severity, times, documents: the most frequent findings, those that appear first before others on a tie. Each row
    of `audited` is a document. Codes are counted inside it, so only one partial row per task and code is shuffled."""
    # an inner explode would have Spark infer a filter on the array and evaluate the whole audit a second time for it
    rows = audited.select(F.col(order).alias("doc"), F.explode_outer(_by_code()).alias("c")).filter("c is not null").select("doc", "c.*")
    first = F.struct("doc", "ord")
    return (
        rows.groupBy("code")
        .agg(F.sum("times").alias("times"), F.count("*").alias("documents"), F.min_by("severity", first).alias("severity"), F.min(first).alias("first"))
        .orderBy(F.desc("times"), "first")
        .limit(limit)
        .select("code", "severity", "times", "documents")
    )


def summarize(results: DataFrame) -> DataFrame:
    """results(ok, valid, estado, seconds, precision, confidence): one row of counts and means. Unreadable documents are
    counted among those with errors and once more by themselves."""
    zero = F.lit(0.0)
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("ok") & F.col("valid")).alias("validas"),
        F.count_if(F.col("ok") & ~F.col("valid")).alias("con_errores"),
        F.count_if(~F.col("ok")).alias("fallidas"),
        F.count_if(~F.col("ok") | (F.col("estado") == "no_legible")).alias("no_legibles"),
        F.round(F.sum("seconds"), 3).alias("segundos"),
        F.round(F.avg("precision"), 4).alias("precision_media"),
        F.coalesce(F.round(F.avg("confidence"), 4), zero).alias("confianza_media"),
    )


def newest(batches: DataFrame, keep: int = RETAINED) -> DataFrame:
    """The `keep` newest batches, newest first. Ordering ends in a top-k, not in one task's window."""
    return batches.orderBy(F.desc("fecha"), F.desc("batch_id")).limit(keep)


def expired(batches: DataFrame, keep: int = RETAINED) -> DataFrame:
    """All but the `keep` newest: what comes before the last of those, a table of one row."""
    edge = newest(batches, keep).orderBy("fecha", "batch_id").limit(1).select(F.struct("fecha", "batch_id").alias("edge"), F.lit(1).alias("one"))
    return batches.withColumn("one", F.lit(1)).join(F.broadcast(edge), "one").filter(F.struct("fecha", "batch_id") < F.col("edge")).drop("one", "edge")


def _total(array: str, field: str) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(cents(x[field]), F.lit(0).cast("long")))


def flat(audited: DataFrame) -> DataFrame:
    """The 21 columns of the export, in their order; amounts of several parts are summed, withholding is negative."""
    have = set(audited.columns)
    optional = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    euros = lambda c: (c / 100).cast("decimal(18,2)")
    return audited.select(
        F.col("doc_id").alias("fichero"),
        "pais",
        F.when(F.col("valid"), "sí").otherwise("no").alias("valida"),
        F.col("n_errors").alias("errores"),
        F.col("n_warnings").alias("avisos"),
        "numero",
        "fecha_emision",
        "fecha_vencimiento",
        F.col("emisor.nombre").alias("emisor"),
        F.col("emisor.nif").alias("emisor_nif"),
        F.col("receptor.nombre").alias("receptor"),
        F.col("receptor.nif").alias("receptor_nif"),
        "base_imponible",
        "total",
        optional("confidence", "double").alias("confianza"),
        optional("origen", "string").alias("origen"),
        verdict().alias("estado"),
        F.when(F.size("iva") > 0, euros(_total("iva", "cuota"))).alias("cuota_impuesto"),
        F.when(F.col("retencion.cuota") != 0, -F.abs("retencion.cuota")).alias("irpf"),
        F.when(F.size("recargo") > 0, euros(_total("recargo", "cuota"))).alias("recargo_equivalencia"),
        "suplidos",
    )


def footer(audited: DataFrame) -> DataFrame:
    """Sums of base, tax and total in cents, and whether every document is valid."""
    return audited.agg(F.sum(cents(F.col("base_imponible"))).alias("base_cents"), F.sum(_total("iva", "cuota")).alias("tax_cents"), F.sum(cents(F.col("total"))).alias("total_cents"), F.bool_and("valid").alias("all_valid"))


def samples(rows: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first row of each group, of the first `limit` groups."""
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min_by(F.struct(*rows.columns), order).alias("first"))
    return first.orderBy("_group").limit(limit).select("first.*")


def folios(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `folio`, from 1 on in the given order. Rows are sorted in ranges; each range starts after all before it."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("folio", F.col("_start") + within + 1).drop("_at", "_part", "_start")
