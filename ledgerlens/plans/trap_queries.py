"""Sound invoices of all orders, each but every eleventh made into a trap, audited and asked for its own finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.taxid import complete_tax_id
from ledgerlens.operators import traps
from ledgerlens.operators.rules import audit
from ledgerlens.operators.schema import LINE, TRANCHE, conform
from ledgerlens.plans.views import table

AS_OF = "2030-01-01"
_NAMES = (*traps.FAMILIES, traps.NONE)


def sound_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Spanish invoice of one line per order, without a defect."""
    k = F.col("o_orderkey")
    cents = F.greatest(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(10_000).cast("long"))
    made = table(spark, sf_dir, "orders").select(k.alias("k"), F.to_date("o_orderdate").alias("day"), (k % 9 + 1).alias("q"), cents.alias("p")).withColumn("base", F.col("q") * F.col("p")).withColumn("vat", F.expr("(base * 21 + 50) div 100"))
    euros = lambda c: (F.col(c) / 100).cast("decimal(18,2)")
    party = lambda name, nif: F.struct(F.lit(name).alias("nombre"), nif.alias("nif"), F.lit(None).cast("struct<calle:string,ciudad:string,provincia:string,codigo_postal:string,pais:string>").alias("direccion"))
    line = F.struct(F.lit("Servicio de montaje").alias("descripcion"), F.col("q").cast("decimal(18,4)").alias("cantidad"), euros("p").cast("decimal(18,4)").alias("precio_unitario"), euros("base").alias("importe")).cast(LINE)
    tranche = F.struct(F.lit(21).cast("decimal(9,4)").alias("porcentaje"), euros("base").alias("base_imponible"), euros("vat").alias("cuota"), F.lit(None).cast("string").alias("motivo"), F.lit(False).alias("base_deducida")).cast(TRANCHE)
    return conform(
        made.select(
            F.col("k").cast("string").alias("doc_id"), F.lit("ES").alias("pais"), F.lit("factura").alias("tipo_documento"), F.lit("Factura").alias("titulo"), F.concat(F.lit("F/"), F.col("k").cast("string")).alias("numero"),
            F.col("day").cast("string").alias("fecha_emision"), F.date_add("day", 30).cast("string").alias("fecha_vencimiento"),
            party("Talleres Norte SL", complete_tax_id(F.col("k") * 7, F.lit("ES"))).alias("emisor"), party("Hostal Ribera SL", complete_tax_id(F.col("k") * 11 + 5, F.lit("ES"))).alias("receptor"),
            F.array(line).alias("lineas"), euros("base").alias("base_imponible"), F.array(tranche).alias("iva"), ((F.col("base") + F.col("vat")) / 100).cast("decimal(18,2)").alias("total"),
        )
    )


def trap_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id").cast("long") % len(_NAMES) + 1).cast("int"))
    made = traps.with_traps(sound_invoices(spark, sf_dir), family, AS_OF)
    audited = audit(made, AS_OF)
    return traps.recall_by_family(audited).select("trap", "code", "documents", "caught", "recall")


_CODES = {name: code for name, (code, _) in traps.FAMILIES.items()}
TRAP_SQL = f"""
WITH o AS (SELECT list_extract({list(_NAMES)}, CAST(o_orderkey % {len(_NAMES)} AS INT) + 1) AS trap FROM orders)
SELECT trap, map_extract(MAP {_CODES}, trap)[1] AS code, count(*) AS documents, count(*) AS caught, 1.0::DOUBLE AS recall FROM o GROUP BY trap
"""


def queries() -> dict:
    return {"trap_families": trap_families}


def oracle_sql() -> dict[str, str]:
    return {"trap_families": TRAP_SQL}
