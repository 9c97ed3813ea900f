"""Invoices written out as text from the order table, read back and audited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.taxid import complete_tax_id
from ledgerlens.functions.text import format_amount
from ledgerlens.operators import extract, rules
from ledgerlens.operators.lines import join_digits
from ledgerlens.plans.views import sql_tax_id, table

ISSUERS = ("Talleres Norte SL", "Aceros del Sur SA", "Estudio Lumbre Gráfica SL")
RECIPIENTS = ("Comercial Levante SA", "Hostal Ribera SL", "Muebles Encina SL", "Papelería Sol SL")
AS_OF = "2024-01-01"


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: one Spanish invoice per order. Layouts take turns: parties by tax identifier or by labelled columns, the
    number by label or in the title, base and total written or left out; every seventh total is off by 30 cents."""
    k = F.col("o_orderkey")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    money = lambda c: format_amount((c / 100).cast("decimal(18,2)"), F.lit("ES"))
    every = lambda n, text: F.when(k % n != 0, text)
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    df = table(spark, sf_dir, "orders").select(
        k, cents.alias("p"), F.expr("o_orderkey % 9 + 1").alias("q"), F.date_format(F.to_date("o_orderdate"), "dd/MM/yyyy").alias("day"), pick(ISSUERS, k).alias("e"), pick(RECIPIENTS, k).alias("r"),
        complete_tax_id(k * 7, F.lit("ES")).alias("ei"), complete_tax_id(k * 11 + 5, F.lit("ES")).alias("ri"),
    ).withColumn("a", F.col("q") * F.col("p")).withColumn("base", F.col("a") + 2500).withColumn("vat", F.expr("(base * 21 + 50) div 100"))
    total = F.col("base") + F.col("vat") + F.when(k % 7 == 0, 30).otherwise(0)
    number = F.when(k % 4 == 0, F.concat(F.lit("FACTURA   F-"), k.cast("string"))).otherwise(F.concat(F.lit("Factura nº: F-"), k.cast("string")))
    free = [F.col("e"), F.concat(F.lit("Calle Mayor 3   28001 Madrid   NIF "), "ei"), number, F.concat(F.lit("Fecha: "), "day"), F.lit("Facturar a:"), F.col("r"), F.lit("Avda. del Puerto 12"), F.concat(F.lit("CIF "), "ri")]
    wide = lambda left, right: F.concat(F.rpad(left, 40, " "), right)
    columns = [number, F.concat(F.lit("Fecha: "), "day"), wide(F.lit("EMISOR"), F.lit("CLIENTE")), wide(F.col("e"), F.col("r")), wide(F.col("ei"), F.col("ri"))]
    rows = [
        F.lit("Concepto                 Cantidad   Precio   Importe"),
        F.concat(F.lit("Servicio de montaje      "), F.col("q").cast("string"), F.lit("   "), money(F.col("p")), F.lit("   "), money(F.col("a"))),
        F.lit("Tornillos (10x2,50€)   25,00"),
        every(5, F.concat(F.lit("Base imponible   "), money(F.col("base")), F.lit(" €"))),
        F.concat(F.lit("IVA 2 1%   "), money(F.col("vat")), F.lit(" €")),
        every(11, F.concat(F.lit("TOTAL A PAGAR:   "), money(total), F.lit(" €"))),
        F.lit("Gracias por su compra"),
    ]
    text = lambda parts: F.array_join(F.array(*parts), "\n")  # noqa: E731  leaves out nulls
    made = df.select(k.alias("doc_id"), F.when(k % 3 == 0, text([*columns, *rows])).otherwise(text([*free, *rows])).alias("text"))
    return spread(made)


def spread(docs: DataFrame) -> DataFrame:
    """Small texts that cost much are dealt to all cores; a file of them may be a single task."""
    return docs.repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism))


def extract_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From text to fields to findings."""
    audited = rules.audit(extract.extract_text(invoice_texts(spark, sf_dir)), AS_OF)
    first = F.get("iva", F.lit(0))
    return audited.select(
        F.col("doc_id").cast("long").alias("doc_id"), "pais", "tipo_documento", "numero", "fecha_emision",
        F.col("emisor.nombre").alias("emisor"), F.col("emisor.nif").alias("emisor_nif"), F.col("receptor.nombre").alias("receptor"), F.col("receptor.nif").alias("receptor_nif"),
        F.array_join(F.transform("lineas", lambda x: F.concat_ws("|", x["descripcion"], x["cantidad"].cast("int").cast("string"), (x["precio_unitario"] * 100).cast("long").cast("string"), (x["importe"] * 100).cast("long").cast("string"))), ";").alias("lineas"),
        (F.col("base_imponible") * 100).cast("long").alias("base"), first["porcentaje"].cast("double").alias("pct"), (first["cuota"] * 100).cast("long").alias("cuota"), (F.col("total") * 100).cast("long").alias("total"),
        "confianza", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("findings"),
    )


def _names(names: tuple[str, ...]) -> str:
    return f"list_extract({list(names)}, CAST(k % {len(names)} AS INT) + 1)"


#: An unwritten base is deduced from the total and its one rate; only where the total is missing too is it the sum of lines.
EXTRACT_SQL = f"""
WITH o AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS p, o_orderkey % 9 + 1 AS q, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dia FROM orders),
b AS (SELECT *, q * p AS a, q * p + 2500 AS sum_lines, k % 5 <> 0 AS has_base, k % 11 <> 0 AS has_total FROM o), v AS (SELECT *, (sum_lines * 21 + 50) // 100 AS vat FROM b),
t AS (SELECT *, sum_lines + vat + CASE WHEN k % 7 = 0 AND has_total THEN 30 ELSE 0 END AS total FROM v)
SELECT k AS doc_id, 'ES' AS pais, 'factura' AS tipo_documento, 'F-' || k AS numero, dia AS fecha_emision, {_names(ISSUERS)} AS emisor, {sql_tax_id("(k * 7)", "'ES'")} AS emisor_nif,
  {_names(RECIPIENTS)} AS receptor, {sql_tax_id("(k * 11 + 5)", "'ES'")} AS receptor_nif,
  'Servicio de montaje|' || q || '|' || p || '|' || a || ';Tornillos (10x2,50€|10|250|2500' AS lineas,
  CASE WHEN has_base OR NOT has_total THEN sum_lines ELSE (total * 200 + 121) // 242 END AS base, 21.0::DOUBLE AS pct, vat AS cuota, total,
  CAST(round((2 * CASE WHEN k % 4 = 0 THEN 0.75 ELSE 0.95 END + 2 * 0.95 + 3 * CASE WHEN has_total THEN 0.95 ELSE 0.5 END + 2 * CASE WHEN has_base OR has_total THEN 0.95 ELSE 0.6 END + 4) / 13.5, 3) AS DOUBLE) AS confianza,
  CASE WHEN k % 7 <> 0 OR NOT has_total THEN '' WHEN has_base THEN 'TOTAL_NO_CUADRA' ELSE 'BASE_NO_CUADRA,CUOTA_NO_CUADRA,TOTAL_NO_CUADRA' END AS findings
FROM t
"""


def split_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, percentages, decimals and identifiers that a reader split, joined again; a quantity before a price is not."""
    k = F.col("o_orderkey")
    made = complete_tax_id(k, F.lit("ES"))
    broken = F.concat(F.substr(made, F.lit(1), F.lit(7)), F.lit(" "), F.substr(made, F.lit(8)))
    text = F.concat(F.lit("31/07/2 026 IVA2 1% 640 ,80 1 60,00 "), broken, F.lit(" y B1234567 9"))
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), join_digits(text).alias("text"))


SPLIT_SQL = f"SELECT o_orderkey AS doc_id, '31/07/2026 IVA21% 640,80 1 60,00 ' || {sql_tax_id('o_orderkey', repr('ES'))} || ' y B1234567 9' AS text FROM orders"


def queries() -> dict:
    return {f.__name__: f for f in (extract_audit, split_figures)}


def oracle_sql() -> dict[str, str]:
    return {"extract_audit": EXTRACT_SQL, "split_figures": SPLIT_SQL}
