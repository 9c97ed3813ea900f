"""Invoices derived from the order tables, as DataFrames and as the CTEs of the SQL side.

The tables hold no invoices, so each order becomes one. Amounts are whole cents; defects are planted by arithmetic on
the order key, so that every rule has cases.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions.taxid import complete_tax_id
from ledgerlens.operators.schema import LINE, TRANCHE, conform

RATES = (0, 4, 10, 21, 5, 20, 7, 19, 3)
RATES_IN_ORDER = ("cast(null as int)", *sorted(RATES))
COUNTRY_BY_KEY = ("ES", "UK", "US", "DE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(key: Column | str, n: int, rest: int = 0) -> Column:
    return F.col(key) % n == rest if isinstance(key, str) else key % n == rest


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, i and the line's fields in cents."""
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", F.round(F.col("l_discount") * 100).cast("int"), "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    raw = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(order)).withColumn("q", F.col("l_quantity").cast("long"))
    raw = raw.withColumn("u", F.expr("cast(round(l_extendedprice * 100) as bigint) div greatest(q, 1)")).withColumn("z", F.col("l_orderkey") + F.col("i"))
    z = F.col("z")
    return raw.select(
        F.col("l_orderkey").alias("k"),
        "i",
        F.col("l_suppkey").alias("supp"),
        F.when(_every(z, 71), F.lit("")).otherwise(F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).alias("descripcion"),
        F.when(_every(z, 53), F.lit(0)).when(_every(z, 59), -F.col("q")).otherwise(F.col("q")).alias("cantidad"),
        F.when(_every(z, 61), -F.col("u")).otherwise(F.col("u")).alias("precio"),
        F.when(~_every(z, 67), F.col("q") * F.col("u") + F.when(_every(z, 17), 5).otherwise(0)).alias("importe"),
        _every(z, 73).alias("rota"),
        F.element_at(F.array(*[F.lit(r) for r in RATES]), F.round(F.col("l_tax") * 100).cast("int") + 1).alias("pct"),
        F.to_date("l_shipdate").alias("enviado"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order, in the shape of ledgerlens.operators.schema."""
    # cents times 0.01 stay whole numbers inside; a division would go by the text of a double
    euros = lambda c: (c.cast("decimal(16,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")
    lines = order_lines(spark, sf_dir)
    counted = F.when(~F.col("rota"), F.coalesce("importe", F.lit(0))).otherwise(0)
    line = F.struct("descripcion", F.col("cantidad").cast("decimal(18,4)").alias("cantidad"), euros(F.col("precio")).cast("decimal(18,4)").alias("precio_unitario"), euros(F.col("importe")).alias("importe")).cast(LINE)
    # one grouping: there are few rates, so a tranche is a pair of sums; a rate that is missing comes first
    of_rate = [(F.lit(None).cast("int"), F.col("pct").isNull()), *((F.lit(r), F.col("pct") == r) for r in sorted(RATES))]
    sums = [x for n, (_, mine) in enumerate(of_rate) for x in (F.count_if(mine).alias(f"n{n}"), F.sum(F.when(mine, F.col("contado"))).alias(f"base{n}"))]
    by_order = (
        lines.withColumn("contado", counted)
        .groupBy("k")
        .agg(
            *sums,
            F.sum("contado").alias("suma"),
            F.collect_list(F.struct("i", F.when(~F.col("rota"), line).alias("line"))).alias("filas"),
            F.min("enviado").alias("enviado"),
            F.min(F.when(F.col("i") == 1, F.col("supp"))).alias("supp"),
        )
    )
    tranches, quotas = [], []
    for n, (pct, _) in enumerate(of_rate):
        base, there, kt = F.col(f"base{n}"), F.col(f"n{n}") > 0, F.col("k") + pct
        quota = F.expr(f"(base{n} * {RATES_IN_ORDER[n]} + 50) div 100") + F.when(_every(kt, 13), 7).otherwise(0)
        tranche = F.struct(pct.cast("decimal(9,4)").alias("porcentaje"), euros(F.when(~_every(kt, 83), base)).alias("base_imponible"), euros(quota).alias("cuota"), F.lit(None).cast("string").alias("motivo"), _every("k", 23).alias("base_deducida")).cast(TRANCHE)
        tranches.append(F.when(there, F.array(tranche)).otherwise(F.array().cast(f"array<{TRANCHE}>")))
        quotas.append(F.when(there, F.coalesce(quota, F.lit(0))).otherwise(0))
    # tranches stand outside of any lambda and beside one: so they are generated code, and in methods small enough to be compiled
    by_order = by_order.withColumns({"lineas": F.transform(F.sort_array("filas"), lambda x: x["line"]), "iva": F.concat(*tranches), "cuotas": reduce(Column.__add__, quotas)}).drop("filas")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("dia"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_name").alias("cliente"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"), F.col("s_name").alias("proveedor"))
    # names first: orders are narrow as long as they have no lines
    df = orders.join(customers, "cust", "left").join(by_order, "k", "left").join(suppliers, "supp", "left")
    k = F.col("k")
    df = df.withColumn("suma", F.coalesce("suma", F.lit(0))).withColumn("cuotas", F.coalesce("cuotas", F.lit(0)))
    df = df.withColumn("pais0", F.element_at(F.array(*[F.lit(c) for c in COUNTRY_BY_KEY]), (k % 4 + 1).cast("int")))
    df = df.withColumn("dto", F.when(_every("k", 10, 3), F.expr("(suma * 10 + 50) div 100") + F.when(_every("k", 30, 3), 9).otherwise(0)))
    base = F.when(_every("k", 89), F.lit(None).cast("long")).otherwise(F.col("suma") - F.coalesce("dto", F.lit(0)) + F.when(_every("k", 70, 3), 4).otherwise(0) + F.when(_every("k", 11), 100).otherwise(0))
    df = df.withColumn("base", base).withColumn("b", F.coalesce("base", F.lit(0)))
    df = df.withColumn("ret", F.when(_every("k", 5), F.expr("(b * 15 + 50) div 100") + F.when(_every("k", 25), 3).otherwise(0)))
    df = df.withColumn("tasa", F.when(_every("k", 12, 1), 52).otherwise(33)).withColumn("re", F.when(_every("k", 6, 1), F.expr("(b * tasa + 500) div 1000") + F.when(_every("k", 18, 1), 6).otherwise(0)))
    df = df.withColumn("sup", F.when(_every("k", 8), 1250))
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = F.col("b") + F.col("cuotas") + zero("re") - zero("ret") + zero("sup") + F.when(_every("k", 7), 30).otherwise(0)
    df = df.withColumn("tot", F.when(_every("k", 97), F.lit(None)).when(_every("k", 101), -total).otherwise(total))
    ours = complete_tax_id(F.col("supp") * 7919, F.col("pais0"))
    ours = F.when(_every("k", 127), F.lit(None)).when(_every("k", 19), F.concat(F.substr(ours, F.lit(1), F.length(ours) - 1), ((F.substr(ours, F.length(ours), F.lit(1)).cast("int") + 1) % 10).cast("string"))).otherwise(ours)
    df = df.withColumn("nif_e", ours)
    theirs = complete_tax_id(F.col("cust") * 104729, F.col("pais0"))
    df = df.withColumn("nif_r", F.when(_every("k", 137), F.lit("FR83999123456")).when(_every("k", 139), F.lit("")).when(_every("k", 149), F.col("nif_e")).otherwise(theirs))
    party = lambda name, nif: F.struct(name.alias("nombre"), nif.alias("nif"), F.lit(None).cast("struct<calle:string,ciudad:string,provincia:string,codigo_postal:string,pais:string>").alias("direccion"))
    return conform(
        df.select(
            k.cast("string").alias("doc_id"),
            F.when(_every("k", 113), F.lit("FR")).otherwise(F.col("pais0")).alias("pais"),
            F.when(_every("k", 109), F.lit("recibo")).otherwise(F.lit("factura")).alias("tipo_documento"),
            F.when(_every("k", 103), F.lit("Albarán de entrega")).when(_every("k", 107), F.lit("Quote")).otherwise(F.lit("Factura")).alias("titulo"),
            F.when(_every("k", 31), F.lit("")).when(_every("k", 37), F.lit("SIN NUMERO")).otherwise(F.concat(F.lit("F/"), k.cast("string"))).alias("numero"),
            F.when(~_every("k", 41), F.col("dia").cast("string")).alias("fecha_emision"),
            F.col("enviado").cast("string").alias("fecha_vencimiento"),
            F.when(~_every("k", 131), party(F.col("proveedor"), F.col("nif_e"))).alias("emisor"),
            party(F.col("cliente"), F.col("nif_r")).alias("receptor"),
            "lineas",
            euros(F.when(_every("k", 10, 3), F.col("suma"))).alias("base_bruta"),
            F.when(_every("k", 10, 3), F.struct(F.lit(10).cast("decimal(9,4)").alias("porcentaje"), euros(F.col("dto")).alias("importe"))).alias("descuento"),
            euros(F.col("base")).alias("base_imponible"),
            "iva",
            F.when(F.col("re").isNotNull(), F.array(F.struct((F.col("tasa") / 10).cast("decimal(9,4)").alias("porcentaje"), euros(F.col("base")).alias("base_imponible"), euros(F.col("re")).alias("cuota"), F.lit(None).cast("string").alias("motivo"), F.lit(False).alias("base_deducida")))).alias("recargo"),
            F.when(F.col("ret").isNotNull(), F.struct(F.lit(15).cast("decimal(9,4)").alias("porcentaje"), euros(F.col("base")).alias("base_imponible"), euros(F.col("ret")).alias("cuota"))).alias("retencion"),
            euros(F.col("sup")).alias("suplidos"),
            euros(F.col("tot")).alias("total"),
            F.when(_every("k", 14), F.lit("Operación exenta art. 20")).alias("exencion"),
            _every("k", 29).alias("precios_con_iva"),
            _every("k", 43).alias("simplificada"),
            _every("k", 47).alias("rectificativa"),
            F.when(_every("k", 94), F.lit("F/1")).alias("rectifica_a"),
        )
    )


def sql_tax_id(number: str, country: str) -> str:
    """SQL for a valid identifier of a number expression, in plain arithmetic."""
    d = [f"(({number} // {10 ** (7 - at)}) % 10)" for at in range(1, 8)]
    cif = "(10 - (" + " + ".join(f"(2 * {x}) // 10 + (2 * {x}) % 10" if at % 2 == 0 else x for at, x in enumerate(d)) + ") % 10) % 10"
    uk = "97 - (" + " + ".join(f"{8 - at} * {x}" for at, x in enumerate(d)) + ") % 97"
    digits = f"list_transform(range(8), lambda n: CAST(substr(lpad(CAST(({number}) % 100000000 AS VARCHAR), 8, '0'), CAST(n AS INT) + 1, 1) AS INT))"
    de = f"(11 - list_reduce({digits}, lambda p, c: (2 * CASE WHEN (c + p) % 10 = 0 THEN 10 ELSE (c + p) % 10 END) % 11, 10)) % 10"
    seven = f"lpad(CAST(({number}) % 10000000 AS VARCHAR), 7, '0')"
    return (
        f"CASE {country} WHEN 'ES' THEN 'B' || {seven} || CAST({cif} AS VARCHAR) WHEN 'UK' THEN 'GB' || {seven} || lpad(CAST({uk} AS VARCHAR), 2, '0') "
        f"WHEN 'DE' THEN 'DE' || lpad(CAST(({number}) % 100000000 AS VARCHAR), 8, '0') || CAST({de} AS VARCHAR) ELSE '12-' || {seven} END"
    )


#: The same invoices for the SQL side: lin (lines), tra (tranches) and inv.
SQL_CTES = f"""
lin AS (
  SELECT l_orderkey AS k, i, l_suppkey AS supp, l_orderkey + i AS z, q, u,
    CASE WHEN (l_orderkey + i) % 71 = 0 THEN '' ELSE 'Part ' || l_partkey END AS descripcion,
    CASE WHEN (l_orderkey + i) % 53 = 0 THEN 0 WHEN (l_orderkey + i) % 59 = 0 THEN -q ELSE q END AS cantidad,
    CASE WHEN (l_orderkey + i) % 61 = 0 THEN -u ELSE u END AS precio,
    CASE WHEN (l_orderkey + i) % 67 <> 0 THEN q * u + CASE WHEN (l_orderkey + i) % 17 = 0 THEN 5 ELSE 0 END END AS importe,
    (l_orderkey + i) % 73 = 0 AS rota, list_extract({list(RATES)}, CAST(round(l_tax * 100) AS INT) + 1) AS pct, CAST(l_shipdate AS DATE) AS enviado
  FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, CAST(round(l_discount * 100) AS INT), l_tax, l_shipdate, l_returnflag, l_linestatus) AS i,
      CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) // greatest(CAST(l_quantity AS BIGINT), 1) AS u
    FROM lineitem) x
), tra AS (
  SELECT *, base * pct AS bp, (base * pct + 50) // 100 + CASE WHEN (k + pct) % 13 = 0 THEN 7 ELSE 0 END AS cuota, CASE WHEN (k + pct) % 83 <> 0 THEN base END AS base_t,
    row_number() OVER (PARTITION BY k ORDER BY pct) AS n
  FROM (SELECT k, pct, CAST(sum(CASE WHEN rota THEN 0 ELSE coalesce(importe, 0) END) AS BIGINT) AS base FROM lin GROUP BY k, pct) x
), inv0 AS (
  SELECT o_orderkey AS k, o_custkey AS cust, CAST(o_orderdate AS DATE) AS dia, list_extract({list(COUNTRY_BY_KEY)}, CAST(o_orderkey % 4 AS INT) + 1) AS pais0,
    l.enviado, l.supp, coalesce(l.suma, 0) AS suma, coalesce(l.n_lineas, 0) AS n_lineas, coalesce(t.cuotas, 0) AS cuotas, coalesce(t.n_tramos, 0) AS n_tramos, t.bases, t.sin_base, c_name AS cliente, s_name AS proveedor
  FROM orders
  LEFT JOIN (SELECT k, min(enviado) AS enviado, min(supp) FILTER (i = 1) AS supp, CAST(sum(CASE WHEN rota THEN 0 ELSE coalesce(importe, 0) END) AS BIGINT) AS suma, count(*) AS n_lineas FROM lin GROUP BY k) l ON l.k = o_orderkey
  LEFT JOIN (SELECT k, CAST(sum(cuota) AS BIGINT) AS cuotas, count(*) AS n_tramos, CAST(sum(base_t) AS BIGINT) AS bases, count(*) FILTER (base_t IS NULL) AS sin_base FROM tra GROUP BY k) t ON t.k = o_orderkey
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN supplier ON s_suppkey = l.supp
), inv1 AS (
  SELECT *, CASE WHEN k % 10 = 3 THEN (suma * 10 + 50) // 100 + CASE WHEN k % 30 = 3 THEN 9 ELSE 0 END END AS dto FROM inv0
), inv2 AS (
  SELECT *, CASE WHEN k % 89 <> 0 THEN suma - coalesce(dto, 0) + CASE WHEN k % 70 = 3 THEN 4 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 100 ELSE 0 END END AS base FROM inv1
), inv3 AS (
  SELECT *, CASE WHEN k % 5 = 0 THEN (coalesce(base, 0) * 15 + 50) // 100 + CASE WHEN k % 25 = 0 THEN 3 ELSE 0 END END AS ret, CASE WHEN k % 12 = 1 THEN 52 ELSE 33 END AS tasa, CASE WHEN k % 8 = 0 THEN 1250 END AS sup,
    {sql_tax_id("(supp * 7919)", "pais0")} AS nif_e0, {sql_tax_id("(cust * 104729)", "pais0")} AS nif_r0
  FROM inv2
), inv4 AS (
  SELECT *, CASE WHEN k % 6 = 1 THEN (coalesce(base, 0) * tasa + 500) // 1000 + CASE WHEN k % 18 = 1 THEN 6 ELSE 0 END END AS re,
    CASE WHEN k % 127 = 0 THEN NULL WHEN k % 19 = 0 THEN left(nif_e0, length(nif_e0) - 1) || CAST((CAST(right(nif_e0, 1) AS INT) + 1) % 10 AS VARCHAR) ELSE nif_e0 END AS nif_e
  FROM inv3
), inv5 AS (
  SELECT *, coalesce(base, 0) + cuotas + coalesce(re, 0) - coalesce(ret, 0) + coalesce(sup, 0) + CASE WHEN k % 7 = 0 THEN 30 ELSE 0 END AS tot0,
    CASE WHEN k % 137 = 0 THEN 'FR83999123456' WHEN k % 139 = 0 THEN '' WHEN k % 149 = 0 THEN nif_e ELSE nif_r0 END AS nif_r,
    CASE WHEN k % 113 = 0 THEN 'FR' ELSE pais0 END AS pais, CASE WHEN k % 109 = 0 THEN 'recibo' WHEN k % 103 = 0 THEN 'albaran' WHEN k % 107 = 0 THEN 'presupuesto' END AS clase
  FROM inv4
), inv AS (
  SELECT *, CAST(k AS VARCHAR) AS doc_id, CASE WHEN k % 97 = 0 THEN NULL WHEN k % 101 = 0 THEN -tot0 ELSE tot0 END AS tot, pais <> 'FR' AND clase IS NULL AS plena, k % 47 = 0 AS rectif, CASE WHEN k % 41 <> 0 THEN dia END AS emision
  FROM inv5
)
"""
