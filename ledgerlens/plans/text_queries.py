"""Queries over texts, identifiers, amounts, dates and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.dates import format_date, parse_date
from ledgerlens.functions.money import cents, parse_amount
from ledgerlens.functions.taxid import complete_tax_id, foreign_prefix, ids_in, is_valid_tax_id
from ledgerlens.functions.text import compact, format_amount, norm
from ledgerlens.operators import classify, extract, layout
from ledgerlens.operators.lines import text_lines
from ledgerlens.plans.extract_queries import spread
from ledgerlens.plans.views import table
from ledgerlens.plans.views import sql_tax_id

ID_SOURCES = {"es": ("ES", "customer", "c_custkey", 104729), "uk": ("UK", "customer", "c_custkey", 7919), "de": ("DE", "supplier", "s_suppkey", 104729), "us": ("US", "supplier", "s_suppkey", 7919)}


def _tax_id(kind: str):
    country, name, key, factor = ID_SOURCES[kind]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = table(spark, sf_dir, name).select(F.col(key).cast("long").alias("key"), complete_tax_id(F.col(key).cast("long") * factor, F.lit(country)).alias("tax_id"))
        return made.withColumn("valid", is_valid_tax_id(F.col("tax_id"), F.lit(country)))

    return query


def _tax_id_sql(kind: str) -> str:
    country, name, key, factor = ID_SOURCES[kind]
    number = f"(CAST({key} AS BIGINT) * {factor})"
    return f"SELECT CAST({key} AS BIGINT) AS key, {sql_tax_id(number, repr(country))} AS tax_id, TRUE AS valid FROM {name}"


def tax_id_corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identifier with its last digit raised by one: only the US form has nothing to fail."""
    out = None
    for country, name, key, factor in ID_SOURCES.values():
        made = complete_tax_id(F.col(key).cast("long") * factor, F.lit(country))
        last = (F.substr(made, F.length(made), F.lit(1)).cast("int") + 1) % 10
        part = table(spark, sf_dir, name).select(F.lit(country).alias("country"), F.col(key).cast("long").alias("key"), F.concat(F.substr(made, F.lit(1), F.length(made) - 1), last.cast("string")).alias("tax_id"))
        part = part.withColumn("valid", is_valid_tax_id(F.col("tax_id"), F.lit(country)))
        out = part if out is None else out.unionByName(part)
    return out


def _tax_id_corrupted_sql() -> str:
    parts = []
    for country, name, key, factor in ID_SOURCES.values():
        made = sql_tax_id(f"(CAST({key} AS BIGINT) * {factor})", repr(country))
        parts.append(f"SELECT '{country}' AS country, CAST({key} AS BIGINT) AS key, left(t, length(t) - 1) || CAST((CAST(right(t, 1) AS INT) + 1) % 10 AS VARCHAR) AS tax_id, {str(country == 'US').upper()} AS valid FROM (SELECT {key}, {made} AS t FROM {name}) x")
    return " UNION ALL ".join(parts)


#: Portable expressions: the same text in Spark SQL and in the SQL side.
FOREIGN = "CASE c_custkey % 6 WHEN 0 THEN 'FR 83.999-123456' WHEN 1 THEN 'ESB12345674' WHEN 2 THEN 'B12345674' WHEN 3 THEN 'gb123456789' WHEN 4 THEN 'DE136695976' ELSE '' END"
COUNTRY = "CASE c_custkey % 4 WHEN 0 THEN 'ES' WHEN 1 THEN 'UK' WHEN 2 THEN 'US' ELSE 'DE' END"


def foreign_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "customer").select("c_custkey", F.expr(FOREIGN).alias("nif"), F.expr(COUNTRY).alias("country"))
    return made.select("c_custkey", "country", foreign_prefix(F.col("nif"), F.col("country")).alias("prefix"))


FOREIGN_SQL = f"""
WITH m AS (SELECT c_custkey, {COUNTRY} AS country, upper(regexp_replace({FOREIGN}, '[ .-]', '', 'g')) AS nif FROM customer),
p AS (SELECT c_custkey, country, CASE WHEN regexp_full_match(nif, '[A-Z]{{2}}[0-9A-Z]{{8,12}}') THEN left(nif, 2) END AS prefix FROM m)
SELECT c_custkey, country, CASE WHEN prefix <> CASE country WHEN 'ES' THEN 'ES' WHEN 'UK' THEN 'GB' WHEN 'DE' THEN 'DE' ELSE '-' END THEN prefix END AS prefix FROM p
"""


def id_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "supplier").select("s_suppkey", complete_tax_id(F.col("s_suppkey") * 31, F.lit("ES")).alias("own"))
    text = F.concat(F.lit("NIF "), "own", F.lit(" y FR83999123456, ref. "), F.col("s_suppkey").cast("string"), F.lit("; repetido "), "own")
    return made.select("s_suppkey", F.array_join(ids_in(text, F.lit("ES")), "|").alias("ids"))


ID_EXTRACTION_SQL = f"SELECT s_suppkey, own || '|FR83999123456|' || own AS ids FROM (SELECT s_suppkey, {sql_tax_id('(s_suppkey * 31)', repr('ES'))} AS own FROM supplier) x"


def _amount_roundtrip(country: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = F.round(F.col("l_extendedprice") * 100).cast("long")
        written = format_amount((value / 100).cast("decimal(18,2)"), F.lit(country))
        return table(spark, sf_dir, "lineitem").select("l_orderkey", cents(parse_amount(written)).alias("cents"))

    return query


AMOUNT_SQL = "SELECT l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem"


def date_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.expr(COUNTRY.replace("c_custkey", "o_orderkey")).alias("country"))
    return made.select("o_orderkey", "country", parse_date(format_date(F.col("day"), F.col("country")), F.col("country")).cast("string").alias("day"))


DATE_SQL = f"SELECT o_orderkey, {COUNTRY.replace('c_custkey', 'o_orderkey')} AS country, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders"


def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = norm(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(plain).cast("long").alias("n_norm"), F.md5(plain).alias("norm_md5"), F.md5(compact(F.col("text"))).alias("compact_md5"))


TEXT_SQL = r"""
WITH p AS (SELECT doc_id, lower(strip_accents(text)) AS low FROM documents), q AS (SELECT *, trim(regexp_replace(low, '\s+', ' ', 'g')) AS plain FROM p)
SELECT doc_id, length(plain) AS n_norm, md5(plain) AS norm_md5, md5(regexp_replace(low, '[^a-z0-9]', '', 'g')) AS compact_md5 FROM q
"""


def visual_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the documents' lines, with a column gap put after each comma."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit(", "), F.lit(",  ")).alias("text"))
    cells = layout.segments(layout.plain_text_words(docs))
    return cells.groupBy("doc_id").agg(F.count_distinct("line").alias("n_lines"), F.count("*").alias("n_segments"), F.max("x1").alias("width"), F.sum(F.length("text")).alias("n_chars"))


SEGMENTS_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(replace(text, ', ', ',  '), chr(10))) AS line, generate_subscripts(string_split(replace(text, ', ', ',  '), chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, n, line, unnest(list_filter(string_split_regex(line, '\s{2,}'), lambda x: trim(x) <> '')) AS cell FROM l)
SELECT doc_id, count(DISTINCT n) AS n_lines, count(*) AS n_segments, CAST(max(5 * length(rtrim(line))) AS DOUBLE) AS width, CAST(sum(length(trim(cell))) AS BIGINT) AS n_chars FROM c GROUP BY doc_id
"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select((k / 10).cast("long").alias("doc_id"), F.lit(1).alias("page"), (k % 10).cast("int").alias("ord"), (k * 7 % 40).cast("double").alias("x0"), (k * 11 % 30).cast("double").alias("y0")).select("*", (F.col("x0") + 5 + F.col("ord")).alias("x1"), (F.col("y0") + 8 + F.col("ord") % 5).alias("y1"))


BOXES_SQL = "b AS (SELECT *, x0 + 5 + ord AS x1, y0 + 8 + ord % 5 AS y1 FROM (SELECT o_orderkey // 10 AS doc_id, CAST(o_orderkey % 10 AS INT) AS ord, CAST(o_orderkey * 7 % 40 AS DOUBLE) AS x0, CAST(o_orderkey * 11 % 30 AS DOUBLE) AS y0 FROM orders) x)"


def overlap_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.visible_glyphs(_boxes(spark, sf_dir)).select("doc_id", "ord", "x0", "y0")


OVERLAP_SQL = f"""
WITH {BOXES_SQL}
SELECT doc_id, ord, x0, y0 FROM b a WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = a.doc_id AND c.ord > a.ord
  AND least(a.x1, c.x1) - greatest(a.x0, c.x0) > 0.3 * (a.x1 - a.x0) AND least(a.y1, c.y1) - greatest(a.y0, c.y0) > 0.3 * (a.y1 - a.y0))
"""


def nearest_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").select((k / 10).cast("long").alias("doc_id"), F.lit(1).alias("page"), (k % 5).cast("int").alias("line"), (k % 10).cast("int").alias("seg"), F.concat(F.lit("v"), k.cast("string")).alias("text"), (k * 13 % 100).cast("double").alias("x0"))
    placed = base.select("*", (F.col("x0") + 30).alias("x1"), (F.col("line") * 8.0).alias("y0"))
    labels = placed.filter("seg = 0").select("doc_id", "page", "line", F.col("text").alias("label"), "x0", "x1", "y0")
    return layout.nearest_below(labels, placed.filter("seg <> 0")).select("doc_id", "label", "value")


NEAREST_SQL = """
WITH p AS (SELECT o_orderkey // 10 AS doc_id, o_orderkey % 5 AS line, o_orderkey % 10 AS seg, 'v' || o_orderkey AS text, CAST(o_orderkey * 13 % 100 AS DOUBLE) AS x0 FROM orders),
j AS (SELECT a.doc_id, a.text AS label, b.text AS value, row_number() OVER (PARTITION BY a.doc_id, a.text ORDER BY b.line, abs(b.x0 - a.x0), b.seg) AS n
  FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.seg = 0 AND b.seg <> 0 AND b.line - a.line BETWEEN 1 AND 3 AND (b.line - a.line) * 8.0 <= 24 AND b.x0 + 30 >= a.x0 - 15 AND b.x0 <= a.x0 + 30 + 60)
SELECT doc_id, label, value FROM j WHERE n = 1
"""


def anchored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words on slanting lines, grouped around each line's first word."""
    k = F.col("o_orderkey")
    words = table(spark, sf_dir, "orders").select(
        (k / 20).cast("long").alias("doc_id"), F.lit(1).alias("page"), (k % 20).cast("int").alias("ord"), F.concat(F.lit("w"), k.cast("string")).alias("text"),
        (k % 20 * 30).cast("double").alias("x0"), (k % 20 * 1.5).cast("double").alias("y0"), (k % 20 * 30 + 20).cast("double").alias("x1"), (k % 20 * 1.5 + 10).cast("double").alias("y1"), F.lit(1.0).alias("conf"), F.lit(False).alias("rotated"),
    )
    return layout.visual_lines(words).select("doc_id", "ord", F.col("line").cast("long").alias("line"))


#: Heights rise by 1.5 a word without gaps, so a line is the words up to 4 points above its first: three of them.
ANCHORED_SQL = """
WITH w AS (SELECT o_orderkey // 20 AS doc_id, CAST(o_orderkey % 20 AS INT) AS ord, (o_orderkey % 20) * 1.5 AS y FROM orders),
l AS (SELECT doc_id, list(y ORDER BY y, ord) AS ys, list(ord ORDER BY y, ord) AS os FROM w GROUP BY doc_id),
s AS (SELECT doc_id, os, list_reduce(list_transform(ys, lambda y: [struct_pack(anchor := y, line := 0)]),
  lambda a, b: list_concat(a, [CASE WHEN abs(b[1].anchor - a[len(a)].anchor) > 4.0 THEN struct_pack(anchor := b[1].anchor, line := a[len(a)].line + 1) ELSE a[len(a)] END])) AS r FROM l)
SELECT doc_id, unnest(os) AS ord, CAST(unnest(list_transform(r, lambda x: x.line)) AS BIGINT) AS line FROM s
"""

DOC_TEXT = (
    "CONCAT(CASE o_orderkey % 8 WHEN 0 THEN 'FACTURA' WHEN 1 THEN 'Albarán de entrega' WHEN 2 THEN 'Presupuesto' WHEN 3 THEN 'Purchase Order' WHEN 4 THEN 'Pro forma' WHEN 5 THEN 'Quittung' "
    "WHEN 6 THEN 'Recibo domiciliado Invoice' ELSE 'nota' END, ' ', CAST(o_orderkey AS STRING), ' ', CASE o_orderkey % 5 WHEN 0 THEN 'pedidos@empresa.es factura' WHEN 1 THEN 'delivery note for invoice' WHEN 2 THEN 'Rechnung' "
    "WHEN 3 THEN 'sales tax invoice' ELSE 'sin más' END, ' ', CASE o_orderkey % 7 WHEN 0 THEN '100,00 €' WHEN 1 THEN '£ 12.00' WHEN 2 THEN '$ 5.00' WHEN 3 THEN 'Base imponible IVA NIF' WHEN 4 THEN 'VAT reg net amount' ELSE '' END)"
)
DUCK_TEXT = DOC_TEXT.replace("AS STRING", "AS VARCHAR")


def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select("o_orderkey", classify.document_type(F.expr(DOC_TEXT)).alias("t"))
    return made.select("o_orderkey", "t.kind", "t.confidence")


_CUES = (("albaran", "albaran"), ("albaran", "delivery note"), ("presupuesto", "presupuesto"), ("pedido", "purchase order"), ("proforma", "pro forma"), ("recibo", "recibo"), ("recibo", "quittung"), ("factura", "factura"), ("factura", "invoice"), ("factura", "rechnung"))
DOC_TYPE_SQL = (
    f"WITH t AS (SELECT o_orderkey, ' ' || replace(lower(strip_accents({DUCK_TEXT})), 'recibo domiciliado', '') || ' ' AS x FROM orders), "
    "c AS (SELECT o_orderkey, unnest([" + ", ".join(f"struct_pack(at := strpos(x, ' {cue} '), kind := '{kind}')" for kind, cue in _CUES) + "]) AS c FROM t) "
    "SELECT o_orderkey, coalesce(arg_min(c.kind, c.at) FILTER (c.at > 0), 'factura') AS kind, CASE WHEN count(*) FILTER (c.at > 0) > 0 THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence FROM c GROUP BY o_orderkey"
)


def country_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(DOC_TEXT)
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.detect_country(text).alias("country"))


def _points(code: str) -> str:
    from ledgerlens.functions.refdata import COUNTRY_WORDS

    sign = {"ES": "CASE WHEN contains(raw, '€') THEN 1 ELSE 0 END", "DE": "CASE WHEN contains(raw, '€') THEN 1 ELSE 0 END", "UK": "CASE WHEN contains(raw, '£') THEN 3 ELSE 0 END", "US": "CASE WHEN contains(raw, '$') THEN 3 ELSE 0 END"}[code]
    return " + ".join([sign, *(f"CASE WHEN contains(x, '{w}') THEN 2 ELSE 0 END" for w in COUNTRY_WORDS[code])])


COUNTRY_SQL = (
    f"WITH t AS (SELECT o_orderkey, {DUCK_TEXT} AS raw, lower(strip_accents({DUCK_TEXT})) AS x FROM orders), "
    f"p AS (SELECT o_orderkey, {_points('ES')} AS es, {_points('UK')} AS uk, {_points('US')} AS us, {_points('DE')} AS de FROM t) "
    "SELECT o_orderkey, CASE greatest(es, uk, us, de) WHEN es THEN 'ES' WHEN uk THEN 'UK' WHEN us THEN 'US' ELSE 'DE' END AS country FROM p"
)

NOTE = "CASE o_orderkey % 6 WHEN 0 THEN 'Operación EXENTA art. 20' WHEN 1 THEN 'IVA incluido' WHEN 2 THEN 'Factura simplificada' WHEN 3 THEN 'Rectifica la factura F-12/9 de 01/02/2024' WHEN 4 THEN 'Reverse charge' ELSE 'gracias' END"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(F.lit("Factura"), F.expr(NOTE), F.lit("fin"))
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.mentions(lines).alias("m")).select("o_orderkey", "m.*")


MENTIONS_SQL = f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 4) THEN n END AS exencion, o_orderkey % 6 = 1 AS precios_con_iva, o_orderkey % 6 = 2 AS simplificada, o_orderkey % 6 = 3 AS rectificativa,
  CASE WHEN o_orderkey % 6 = 3 THEN regexp_extract(n, 'factura (\\S+) de', 1) || ' de ' || regexp_extract(n, ' de (\\S+)$', 1) END AS rectifica_a FROM (SELECT o_orderkey, {NOTE} AS n FROM orders) x
"""


def label_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and dates read from invoice-like text: beside their labels, or below them."""
    day = F.date_format(F.to_date("o_orderdate"), "dd/MM/yyyy")
    key = F.col("o_orderkey").cast("string")
    beside = F.concat(F.lit("Acme SL\nFactura nº:  F-"), key, F.lit("\nFecha de vencimiento   31/12/2030\nFecha   "), day)
    below = F.concat(F.lit("Acme SL\nNúmero de factura      Fecha de emisión\nF-"), key, F.lit("                   "), day)
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, beside).otherwise(below).alias("text"))
    return extract.label_values(spread(docs).select("doc_id", text_lines(F.col("text")).alias("lines")))


LABEL_SQL = """
SELECT o_orderkey AS doc_id, 'numero' AS kind, 'F-' || o_orderkey AS value, CASE WHEN o_orderkey % 2 = 0 THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence FROM orders
UNION ALL SELECT o_orderkey, 'fecha_emision', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN 0.95 ELSE 0.8 END::DOUBLE FROM orders
UNION ALL SELECT o_orderkey, 'fecha_vencimiento', '2030-12-31', 0.95::DOUBLE FROM orders WHERE o_orderkey % 2 = 0
"""


def totals_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals read back from invoice-like lines."""
    base = F.round(F.col("o_totalprice") * 100).cast("long")
    shown = lambda c: format_amount((c / 100).cast("decimal(18,2)"), F.lit("ES"))
    tax = F.expr("(cast(round(o_totalprice * 100) as bigint) * 21 + 50) div 100")
    rows = F.array(F.concat(F.lit("Base imponible "), shown(base), F.lit(" €")), F.concat(F.lit("IVA 21% "), shown(tax), F.lit(" €")), F.concat(F.lit("Suplidos "), F.lit("12,50 €")), F.concat(F.lit("TOTAL A PAGAR: "), shown(base + tax + 1250), F.lit(" €")))
    lines = F.transform(rows, lambda text: F.struct(text.alias("text"), F.lit(None).cast("string").alias("next")))
    read = extract.totals_in(spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("doc_id"), lines.alias("lines")))
    first = F.get("iva", F.lit(0))
    return read.select("doc_id", "base", first["porcentaje"].cast("double").alias("pct"), first["cuota"].alias("cuota"), first["base"].alias("base_tramo"), "suplidos", "total")


TOTALS_SQL = """
WITH b AS (SELECT o_orderkey AS doc_id, CAST(round(o_totalprice * 100) AS BIGINT) AS base FROM orders), t AS (SELECT *, (base * 21 + 50) // 100 AS cuota FROM b)
SELECT doc_id, base, 21.0::DOUBLE AS pct, cuota, base AS base_tramo, 1250 AS suplidos, base + cuota + 1250 AS total FROM t
"""


def queries() -> dict:
    own = (tax_id_corrupted, foreign_id, id_extraction, date_roundtrip, text_normalise, visual_segments, overlap_antijoin, nearest_below, anchored_lines, doc_type, country_vote, mentions, label_value, totals_concepts)
    return {f"tax_id_{kind}": _tax_id(kind) for kind in ID_SOURCES} | {"amount_roundtrip_es": _amount_roundtrip("ES"), "amount_roundtrip_us": _amount_roundtrip("US")} | {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {f"tax_id_{kind}": _tax_id_sql(kind) for kind in ID_SOURCES} | {
        "amount_roundtrip_es": AMOUNT_SQL,
        "amount_roundtrip_us": AMOUNT_SQL,
        "tax_id_corrupted": _tax_id_corrupted_sql(),
        "foreign_id": FOREIGN_SQL,
        "id_extraction": ID_EXTRACTION_SQL,
        "date_roundtrip": DATE_SQL,
        "text_normalise": TEXT_SQL,
        "visual_segments": SEGMENTS_SQL,
        "overlap_antijoin": OVERLAP_SQL,
        "nearest_below": NEAREST_SQL,
        "anchored_lines": ANCHORED_SQL,
        "doc_type": DOC_TYPE_SQL,
        "country_vote": COUNTRY_SQL,
        "mentions": MENTIONS_SQL,
        "label_value": LABEL_SQL,
        "totals_concepts": TOTALS_SQL,
    }
