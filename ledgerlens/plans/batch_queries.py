"""Queries over audited batches: verdicts, summaries, scores, benchmarks, history, export, stream."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.money import cents
from ledgerlens.functions.refdata import DEFECT_CODES
from ledgerlens.functions.taxid import complete_tax_id
from ledgerlens.operators import batch, extract, score
from ledgerlens.operators.classify import verdict
from ledgerlens.operators.rules import audit
from ledgerlens.operators.schema import conform, violations
from ledgerlens.plans.rule_queries import ALL_SQL, AS_OF
from ledgerlens.plans.views import SQL_CTES, invoices, table
from ledgerlens.sources.readers import cases, with_files
from ledgerlens.streaming import audit_stream
from ledgerlens.streaming.changes import changes, use_state_store


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(invoices(spark, sf_dir), AS_OF)


#: Counts of findings per document, with the verdict they give.
FOUND = (
    f"{SQL_CTES}, f AS (SELECT doc_id AS d, count(*) FILTER (severity = 'error') AS ne, count(*) FILTER (severity = 'aviso') AS nw, count(*) AS nf FROM {ALL_SQL} a GROUP BY doc_id), "
    "r AS (SELECT inv.*, coalesce(ne, 0) AS n_errors, coalesce(nw, 0) AS n_warnings, coalesce(nf, 0) AS n_findings, coalesce(ne, 0) = 0 AS valid, "
    "CASE WHEN coalesce(ne, 0) > 0 THEN 'no_conforme' WHEN coalesce(nw, 0) > 0 THEN 'con_avisos' ELSE 'conforme' END AS estado FROM inv LEFT JOIN f ON d = doc_id)"
)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("doc_id", "pais", verdict().alias("estado"), F.col("n_errors").cast("long").alias("n_errors"), F.col("n_warnings").cast("long").alias("n_warnings"), "valid")


VERDICTS_SQL = f"WITH {FOUND} SELECT doc_id, pais, estado, n_errors, n_warnings, valid FROM r"


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("long")
    results = _audited(spark, sf_dir).select(
        (key % 50 != 0).alias("ok"),
        "valid",
        verdict().alias("estado"),
        F.lit(0.25).alias("seconds"),
        F.when(key % 3 == 0, (key % 4) / 4.0).alias("precision"),
        F.when(key % 2 == 0, (key % 8) / 8.0).alias("confidence"),
    )
    return batch.summarize(results)


SUMMARY_SQL = f"""
WITH {FOUND}
SELECT count(*) AS total, count(*) FILTER (k % 50 <> 0 AND valid) AS validas, count(*) FILTER (k % 50 <> 0 AND NOT valid) AS con_errores, count(*) FILTER (k % 50 = 0) AS fallidas,
  count(*) FILTER (k % 50 = 0) AS no_legibles, round(count(*) * 0.25, 3)::DOUBLE AS segundos, round(avg((k % 4) / 4.0) FILTER (k % 3 = 0), 4)::DOUBLE AS precision_media, round(avg((k % 8) / 8.0) FILTER (k % 2 = 0), 4)::DOUBLE AS confianza_media
FROM r
"""


def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.top_findings(_audited(spark, sf_dir))


TOP_SQL = f"WITH {SQL_CTES} SELECT code, severity, count(*) AS times, count(DISTINCT doc_id) AS documents FROM {ALL_SQL} a GROUP BY code, severity ORDER BY times DESC, code LIMIT 10"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a record holds against the number, total, date and ids it should hold."""
    made = invoices(spark, sf_dir)
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("f/"), F.col("o_orderkey").cast("string")).alias("numero"), F.to_date("o_orderdate").cast("string").alias("fecha"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("fr-83999 123456")).alias("nif"))
    expected = score.unpivoted(wanted, "doc_id", {"numero": F.col("numero"), "fecha_emision": F.concat(F.col("fecha"), F.lit("T00:00")), "receptor.nif": F.col("nif"), "titulo": F.lit("factura")}, "expected")
    obtained = score.unpivoted(made, "doc_id", {"numero": F.nullif(F.col("numero"), F.lit("")), "fecha_emision": F.col("fecha_emision"), "receptor.nif": F.col("receptor.nif"), "titulo": F.col("titulo")}, "obtained")
    return score.field_scores(expected, obtained)


SCORES_CTE = f"""
{SQL_CTES}, s AS (
  SELECT doc_id, 'numero' AS field, k % 31 = 0 AS missing, k % 31 <> 0 AND k % 37 <> 0 AS hit FROM inv
  UNION ALL SELECT doc_id, 'fecha_emision', k % 41 = 0, k % 41 <> 0 FROM inv
  UNION ALL SELECT doc_id, 'receptor.nif', nif_r IS NULL, coalesce(nif_r = 'FR83999123456', FALSE) FROM inv WHERE k % 2 = 0
  UNION ALL SELECT doc_id, 'titulo', FALSE, k % 103 <> 0 AND k % 107 <> 0 FROM inv)
"""


def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.document_scores(_scores(spark, sf_dir))


FIELD_SCORES_SQL = f"WITH {SCORES_CTE} SELECT doc_id, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit AND NOT missing) AS wrong, count(*) FILTER (missing) AS absent, count(*) AS evaluated, round(count(*) FILTER (hit) / count(*), 4)::DOUBLE AS precision FROM s GROUP BY doc_id"


def field_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.failures_by_field(_scores(spark, sf_dir))


FAILURES_SQL = f"WITH {SCORES_CTE} SELECT field, count(*) AS failures FROM s WHERE NOT hit GROUP BY field"


def doc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = invoices(spark, sf_dir)
    has = lambda c, sure: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), sure)
    fields = {"numero": has("numero", 0.95), "fecha_emision": has("fecha_emision", 0.8), "total": has("total", 0.95), "base_imponible": has("base_imponible", 0.8), "fecha_vencimiento": has("fecha_vencimiento", 0.95)}
    lines = F.coalesce(F.size("lineas"), F.lit(0)) > 0
    return made.select("doc_id", extract.document_confidence(fields, F.col("emisor.nif").isNotNull(), lines).alias("confidence"))


CONFIDENCE_SQL = f"""
WITH {SQL_CTES}
SELECT doc_id, round((CASE WHEN k % 31 <> 0 THEN 1.9 ELSE 0 END + CASE WHEN k % 41 <> 0 THEN 1.6 ELSE 0 END + CASE WHEN tot IS NOT NULL THEN 2.85 ELSE 0 END + CASE WHEN base IS NOT NULL THEN 1.6 ELSE 0 END
  + CASE WHEN enviado IS NOT NULL THEN 0.475 ELSE 0 END + CASE WHEN nif_e IS NOT NULL AND k % 131 <> 0 THEN 2 ELSE 0 END + CASE WHEN n_lineas > 0 THEN 2 ELSE 0 END)::DOUBLE / 13.5, 3) AS confidence FROM inv
"""

#: Files of the outside bank: those made with a defect, and one without.
_FILES = (*DEFECT_CODES, "f01_simple")


def external_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a row of a manifest, as what was read of it and as how it was judged: each ninth is without a defect.
    Some dates and bases are misread, some numbers are read where there is none, some judgements have noise."""
    k = F.col("k")
    defect = F.element_at(F.array(*[F.lit(f) for f in _FILES]), (k % len(_FILES) + 1).cast("int"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    euros = lambda c: (c / 100).cast("decimal(18,2)").cast("double")
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), cents.alias("cents"), F.to_date("o_orderdate").alias("day"))
    made = made.withColumns({"defect": defect, "nif": complete_tax_id(k * 7, F.lit("ES"))}).withColumn("fichero", F.concat(k.cast("string"), F.lit("/"), "defect", F.lit(".pdf")))
    numberless, wrong_id = F.col("defect") == "f18_sin_numero_factura", F.col("defect") == "f20_nif_emisor_invalido"
    number = F.concat(F.lit("A-"), k.cast("string"))
    manifest = made.select(
        "fichero", F.when(~numberless, number).alias("numero"), F.date_format("day", "dd/MM/yyyy").alias("fecha"), F.lit("Grafica Sol").alias("emisor"),
        F.when((k % 7 != 0) & ~wrong_id, F.col("nif")).alias("nif_emisor"), F.when((k % 7 != 0) & wrong_id, F.col("nif")).alias("nif_declarado"),
        F.when(k % 5 != 0, euros(F.col("cents"))).alias("base"), F.when(k % 5 == 0, euros(F.col("cents"))).alias("base_declarada"), euros(F.col("cents") + 100).alias("total"), F.lit(None).cast("double").alias("total_declarado"),
    )
    read = made.select(
        "fichero", F.when(~numberless | (k % 23 == 0), F.concat(F.lower(number), F.lit(" "))).alias("numero"), F.when(k % 11 == 0, F.date_add("day", 1)).otherwise(F.col("day")).cast("string").alias("fecha"), F.lit("GRÁFICA, Sol").alias("emisor"),
        F.lower("nif").alias("nif_emisor"), euros(F.col("cents") + F.when(k % 13 == 0, 2).when(k % 3 == 0, 1).otherwise(0)).alias("base"), euros(F.col("cents") + 100).alias("total"),
    )
    reason = F.create_map(*[F.lit(x) for pair in DEFECT_CODES.items() for x in pair])
    own, noise = F.try_element_at(reason, F.col("defect")), F.when((k % 17 == 0) | ((k % 19 == 0) & F.col("own").isNull()), F.lit("LINEA_SIN_DESCRIPCION"))
    errors = F.filter(F.array("own", noise), lambda x: x.isNotNull())
    judged = made.withColumn("own", F.when(k % 29 != 0, own)).withColumn("errores", errors).select("fichero", F.when(F.size("errores") > 0, "no_conforme").otherwise("conforme").alias("estado"), "errores")
    obtained = score.unpivoted(read, "fichero", {c: F.col(c) for c in read.columns if c != "fichero"}, "obtained").withColumnRenamed("doc_id", "fichero")
    return score.outside_cases(score.expected_of_manifest(manifest), obtained, judged)


EXTERNAL_SQL = f"""
WITH o AS (
  SELECT o_orderkey AS k, list_extract({list(_FILES)}, CAST(o_orderkey % {len(_FILES)} AS INT) + 1) AS defect FROM orders
), m AS (
  SELECT *, map_extract(MAP {dict(DEFECT_CODES)}, defect)[1] AS motivo, defect = 'f18_sin_numero_factura' AND k % 23 = 0 AS wrong_number FROM o
), j AS (
  SELECT *, motivo IS NOT NULL AND k % 29 <> 0 AS own_reason, k % 17 = 0 OR (k % 19 = 0 AND NOT coalesce(motivo IS NOT NULL AND k % 29 <> 0, FALSE)) AS noisy,
    5 + CASE WHEN k % 7 <> 0 THEN 1 ELSE 0 END AS fields, CASE WHEN wrong_number THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS missed FROM m
)
SELECT k || '/' || defect || '.pdf' AS fichero, CASE WHEN own_reason OR noisy THEN 'no_conforme' ELSE 'conforme' END AS estado, motivo, CAST(fields - missed AS BIGINT) AS fields_ok, CAST(fields AS BIGINT) AS fields,
  CASE WHEN noisy THEN 1 ELSE 0 END AS noise, own_reason, missed = 0 AND NOT noisy AND (motivo IS NULL OR own_reason) AS correct
FROM j
"""


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("long")
    results = _audited(spark, sf_dir).select("doc_id", F.when(key % 4 != 0, (key % 5 + 95) / 100.0).alias("precision"), "valid", F.size("findings").alias("n_findings"))
    return score.bank_metrics(results)


def bench_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bank(spark, sf_dir).select("precision", "conforming", "normal", "caught", "traps", "n_escaped", "perfect")


BENCH_SQL = f"""
WITH {FOUND}, m AS (SELECT round(avg((k % 5 + 95) / 100.0) FILTER (k % 4 <> 0), 4)::DOUBLE AS precision, count(*) FILTER (k % 4 <> 0 AND valid) AS conforming, count(*) FILTER (k % 4 <> 0) AS normal,
  count(*) FILTER (k % 4 = 0 AND n_findings > 0) AS caught, count(*) FILTER (k % 4 = 0) AS traps, count(*) FILTER (k % 4 = 0 AND n_findings = 0) AS n_escaped FROM r)
SELECT *, precision = 1.0 AND conforming = normal AND caught = traps AS perfect FROM m
"""


def regression_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {c: F.col(c).cast("double") for c in ("precision", "conforming", "caught")} | {"segundos": F.lit(30.0)}
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), c.alias("value")) for n, c in named.items()])
    current = _bank(spark, sf_dir).select(F.inline(pairs))
    baseline = spark.createDataFrame([("precision", 0.99), ("conforming", 0.0), ("caught", 1e9), ("segundos", 10.0)], "metric string, value double")
    return score.regressions(current, baseline)


REGRESSION_SQL = f"""
WITH {FOUND}, m AS (SELECT round(avg((k % 5 + 95) / 100.0) FILTER (k % 4 <> 0), 4)::DOUBLE AS precision, count(*) FILTER (k % 4 = 0 AND n_findings > 0) AS caught FROM r)
SELECT 'precision' AS metric, 0.99::DOUBLE AS before, precision AS now FROM m WHERE precision < 0.99 UNION ALL SELECT 'caught', 1e9::DOUBLE, caught::DOUBLE FROM m UNION ALL SELECT 'segundos', 10.0::DOUBLE, 30.0::DOUBLE
"""


def case_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = invoices(spark, sf_dir).select("doc_id", "pais", "numero")
    even = F.col("doc_id").cast("long") % 2 == 0
    return cases(made.filter(even), made.filter(~even).drop("numero")).groupBy("pais", "trap").agg(F.count("*").alias("n"), F.count("numero").alias("n_numbers"))


CASE_SQL = f"WITH {SQL_CTES} SELECT pais, k % 2 <> 0 AS trap, count(*) AS n, count(*) FILTER (k % 2 = 0) AS n_numbers FROM inv GROUP BY ALL"


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers and labels as their files: what has no file is judged from its record."""
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source")
    files = table(spark, sf_dir, "labels").select(F.concat(F.lit("/bank/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path")).distinct()
    return with_files(answers, files).groupBy("source", "input").agg(F.count("*").alias("n"))


MISSING_SQL = "SELECT source, CASE WHEN l.doc_id IS NULL THEN 'record' ELSE 'file' END AS input, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY ALL"


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("batch_id"), F.col("ts").alias("fecha"), F.col("event_type").alias("origen"))


def history_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.newest(_batches(spark, sf_dir)).select("batch_id", "origen")


def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.expired(_batches(spark, sf_dir)).select("batch_id")


HISTORY_SQL = "SELECT event_id AS batch_id, event_type AS origen FROM events ORDER BY ts DESC, event_id DESC LIMIT 100"
RETENTION_SQL = "SELECT event_id AS batch_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n > 100"


def csv_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batch.flat(_audited(spark, sf_dir))
    money = [c for c, kind in out.dtypes if kind.startswith("decimal")]
    return out.select(*[c for c in out.columns if c not in money and c not in ("confianza", "origen")], *[cents(F.col(c)).alias(c) for c in money])


CSV_SQL = f"""
WITH {FOUND}
SELECT doc_id AS fichero, pais, CASE WHEN valid THEN 'sí' ELSE 'no' END AS valida, CAST(n_errors AS INT) AS errores, CAST(n_warnings AS INT) AS avisos,
  CASE WHEN k % 31 = 0 THEN '' WHEN k % 37 = 0 THEN 'SIN NUMERO' ELSE 'F/' || k END AS numero, CAST(emision AS VARCHAR) AS fecha_emision, CAST(enviado AS VARCHAR) AS fecha_vencimiento,
  CASE WHEN k % 131 <> 0 THEN proveedor END AS emisor, CASE WHEN k % 131 <> 0 THEN nif_e END AS emisor_nif, cliente AS receptor, nif_r AS receptor_nif, estado,
  base AS base_imponible, tot AS total, CASE WHEN n_tramos > 0 THEN cuotas END AS cuota_impuesto, CASE WHEN ret <> 0 THEN -ret END AS irpf, re AS recargo_equivalencia, sup AS suplidos FROM r
"""


def footer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.footer(_audited(spark, sf_dir))


FOOTER_SQL = f"WITH {FOUND} SELECT CAST(sum(base) AS BIGINT) AS base_cents, CAST(sum(cuotas) AS BIGINT) AS tax_cents, CAST(sum(tot) AS BIGINT) AS total_cents, bool_and(valid) AS all_valid FROM r"


def sample_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.samples(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 4)


SAMPLE_SQL = "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source ORDER BY source LIMIT 4"


def strict_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each constraint of a clean dataset is violated."""
    return violations(invoices(spark, sf_dir)).select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


STRICT_SQL = f"""
WITH {SQL_CTES}, l AS (
  SELECT k, bool_and(coalesce(NOT rota AND cantidad > 0 AND precio > 0 AND importe > 0, FALSE)) AS line_values, bool_and(coalesce(NOT rota AND abs(importe - cantidad * precio) <= 2, FALSE)) AS line_amount FROM lin GROUP BY k
), c AS (
  SELECT inv.k, coalesce(line_values, FALSE) AS line_values, coalesce(line_amount, FALSE) AS line_amount, n_lineas > 0 AS has_lines, n_tramos > 0 AS has_tranches, n_tramos > 0 AS percent_range,
    coalesce(n_lineas > 0 AND abs(base - suma) <= 2, FALSE) AS base_sum, coalesce(n_tramos > 0 AND abs(tot - (base + cuotas - coalesce(ret, 0))) <= 2, FALSE) AS total_sum,
    pais <> 'FR' AS country, coalesce(base >= 0 AND tot >= 0, FALSE) AS sign
  FROM inv LEFT JOIN l ON l.k = inv.k
), u AS (UNPIVOT c ON line_values, line_amount, has_lines, has_tranches, percent_range, base_sum, total_sum, country, sign INTO NAME violation VALUE held)
SELECT violation, count(*) AS n FROM u WHERE NOT held GROUP BY violation
"""


def _event_invoices(events: DataFrame) -> DataFrame:
    return conform(
        events.select(
            F.col("event_id").cast("string").alias("doc_id"),
            F.lit("ES").alias("pais"),
            F.concat(F.lit("E/"), F.col("event_id").cast("string")).alias("numero"),
            F.to_date("ts").cast("string").alias("fecha_emision"),
            F.col("value").cast("decimal(18,2)").alias("base_imponible"),
            F.when(F.col("event_id") % 2 == 0, F.col("value").cast("decimal(18,2)")).alias("total"),
        )
    )


def _stream_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's state and output, in the one that the cluster shares; a local one only where driver and
    executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder for the stream's state")
        base = tempfile.mkdtemp(prefix="stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: A user of whom nothing was heard for so long is told anew.
IDLE_MS = 7 * 24 * 3600 * 1000


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive: of each user those whose type is another than that of the event before."""
    from pyspark.errors import AnalysisException

    folder, store = _stream_folder(spark, "status-changes"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    use_state_store(spark)
    try:
        told = changes(stream, "user_id", "ts", ["event_type"], expiry_ms=IDLE_MS)
        audit_stream.to_batches(told, lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/out/part={number}"), f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    try:
        seen = spark.read.parquet(f"{folder}/out")
    except AnalysisException:  # no file arrived, so no batch was written
        seen = spark.createDataFrame([], "key string, at timestamp, state string")
    return seen.select(F.col("key").cast("long").alias("user_id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.get_json_object("state", "$.event_type").alias("event_type"))


STATUS_SQL = f"""
WITH e AS (SELECT user_id, ts, event_type, row_number() OVER w AS n, lag(event_type) OVER w AS before, lag(ts) OVER w AS seen FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type))
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, event_type FROM e WHERE n = 1 OR event_type IS DISTINCT FROM before OR epoch_ms(ts) - epoch_ms(seen) > {IDLE_MS}
"""


def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as invoices that arrive: audited in micro-batches, each written to a folder of its own number."""
    from pyspark.errors import AnalysisException

    source = table(spark, sf_dir, "events")
    folder = _stream_folder(spark, "stream-audit")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    audited = audit_stream.audited(_event_invoices(stream), "2000-01-01").select("doc_id", "estado", F.transform("findings", lambda f: f["code"]).alias("codes"))

    def sink(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    audit_stream.to_batches(audited, sink, f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    try:
        seen = spark.read.parquet(f"{folder}/out")
    except AnalysisException:  # no file arrived, so no batch was written
        seen = spark.createDataFrame([], "doc_id string, estado string, codes array<string>")
    return seen.select("estado", F.explode("codes").alias("code")).groupBy("estado", "code").agg(F.count("*").alias("n"))


OWN = (verdicts, batch_summary, top_findings, field_scores, field_failures, doc_confidence, external_cases, bench_metrics, regression_diff, case_union, missing_files, history_listing, history_retention, csv_flat, footer_totals, sample_picker, strict_schema, stream_audit, status_changes)


def queries() -> dict:
    return {f.__name__: f for f in OWN}


def oracle_sql() -> dict[str, str]:
    return {
        "verdicts": VERDICTS_SQL, "batch_summary": SUMMARY_SQL, "top_findings": TOP_SQL, "field_scores": FIELD_SCORES_SQL, "field_failures": FAILURES_SQL, "doc_confidence": CONFIDENCE_SQL,
        "external_cases": EXTERNAL_SQL, "bench_metrics": BENCH_SQL, "regression_diff": REGRESSION_SQL, "case_union": CASE_SQL, "missing_files": MISSING_SQL, "history_listing": HISTORY_SQL,
        "history_retention": RETENTION_SQL, "csv_flat": CSV_SQL, "footer_totals": FOOTER_SQL, "sample_picker": SAMPLE_SQL, "strict_schema": STRICT_SQL, "status_changes": STATUS_SQL,
    }
