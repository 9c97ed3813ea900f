"""Every query with SQL against DuckDB on the smallest tables; plans that must stay as they are."""

import collections
import decimal
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import batch_queries, catalog, extract_queries, rule_queries, text_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
# the groups are parts of audit_findings; two of them stand for all
NAMES = [n for n in SQL if n not in rule_queries.GROUPS or n in ("party_rules", "tranche_bases")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    mine = collections.Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = collections.Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert mine == theirs


def test_catalog_is_whole():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) == sum(len(m.queries()) for m in catalog.MODULES)


def test_rules_cover_every_code():
    from ledgerlens.operators.rules import MESSAGES

    assert sorted(code for codes in rule_queries.GROUPS.values() for code in codes) == sorted(set(MESSAGES) - {"NO_LEGIBLE"})


def test_rules_stay_in_the_engine(spark):
    frame = QUERIES["audit_findings"](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_two_columns(spark):
    plan = QUERIES["amount_roundtrip_es"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan


def test_stream_gives_the_same_findings_as_the_table(spark):
    from ledgerlens.operators.classify import verdict
    from ledgerlens.operators.rules import audit
    from ledgerlens.plans.views import table

    judged = audit(batch_queries._event_invoices(table(spark, SF, "events")), "2000-01-01").withColumn("estado", verdict())
    expected = collections.Counter((r["estado"], f["code"]) for r in judged.select("estado", "findings").collect() for f in r["findings"])
    for _ in range(2):  # a second run has state of its own
        assert {(r["estado"], r["code"]): r["n"] for r in QUERIES["stream_audit"](spark, SF).collect()} == expected


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert 0 < len(rows) <= 10 and rows[0]["times"] >= rows[-1]["times"]


def test_escaped_traps_are_rows(spark):
    from ledgerlens.operators import score

    results = spark.createDataFrame([("a", None, True, 0), ("b", None, True, 2), ("c", 1.0, True, 0), ("d", None, False, 0)], "doc_id string, precision double, valid boolean, n_findings int")
    metrics = score.bank_metrics(results)
    assert "collect_list" not in metrics._jdf.queryExecution().optimizedPlan().toString() and metrics.first()["n_escaped"] == 2
    assert {r["doc_id"] for r in score.escaped_traps(results).collect()} == {"a", "d"}


def test_outside_cases_by_hand(spark):
    from ledgerlens.operators import score

    manifest = spark.createDataFrame([("b/f01_simple.pdf", "A-1", "01/02/2025", "Grafica Sol", 100.0), ("f18_sin_numero_factura.pdf", None, "05/03/2025", "Luz SA", 50.0), ("f16_base_no_suma.pdf", "B-7", "07/03/2025", "Mar SL", 80.0)], "fichero string, numero string, fecha string, emisor string, base double")
    read = spark.createDataFrame([("b/f01_simple.pdf", "a-1 ", "2025-02-01", "Gráfica Sol", 100.01), ("f18_sin_numero_factura.pdf", None, "2025-03-05", "LUZ, S.A.", 50.0), ("f16_base_no_suma.pdf", "B-7", "2025-03-08", "Mar SL", 80.0)], manifest.schema)
    obtained = score.unpivoted(read, "fichero", {c: F.col(c) for c in read.columns[1:]}, "obtained").withColumnRenamed("doc_id", "fichero")
    judged = spark.createDataFrame([("b/f01_simple.pdf", "conforme", []), ("f18_sin_numero_factura.pdf", "no_conforme", ["SIN_NUMERO"]), ("f16_base_no_suma.pdf", "no_conforme", ["BASE_NO_CUADRA", "TOTAL_NO_CUADRA"])], "fichero string, estado string, errores array<string>")
    got = {r["fichero"]: tuple(r)[1:] for r in score.outside_cases(score.expected_of_manifest(manifest), obtained, judged).collect()}
    assert got == {"b/f01_simple.pdf": ("conforme", None, 4, 4, 0, False, True), "f18_sin_numero_factura.pdf": ("no_conforme", "SIN_NUMERO", 4, 4, 0, True, True), "f16_base_no_suma.pdf": ("no_conforme", "BASE_NO_CUADRA", 3, 4, 1, True, False)}
