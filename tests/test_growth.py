"""What a query need not do, so that its work stays small as tables grow."""

import collections
import decimal
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.binding import let
from ledgerlens.functions.dates import iso_date
from ledgerlens.functions.taxid import complete_tax_id, holds_valid_ids, is_valid_tax_id, valid_ids_in
from ledgerlens.functions.text import BARE, MARKED, norm
from ledgerlens.operators import classify, extract, lines
from ledgerlens.operators.rules import BLOCK_CODES, MESSAGES, audit
from ledgerlens.operators.schema import conform
from ledgerlens.operators.totals import carries_concept, concepts
from ledgerlens.plans import rule_queries, text_queries
from ledgerlens.plans.views import invoices

SF = "/root/testdata/sf0.001"


def test_blocks_hold_every_code_once():
    held = collections.Counter(code for codes in BLOCK_CODES.values() for code in codes)
    assert set(held.values()) == {1}
    assert set(held) == set(MESSAGES) - {"PAIS_NO_SOPORTADO", "DOC_NO_ES_FACTURA", "NO_LEGIBLE"}


def test_groups_are_parts_of_the_whole_audit(spark):
    rows = lambda frame: collections.Counter(map(tuple, frame.collect()))
    whole = rule_queries.findings(spark, SF).localCheckpoint()
    for name in ("line_structure", "tax_rate_domain", "number_rules", "document_class"):
        assert rows(rule_queries.rule_query(name)(spark, SF)) == rows(whole.filter(F.col("code").isin(*rule_queries.GROUPS[name])))


@pytest.mark.parametrize("name, unused", [("date_rules", "collect_list"), ("tax_rate_domain", "collect_list")])
def test_group_leaves_out_what_its_rules_do_not_ask(spark, capsys, name, unused):
    rule_queries.rule_query(name)(spark, SF).explain()
    assert unused not in capsys.readouterr().out


def test_both_ways_of_placing_words_agree(spark, monkeypatch):
    texts = ["", "  uno   dos ", "a", "Año  nº\t7  \n\n  " + "x yz  " * 70, "é" * 3 + " €  😀 fin", "   \n b", "w " * 64, "w " * 65]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    read = lambda: [r[0] for r in docs.coalesce(1).select(lines.text_lines(F.col("text"))).collect()]
    walked = read()
    monkeypatch.setattr(lines, "MOST_WALKED", 0)
    assert read() == walked
    words = walked[1][0]["words"]
    assert [(w["text"], w["x0"], w["x1"]) for w in words] == [("uno", 10.0, 25.0), ("dos", 40.0, 55.0)]


def test_audit_reads_each_text_and_date_once(spark):
    plan = rule_queries.findings(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(") == 1
    assert "gettimestamp" not in plan  # dates of fixed form need no formatter


def test_lines_at_the_edge_of_tolerance_are_judged_exactly(spark):
    amounts = ["10.00", "10.02", "10.03", "9.98", "9.97", "-10.00", None, "9999999999999.99"]
    lines_of = ", ".join(f"named_struct('descripcion', 'x', 'cantidad', {q}, 'precio_unitario', {p}, 'importe', {a or 'null'})" for q, p in (("2.5", "4.0018"), ("1", "10.0050"), ("1", "9999999999999.95")) for a in amounts)
    made = conform(spark.sql(f"SELECT '1' AS doc_id, array({lines_of}) AS lineas"))
    wrong = {f["field"] for f in audit(made, "2024-01-01").collect()[0]["findings"] if f["code"] == "LINEA_NO_CUADRA"}
    half_up = decimal.Context(prec=60, rounding=decimal.ROUND_HALF_UP)
    cents = lambda x: int(x.scaleb(2, half_up).quantize(decimal.Decimal(1), context=half_up))
    expected, at = set(), 0
    for q, p in (("2.5", "4.0018"), ("1", "10.0050"), ("1", "9999999999999.95")):
        for a in amounts:
            at += 1
            if a and abs(cents(decimal.Decimal(a)) - cents(decimal.Decimal(q) * decimal.Decimal(p))) > 2:
                expected.add(f"lineas[{at}].importe")
    assert wrong == expected


def test_iso_dates_are_of_fixed_form(spark):
    texts = {"2024-02-29": "2024-02-29", "2024-02-29T10:00": "2024-02-29", "2023-02-29": None, "2024-1-01": None, "2024-01-1T": None, " 2024-01-1": None, "2024-13-01": None, "": None, "12024-01-01": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", iso_date(F.col("t")).cast("string")).collect()
    assert {r[0]: r[1] for r in rows} == texts


def test_made_identifiers_are_valid_and_no_other_digit_is(spark):
    made = spark.range(0, 3000, 7).withColumn("country", F.explode(F.array(*[F.lit(c) for c in ("ES", "UK", "DE")]))).withColumn("nif", complete_tax_id(F.col("id") * 104729, F.col("country")))
    other = F.concat(F.expr("substr(nif, 1, length(nif) - 1)"), ((F.expr("right(nif, 1)").cast("int") + 1) % 10).cast("string"))
    assert made.filter(~is_valid_tax_id(F.col("nif"), F.col("country")) | is_valid_tax_id(other, F.col("country"))).count() == 0


def test_generated_methods_of_invoices_are_small(spark):
    # the JVM compiles no method of over 8,000 bytes
    explained = spark._jvm.PythonSQLUtils.explainString(invoices(spark, SF)._jdf.queryExecution(), "codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", explained)), default=0) < 8000


def test_totals_of_lines_in_a_row_need_no_grouping(spark):
    plan = text_queries.totals_concepts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" not in plan and "Generate " not in plan
    texts = ["Subtotal 1.000,00 €\nDescuento 10 % 100,00 €\nBase imponible neta 900,00\nIVA 21% 168,00 €\nTotal a pagar\n984,60 €", "IVA (EXENTO) 0,00 €\nIVA: 4 % (a) (isp) 1,00\nTotal 121,00", "IVA () 1,00\nTotal % 5,00", "", "nada"]
    docs = spark.createDataFrame([(k, list(zip(t.split("\n"), [*t.split("\n")[1:], None]))) for k, t in enumerate(texts)] + [(9, [(None, None)])], "doc_id long, lines array<struct<text:string,next:string>>")
    apart = docs.select("doc_id", F.posexplode("lines").alias("line", "x")).select("doc_id", "line", "x.text", "x.next")
    assert sorted(map(str, extract.totals_in(docs).collect())) == sorted(map(str, extract.totals(apart).collect()))


def test_bound_values_are_not_copied(spark):
    frame = spark.range(3).select(let(F.col("id") + 1, lambda x: x * x).alias("v"), let(F.lit(None).cast("int"), lambda x: F.coalesce(x, F.lit(7))).alias("n"))
    assert "transform(" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in frame.orderBy("v").collect()] == [(1, 7), (4, 7), (9, 7)]


def test_what_follows_the_first_hit_is_not_tested(spark):
    test = lambda x: F.when(x >= 3, F.raise_error(F.lit("tested")).cast("boolean")).otherwise(x == 2)
    frame = spark.createDataFrame([([1, 2, 3],), ([0, 1],), ([],), ([None, 2],)], "a array<int>")
    assert [r[0] for r in frame.select(lines.first_such(F.col("a"), test, "int")).collect()] == [2, None, None, 2]


def test_lines_are_normalised_as_by_norm(spark):
    signs = [chr(c) for c in (*range(1, 0x250), *range(0x300, 0x370), *range(0x1680, 0x1682), *range(0x2000, 0x2070), 0x3000)]
    texts = [f"A{s}b {s}  C{s}" for s in signs if s not in "\n\r"] + ["́ x", "ΟΔΟΣ ΑΣ  ", "IVA2 1%  640 ,80"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines.first_of(lines.text_lines(F.col("t"))).alias("l"))
    assert frame.filter(F.col("l.plain") != norm(F.col("l.text"))).count() == 0
    plain = norm(F.translate("t", "\t\v\f", "   "))
    assert frame.filter(plain != F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.translate("t", MARKED, BARE), r"\p{Mn}", "")), r"(?U)\s+", " "))).count() == 0


def test_one_search_finds_whether_any_identifier_is_valid(spark):
    made = [complete_tax_id(F.lit(n), F.lit(c)) for n in (7, 1234567) for c in ("ES", "UK", "US", "DE")]
    rows = spark.range(1).select(F.explode(F.array(*made, *[F.lower(m) for m in made])).alias("i")).select(F.explode(F.array("i", F.concat(F.lit("x "), "i", F.lit(".")), F.concat(F.lit("É"), "i"), F.concat("i", F.lit("1")), F.concat(F.lit("12-"), "i"), F.substring("i", 3, 20), F.translate("i", "4", "5"))).alias("t"))
    more = spark.createDataFrame([("00-1234567",), ("112-1234567-8",), ("12345678Z X1234567L",), ("Ñ12-3456789",), ("",)], "t string")
    texts = rows.union(more)
    differ = [f"h.{c} <> {c.lower()}" for c in ("ES", "UK", "US", "DE")]
    read = texts.select("t", holds_valid_ids(F.col("t")).alias("h"), *[(F.size(valid_ids_in(F.col("t"), F.lit(c))) > 0).alias(c.lower()) for c in ("ES", "UK", "US", "DE")])
    assert read.count() == 16 * 7 + 5 and read.filter(" OR ".join(differ)).collect() == []
    assert read.filter("h.ES").count() and read.filter("h.UK").count() and read.filter("h.US").count() and read.filter("h.DE").count()


def test_lines_that_carry_a_concept_are_those_that_give_one(spark):
    texts = ["subtotal 10,00", "iva 21% 2,10", "iva 21%", "total", "total (iva 3,00)", "retencion (iva 5,00)", "irpf 15 % (a) : 3,00 €", "xiva 2,00", "total 2,000", "total 5,00%", "recargo equiv. 5,2% 1,00", "base imponible", "r. e. 5,2% 3,00", "nada 1,00", None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", carries_concept(F.col("t")).alias("c"), (F.size(concepts(F.col("t"), F.lit(None).cast("string"))) > 0).alias("e")).collect()
    assert [r["c"] for r in rows] == [bool(r["e"]) for r in rows] and sum(r["c"] for r in rows) >= 6


def test_mentions_are_read_only_where_a_stem_stands(spark):
    said = ["exenta", "exento", "exención", "no sujeta", "no sujeto", "Inversión del sujeto pasivo", "art. 20 LIVA", "art 84", "zero-rated", "zero rated", "exempt", "Steuerfrei", "reverse charge", "Steuerschuldnerschaft", "IVA incluido", "impuestos incluidos", "IVA inc.", "prices include VAT", "incl. VAT", "inkl. MwSt", "Factura simplificada", "simplified invoice", "Rectifica la factura A-1 de 01/02/2025", "credit note", "Gutschrift", "artículo", "nada"]
    frame = spark.createDataFrame([(s, [s, "Total 1,00"]) for s in said], "s string, l array<string>")
    pairs = F.transform("l", lambda x: F.struct(x.alias("text"), norm(x).alias("plain")))
    rows = frame.select("s", classify.mentions(F.col("l")).alias("a"), classify.mentions_in(pairs, norm(F.array_join("l", " "))).alias("b")).collect()
    assert [r["s"] for r in rows if r["a"] != r["b"]] == []
    assert [r["s"] for r in rows if not any(r["a"])] == ["artículo", "nada"]
