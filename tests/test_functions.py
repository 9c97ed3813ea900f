"""Column functions against vectors worked out by hand, and round trips over many values."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import dates, money, taxid, text


def one(spark, values, kind, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", column.alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_parse_amount(spark):
    vectors = {
        "1.234,56": 1234.56, "1,234.56": 1234.56, "1234,5": 1234.5, "1.234": 1234, "0.123": 123, "12.5": 12.5, "(100,00)": -100, "−3,20 €": -3.2,
        "£ 1,000": 1000, "1,23,45": None, "1-2": None, "": None, "abc": None, "12": 12, "-7": -7, None: None,
    }
    got = one(spark, list(vectors), "string", money.parse_amount(F.col("x")))
    assert [None if g is None else float(g) for g in got] == [None if v is None else float(v) for v in vectors.values()]


@pytest.mark.parametrize("country", ["ES", "UK", "US", "DE"])
def test_amounts_and_dates_come_back(spark, country):
    rng = random.Random(7)
    cents = [rng.randrange(0, 10**9) for _ in range(500)]
    written = text.format_amount((F.col("x") / 100).cast("decimal(18,2)"), F.lit(country))
    assert one(spark, cents, "long", money.cents(money.parse_amount(written))) == cents
    days = [dt.date(1990, 1, 1) + dt.timedelta(rng.randrange(20000)) for _ in range(500)]
    assert one(spark, days, "date", dates.parse_date(dates.format_date(F.col("x"), F.lit(country)), F.lit(country))) == days


def test_parse_date_forms(spark):
    vectors = {
        "Madrid, 3/2/2024.": dt.date(2024, 2, 3), "2024-12-31": dt.date(2024, 12, 31), "31 de abril de 2024": None, "5 de marzo de 2023": dt.date(2023, 3, 5),
        "01.02.69": dt.date(1969, 2, 1), "01.02.68": dt.date(2068, 2, 1), "7 May 2021": dt.date(2021, 5, 7), "nada": None, None: None,
    }
    assert one(spark, list(vectors), "string", dates.parse_date(F.col("x"), F.lit("DE"))) == list(vectors.values())
    assert one(spark, ["02/03/2024"], "string", dates.parse_date(F.col("x"), F.lit("US"))) == [dt.date(2024, 2, 3)]


def test_tax_ids(spark):
    cases = [
        ("12345678Z", "ES", True), ("X1234567L", "ES", True), ("B12345674", "ES", True), ("ES B-12.345.674", "ES", True), ("12345678A", "ES", False), ("B12345678", "ES", False), ("B99999999", "ES", False),
        ("DE136695976", "DE", True), ("DE136695970", "DE", False), ("12-3456789", "US", True), ("00-1234567", "US", False), ("GB123456789", "UK", False), ("", "ES", False), (None, "UK", False), ("12345678Z", "FR", False),
    ]
    rows = spark.createDataFrame(cases, "id string, country string, expected boolean").withColumn("got", taxid.is_valid_tax_id(F.col("id"), F.col("country"))).collect()
    assert [(r["id"], r["got"]) for r in rows] == [(r["id"], r["expected"]) for r in rows]


@pytest.mark.parametrize("country", ["ES", "UK", "DE"])
def test_made_ids_hold_and_changed_ones_fail(spark, country):
    ids = spark.range(2000).select(taxid.complete_tax_id(F.col("id") * 7919 + 13, F.lit(country)).alias("x"))
    last = F.substr("x", F.length("x"), F.lit(1)).cast("int")
    changed = F.concat(F.substr("x", F.lit(1), F.length("x") - 1), ((last + 3) % 10).cast("string"))
    good, bad = ids.select(F.count_if(taxid.is_valid_tax_id(F.col("x"), F.lit(country))), F.count_if(taxid.is_valid_tax_id(changed, F.lit(country)))).first()
    assert (good, bad) == (2000, 0)


def test_ids_in_text(spark):
    got = one(spark, ["nif b12345674, FR83999123456 B12345678", ""], "string", taxid.ids_in(F.col("x"), F.lit("ES")))
    assert got == [["B12345674", "FR83999123456", "B12345678"], []]
    assert one(spark, ["B12345674 y B12345678 y B12345674"], "string", taxid.valid_ids_in(F.col("x"), F.lit("ES"))) == [["B12345674"]]


def test_text(spark):
    assert one(spark, ["  Ñandú \n ÉL ", None], "string", text.norm(F.col("x"))) == ["nandu el", None]
    assert one(spark, ["N . º 7", "n° 8"], "string", text.norm_label(F.col("x"))) == ["nº 7", "nº 8"]
    assert one(spark, ["Marta Olmedo — Abogada |"], "string", text.clean_name(F.col("x"))) == ["Marta Olmedo"]
    assert one(spark, ["Talleres Norte SL", "Calle Mayor 3", "Total 12,00"], "string", text.looks_like_name(F.col("x"), money.AMOUNT_CI)) == [True, False, False]


def test_tolerance_is_two_whole_cents(spark):
    a, b = F.col("x"), F.lit(3)
    assert one(spark, [5, 6, 1, 0], "long", money.near(a, b)) == [True, False, True, False]


def test_company_names(spark):
    from ledgerlens.functions.money import AMOUNT_CI
    from ledgerlens.functions.text import looks_like_name

    names = ["Acme 123456 SL", "Talleres Norte SL", "Estudio Lumbre Gráfica SL", "Moda SA", "Bar Kmart", "Artesanos", "Abc", "Grupo 1234 SA"]
    others = ["", "ab", "3M España", "Calle Mayor 3", "28001 Madrid", "Madrid 28001", "Sol, 12", "Nave km 4", "Polígono s/n", "info@acme.es", "www.acme.es", "Tel 912", "Ley 37", "según art 20", "Total general", "Factura simplificada",
              "deadbeefdeadbeef01", "Servicio 12,50 €", "una dos tres cuatro cinco seis siete ocho"]
    got = {r["t"]: r["name"] for r in spark.createDataFrame([(x,) for x in names + others], "t string").select("t", looks_like_name(F.col("t"), AMOUNT_CI).alias("name")).collect()}
    assert {t for t, name in got.items() if name} == set(names)
