"""Layout, extraction, classification and scoring on small hand-made inputs."""

from pyspark.sql import functions as F

from ledgerlens.functions.refdata import TABLE_HEADERS
from ledgerlens.operators import classify, extract, layout, score
from ledgerlens.operators.lines import join_digits, text_lines

WORDS = "doc_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, conf double, rotated boolean"


def word(ord_, text, x0, y0, width=20.0, rotated=False, page=1):
    return (1, page, ord_, text, float(x0), float(y0), float(x0) + width, float(y0) + 10, 1.0, rotated)


def test_lines_are_anchored_at_their_first_word(spark):
    words = [word(i, f"w{i}", i * 30, y) for i, y in enumerate((0, 3, 6, 9))] + [word(9, "turned", 5, 3, rotated=True), word(10, "next", 0, 0, page=2)]
    rows = {r["ord"]: r["line"] for r in layout.visual_lines(spark.createDataFrame(words, WORDS)).collect()}
    assert [rows[i] for i in range(4)] == [0, 0, 1, 1] and rows[9] >= 1_000_000 and rows[10] == 0


def test_segments_split_at_more_than_nine_points(spark):
    words = spark.createDataFrame([word(0, "a", 0, 0), word(1, "b", 29, 0), word(2, "c", 58.5, 0)], WORDS).withColumn("line", F.lit(0))
    assert sorted(r["text"] for r in layout.segments(words).collect()) == ["a b", "c"]


def test_lines_of_a_long_page(spark):
    """A page of 60,000 words in lines of some 50, each slanting: numbers as a plain loop gives them."""
    heights = [20.0 * (k // 50) + 0.11 * (k % 50) for k in range(60_000)]
    words = spark.range(60_000, numPartitions=4).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("ord"), F.lit("w").alias("text"), (F.col("id") % 50 * 10.0).alias("x0"), (F.floor(F.col("id") / 50) * 20.0 + F.col("id") % 50 * 0.11).alias("y0"), F.lit(False).alias("rotated"))
    got = {r["ord"]: r["line"] for r in layout.visual_lines(words).select("ord", "line").toLocalIterator()}
    line, anchor = -1, None
    for ord_, height in enumerate(heights):
        if anchor is None or height - anchor > layout.LINE_DRIFT:
            line, anchor = line + 1, height
        assert got[ord_] == line
    assert len(got) == 60_000 and line == 2 * 60_000 // 50 - 1


def test_stitching_of_long_and_empty_lines(spark):
    """Blocks of the fold end at no figure: 1,000 words, of which each second one closes up with the one before."""
    kind = "array<struct<text:string,x0:double,x1:double,height:double>>"
    word = lambda k: F.struct(F.lit("1").alias("text"), (k * 10.0 - (k % 2) * 5.0).alias("x0"), (k * 10.0 - (k % 2) * 5.0 + 5.0).alias("x1"), F.lit(10.0).alias("height"))
    frame = spark.range(1).select(layout.stitched(F.transform(F.sequence(F.lit(0), F.lit(999)), word)).alias("w"), layout.stitched(F.array().cast(kind)).alias("none"))
    row = frame.first()
    assert row["none"] == []
    assert [(w["text"], w["x0"], w["x1"]) for w in row["w"]] == [("11", 20.0 * k, 20.0 * k + 10.0) for k in range(500)]


def test_stitching(spark):
    cells = [("1", 0.0, 5.0, 10.0), ("60,00", 5.5, 20.0, 10.0), ("€", 20.4, 25.0, 10.0), ("7", 27.0, 30.0, 10.0)]
    frame = spark.createDataFrame([(1, cells)], "i int, ws array<struct<text:string,x0:double,x1:double,height:double>>")
    assert [w["text"] for w in frame.select(layout.stitched(F.col("ws")).alias("w")).first()["w"]] == ["160,00", "€", "7"]


def test_overpainted_glyphs_go(spark):
    boxes = [(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 2.0, 2.0, 12.0, 12.0), (1, 1, 2, 11.0, 0.0, 21.0, 10.0), (2, 1, 3, 2.0, 2.0, 12.0, 12.0)]
    frame = spark.createDataFrame(boxes, "doc_id int, page int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["ord"] for r in layout.visible_glyphs(frame).collect()) == [1, 2, 3]


def test_table_header(spark):
    text = "Factura 7\nConcepto  Cantidad  Precio  Importe\nServicio  2  450,00  900,00"
    words = layout.plain_text_words(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = layout.table_header(words, TABLE_HEADERS).first()
    assert row["line"] == 1 and set(row["columns"]) == {"descripcion", "cantidad", "precio_unitario", "importe"}


def test_read_number(spark):
    texts = [": F-2024/7 del", "#2026/0038", "Fecha 3", "12/03/2024", "100,00", "A1", "ninguno"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", extract.read_number(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in rows] == ["F-2024/7", "2026/0038", None, None, None, None, None]


def test_detail_row(spark):
    frame = spark.createDataFrame([(0, "Servicio de montaje  2  450,00  900,00"), (1, "Tornillos   (10x24,00€)   240,00"), (2, "sin importe")], "i int, t string")
    rows = [r["d"] for r in frame.select("i", extract.detail_row(F.get(text_lines(F.col("t")), F.lit(0)), F.lit(100.0)).alias("d")).orderBy("i").collect()]
    assert [r and (r["descripcion"], float(r["cantidad"]), float(r["precio"]), float(r["importe"])) for r in rows] == [("Servicio de montaje", 2, 450, 900), ("Tornillos (10x24,00€", 10, 24, 240), None]


ID1, ID2, ID3 = "B99123408", "A58818501", "B83719260"


def read_invoice(spark, text, country=None):
    return extract.extract_text(spark.createDataFrame([(1, text)], "doc_id long, text string"), country=country).first()


def test_invoice_with_parties_by_tax_id(spark):
    text = f"""FACTURA   RC-26-0152
Fecha de factura: 03/02/2026
Vence en 30 días: Fecha de vencimiento 05/03/2026
Para: Hostal Ribera SL
      Avda. del Puerto 12
      NIF {ID2}
Concepto          Cantidad   Precio   Importe
Diseño de carta     2          450,00   900,00
Imprenta (10x24,00€)       240,00
Subtotal   1.140,00 €
Descuento 10 %   114,00 €
Base imponible neta   1.026,00 €
IVA 21%   215,46 €
Retención IRPF 15%   153,90 €
TOTAL FACTURA   1.087,56 €
Estudio Lumbre Gráfica SL | NIF {ID1} | tel. 910 000 000"""
    r = read_invoice(spark, text)
    assert (r["pais"], r["numero"], r["fecha_emision"], r["fecha_vencimiento"]) == ("ES", "RC-26-0152", "2026-02-03", "2026-03-05")
    assert (r["emisor"]["nombre"], r["emisor"]["nif"], r["receptor"]["nombre"], r["receptor"]["nif"]) == ("Estudio Lumbre Gráfica SL", ID1, "Hostal Ribera SL", ID2)
    assert [(float(x["cantidad"]), float(x["precio_unitario"]), float(x["importe"])) for x in r["lineas"]] == [(2, 450, 900), (10, 24, 240)]
    assert [float(r[c]) for c in ("base_bruta", "base_imponible", "total")] == [1140, 1026, 1087.56] and float(r["descuento"]["importe"]) == -114 and float(r["retencion"]["cuota"]) == 153.9
    assert r["campos"] == {"numero": 0.75, "fecha_emision": 0.95, "fecha_vencimiento": 0.95, "base_imponible": 0.95, "total": 0.95}


def test_invoice_with_parties_by_columns(spark):
    text = f"""Factura nº: 77/2026
FROM                          BILL TO
Aceros del Sur SA             Papelería Sol SL
Polígono Norte 4              Calle Sol 1
{ID3}
Descripción      Importe
Chapa            100,00
IVA 10%          10,00
Gracias. NIF cliente {ID2}"""
    r = read_invoice(spark, text, "ES")
    assert (r["emisor"]["nombre"], r["emisor"]["nif"], r["receptor"]["nombre"], r["receptor"]["nif"]) == ("Aceros del Sur SA", ID3, "Papelería Sol SL", ID2)
    assert (r["numero"], float(r["base_imponible"]), float(r["total"]), r["campos"]["base_imponible"], r["campos"]["total"]) == ("77/2026", 100, 110, 0.6, 0.5)


def test_issuer_above_its_identifier_and_block_end(spark):
    text = f"""Talleres Norte SL
Calle Mayor 3, 28001 Madrid
CIF: {ID1}
Facturar a:
Muebles Encina SL


                         Nota aparte
NIF {ID2}"""
    r = read_invoice(spark, text)
    # a line beside the column, 36 points below its last cell, ends the block, so the recipient has no identifier
    assert (r["emisor"]["nombre"], r["emisor"]["nif"], r["receptor"]["nombre"], r["receptor"]["nif"]) == ("Talleres Norte SL", ID1, "Muebles Encina SL", None)
    assert r["lineas"] == [] and r["total"] is None


def test_extraction_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "una nota"), (5, "x " * 3000)]
    got = {r["doc_id"]: r for r in extract.extract_text(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got) == ["1", "2", "3", "4", "5"] and all(r["numero"] is None and r["total"] is None and r["lineas"] == [] and r["confianza"] == 0 for r in got.values())
    assert extract.extract_text(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_give_the_same_invoice(spark):
    text = f"Factura nº: F-7\nFecha: 01/02/2026\nTalleres Norte SL\nNIF {ID1}\nBase imponible   100,00\nIVA 21%   21,00\nTotal   121,00"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    from_words = extract.extract_words(layout.plain_text_words(docs)).first()
    assert from_words == read_invoice(spark, text) and float(from_words["total"]) == 121


def test_join_digits(spark):
    cases = [("31/07/2 026", "31/07/2026"), ("IVA2 1%", "IVA21%"), ("640 ,80", "640,80"), ("1 60,00", "1 60,00"), (f"{ID1[:7]} {ID1[7:]}", ID1), ("B1234567 9", "B1234567 9"), (None, None)]
    rows = spark.createDataFrame(cases, "t string, e string").withColumn("got", join_digits(F.col("t"))).collect()
    assert [r["got"] for r in rows] == [r["e"] for r in rows]


def read_totals(spark, text):
    lines = text.split("\n")
    rows = [(1, i, t, lines[i + 1] if i + 1 < len(lines) else None) for i, t in enumerate(lines)]
    return extract.totals(spark.createDataFrame(rows, "doc_id long, line int, text string, next string")).first()


def test_totals(spark):
    r = read_totals(spark, "Subtotal 1.000,00 €\nDescuento 10 % 100,00 €\nBase imponible neta 900,00\nIVA 21% 168,00 €\nIVA 10% 10,00\nRetención IRPF 15% 135,00\nRecargo equivalencia 5,2% 41,60\nTotal 700,00\nel descuento sobre el total\nTotal a pagar\n984,60 €")
    assert (r["base"], r["base_bruta"], r["total"]) == (90000, 100000, 98460)
    assert [(float(t["porcentaje"]), t["cuota"], t["base"], t["base_deducida"]) for t in r["iva"]] == [(21, 16800, 80000, True), (10, 1000, 10000, True)]
    assert (r["retencion"]["cuota"], r["recargo"][0]["cuota"], r["descuento"]["importe"]) == (13500, 4160, -10000)
    r = read_totals(spark, "IVA (EXENTO) 0,00 €\nTotal 121,00")
    assert (r["iva"][0]["motivo"], float(r["iva"][0]["porcentaje"]), r["base"]) == ("exento", 0, 12100)


def test_confidence(spark):
    sure = {"numero": F.lit(0.95), "fecha_emision": F.lit(0.8), "total": F.lit(0.95), "base_imponible": F.lit(None), "fecha_vencimiento": F.lit(None)}
    assert spark.range(1).select(extract.document_confidence(sure, F.lit(True), F.lit(False))).first()[0] == round((1.9 + 1.6 + 2.85 + 2) / 13.5, 3)


def test_document_type_and_country(spark):
    texts = ["Recibo domiciliado\nFACTURA 7", "pedidos@x.es Albarán", "nada", "Rechnung mwst", "Invoice VAT £1.00", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", classify.document_type(F.col("t"))["kind"].alias("k"), classify.detect_country(F.col("t")).alias("c")).orderBy("i").collect()
    assert [(r["k"], r["c"]) for r in rows] == [("factura", "ES"), ("albaran", "ES"), ("factura", "ES"), ("factura", "DE"), ("factura", "UK"), ("factura", "ES")]


def test_origin_and_confidence(spark):
    pages = spark.createDataFrame([(1, "vacio"), (1, "texto"), (2, "texto"), (2, "ocr"), (3, "vacio")], "doc_id int, origin string")
    assert {r["doc_id"]: r["origen"] for r in classify.origin(pages).collect()} == {1: "texto", 2: "mixto", 3: "vacio"}
    words = spark.createDataFrame([(1, "a", 0.5), (1, " ", 0.1), (1, "b", 0.75), (2, "", 0.3)], "doc_id int, text string, conf double")
    assert {r["doc_id"]: r["confianza_media"] for r in classify.mean_confidence(words).collect()} == {1: 0.625, 2: 0.0}


def test_field_equality(spark):
    cases = [("total", "10.00", "10.02", True), ("total", "10.00", "10.03", False), ("total", "10", "x", False), ("fecha_emision", "2024-01-01", "2024-01-01T10:00", True), ("emisor.nif", "b-123 4", "B1234", True), ("numero", " A  b", "a B", True), ("numero", None, None, True), ("numero", "x", None, False)]
    frame = spark.createDataFrame(cases, "f string, e string, o string, expected boolean")
    rows = frame.withColumn("got", score.fields_equal(F.col("f"), F.col("e"), F.col("o"))).collect()
    assert [r["got"] for r in rows] == [r["expected"] for r in rows]


def test_rotated_labels(spark):
    up = [(1, 1, k, c, 10.0 + 0.2 * k, 100.0 - 8 * k, 18.0, 106.0 - 8 * k, True) for k, c in enumerate("AB")]
    more = [(1, 1, 5, "C", 20.0, 100.0, 28.0, 106.0, True), (1, 1, 6, "x", 60.0, 10.0, 68.0, 16.0, False), (1, 1, 7, "y", 60.0, 18.0, 68.0, 24.0, False)]
    rows = layout.rotated_labels(spark.createDataFrame(up + more, "doc_id int, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, upwards boolean")).collect()
    assert sorted(r["text"] for r in rows) == ["AB C", "xy"]


def test_worst_status_and_folios(spark):
    from ledgerlens.operators.batch import folios

    frame = spark.createDataFrame([("ok",), ("fallo",), ("aviso",)], "estado string")
    assert score.worst_status(frame).first()[0] == "fallo" and score.worst_status(frame.filter("estado <> 'fallo'")).first()[0] == "aviso" and score.worst_status(frame.limit(0)).first()[0] == "ok"
    rows = folios(spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 500).alias("k")), "k").collect()
    assert sorted((r["k"], r["folio"]) for r in rows) == [(k, k + 1) for k in range(500)]


def test_ocr_lines_and_stream_helpers(spark):
    frame = spark.createDataFrame([word(0, "a", 0, 0), word(1, "b", 30, 7), word(2, "c", 0, 17)], WORDS)
    assert {r["ord"]: r["line"] for r in layout.ocr_lines(frame).collect()} == {0: 0, 1: 0, 2: 1}
