"""The audit: one sound invoice, each test breaks one thing and names the whole ordered list of codes."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.classify import mark_illegible, verdict
from ledgerlens.operators.rules import MESSAGES, audit
from ledgerlens.operators.schema import from_json_text, violations

SOUND = {
    "pais": "ES", "tipo_documento": "factura", "numero": "F/2025/0001", "fecha_emision": "2025-01-15", "fecha_vencimiento": "2025-02-14",
    "emisor": {"nombre": "Acme SL", "nif": "B12345674"}, "receptor": {"nombre": "Beta SA", "nif": "A87654323"},
    "lineas": [{"descripcion": "Servicio", "cantidad": 2, "precio_unitario": 450.0, "importe": 900.0}],
    "base_imponible": 900.0, "iva": [{"porcentaje": 21, "base_imponible": 900.0, "cuota": 189.0}], "total": 1089.0,
}
LINE = SOUND["lineas"][0]
TAX = SOUND["iva"][0]
CASES = {
    "sound": ({}, []),
    "country": ({"pais": "FR"}, ["PAIS_NO_SOPORTADO"]),
    "lower_case_country": ({"pais": "es"}, []),
    "declared_class": ({"tipo_documento": "Albaran", "numero": None}, ["DOC_NO_ES_FACTURA"]),
    "class_in_title": ({"titulo": "DELIVERY NOTE 7", "emisor": {"nombre": "", "nif": "B1"}}, ["DOC_NO_ES_FACTURA", "EMISOR_ID_INVALIDO", "EMISOR_SIN_NOMBRE"]),
    "no_number": ({"numero": " "}, ["SIN_NUMERO"]),
    "wordy_number": ({"numero": "ABC"}, ["NUMERO_SIN_CIFRAS"]),
    "no_date": ({"fecha_emision": "15/01/2025"}, ["SIN_FECHA_EMISION"]),
    "future": ({"fecha_emision": "2026-01-15", "fecha_vencimiento": None}, ["EMISION_FUTURA"]),
    "due_first": ({"fecha_vencimiento": "2025-01-14"}, ["VENCIMIENTO_ANTERIOR"]),
    "no_issuer": ({"emisor": None}, ["EMISOR_AUSENTE"]),
    "no_recipient": ({"receptor": None}, []),
    "issuer_without_id": ({"emisor": {"nombre": "Acme", "nif": None}}, ["EMISOR_SIN_ID"]),
    "simplified": ({"receptor": {"nombre": None, "nif": None}, "simplificada": True}, []),
    "foreign_recipient": ({"receptor": {"nombre": "Gamma", "nif": "FR83999123456"}}, ["RECEPTOR_ID_EXTRANJERO"]),
    "bad_check_digit": ({"receptor": {"nombre": "Gamma", "nif": "A87654320"}}, ["RECEPTOR_ID_INVALIDO"]),
    "self_invoice": ({"receptor": {"nombre": "Acme", "nif": "b12345674"}}, ["EMISOR_IGUAL_RECEPTOR"]),
    "rectifying": ({"rectificativa": True}, ["RECTIFICATIVA_SIN_REFERENCIA"]),
    "no_lines": ({"lineas": []}, ["SIN_LINEAS"]),
    "lines_of_another_type": ({"lineas": 5}, ["SIN_LINEAS"]),
    "malformed_line": ({"lineas": [LINE, 7]}, ["LINEA_MALFORMADA"]),
    "line_without_amount": ({"lineas": [LINE, {"descripcion": "x"}]}, ["LINEA_SIN_IMPORTE"]),
    "line_without_words": ({"lineas": [{**LINE, "descripcion": " "}]}, ["LINEA_SIN_DESCRIPCION"]),
    "zero_quantity": ({"lineas": [{**LINE, "cantidad": 0}]}, ["LINEA_CANTIDAD_INVALIDA", "LINEA_NO_CUADRA"]),
    "negative_price": ({"lineas": [{**LINE, "cantidad": -2, "precio_unitario": -450}]}, ["LINEA_CANTIDAD_INVALIDA", "LINEA_PRECIO_NEGATIVO"]),
    "two_cents_off": ({"lineas": [{**LINE, "precio_unitario": 450.01}]}, []),
    "three_cents_off": ({"lineas": [{**LINE, "precio_unitario": 450.015}]}, ["LINEA_NO_CUADRA"]),
    "no_base": ({"base_imponible": None}, ["SIN_BASE"]),
    "false_base": ({"base_imponible": 800, "iva": [{**TAX, "base_imponible": 800, "cuota": 168}], "total": 968}, ["BASE_NO_CUADRA"]),
    "tax_included": ({"precios_con_iva": True, "lineas": [{**LINE, "precio_unitario": 544.5, "importe": 1089}]}, []),
    "discount": ({"base_bruta": 900, "descuento": {"porcentaje": 10, "importe": 80}, "base_imponible": 820, "iva": [{**TAX, "base_imponible": 820, "cuota": 172.2}], "total": 992.2}, ["DESCUENTO_NO_CUADRA"]),
    "net_base": ({"base_bruta": 900, "descuento": {"porcentaje": 10, "importe": 90}, "base_imponible": 800, "iva": [{**TAX, "base_imponible": 800, "cuota": 168}], "total": 968}, ["BASE_NETA_NO_CUADRA"]),
    "no_breakdown": ({"iva": [], "total": 900}, ["SIN_DESGLOSE_IMPUESTO"]),
    "unknown_rate": ({"iva": [{**TAX, "porcentaje": 20, "cuota": 180}], "total": 1080}, ["TIPO_IMPUESTO_INEXISTENTE"]),
    "wrong_quota": ({"iva": [{**TAX, "cuota": 190}], "total": 1090}, ["CUOTA_NO_CUADRA"]),
    "tranches": ({"iva": [{"porcentaje": 21, "base_imponible": 500, "cuota": 105}, {"porcentaje": 10, "base_imponible": 300, "cuota": 30}], "total": 1035}, ["TRAMOS_NO_SUMAN_BASE"]),
    "deduced_bases": ({"iva": [{"porcentaje": 21, "base_imponible": 500.02, "cuota": 105, "base_deducida": True}, {"porcentaje": 4, "base_imponible": 400.1, "cuota": 16, "base_deducida": True}], "total": 1021}, []),
    "exempt_and_taxed": ({"exencion": "exento art. 20"}, ["IVA_EN_EXENTA"]),
    "silent_exemption": ({"iva": [{"porcentaje": 0, "base_imponible": 900, "cuota": 0}], "total": 900}, ["EXENCION_SIN_MENCION"]),
    "withholding": ({"retencion": {"porcentaje": 15, "base_imponible": 900, "cuota": 130}, "total": 959}, ["RETENCION_NO_CUADRA"]),
    "surcharge": ({"recargo": [{"porcentaje": 5.0, "base_imponible": 900, "cuota": 40}], "total": 1129}, ["RECARGO_TIPO_INEXISTENTE", "RECARGO_NO_CUADRA"]),
    "disbursements": ({"suplidos": 10, "total": 1099}, []),
    "no_total": ({"total": None}, ["SIN_TOTAL"]),
    "wrong_total": ({"total": 1100}, ["TOTAL_NO_CUADRA"]),
    "negative_total": ({"total": -1089}, ["TOTAL_NEGATIVO", "TOTAL_NO_CUADRA"]),
    "uk_withholding": (
        {"pais": "UK", "emisor": {"nombre": "A", "nif": "GB123456782"}, "receptor": None, "iva": [{**TAX, "porcentaje": 20, "cuota": 180}], "retencion": {"porcentaje": 15, "base_imponible": 900, "cuota": 135}, "total": 945},
        ["RETENCION_NO_APLICABLE"],
    ),
}


@pytest.fixture(scope="module")
def audited(spark):
    rows = [(name, json.dumps({**SOUND, **change})) for name, (change, _) in CASES.items()]
    rows += [("garbage", "not json"), ("null", None), ("array", "[1]"), ("types", json.dumps({"iva": "x", "lineas": {"a": 1}, "total": [], "emisor": 3, "base_imponible": "abc"}))]
    frame = audit(from_json_text(spark.createDataFrame(rows, "doc_id string, value string")), "2025-06-01")
    return {r["doc_id"]: r for r in frame.withColumn("estado", verdict()).collect()}


@pytest.mark.parametrize("name", CASES)
def test_codes_in_order(audited, name):
    assert [f["code"] for f in audited[name]["findings"]] == CASES[name][1]


def test_garbage_never_raises(audited):
    for name in ("garbage", "null", "array", "types"):
        codes = [f["code"] for f in audited[name]["findings"]]
        assert codes[:2] == ["SIN_NUMERO", "SIN_FECHA_EMISION"] and "SIN_LINEAS" in codes and "SIN_TOTAL" in codes


def test_verdicts_and_counts(audited):
    assert audited["sound"]["estado"] == "conforme" and audited["sound"]["valid"]
    assert audited["wordy_number"]["estado"] == "con_avisos" and audited["wordy_number"]["valid"]
    assert audited["no_total"]["estado"] == "no_conforme" and audited["zero_quantity"]["n_errors"] == 2
    assert all(f["code"] in MESSAGES for r in audited.values() for f in r["findings"])


def test_illegible_comes_first(spark):
    record = from_json_text(spark.createDataFrame([("a", json.dumps({**SOUND, "total": None, "base_imponible": None}))], "doc_id string, value string"))
    row = mark_illegible(audit(record, "2025-06-01").withColumn("origen", F.lit("texto"))).withColumn("estado", verdict()).first()
    assert row["findings"][0]["code"] == "NO_LEGIBLE" and row["estado"] == "no_legible"


def test_strict_constraints(spark):
    rows = [("ok", json.dumps(SOUND)), ("bad", json.dumps({**SOUND, "total": 5, "lineas": [], "pais": "FR"}))]
    got = {r["doc_id"]: r["violations"] for r in violations(from_json_text(spark.createDataFrame(rows, "doc_id string, value string"))).collect()}
    assert got["ok"] == [] and set(got["bad"]) == {"has_lines", "base_sum", "total_sum", "country"}
