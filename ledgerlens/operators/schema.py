"""The invoice record: its types, a permissive reader and strict constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.money import cents, near
from ledgerlens.functions.refdata import CODES

MONEY, PERCENT, QUANTITY = "decimal(18,2)", "decimal(9,4)", "decimal(18,4)"
PARTY = "struct<nombre:string,nif:string,direccion:struct<calle:string,ciudad:string,provincia:string,codigo_postal:string,pais:string>>"
LINE = f"struct<descripcion:string,cantidad:{QUANTITY},precio_unitario:{QUANTITY},importe:{MONEY}>"
TRANCHE = f"struct<porcentaje:{PERCENT},base_imponible:{MONEY},cuota:{MONEY},motivo:string,base_deducida:boolean>"
WITHHOLDING = f"struct<porcentaje:{PERCENT},base_imponible:{MONEY},cuota:{MONEY}>"
DISCOUNT = f"struct<porcentaje:{PERCENT},importe:{MONEY}>"
#: Fields of an invoice. A null element of `lineas`, `iva` or `recargo` is one that was no structure.
FIELDS = {
    "doc_id": "string", "pais": "string", "tipo_documento": "string", "titulo": "string", "observaciones": "string", "numero": "string",
    "fecha_emision": "string", "fecha_vencimiento": "string", "emisor": PARTY, "receptor": PARTY, "lineas": f"array<{LINE}>",
    "base_bruta": MONEY, "descuento": DISCOUNT, "base_imponible": MONEY, "iva": f"array<{TRANCHE}>", "recargo": f"array<{TRANCHE}>",
    "retencion": WITHHOLDING, "suplidos": MONEY, "total": MONEY, "exencion": "string", "precios_con_iva": "boolean",
    "simplificada": "boolean", "rectificativa": "boolean", "rectifica_a": "string",
}


def conform(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All fields of the record in order; those the input lacks are null, and what it has besides is dropped but for `keep`."""
    have = set(df.columns)
    return df.select(*[(F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)).alias(name) for name, kind in FIELDS.items()], *keep)


def _scalar(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, "string").try_cast(kind)


def _flag(value: Column, path: str) -> Column:
    text = F.lower(F.try_variant_get(value, path, "string"))
    return text.isNotNull() & ~text.isin("false", "0", "")


def _object(value: Column, kind: str) -> Column:
    """A variant as a structure, null if it is no object; fields of another type become null."""
    names = [part.split(":", 1) for part in _fields_of(kind)]
    made = F.struct(*[(_object(F.try_variant_get(value, f"$.{n}", "variant"), k) if k.startswith("struct<") else _flag(value, f"$.{n}") if k == "boolean" else _scalar(value, f"$.{n}", k)).alias(n) for n, k in names])
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), made)


def _as(kind: str):
    return lambda value: _object(value, kind)


def _fields_of(kind: str) -> list[str]:
    body, depth, parts, start = kind[len("struct<") : -1], 0, [], 0
    for at, sign in enumerate(body):
        depth += (sign in "<(") - (sign in ">)")
        if sign == "," and not depth:
            parts.append(body[start:at])
            start = at + 1
    return [*parts, body[start:]]


def from_json_text(df: DataFrame, json_col: str = "value", id_col: str = "doc_id") -> DataFrame:
    """Records from JSON text. Nothing raises: text that is no JSON object, and values of another type than declared,
    become nulls; an element of a list that is no object becomes a null element, a list that is none becomes null."""
    parsed = df.select(F.col(id_col).cast("string").alias("doc_id"), F.try_parse_json(json_col).alias("v"))
    v = F.col("v")
    columns = []
    for name, kind in FIELDS.items():
        if name == "doc_id":
            columns.append(F.col("doc_id"))
        elif kind.startswith("array<"):
            columns.append(F.transform(F.try_variant_get(v, f"$.{name}", "array<variant>"), _as(kind[6:-1])).alias(name))
        elif kind.startswith("struct<"):
            columns.append(_object(F.try_variant_get(v, f"$.{name}", "variant"), kind).alias(name))
        elif kind == "boolean":
            columns.append(_flag(v, f"$.{name}").alias(name))
        else:
            columns.append(_scalar(v, f"$.{name}", kind).alias(name))
    return conform(parsed.select(*columns))


def violations(df: DataFrame) -> DataFrame:
    """doc_id and the names of the strict constraints a record violates, for building clean datasets."""
    line_sum = F.aggregate("lineas", F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(cents(x["importe"]), F.lit(0)))
    tax_sum = F.aggregate("iva", F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(cents(x["cuota"]), F.lit(0)))
    positive = lambda x: (x["cantidad"] > 0) & (x["precio_unitario"] > 0) & (x["importe"] > 0)
    exact = lambda x: near(cents(x["importe"]), F.round(x["cantidad"] * x["precio_unitario"] * 100).cast("long"))
    percent = lambda x: x["porcentaje"].between(0, 100)
    checks = {
        "line_values": F.forall("lineas", positive),
        "line_amount": F.forall("lineas", exact),
        "has_lines": F.size("lineas") > 0,
        "has_tranches": F.size("iva") > 0,
        "percent_range": F.forall("iva", percent) & F.coalesce(percent(F.col("retencion")), F.lit(True)),
        "base_sum": near(cents(F.col("base_imponible")), line_sum),
        "total_sum": near(cents(F.col("total")), cents(F.col("base_imponible")) + tax_sum - F.coalesce(cents(F.col("retencion.cuota")), F.lit(0))),
        "recipient": F.col("receptor").isNotNull() | F.coalesce(F.col("simplificada"), F.lit(False)),
        "country": F.upper("pais").isin(*CODES),
        "postal_code": F.coalesce(F.length("emisor.direccion.codigo_postal").between(2, 12), F.lit(True)) & F.coalesce(F.length("receptor.direccion.codigo_postal").between(2, 12), F.lit(True)),
        "sign": (F.col("base_imponible") >= 0) & (F.col("total") >= 0),
    }
    return df.select("doc_id", F.array_compact(F.array(*[F.when(~F.coalesce(check, F.lit(False)), F.lit(name)) for name, check in checks.items()])).alias("violations"))
