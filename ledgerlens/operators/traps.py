"""Families of defective invoices, made from sound ones, and the loop that asks whether each is caught for its own reason."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "ninguna"


def _first_of(array: str, field: str, value: Callable[[Column], Column]) -> Column:
    """The array with a field of its first element changed."""
    return F.transform(array, lambda x, i: F.when(i == 0, x.withField(field, value(x[field]))).otherwise(x))


def _plus(amount: int) -> Callable[[Column], Column]:
    return lambda x: (x + amount).cast("decimal(18,2)")


#: family: the code that has to catch it, and what it changes, as columns of an invoice record and a date to judge by.
FAMILIES: dict[str, tuple[str, Callable[[Column], dict[str, Column]]]] = {
    "albaran_no_factura": ("DOC_NO_ES_FACTURA", lambda as_of: {"titulo": F.lit("Albarán de entrega")}),
    "factura_sin_cif": ("EMISOR_SIN_ID", lambda as_of: {"emisor": F.col("emisor").withField("nif", F.lit(None).cast("string"))}),
    "factura_sin_numero": ("SIN_NUMERO", lambda as_of: {"numero": F.lit(None).cast("string")}),
    "factura_emitida_futuro": ("EMISION_FUTURA", lambda as_of: {"fecha_emision": F.date_add(as_of, 30).cast("string"), "fecha_vencimiento": F.date_add(as_of, 60).cast("string")}),
    "total_incorrecto": ("TOTAL_NO_CUADRA", lambda as_of: {"total": _plus(50)(F.col("total"))}),
    "base_no_suma": ("BASE_NO_CUADRA", lambda as_of: {"base_imponible": _plus(100)(F.col("base_imponible"))}),
    "factura_sin_iva": ("SIN_DESGLOSE_IMPUESTO", lambda as_of: {"iva": F.slice("iva", 1, 0), "total": F.col("base_imponible")}),
    "receptor_igual_emisor": ("EMISOR_IGUAL_RECEPTOR", lambda as_of: {"receptor": F.col("emisor")}),
    "linea_cantidad_cero": ("LINEA_CANTIDAD_INVALIDA", lambda as_of: {"lineas": _first_of("lineas", "cantidad", lambda x: F.lit(0).cast("decimal(18,4)"))}),
    "cuota_iva_no_cuadra": ("CUOTA_NO_CUADRA", lambda as_of: {"iva": _first_of("iva", "cuota", _plus(25))}),
}


def with_traps(invoices: DataFrame, family: Column, as_of: str) -> DataFrame:
    """invoices with the defect of the family that `family` names for each row, and where it came from: trap, trap_code
    (null for rows of no known family, which stay as they are). A projection; all families in one pass."""
    named = invoices.withColumn("trap", F.when(family.isin(*FAMILIES), family))
    day = F.to_date(F.lit(as_of))
    changed: dict[str, Column] = {}
    for name, (_, change) in FAMILIES.items():
        for column, value in change(day).items():
            changed[column] = F.when(F.col("trap") == name, value).otherwise(changed.get(column, F.col(column)))
    code = reduce(lambda rest, item: F.when(F.col("trap") == item[0], F.lit(item[1][0])).otherwise(rest), FAMILIES.items(), F.lit(None).cast("string"))
    return named.withColumns({**changed, "trap_code": code})


def recall_by_family(audited: DataFrame) -> DataFrame:
    """trap, code, documents, caught (by the family's own code), noisy (with findings of other codes too), recall. Sound rows
    are the family `ninguna`, whose recall is the share without any finding."""
    codes = F.transform("findings", lambda f: f["code"])
    sound = F.col("trap").isNull()
    own = F.when(sound, F.size("findings") == 0).otherwise(F.array_contains(codes, F.col("trap_code")))
    other = F.size(F.filter(codes, lambda c: ~c.eqNullSafe(F.col("trap_code")))) > 0
    told = audited.select(F.coalesce("trap", F.lit(NONE)).alias("trap"), F.col("trap_code").alias("code"), F.coalesce(own, F.lit(False)).alias("own"), other.alias("other"))
    return told.groupBy("trap", "code").agg(F.count("*").alias("documents"), F.count_if("own").alias("caught"), F.count_if("other").alias("noisy"), F.round(F.count_if("own") / F.count("*"), 4).alias("recall"))
