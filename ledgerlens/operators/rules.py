"""The audit: an invoice record in, an ordered list of findings out.

Every rule is a predicate over one record. Blocks are evaluated in the order number, dates, parties, rectification,
lines, taxes; each is a column of its own so that no generated method grows too large. Money is compared in whole
cents, and "today" is the argument `as_of`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.money import cents, near, share_cents
from ledgerlens.functions.dates import iso_date
from ledgerlens.functions.refdata import CODES, COUNTRIES, NON_INVOICE_CUES, SURCHARGE_RATES, TAX_RATES
from ledgerlens.functions.taxid import clean_id, is_foreign_clean, is_valid_clean

ERROR, WARNING, INFO = "error", "aviso", "info"
FINDING = "struct<code:string,severity:string,field:string,expected:string,found:string>"

MESSAGES = {
    "PAIS_NO_SOPORTADO": "The country is not supported.",
    "DOC_NO_ES_FACTURA": "The document is not an invoice.",
    "SIN_NUMERO": "The invoice has no number.",
    "NUMERO_SIN_CIFRAS": "The invoice number has no digit.",
    "SIN_FECHA_EMISION": "The issue date is missing or no date.",
    "EMISION_FUTURA": "The issue date lies in the future.",
    "VENCIMIENTO_ANTERIOR": "The due date is before the issue date.",
    "EMISOR_AUSENTE": "The issuer is missing.",
    "EMISOR_SIN_ID": "The issuer has no tax id.",
    "RECEPTOR_SIN_ID": "The recipient has no tax id.",
    "RECEPTOR_ID_EXTRANJERO": "The recipient's tax id is foreign; only its form is checked.",
    "EMISOR_ID_INVALIDO": "The issuer's tax id fails its check digit.",
    "RECEPTOR_ID_INVALIDO": "The recipient's tax id fails its check digit.",
    "EMISOR_SIN_NOMBRE": "The issuer has no name.",
    "RECEPTOR_SIN_NOMBRE": "The recipient has no name.",
    "EMISOR_IGUAL_RECEPTOR": "Issuer and recipient have the same tax id.",
    "RECTIFICATIVA_SIN_REFERENCIA": "A rectifying invoice does not say which one it rectifies.",
    "TOTAL_NEGATIVO": "The total is negative and the invoice is not rectifying.",
    "SIN_LINEAS": "There are no lines.",
    "LINEA_MALFORMADA": "A line is no structure.",
    "LINEA_SIN_IMPORTE": "A line has no amount.",
    "LINEA_SIN_DESCRIPCION": "A line has no description.",
    "LINEA_CANTIDAD_INVALIDA": "A line's quantity is zero or negative.",
    "LINEA_PRECIO_NEGATIVO": "A line's unit price is negative.",
    "LINEA_NO_CUADRA": "Quantity times price is not a line's amount.",
    "SIN_BASE": "The taxable base is missing.",
    "BASE_NO_CUADRA": "The lines do not add up to the base.",
    "DESCUENTO_NO_CUADRA": "The discount does not follow from the gross base.",
    "BASE_NETA_NO_CUADRA": "The base is not gross less discount.",
    "SIN_DESGLOSE_IMPUESTO": "There is no tax breakdown.",
    "TIPO_IMPUESTO_INEXISTENTE": "A tax rate is not in force in the country.",
    "CUOTA_NO_CUADRA": "A tranche's tax does not follow from its base.",
    "TRAMOS_NO_SUMAN_BASE": "The tranches' bases do not add up to the base.",
    "IVA_EN_EXENTA": "The invoice claims an exemption and charges tax.",
    "EXENCION_SIN_MENCION": "No tax is charged and no reason is given.",
    "RETENCION_NO_APLICABLE": "Withholding is not used in the country.",
    "RETENCION_NO_CUADRA": "The withholding does not follow from its base.",
    "RECARGO_TIPO_INEXISTENTE": "A surcharge rate does not exist.",
    "RECARGO_NO_CUADRA": "A surcharge does not follow from its base.",
    "SIN_TOTAL": "The total is missing.",
    "TOTAL_NO_CUADRA": "The total does not follow from its parts.",
    "NO_LEGIBLE": "The document could not be read well enough.",
}


def finding(code: str | Column, severity: str, field: str | Column, expected: Column | None = None, found: Column | None = None) -> Column:
    text = lambda x: F.lit(None).cast("string") if x is None else x.cast("string")
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(code).alias("code"), F.lit(severity).alias("severity"), as_column(field).alias("field"), text(expected).alias("expected"), text(found).alias("found"))


def none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def listed(*items: Column) -> Column:
    """Findings in order, null where a rule holds: `audit` drops those once for all blocks, since dropping them here would take
    every rule out of generated code."""
    return F.array(*items).cast(f"array<{FINDING}>")


def cents_of(array: Column | str, field: str) -> Column:
    """The sum of an amount over an array in cents; amounts are added as they are, so only their sum is converted."""
    of = lambda x: F.coalesce(x[field].cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    return cents(F.aggregate(array, F.lit(0).cast("decimal(28,2)"), lambda acc, x: (acc + of(x)).cast("decimal(28,2)")))


def money(in_cents: Column) -> Column:
    return (in_cents / 100).cast("decimal(18,2)")


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def yes(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def non_invoice_class() -> Column:
    """The class a document declares or gives away in title, notes or number (as a substring); null for invoices."""
    declared = F.lower(F.coalesce(F.nullif(F.col("tipo_documento"), F.lit("")), F.lit("factura")))
    text = F.col("_text")
    by_text = [F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(cue)) for cue in cues]), F.lit(name)) for name, cues in NON_INVOICE_CUES.items()]
    return F.coalesce(F.when(declared.isin(*NON_INVOICE_CUES), declared), *by_text)


def near_for_sure(a: Column, b: Column) -> Column:
    """Whether two amounts in euros, as doubles, are surely `near` when rounded to cents: cents that are at most 2 apart may
    differ by 2.5 before rounding, and below 1e9 a double is off by far less. Null and false leave it open."""
    return (F.abs(a - b) <= 0.02) & (F.abs(a) < 1e9)


def number_rules() -> Column:
    number = F.trim("numero")
    return listed(
        F.when(blank(F.col("numero")), finding("SIN_NUMERO", ERROR, "numero")).when(~number.rlike(r"(?U)\d"), finding("NUMERO_SIN_CIFRAS", WARNING, "numero", found=number)),
    )


def date_rules(as_of: Column) -> Column:
    issued, due = F.col("_issued"), F.col("_due")
    return F.when(issued.isNull(), listed(finding("SIN_FECHA_EMISION", ERROR, "fecha_emision", found=F.col("fecha_emision")))).otherwise(
        listed(
            F.when(issued > as_of, finding("EMISION_FUTURA", WARNING, "fecha_emision", found=issued)),
            F.when(due < issued, finding("VENCIMIENTO_ANTERIOR", ERROR, "fecha_vencimiento", F.concat(F.lit(">= "), issued.cast("string")), due)),
        )
    )


def party_rules() -> Column:
    items = []
    for role in ("emisor", "receptor"):
        party, nif, prefix = F.col(role), F.trim(f"{role}.nif"), role.upper()
        there = party.isNotNull()
        if role == "emisor":
            items.append(F.when(~there, finding("EMISOR_AUSENTE", ERROR, role)))
        else:
            there = there & ~(yes("simplificada") & (F.coalesce(F.col("receptor.nif"), F.lit("")) == ""))
        foreign = is_foreign_clean(F.col("_receptor_id"), F.col("pais")) if role == "receptor" else F.lit(False)
        items.append(
            F.when(there & blank(nif), finding(f"{prefix}_SIN_ID", ERROR, f"{role}.nif"))
            .when(there & foreign, finding("RECEPTOR_ID_EXTRANJERO", INFO, "receptor.nif", found=nif))
            .when(there & ~is_valid_clean(F.col(f"_{role}_id"), F.col("pais")), finding(f"{prefix}_ID_INVALIDO", ERROR, f"{role}.nif", found=nif))
        )
        items.append(F.when(there & blank(F.col(f"{role}.nombre")), finding(f"{prefix}_SIN_NOMBRE", ERROR, f"{role}.nombre")))
    ours, theirs = F.upper(F.trim("emisor.nif")), F.upper(F.trim("receptor.nif"))
    items.append(F.when((ours != "") & (ours == theirs), finding("EMISOR_IGUAL_RECEPTOR", ERROR, "receptor.nif", found=ours)))
    return listed(*items)


def rectification_rules() -> Column:
    return listed(
        F.when(yes("rectificativa") & blank(F.col("rectifica_a")), finding("RECTIFICATIVA_SIN_REFERENCIA", WARNING, "rectifica_a")).when(
            ~yes("rectificativa") & (F.col("total") < 0), finding("TOTAL_NEGATIVO", ERROR, "total", found=F.col("total"))
        )
    )


def line_rules() -> Column:
    def of_line(x: Column, i: Column) -> Column:
        at = lambda part: F.concat(F.lit("lineas["), (i + 1).cast("string"), F.lit("]" + part))
        amount, product = cents(x["importe"]), F.round(x["cantidad"] * x["precio_unitario"] * 100).cast("long")
        checked = listed(
            F.when(blank(x["descripcion"]), finding("LINEA_SIN_DESCRIPCION", WARNING, at(".descripcion"))),
            F.when((x["cantidad"] == 0) | ((x["cantidad"] < 0) & ~yes("rectificativa")), finding("LINEA_CANTIDAD_INVALIDA", ERROR, at(".cantidad"), F.lit("> 0"), x["cantidad"])),
            F.when((x["precio_unitario"] < 0) & ~yes("rectificativa"), finding("LINEA_PRECIO_NEGATIVO", ERROR, at(".precio_unitario"), found=x["precio_unitario"])),
            F.when(~near(amount, product), finding("LINEA_NO_CUADRA", ERROR, at(".importe"), money(product), x["importe"])),
        )
        number = lambda field: x[field].cast("double")
        sound = (number("cantidad") > 0) & (number("precio_unitario") >= 0) & near_for_sure(number("importe"), number("cantidad") * number("precio_unitario")) & ~blank(x["descripcion"])
        return (
            F.when(sound, none())
            .when(x.isNull(), listed(finding("LINEA_MALFORMADA", ERROR, at(""))))
            .when(amount.isNull(), listed(finding("LINEA_SIN_IMPORTE", ERROR, at(".importe"))))
            .otherwise(checked)
        )

    return F.when(F.coalesce(F.size("lineas"), F.lit(0)) <= 0, listed(finding("SIN_LINEAS", ERROR, "lineas"))).otherwise(F.flatten(F.transform("lineas", of_line)))


def base_rules() -> Column:
    base, gross, total = F.col("_base_cents"), F.col("_gross_cents"), F.col("_total_cents")
    lines, discount = F.col("_lines"), F.col("_discount")
    has_discount, percent = F.col("descuento").isNotNull(), F.col("descuento.porcentaje")
    before = F.coalesce(gross, base + discount)
    off = lambda field, a: F.when(~near(a, lines), finding("BASE_NO_CUADRA", ERROR, field, money(lines), money(a)))
    due = share_cents(gross, percent)
    return listed(
        F.when(base.isNull(), finding("SIN_BASE", ERROR, "base_imponible")).when(
            lines != 0,
            F.when(yes("precios_con_iva") & total.isNotNull(), off("total", total)).when(has_discount, off("base_bruta", before)).otherwise(off("base_imponible", base)),
        ),
        F.when(has_discount & ~near(discount, due), finding("DESCUENTO_NO_CUADRA", ERROR, "descuento", money(due), money(discount))),
        F.when(has_discount & ~near(base, gross - discount), finding("BASE_NETA_NO_CUADRA", ERROR, "base_imponible", money(gross - discount), money(base))),
    )


def _in_rates(percent: Column) -> Column:
    known = [F.when(F.col("pais") == code, percent.isin(*[float(r) for r in rates])) for code, rates in TAX_RATES.items()]
    return F.coalesce(*known, F.lit(True))


def tax_rules() -> Column:
    base, tranches = F.col("_base_cents"), F.col("_tranches")
    rates = F.coalesce(*[F.when(F.col("pais") == code, F.lit(str([float(r) for r in rates]))) for code, rates in TAX_RATES.items()])

    def of_tranche(t: Column, i: Column) -> Column:
        at = lambda part: F.concat(F.lit("iva["), (i + 1).cast("string"), F.lit("]" + part))
        due = share_cents(cents(t["base_imponible"]), t["porcentaje"])
        number = lambda field: t[field].cast("double")
        sound = near_for_sure(number("cuota"), number("base_imponible") * number("porcentaje") / 100) & _in_rates(t["porcentaje"])
        checked = listed(
            F.when(~_in_rates(t["porcentaje"]), finding("TIPO_IMPUESTO_INEXISTENTE", ERROR, at(".porcentaje"), rates, t["porcentaje"])),
            F.when(~F.coalesce(t["base_deducida"], F.lit(False)) & ~near(cents(t["cuota"]), due), finding("CUOTA_NO_CUADRA", ERROR, at(".cuota"), money(due), t["cuota"])),
        )
        return F.when(sound, none()).otherwise(checked)

    bases = cents_of(tranches, "base_imponible")
    complete = F.forall(tranches, lambda t: t["base_imponible"].isNotNull())
    # the quota of a deduced base was rounded to a cent, so the base is known to half a cent over the rate
    slack = F.when(~F.exists(tranches, lambda t: F.coalesce(t["base_deducida"], F.lit(False))), 2.0).otherwise(F.aggregate(tranches, F.lit(2.0), lambda acc, t: acc + F.when(F.coalesce(t["base_deducida"], F.lit(False)) & (t["porcentaje"] != 0), 50.0 / t["porcentaje"].cast("double")).otherwise(0.0)))
    charged = F.filter(tranches, lambda t: (t["porcentaje"] > 0) & (F.abs(cents(t["cuota"])) > 2))
    charged_sum = F.aggregate(charged, F.lit(0).cast("long"), lambda acc, t: acc + cents(t["cuota"]))
    all_zero = F.forall(tranches, lambda t: F.coalesce(t["porcentaje"], F.lit(0)) == 0)
    mention = ~blank(F.col("exencion"))
    return F.when(F.coalesce(F.size(tranches), F.lit(0)) <= 0, listed(finding("SIN_DESGLOSE_IMPUESTO", ERROR, "iva"))).otherwise(
        F.concat(
            F.flatten(F.transform(tranches, of_tranche)),
            listed(
                F.when((F.size(tranches) > 1) & complete & (F.abs(bases - base) > slack), finding("TRAMOS_NO_SUMAN_BASE", ERROR, "iva", money(base), money(bases))),
                F.when(mention & (F.size(charged) > 0), finding("IVA_EN_EXENTA", ERROR, "iva", F.lit("0.00"), money(charged_sum))).when(
                    (F.col("pais") == "ES") & ~mention & (base != 0) & all_zero & (F.size(charged) == 0), finding("EXENCION_SIN_MENCION", WARNING, "iva")
                ),
            ),
        )
    )


def other_tax_rules() -> Column:
    held, held_base, percent = F.col("_held"), cents(F.col("retencion.base_imponible")), F.col("retencion.porcentaje")
    has = F.col("retencion").isNotNull()
    due = share_cents(held_base, percent)
    withholding = listed(
        F.when(has & ~F.col("pais").isin(*[c.code for c in COUNTRIES if c.withholds]), finding("RETENCION_NO_APLICABLE", WARNING, "retencion")),
        F.when(has & ~near(held, due), finding("RETENCION_NO_CUADRA", ERROR, "retencion.cuota", money(due), money(held))),
    )

    def of_surcharge(t: Column, i: Column) -> Column:
        at = lambda part: F.concat(F.lit("recargo["), (i + 1).cast("string"), F.lit("]" + part))
        quota, owed = F.coalesce(cents(t["cuota"]), F.lit(0)), share_cents(cents(t["base_imponible"]), t["porcentaje"])
        return listed(
            F.when((F.col("pais") == "ES") & ~t["porcentaje"].isin(*[float(r) for r in SURCHARGE_RATES]), finding("RECARGO_TIPO_INEXISTENTE", ERROR, at(".porcentaje"), F.lit(str([float(r) for r in SURCHARGE_RATES])), t["porcentaje"])),
            F.when(~F.coalesce(t["base_deducida"], F.lit(False)) & ~near(quota, owed), finding("RECARGO_NO_CUADRA", ERROR, at(".cuota"), money(owed), money(quota))),
        )

    surcharges = F.coalesce(F.flatten(F.transform("recargo", of_surcharge)), none())
    total = F.col("_total_cents")
    expected = F.col("_base_cents") + F.col("_taxes") + F.col("_surcharges") - held + F.coalesce(cents(F.col("suplidos")), F.lit(0))
    totals = listed(F.when(total.isNull(), finding("SIN_TOTAL", ERROR, "total")).when(~near(total, expected), finding("TOTAL_NO_CUADRA", ERROR, "total", money(expected), money(total))))
    return F.concat(withholding, surcharges, totals)


#: The codes of each block of rules.
BLOCK_CODES = {
    "_head": ("SIN_NUMERO", "NUMERO_SIN_CIFRAS", "SIN_FECHA_EMISION", "EMISION_FUTURA", "VENCIMIENTO_ANTERIOR"),
    "_parties": ("EMISOR_AUSENTE", "EMISOR_SIN_ID", "RECEPTOR_SIN_ID", "RECEPTOR_ID_EXTRANJERO", "EMISOR_ID_INVALIDO", "RECEPTOR_ID_INVALIDO", "EMISOR_SIN_NOMBRE", "RECEPTOR_SIN_NOMBRE", "EMISOR_IGUAL_RECEPTOR"),
    "_rectified": ("RECTIFICATIVA_SIN_REFERENCIA", "TOTAL_NEGATIVO"),
    "_body": ("SIN_LINEAS", "LINEA_MALFORMADA", "LINEA_SIN_IMPORTE", "LINEA_SIN_DESCRIPCION", "LINEA_CANTIDAD_INVALIDA", "LINEA_PRECIO_NEGATIVO", "LINEA_NO_CUADRA"),
    "_base": ("SIN_BASE", "BASE_NO_CUADRA", "DESCUENTO_NO_CUADRA", "BASE_NETA_NO_CUADRA"),
    "_tax": ("SIN_DESGLOSE_IMPUESTO", "TIPO_IMPUESTO_INEXISTENTE", "CUOTA_NO_CUADRA", "TRAMOS_NO_SUMAN_BASE", "IVA_EN_EXENTA", "EXENCION_SIN_MENCION"),
    "_rest": ("RETENCION_NO_APLICABLE", "RETENCION_NO_CUADRA", "RECARGO_TIPO_INEXISTENTE", "RECARGO_NO_CUADRA", "SIN_TOTAL", "TOTAL_NO_CUADRA"),
}


def audit(invoices: DataFrame, as_of: str | Column, country: str | None = None, codes: tuple[str, ...] | None = None) -> DataFrame:
    """The input with `pais` upper-cased (ES where missing) and findings array<struct<code, severity, field, expected, found>>,
    n_errors, n_warnings and valid. A recipient that is missing altogether yields no finding.

    With `codes`, findings and counts are of these codes only, and no block without one is evaluated."""
    day = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    code = F.lit(country) if country else F.coalesce(F.nullif(F.col("pais"), F.lit("")), F.lit("ES"))
    zero = F.lit(0).cast("long")
    total_of = lambda array, field: F.coalesce(cents_of(array, field), zero)
    helpers = {
        "_text": F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("titulo", "observaciones", "numero")])),
        "_base_cents": cents(F.col("base_imponible")),
        "_gross_cents": cents(F.col("base_bruta")),
        "_total_cents": cents(F.col("total")),
        "_tranches": F.filter("iva", lambda t: t.isNotNull()),
        "_lines": total_of("lineas", "importe"),
        "_taxes": total_of("iva", "cuota"),
        "_surcharges": total_of("recargo", "cuota"),
        "_held": F.coalesce(cents(F.col("retencion.cuota")), zero),
        "_discount": F.coalesce(F.abs(cents(F.col("descuento.importe"))), zero),
        "_issued": iso_date(F.col("fecha_emision")),
        "_due": iso_date(F.col("fecha_vencimiento")),
        "_emisor_id": clean_id(F.trim("emisor.nif")),
        "_receptor_id": clean_id(F.trim("receptor.nif")),
    }
    prepared = invoices.withColumn("pais", F.upper(code)).withColumns(helpers).withColumn("_class", non_invoice_class())
    blocks = {
        "_head": lambda: F.concat(number_rules(), date_rules(day)),
        "_parties": party_rules,
        "_rectified": rectification_rules,
        "_body": line_rules,
        "_base": base_rules,
        "_tax": tax_rules,
        "_rest": other_tax_rules,
    }
    wanted = {name: rules() for name, rules in blocks.items() if codes is None or set(codes) & set(BLOCK_CODES[name])}
    asked = lambda name, *items: [listed(*items)] if codes is None or name in codes else []
    joined = lambda parts: F.concat(*parts) if parts else none()
    unsupported = joined(asked("PAIS_NO_SOPORTADO", finding("PAIS_NO_SOPORTADO", ERROR, "pais", F.lit(str(sorted(CODES))), F.col("pais"))))
    other = asked("DOC_NO_ES_FACTURA", finding("DOC_NO_ES_FACTURA", ERROR, "tipo_documento", F.lit("factura"), F.col("_class")))
    other = joined([*other, *[F.col(name) for name in wanted if name == "_parties"]])
    chosen = F.when(~F.col("pais").isin(*CODES), unsupported).when(F.col("_class").isNotNull(), other).otherwise(joined([F.col(name) for name in wanted]))
    # asked for twice, so that Spark does not merge the rules into the filter, which has no generated code
    real = F.filter("_found", lambda f: f.isNotNull() if codes is None else f["code"].isin(*codes))
    found = prepared.withColumns(wanted).withColumn("_found", chosen).withColumn("findings", F.when(F.size("_found") > 0, real).otherwise(none()))
    return with_counts(found.drop(*helpers, "_class", *wanted, "_found"))


def with_counts(audited: DataFrame) -> DataFrame:
    count = lambda severity: F.size(F.filter("findings", lambda f: f["severity"] == severity))
    return audited.withColumns({"n_errors": count(ERROR), "n_warnings": count(WARNING)}).withColumn("valid", F.col("n_errors") == 0)


def exploded(audited: DataFrame) -> DataFrame:
    """doc_id, ord, code, severity, field, expected, found: one row per finding."""
    # an inner explode would have Spark infer a filter on the array and evaluate the whole audit a second time for it
    return audited.select("doc_id", F.posexplode_outer("findings").alias("ord", "f")).filter("ord is not null").select("doc_id", "ord", "f.*")
