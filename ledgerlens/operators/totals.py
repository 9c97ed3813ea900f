"""Totals of an invoice: concepts that carry an amount, and what they add up to. Columns only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import refdata as R
from ledgerlens.functions.binding import let
from ledgerlens.functions.money import AMOUNT_CI, cents, deduce_base, parse_amount

_CONCEPT = "array<struct<kind:string,pct:string,amount:string,reason:string,beside:boolean>>"
#: What may stand between a concept and its amount: remarks in parentheses and colons, and one percentage among them.
_REMARKS = r"(?:\s*(?:\([^)]{1,15}\)|:))*"
_PERCENT = r"\d{1,2}(?:[.,]\d{1,2})?\s*%"
_BETWEEN = rf"({_REMARKS}(?:\s*{_PERCENT})?{_REMARKS})"
_USED = "\u0001"  # stands for what an earlier concept has read, so that no later one begins inside it


def _word(pattern: str) -> str:
    return f"(?=[a-z])(?<![a-z])(?:{pattern})(?![a-z])"


_ANYTHING = _word("|".join(pattern for _, pattern in R.CONCEPTS))


def _reason(between: Column) -> Column:
    remarks = F.transform(F.regexp_extract_all(between, F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda x: F.trim(x))
    known = F.create_map(*[F.lit(x) for pair in R.ZERO_REASONS.items() for x in pair])
    return F.try_element_at(known, F.coalesce(F.try_element_at(F.filter(remarks, lambda x: x.isin(*R.ZERO_REASONS)), F.lit(-1)), F.lit("")))


def _found(kind: str, between: Column, amount: Column, beside: bool) -> Column:
    def read(between: Column) -> Column:
        percent = F.when(F.contains(between, F.lit("%")), F.nullif(F.regexp_extract(between, _PERCENT.replace(r"\s*%", "") + r"(?=\s*%)", 0), F.lit("")))
        reason = F.when(F.contains(between, F.lit("(")), _reason(between))
        return F.struct(F.lit(kind).alias("kind"), percent.alias("pct"), amount.alias("amount"), reason.alias("reason"), F.lit(beside).alias("beside"))

    return let(between, read)


def _whole(pattern: str) -> str:
    return f"(?i){_word(pattern)}{_BETWEEN}\\s*({R.AMOUNT})(?![\\d%])"


def carries_concept(plain: Column) -> Column:
    """Whether a normalised line has a concept with its amount: concepts() without a line that follows is not empty."""
    return F.coalesce(plain.rlike(_ANYTHING) & plain.rlike(_whole("|".join(f"(?:{pattern})" for _, pattern in R.CONCEPTS))), F.lit(False))


def _read_kind(kind: str, pattern: str, state: Column, following: Column) -> Column:
    """The state (rest, found) after one kind: what it reads leaves the rest of the line."""
    whole = _whole(pattern)
    bare = f"{_word(pattern)}{_BETWEEN}\\s*$"

    def read(rest: Column, found: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(rest, F.lit(whole), F.lit(0)), lambda hit: _found(kind, F.regexp_extract(hit, whole, 1), F.regexp_extract(hit, whole, 2), True))
        return let(
            F.struct(F.regexp_replace(rest, whole, _USED).alias("rest"), F.concat(found, hits).alias("found")),
            lambda s: F.when(
                following.isNotNull() & s["rest"].rlike(bare),
                F.struct(F.regexp_replace(s["rest"], bare, _USED).alias("rest"), F.concat(s["found"], F.array(_found(kind, F.regexp_extract(s["rest"], bare, 1), following, False))).alias("found")),
            ).otherwise(s),
        )

    return F.when(state["rest"].rlike(_word(pattern)), read(state["rest"], state["found"])).otherwise(state)


def concepts(plain: Column, following: Column) -> Column:
    """Concepts of one normalised line that carry an amount: array of (kind, pct, amount, reason, beside).

    An amount follows its concept directly, or after a percentage and remarks; a concept that ends its line also takes an
    amount that stands alone on the line `following` (beside is false then). Kinds read by precedence, and no kind
    begins in what another has read; hits of one kind stand in order."""
    none = F.array().cast(_CONCEPT)
    alone = F.when(following.rlike(f"{AMOUNT_CI[:4]}^\\s*(?:{R.AMOUNT})\\s*$"), F.trim(following))

    def all_kinds(args: Column) -> Column:
        after = lambda state, concept: let(state, lambda s: _read_kind(*concept, s, args["alone"]))
        return reduce(after, R.CONCEPTS, F.struct(args["plain"].alias("rest"), none.alias("found")))["found"]

    return F.when(plain.rlike(_ANYTHING), let(F.struct(plain.alias("plain"), alone.alias("alone")), all_kinds)).otherwise(none)


def totals_of(found: Column) -> Column:
    """struct(base, base_bruta, descuento, iva, retencion, recargo, suplidos, total), amounts in cents, from concepts in order.

    The first base and net base count, the last total, every tax, the last withholding, every surcharge, the first
    discount, and the sum of disbursements. The base of a single tax is the document's; those of several are deduced
    from their quotas. Without a base, a single rate takes it from the total."""
    typed = F.transform(found, lambda c: F.struct(c["kind"].alias("kind"), parse_amount(c["pct"]).cast("decimal(9,4)").alias("pct"), cents(parse_amount(c["amount"])).alias("amount"), c["reason"].alias("reason")))

    def parts(items: Column) -> Column:
        of = lambda kind: F.filter(items, lambda c: (c["kind"] == kind) & c["amount"].isNotNull())
        at = lambda kind, place: F.try_element_at(of(kind), F.lit(place))
        discount, gross, net = at("descuento", 1), at("base", 1)["amount"], at("base_neta", 1)["amount"]
        has_discount = F.coalesce(discount["amount"] != 0, F.lit(False))
        extras = of("suplidos")
        return F.struct(
            F.when(has_discount, F.coalesce(net, gross - F.abs(discount["amount"]))).otherwise(F.coalesce(net, gross)).alias("base"),
            F.when(has_discount | (gross != net), gross).alias("base_bruta"),
            F.when(has_discount, F.struct(discount["pct"].alias("porcentaje"), (-F.abs(discount["amount"])).alias("importe"))).alias("descuento"),
            F.transform(of("impuesto"), lambda c: F.struct(F.when(c["reason"].isNotNull() | (c["pct"].isNull() & (c["amount"] == 0)), F.lit(0)).otherwise(c["pct"]).cast("decimal(9,4)").alias("pct"), c["amount"].alias("amount"), c["reason"].alias("reason"))).alias("taxes"),
            F.try_element_at(F.filter(of("retencion"), lambda c: c["pct"].isNotNull() | (c["amount"] != 0)), F.lit(-1)).alias("held"),
            of("recargo").alias("extra"),
            F.when(F.size(extras) > 0, F.aggregate(extras, F.lit(0).cast("long"), lambda acc, c: acc + c["amount"])).alias("suplidos"),
            at("total", -1)["amount"].alias("total"),
        )

    def assembled(p: Column) -> Column:
        single = F.size(p["taxes"]) == 1
        rate = F.get(p["taxes"], F.lit(0))["pct"]
        return let(F.struct(p.alias("p"), F.coalesce(p["base"], F.when(single, F.round(p["total"] / (1 + rate / 100)).cast("long"))).alias("base"), single.alias("single")), rows)

    def rows(s: Column) -> Column:
        p, base, single = s["p"], s["base"], s["single"]
        alone = (F.size(p["extra"]) == 1) & (F.size(p["taxes"]) <= 1)
        return F.struct(
            base.alias("base"),
            p["base_bruta"].alias("base_bruta"),
            p["descuento"].alias("descuento"),
            F.transform(p["taxes"], lambda x: F.struct(x["pct"].alias("porcentaje"), F.when(single, base).otherwise(deduce_base(x["amount"], x["pct"])).alias("base"), x["amount"].alias("cuota"), x["reason"].alias("motivo"), (~single).alias("base_deducida"))).alias("iva"),
            F.when(p["held"].isNotNull(), F.struct(p["held"]["pct"].alias("porcentaje"), base.alias("base"), F.abs(p["held"]["amount"]).alias("cuota"))).alias("retencion"),
            F.transform(p["extra"], lambda x: F.struct(x["pct"].alias("porcentaje"), F.when(alone, base).otherwise(deduce_base(x["amount"], x["pct"])).alias("base"), x["amount"].alias("cuota"), (~alone).alias("base_deducida"))).alias("recargo"),
            p["suplidos"].alias("suplidos"),
            p["total"].alias("total"),
        )

    return let(let(typed, parts), assembled)
