"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed placeholders; windows of template tokens are hash-joined between documents and
benchmark items, and the slots behind the placeholders must map one to one, so a question with other names or numbers
is caught and a chance likeness of two templates is not. All texts are first looked through for windows of an item by
hashes alone; only those that have some are read with their slots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import cut, pick, text_or_empty

#: Words and signs of measure that count as a unit right after a number.
UNITS = ("km", "kg", "cm", "mm", "mg", "ml", "m", "g", "l", "s", "h", "min", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "years", "year", "miles", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent")
_TOKEN = r"\p{L}[\p{L}\p{M}'’]*|\p{N}+(?:[.,]\p{N}+)*|[%€$£°]"
_SLOTTED = ("\u0001n", "\u0001w", "\u0001u")
_GAP = "\u0002"
_CELLS = "array<struct<code:bigint,at:int,slots:string,exact:boolean>>"


def _raw(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _tokens(text: Column) -> Column:
    """Structs (t, s): the template token, and what the placeholder stands for ("" for a plain word). A word with a capital is
    a name wherever it stands, also at the start of a sentence."""

    def canonical(array: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            low, first = F.lower(w), F.substring(w, 1, 1)
            slot = lambda kind: F.struct(F.lit(kind).alias("t"), low.alias("s"))
            unit = low.isin(*UNITS, "%", "€", "$", "£", "°") & (i > 0) & F.substring(F.get(array, i - 1), 1, 1).between("0", "9")
            return F.when(first.between("0", "9"), slot(_SLOTTED[0])).when(F.lower(first) != first, slot(_SLOTTED[1])).when(unit, slot(_SLOTTED[2])).otherwise(F.struct(low.alias("t"), F.lit("").alias("s")))

        return F.transform(array, one)

    return F.transform(F.array(_raw(text)), canonical)[0]


def _hashes(tokens: Column, words: bool) -> Column:
    """Per raw token the hash of its template token, or of its word in lower case; the kinds of placeholders are numbers."""
    if words:
        return F.transform(tokens, lambda w: F.xxhash64(F.lower(w)))

    def one(w: Column, i: Column) -> Column:
        # most tokens are lower case, and what is asked of them is kept short
        first, kind = F.substring(w, 1, 1), [F.lit(k).cast("long") for k in range(3)]
        unit = w.isin(*UNITS, "%", "€", "$", "£", "°") & (i > 0) & F.substring(F.get(tokens, i - 1), 1, 1).between("0", "9")
        plain = F.when((w < ":") & (w >= "0"), kind[0]).when(unit, kind[2]).otherwise(F.xxhash64(w))
        return F.when(F.lower(w) == w, plain).otherwise(F.when(F.lower(first) != first, kind[1]).otherwise(F.xxhash64(F.lower(w))))

    return F.transform(tokens, one)


def _codes(text: Column, sizes: list[int], exact: list[int]) -> Column:
    """Codes of all windows of a text: by template for the sizes in `sizes`, by words for those in `exact`. The text is cut into
    tokens once, and each token is hashed once by template and once by word, whatever the number of sizes."""

    def of_size(h: Column, size: int) -> Column:
        at = F.when(F.size(h) >= size, F.sequence(F.lit(1), F.size(h) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.slice(h, i, size)))

    def of(tokens: Column) -> Column:
        by = lambda words, wanted: F.transform(F.array(_hashes(tokens, words)), lambda h: F.concat(*[of_size(h, s) for s in wanted]))[0]
        return F.concat(*[by(words, wanted) for words, wanted in ((False, sizes), (True, exact)) if wanted])

    return F.transform(F.array(_raw(text)), of)[0]


def _suspects(texts: DataFrame, items: DataFrame, sizes: list[int], exact: list[int], broadcast_windows: int) -> DataFrame:
    """doc_id of the texts that have some window of some item, by template or, for the sizes in `exact`, by words: one pass
    over the texts, whatever the number of sizes."""
    of_item = reduce(lambda rest, s: F.when(F.col("size") == s, _codes(F.col("text"), [s], [s] if s in exact else [])).otherwise(rest), sizes, F.array().cast("array<bigint>"))
    codes = cut(items.select(F.explode(of_item).alias("code")).distinct())
    codes = F.broadcast(codes) if codes.count() <= broadcast_windows else codes
    return cut(texts.select("doc_id", F.explode(_codes(F.col("text"), sizes, exact)).alias("code")).join(codes, "code", "left_semi").select("doc_id").distinct())


def _windows(tokens: str, sizes: list[int], min_words: int, exact: list[int]) -> Column:
    """Structs (code, at, slots, exact) of all windows of the given sizes; a window's slots are null where it has none.
    A window of a size in `exact` with too few plain words is coded by its words instead of its template."""
    has_slots = F.exists(tokens, lambda x: x["s"] != "")

    def of(size: int) -> Column:
        template, slots = F.transform(tokens, lambda x: x["t"]), F.transform(tokens, lambda x: x["s"])
        words = F.transform(tokens, lambda x: F.when(x["s"] != "", x["s"]).otherwise(x["t"]))

        def cell(d: Column, i: Column) -> Column:
            plain = F.xxhash64(F.slice(d["t"], i, size))
            few = d["h"] & (F.size(F.filter(F.slice(d["s"], i, size), lambda x: x == "")) < min(min_words, size))
            return F.struct(
                (F.when(few, F.xxhash64(F.lit(_GAP), F.slice(d["w"], i, size))).otherwise(plain) if size in exact else plain).alias("code"),
                i.alias("at"),
                F.when(d["h"], F.array_join(F.slice(d["s"], i, size), _GAP)).alias("slots"),
                (few if size in exact else F.lit(False)).alias("exact"),
            )

        whole = F.struct(template.alias("t"), slots.alias("s"), (words if size in exact else F.lit(None).cast("array<string>")).alias("w"), has_slots.alias("h"), F.size(tokens).alias("n"))
        cells = F.transform(F.array(whole), lambda d: F.when(d["n"] >= size, F.transform(F.sequence(F.lit(1), d["n"] - size + 1), lambda i: cell(d, i))))[0]
        return F.coalesce(cells, F.array().cast(_CELLS))

    return reduce(lambda a, b: F.concat(a, b), [of(s) for s in sizes])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, min_words: int = 4, min_coverage: float = 0.5, broadcast_windows: int = 500_000) -> DataFrame:
    """One row per document and item it leaks: doc_id, item_id, n_windows, n_matched, coverage, kind (exact or
    reparameterised), n_slots.

    A document leaks an item if it holds at least `min_coverage` of the item's distinct windows and every slot of the
    item goes with one value of the document and the other way round. Windows with fewer than `min_words` plain words
    match only with the same words, other windows also with other values; items of fewer tokens than a window are one
    window of their own length. Both conditions are judged for each single offset between document and item, for each
    run of offsets less than a window apart, and for the document as a whole; it leaks the item if any of these passes,
    and the exact one of the largest coverage is reported, or else the largest. Null and empty texts and items, and
    null ids, match nothing. Rows that repeat an id are judged together. The benchmark is broadcast only while it has
    at most `broadcast_windows` windows. Other columns of either input are ignored.
    """
    items = cut(pick(benchmark, item_id=item_col, text=item_text_col).filter("item_id is not null").select("item_id", text_or_empty().alias("text"), _tokens(text_or_empty()).alias("tokens")).withColumn("size", F.least(F.size("tokens"), F.lit(window))).filter("size > 0"))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [window]  # at most `window` values
    known = F.concat(*[F.when(F.col("size") == s, _windows("tokens", [s], min_words, [s])).otherwise(F.array().cast(_CELLS)) for s in sizes])
    # of an item's equal windows the first place stands for all
    wanted = cut(items.select("item_id", "size", F.explode(known).alias("w")).groupBy("item_id", "size", "w.code", "w.exact", F.coalesce("w.slots", F.lit("")).alias("item_slots")).agg(F.min("w.at").alias("item_at")))
    exact = sorted(r["size"] for r in wanted.filter("exact").select("size").distinct().collect())
    totals = wanted.groupBy("item_id").agg(F.count_distinct("code").alias("n_windows"))

    texts = pick(docs, doc_id=id_col, text=text_col).filter("doc_id is not null and text is not null")
    texts = texts.join(_suspects(texts, items, sizes, exact, broadcast_windows), "doc_id", "left_semi")
    side = wanted.drop("exact")
    side = F.broadcast(side) if wanted.count() <= broadcast_windows else side
    found = texts.select("doc_id", _tokens(F.col("text")).alias("tokens")).select("doc_id", F.inline(_windows("tokens", sizes, min_words, exact))).join(side, "code")
    same = F.col("exact") | (F.coalesce("slots", F.lit("")) == F.col("item_slots"))
    matched = cut(found.select("doc_id", "item_id", "size", "code", "item_slots", F.when(same, F.col("item_slots")).otherwise(F.coalesce("slots", F.lit(""))).alias("slots"), (F.col("at") - F.col("item_at")).alias("offset")).distinct())

    pair = ["doc_id", "item_id"]
    order = Window.partitionBy(*pair).orderBy("offset")
    offsets = matched.select(*pair, "size", "offset").distinct().withColumn("before", F.lag("offset").over(order))
    runs = offsets.withColumn("run", F.sum(F.when(F.col("offset") - F.col("before") < F.col("size"), 0).otherwise(1)).over(order)).select(*pair, "offset", "run")
    scopes = F.array(*[F.struct(F.lit(level).alias("level"), at.cast("long").alias("scope")) for level, at in enumerate((F.col("offset"), F.col("run"), F.lit(0)))])
    placed = matched.join(runs, [*pair, "offset"]).select(*pair, "code", "item_slots", "slots", F.inline(scopes))
    scope = [*pair, "level", "scope"]

    # per item window the scope's windows whose slots agree, where there are any, else those with other values
    agreed = placed.groupBy(*scope, "code", "item_slots").agg(F.max(F.col("slots") == F.col("item_slots")).alias("same"), F.min("slots").alias("slots"))
    counted = agreed.groupBy(*scope).agg(F.count_distinct("code").alias("n_matched"))
    enough = cut(
        counted.join(F.broadcast(totals) if totals.count() <= broadcast_windows else totals, "item_id")
        .withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
        .filter(F.col("coverage") >= min_coverage)
    )
    names = agreed.filter("replace(item_slots, '\u0002', '') <> ''").join(enough.select(*scope), scope, "left_semi").select(*scope, F.when(F.col("same"), F.col("item_slots")).otherwise(F.col("slots")).alias("theirs"), "item_slots")
    cells = names.select(*scope, F.explode(F.arrays_zip(F.split("item_slots", _GAP).alias("a"), F.split("theirs", _GAP).alias("b"))).alias("x")).select(*scope, "x.a", "x.b").filter("a <> ''").distinct()
    clash = cells.groupBy(*scope).agg(F.count("*").alias("n_slots"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"), F.count_if(F.col("a") != F.col("b")).alias("other"))
    passed = enough.join(clash, scope, "left").filter("n_slots is null or (n_slots = na and n_slots = nb)").withColumn("other", F.coalesce("other", F.lit(0)) > 0)
    best = passed.groupBy(*pair).agg(F.min_by(F.struct("n_windows", "n_matched", "coverage", "other", F.coalesce("n_slots", F.lit(0)).alias("n_slots")), F.struct("other", -F.col("n_matched"), "level", "scope")).alias("best"))
    return best.select(*pair, "best.n_windows", "best.n_matched", "best.coverage", F.when(F.col("best.other"), "reparameterised").otherwise("exact").alias("kind"), "best.n_slots")
