"""From positioned words to visual lines and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions.binding import let

LINE_DRIFT, COLUMN_GAP, OCR_BAND, OVERLAP = 4.0, 9.0, 8.0, 0.3
CHAR_WIDTH, LINE_HEIGHT = 5.0, 12.0


def plain_text_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of plain text with made-up boxes: 5 points a character, 12 a line.
    doc_id, page, line, ord, text, x0, y0, x1, y1, conf, rotated."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line", "content"))
    gaps, words = F.split("content", r"\S+", -1), F.regexp_extract_all("content", F.lit(r"\S+"), F.lit(0))
    sizes = F.zip_with(F.slice(gaps, 1, F.size(words)), words, lambda gap, word: F.struct(F.length(gap).alias("gap"), word.alias("word")))
    tokens = lines.select("doc_id", "line", F.posexplode(sizes).alias("ord", "t")).select("doc_id", "line", "ord", "t.word", (F.col("t.gap") + F.length("t.word")).alias("advance"))
    end = F.sum("advance").over(Window.partitionBy("doc_id", "line").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    placed = tokens.withColumn("end", end)
    return placed.select(
        "doc_id",
        F.lit(1).alias("page"),
        "line",
        "ord",
        F.col("word").alias("text"),
        ((F.col("end") - F.length("word")) * CHAR_WIDTH).alias("x0"),
        (F.col("line") * LINE_HEIGHT).alias("y0"),
        (F.col("end") * CHAR_WIDTH).alias("x1"),
        (F.col("line") * LINE_HEIGHT + 10.0).alias("y1"),
        F.lit(1.0).alias("conf"),
        F.lit(False).alias("rotated"),
    )


def _fold(items: Column, kind: str, start: Column, step, finish=None, block: int = 512) -> Column:
    """What a fold over `items` gives out: step(state, item) returns the next state and an array of items of type `kind`,
    and finish(state) such an array. Spark copies the state of a fold at each item, so what is given out is gathered
    within blocks, and those are joined: some n * block + n * n / block copies, not n * n."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        state, given = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], given).alias("out"))

    def whole(array: Column) -> Column:
        def part(acc: Column, at: Column) -> Column:
            join = lambda inner: F.struct(inner["state"].alias("state"), F.concat(acc["out"], inner["out"]).alias("out"))
            return F.aggregate(F.slice(array, at, block), F.struct(acc["state"].alias("state"), none.alias("out")), one, join)

        places = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array), F.lit(block))).otherwise(F.array().cast("array<int>"))
        last = lambda acc: F.concat(acc["out"], finish(acc["state"])) if finish else acc["out"]
        return F.aggregate(places, F.struct(start.alias("state"), none.alias("out")), part, last)

    return let(items, whole)


def _anchored(sorted_words: Column, place, drift: float) -> Column:
    """Line numbers for words in reading order: a new line where a word is more than `drift` from the first of its line."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"))

    def step(state: Column, w: Column) -> tuple[Column, Column]:
        new = state["anchor"].isNull() | (F.abs(place(w) - state["anchor"]) > drift)
        line = state["line"] + new.cast("int")
        return F.struct(F.when(new, place(w)).otherwise(state["anchor"]).alias("anchor"), line.alias("line")), F.array(line)

    return _fold(sorted_words, "int", start, step)


def visual_lines(words: DataFrame, drift: float = LINE_DRIFT) -> DataFrame:
    """words with `line`, numbered from 0 on each page: upright words are grouped around the first word of a line (a
    slanting line drifts off it), rotated ones by their exact height and numbered after the upright ones."""
    upright = words.filter("not rotated")
    box = F.struct(F.col("y0").alias("y"), F.col("x0").alias("x"), F.col("ord").alias("ord"))
    pages = upright.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(box)).alias("ws"))
    numbered = pages.select("doc_id", "page", F.inline(F.arrays_zip(F.transform("ws", lambda w: w["ord"]).alias("ord"), _anchored(F.col("ws"), lambda w: w["y"], drift).alias("line"))))
    turned = words.filter("rotated").withColumn("line", F.lit(1_000_000) + F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy("y0")))
    return upright.drop("line").join(numbered, ["doc_id", "page", "ord"]).select(*[c for c in words.columns if c != "line"], "line").unionByName(turned.select(*[c for c in words.columns if c != "line"], "line"))


def rotated_labels(glyphs: DataFrame, same: float = 1.0, apart: float = 12.0) -> DataFrame:
    """Turned glyphs (doc_id, page, ord, text, x0, y0, x1, y1, upwards) to labels: doc_id, page, text, x0, y0, x1, y1.

    Glyphs whose baselines (x0) differ by a point at most stand in one column, columns no more than 12 points from the
    first of their label belong to it; each column is read upwards or downwards as its glyphs are turned."""

    def runs(start: str, drift: float, *within: str) -> Column:
        order = Window.partitionBy("doc_id", "page", "upwards", *within).orderBy("x0", "ord")
        return F.sum(F.when(F.col("x0") - F.coalesce(F.lag("x0").over(order), F.lit(-1e9)) > drift, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(start)

    columns = glyphs.select("*", runs("col", same)).withColumn("along", F.when(F.col("upwards"), -F.col("y1")).otherwise(F.col("y0")))
    read = F.array_sort(F.collect_list(F.struct("along", "ord", "text")))
    lines = columns.groupBy("doc_id", "page", "upwards", "col").agg(F.array_join(F.transform(read, lambda g: g["text"]), "").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    labels = lines.withColumn("ord", F.col("col")).select("*", runs("label", apart))
    side = F.when(F.col("upwards"), F.col("x0")).otherwise(-F.col("x0"))
    joined = F.array_sort(F.collect_list(F.struct(side.alias("at"), F.col("text").alias("text"))))
    return labels.groupBy("doc_id", "page", "upwards", "label").agg(F.array_join(F.transform(joined, lambda c: c["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("upwards", "label")


def ocr_lines(words: DataFrame, band: float = OCR_BAND) -> DataFrame:
    """Line numbers of scanned words: sorted by band of 8 points and x, a new line more than a band off the first word."""
    box = F.struct(F.rint(F.col("y0") / band).alias("band"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("ord").alias("ord"))
    pages = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(box)).alias("ws"))
    return pages.select("doc_id", "page", F.inline(F.arrays_zip(F.transform("ws", lambda w: w["ord"]).alias("ord"), _anchored(F.col("ws"), lambda w: w["y"], band).alias("line"))))


def stitched(words: Column) -> Column:
    """Words of one line (array of struct text, x0, x1, height by x0) with split figures joined: a gap below a point and
    below 0.15 of the height between two numeric edges closes."""
    edge_end, edge_start, kind = r"[\d.,/-]$", r"^[\d.,/%-]", "struct<text:string,x0:double,x1:double,height:double>"

    none = F.array().cast(f"array<{kind}>")

    def step(last: Column, w: Column) -> tuple[Column, Column]:
        close = F.coalesce((w["x0"] - last["x1"] < F.least(F.lit(1.0), 0.15 * w["height"])) & last["text"].rlike(edge_end) & w["text"].rlike(edge_start), F.lit(False))
        joined = F.struct(F.concat(last["text"], w["text"]).alias("text"), last["x0"].alias("x0"), w["x1"].alias("x1"), last["height"].alias("height"))
        return F.when(close, joined).otherwise(w), F.when(last.isNotNull() & ~close, F.array(last)).otherwise(none)

    ordered = F.array_sort(words, lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0))
    return _fold(ordered, kind, F.lit(None).cast(kind), step, lambda last: F.when(last.isNotNull(), F.array(last)).otherwise(none))


def segments(words: DataFrame, gap: float = COLUMN_GAP) -> DataFrame:
    """Cells: runs of words of a line without a gap of over 9 points. doc_id, page, line, seg, text, x0, x1, y0."""
    order = Window.partitionBy("doc_id", "page", "line").orderBy("x0", "ord")
    flagged = words.withColumn("new", F.coalesce((F.col("x0") - F.lag("x1").over(order) > gap).cast("int"), F.lit(0)))
    numbered = flagged.withColumn("seg", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    cell = F.array_sort(F.collect_list(F.struct("x0", "ord", "text")))
    return numbered.groupBy("doc_id", "page", "line", "seg").agg(F.array_join(F.transform(cell, lambda w: w["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"))


def visible_glyphs(chars: DataFrame, share: float = OVERLAP) -> DataFrame:
    """chars(doc_id, page, ord, x0, y0, x1, y1) without those that a later one covers by over 30 % both ways. Glyphs that
    overlap share one of the squares of a grid, which makes the join an equi-join."""
    cell = 16.0
    squares = F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))
    bands = F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell)))
    placed = lambda df: df.withColumn("gx", squares).withColumn("gy", bands)
    a, b = placed(chars).alias("a"), placed(chars).alias("b")
    dx = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    dy = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("doc_id", "page", "gx", "gy")]
    covered = a.join(b, [*same, F.col("b.ord") > F.col("a.ord"), dx > share * (F.col("a.x1") - F.col("a.x0")), dy > share * (F.col("a.y1") - F.col("a.y0"))], "left_semi").select("doc_id", "page", "ord").distinct()
    return chars.join(covered, ["doc_id", "page", "ord"], "left_anti")


def nearest_below(labels: DataFrame, cells: DataFrame, lines: int = 3, drop: float = 24.0, left: float = 15.0, right: float = 60.0) -> DataFrame:
    """For each label (doc_id, page, line, x0, x1, y0, label) the cell (doc_id, page, line, seg, text, x0, x1, y0) of
    the next three lines that overlaps it: the nearest line, then the nearest left edge."""
    a, b = labels.alias("a"), cells.alias("b")
    below = (F.col("b.line") - F.col("a.line")).between(1, lines) & (F.col("b.y0") - F.col("a.y0") <= drop)
    overlap = (F.col("b.x1") >= F.col("a.x0") - left) & (F.col("b.x0") <= F.col("a.x1") + right)
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & below & overlap)
    first = F.min_by(F.col("b.text"), F.struct(F.col("b.line"), F.abs(F.col("b.x0") - F.col("a.x0")), F.col("b.seg")))
    return pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in ("doc_id", "page", "line", "label", "x0")]).agg(first.alias("value"))


def table_header(words: DataFrame, synonyms: dict[str, tuple[str, ...]]) -> DataFrame:
    """doc_id, page, line, columns (map of column to the middle of its heading): the first line that has both a
    description and an amount heading."""
    from ledgerlens.functions.text import norm

    plain = F.regexp_replace(norm(F.col("text")), "[.:]+$", "")
    which = F.coalesce(*[F.when(F.lit(False) | _any_prefix(plain, names), F.lit(column)) for column, names in synonyms.items()])
    heads = words.withColumn("column", which).filter("column is not null").groupBy("doc_id", "page", "line", "column").agg(F.min_by((F.col("x0") + F.col("x1")) / 2, "x0").alias("middle"))
    lines = heads.groupBy("doc_id", "page", "line").agg(F.map_from_entries(F.collect_list(F.struct("column", "middle"))).alias("columns"))
    good = lines.filter(F.map_contains_key("columns", "descripcion") & F.map_contains_key("columns", "importe"))
    return good.groupBy("doc_id").agg(F.min_by(F.struct("page", "line", "columns"), F.struct("page", "line")).alias("h")).select("doc_id", "h.*")


def _any_prefix(plain: Column, names: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | plain.startswith(name)
    return found
