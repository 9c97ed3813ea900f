"""Documents as arrays of lines, so that extraction is one narrow projection.

A line is a struct (page, y, turned, text, plain, words, cells): `plain` is the normalised text, words are (text, x0, x1,
plain) from left to right, and cells are runs of words without a column gap: (text, x0, x1, first word's place).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.binding import let
from ledgerlens.functions.taxid import is_valid_tax_id
from ledgerlens.functions.text import MARKED_SIGN, norm, strip_accents
from ledgerlens.operators.layout import CHAR_WIDTH, COLUMN_GAP, LINE_HEIGHT, stitched

MOST_WALKED = 64
_SPLIT_FIGURE = r"\d [\d.,]"
#: White space that is neither a blank nor a line's end, nor written as a blank by `text_lines`.
_ODD_BLANK = r"[\x85\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def places(size: Column) -> Column:
    """0 to size - 1; empty for an empty array."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def first_of(array: Column) -> Column:
    return F.get(array, F.lit(0))


def first_such(array: Column, test, kind: str) -> Column:
    """The first element (of type `kind`) that passes a test, null without one; those after it are not tested."""
    return F.aggregate(array, F.lit(None).cast(kind), lambda found, x: F.when(found.isNotNull(), found).when(test(x), x))


def join_digits(text: Column) -> Column:
    """Figures that a reader split are closed where only one reading is possible: the year of a date, the figure before a
    percent sign or a decimal sign, and a Spanish tax identifier whose halves make a valid one."""
    year = F.regexp_replace(text, r"\b(\d{1,2}[/.-]\d{1,2}[/.-])(?:(\d) (\d{3})|(\d\d) (\d\d)|(\d{3}) (\d))\b", "$1$2$3$4$5$6$7")
    closed = F.regexp_replace(year, r"(?<=\d) (?=\d\s*%|[.,]\d\d\b)", "")

    def ids(x: Column) -> Column:
        halves = F.filter(F.regexp_extract_all(x, F.lit(r"\b[A-Z]?\d{4,7} \d{1,4}[A-Z]?\b"), F.lit(0)), lambda h: is_valid_tax_id(h, F.lit("ES")))
        return F.aggregate(halves, x, lambda acc, h: F.replace(acc, h, F.replace(h, F.lit(" "), F.lit(""))))

    return F.when(text.rlike(_SPLIT_FIGURE), let(closed, ids)).otherwise(text)


def cells_of(words: Column, gap: float = COLUMN_GAP) -> Column:
    """Cells of words from left to right."""
    starts = F.filter(places(F.size(words)), lambda i: (i == 0) | (F.get(words, i)["x0"] - F.get(words, i - 1)["x1"] > gap))

    def cell(start: Column, stop: Column) -> Column:
        joined = lambda held: let(F.array_join(held["text"], " "), join_digits)
        return let(F.slice(words, start + 1, stop - start), lambda held: F.struct(joined(held).alias("text"), first_of(held)["x0"].alias("x0"), F.array_max(held["x1"]).alias("x1"), start.alias("first")))

    return let(starts, lambda s: F.transform(s, lambda start, k: cell(start, F.coalesce(F.get(s, k + 1), F.size(words)))))


#: As many blanks in a row as leave a column gap in plain text.
_WIDE = " " * (int(COLUMN_GAP // CHAR_WIDTH) + 1)


def _word(text: Column, x0: Column, x1: Column, plain: Column) -> Column:
    return F.struct(text.alias("text"), x0.alias("x0"), x1.alias("x1"), plain.alias("plain"))


def _line(page: Column, y: Column, turned: Column, words: Column) -> Column:
    def normalised(raw: Column) -> Column:
        plain = norm(raw["text"])
        return let(F.struct(raw["words"].alias("words"), raw["text"].alias("raw"), join_digits(raw["text"]).alias("text"), plain.alias("plain"), F.split(plain, " ").alias("parts")), made)

    def made(x: Column) -> Column:
        # the line is normalised once; its words are the parts, but where one has no sign left
        one = lambda w, plain: _word(w["text"], w["x0"], w["x1"], plain)
        ws = F.when(F.size(x["parts"]) == F.size(x["words"]), F.zip_with(x["words"], x["parts"], one)).otherwise(F.transform(x["words"], lambda w: one(w, norm(w["text"]))))
        plain = F.when(x["text"] == x["raw"], x["plain"]).otherwise(norm(x["text"]))
        return let(ws, lambda held: F.struct(page.alias("page"), y.cast("double").alias("y"), turned.alias("turned"), x["text"].alias("text"), plain.alias("plain"), held.alias("words"), cells_of(held).alias("cells")))

    return let(let(words, lambda w: F.struct(w.alias("words"), F.array_join(w["text"], " ").alias("text"))), normalised)


def _placed_words(content: Column, raw: Column, parts: Column) -> Column:
    """The words of a line of plain text, with boxes; `raw` is the line with single blanks, `parts` is the normalised line, split."""

    def spaced_once(texts: Column) -> Column:
        margin = F.length(content) - F.length(F.ltrim(content))
        return walked(texts, F.aggregate(texts, F.array(margin - 1), lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + 1 + F.length(w))))

    def spaced(pieces: Column) -> Column:
        return walked(F.transform(pieces, lambda piece: F.ltrim(piece)), F.aggregate(pieces, F.array(F.lit(0)), lambda acc, piece: F.array_append(acc, F.element_at(acc, -1) + F.length(piece))))

    def walked(texts: Column, ends: Column) -> Column:
        return let(ends, lambda held: boxed(texts, lambda w, i: (F.get(held, i + 1) - F.length(w), F.get(held, i + 1))))

    def looked_up(texts: Column) -> Column:
        placed = lambda signs: F.filter(places(F.size(signs)), lambda i: (F.get(signs, i) != " ") & ((i == 0) | (F.get(signs, i - 1) == " ")))
        return let(let(F.split(content, ""), placed), lambda starts: boxed(texts, lambda w, i: (F.get(starts, i), F.get(starts, i) + F.length(w))))

    def boxed(texts: Column, span) -> Column:
        box = lambda plain: lambda w, i: _word(w, *[at * CHAR_WIDTH for at in span(w, i)], plain(w, i))
        return let(texts, lambda texts: F.when(F.size(parts) == F.size(texts), F.transform(texts, box(lambda w, i: F.get(parts, i)))).otherwise(F.transform(texts, box(lambda w, i: norm(w)))))

    # a walk over words costs less than one over signs, but what it gathers grows with their square
    few = lambda array, walk: F.when(F.size(array) <= MOST_WALKED, walk(array)).otherwise(looked_up(F.split(raw, " ")))
    several = let(F.regexp_extract_all(content, F.lit(" *[^ ]+"), F.lit(0)), lambda pieces: few(pieces, spaced))
    return F.when(F.contains(F.trim(content), F.lit("  ")), several).otherwise(let(F.split(raw, " "), lambda texts: few(texts, spaced_once)))


def _placed_cells(content: Column, text: Column, split: Column, words: Column) -> Column:
    """cells_of() words that were placed by their signs: a cell is a run without two blanks, and none holds a split figure
    (`split`) where the line does not."""
    last = F.get(words, F.size(words) - 1)
    alone = F.array(F.struct(text.alias("text"), first_of(words)["x0"].alias("x0"), last["x1"].alias("x1"), F.lit(0).alias("first")))
    starts = F.filter(places(F.size(words)), lambda i: (i == 0) | (F.get(words, i)["x0"] - F.get(words, i - 1)["x1"] > COLUMN_GAP))

    def several(starts: Column, texts: Column) -> Column:
        def cell(start: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(starts, k + 1), F.size(words))
            return F.struct(F.when(split, join_digits(F.get(texts, k))).otherwise(F.get(texts, k)).alias("text"), F.get(words, start)["x0"].alias("x0"), F.get(words, stop - 1)["x1"].alias("x1"), start.alias("first"))

        return F.transform(starts, cell)

    runs = F.regexp_extract_all(content, F.lit("[^ ]+(?: [^ ]+)*"), F.lit(0))
    return F.when(F.contains(F.trim(content), F.lit(_WIDE)), let(starts, lambda s: let(runs, lambda texts: several(s, texts)))).otherwise(alone)


def text_lines(text: Column) -> Column:
    """The lines of plain text that are not blank, with boxes of 5 points a character and 12 a line. No shuffle."""

    def placed(row: Column) -> Column:
        content, plain = row["content"], row["plain"]
        raw = F.when(F.contains(F.trim(content), F.lit("  ")), F.regexp_replace(F.trim(content), " +", " ")).otherwise(F.trim(content))

        def made(raw: Column, split: Column, words: Column) -> Column:
            def finished(text: Column) -> Column:
                own = F.when(split & (text != raw), norm(text)).otherwise(plain)
                return F.struct(F.lit(1).alias("page"), (row["i"] * LINE_HEIGHT).cast("double").alias("y"), F.lit(False).alias("turned"), text.alias("text"), own.alias("plain"), words.alias("words"), _placed_cells(content, text, split, words).alias("cells"))

            return let(F.when(split, join_digits(raw)).otherwise(raw), finished)

        words = lambda raw: let(F.split(plain, " "), lambda parts: _placed_words(content, raw, parts))
        return let(raw, lambda raw: let(raw.rlike(_SPLIT_FIGURE), lambda split: let(words(raw), lambda words: made(raw, split, words))))

    def rows(plain: Column) -> Column:
        contents = F.split(plain, "\n")
        # the text is normalised as a whole: a line's end is kept, all other white space becomes a blank
        bare = F.when(plain.rlike(MARKED_SIGN), F.array_join(F.transform(contents, strip_accents), "\n")).otherwise(plain)
        closed = lambda x: F.when(x.rlike(_ODD_BLANK), F.regexp_replace(x, r"(?U)[^\S\n]+", " ")).otherwise(F.regexp_replace(x, "  +", " "))
        row = lambda flat: F.transform(contents, lambda content, i: F.struct(content.alias("content"), F.trim(F.get(flat, i)).alias("plain"), i.alias("i")))
        return F.transform(F.filter(let(F.split(let(F.lower(bare), closed), "\n"), row), lambda r: F.trim(r["content"]) != ""), placed)

    def spaced(raw: Column) -> Column:
        return F.when(raw.rlike("[\t\v\f\r\u00a0]"), F.translate(F.replace(raw, F.lit("\r\n"), F.lit("\n")), "\t\v\f\r\u00a0", "     ")).otherwise(raw)

    return let(let(F.coalesce(text, F.lit("")), spaced), rows)


def word_lines(words: DataFrame) -> DataFrame:
    """doc_id, lines from positioned words with line numbers (doc_id, page, line, ord, text, x0, y0, x1, y1, rotated).
    Figures that were split without a gap are stitched. Words are dealt by doc_id once, which serves both groupings."""
    box = F.struct("x0", "ord", "text", "x1", (F.col("y1") - F.col("y0")).alias("height"))
    rows = words.filter(F.col("text").rlike(r"\S")).repartition("doc_id").groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(box)).alias("ws"), F.min("y0").alias("y"), F.max("rotated").alias("turned"))
    joined = stitched(F.transform("ws", lambda w: F.struct(w["text"].alias("text"), w["x0"].cast("double").alias("x0"), w["x1"].cast("double").alias("x1"), w["height"].cast("double").alias("height"))))
    held = F.transform(joined, lambda w: F.struct(w["text"].alias("text"), w["x0"].alias("x0"), w["x1"].alias("x1")))
    made = rows.select("doc_id", F.struct("page", "y", "line").alias("at"), _line(F.col("page").cast("int"), F.col("y"), F.col("turned"), held).alias("made"))
    return made.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "made"))), lambda x: x["made"]).alias("lines"))


def upright(lines: Column) -> Column:
    return F.filter(lines, lambda line: ~line["turned"])


def cells_flat(lines: Column) -> Column:
    """All cells in reading order: (li, n, page, y, x0, x1, text)."""
    return F.flatten(F.transform(lines, lambda line, li: F.transform(line["cells"], lambda c, n: F.struct(li.alias("li"), n.alias("n"), line["page"].alias("page"), line["y"].alias("y"), c["x0"].alias("x0"), c["x1"].alias("x1"), c["text"].alias("text")))))


def gram(words: Column, start: Column, width: int) -> Column:
    """The normalised text of `width` words from a place on, without a colon at its end; null where the line is too short."""
    plain = F.concat_ws(" ", *[F.get(words, start + k)["plain"] for k in range(width)])
    one_sign = lambda x: F.when(F.contains(x, F.lit("º")) | F.contains(x, F.lit("°")), F.regexp_replace(x, r"\bn\s*\.?\s*[º°]", "nº")).otherwise(x)
    return F.when(start + width <= F.size(words), F.rtrim(let(plain, one_sign), F.lit(": ")))


def opens_with(labels: tuple[str, ...]) -> str:
    """A pattern that each normalised line with one of the labels matches."""
    return r"(?<!\S)(?:" + "|".join(_openings(labels)) + ")"


def _openings(labels: tuple[str, ...]) -> list[str]:
    return sorted({re.escape(label.split()[0]).replace("º", "") for label in labels})


def opening_places(words: Column, labels: tuple[str, ...]) -> Column:
    """The places of words that one of the labels may begin with."""
    opening = "^(?:" + "|".join(_openings(labels)) + ")"
    return F.filter(F.transform(words, lambda w, i: F.when(w["plain"].rlike(opening), i)), lambda i: i.isNotNull())


def first_label(lines: Column, labels: tuple[str, ...], widest: int) -> Column:
    """struct(li, start, width) of the first place of any label, longer ones first; null without one."""

    def of_line(line: Column, li: Column) -> Column:
        def at(i: Column) -> Column:
            width = F.coalesce(*[F.when(gram(line["words"], i, width).isin(*labels), F.lit(width)) for width in range(widest, 0, -1)])
            return F.struct(li.alias("li"), i.alias("start"), width.alias("width"))

        found = F.filter(F.transform(opening_places(line["words"], labels), at), lambda x: x["width"].isNotNull())
        return F.when(line["plain"].rlike(opens_with(labels)), found).otherwise(F.array().cast("array<struct<li:int,start:int,width:int>>"))

    return first_of(F.flatten(F.transform(lines, of_line)))
