"""Issuer and recipient of an invoice from its upright lines. Columns only: documents never leave their row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import refdata as R
from ledgerlens.functions.binding import let
from ledgerlens.functions.money import AMOUNT_CI
from ledgerlens.functions.taxid import ids_in, valid_ids_in
from ledgerlens.functions.text import clean_name, looks_like_name, norm
from ledgerlens.operators.layout import COLUMN_GAP
from ledgerlens.operators.lines import cells_flat, first_label, first_of, first_such, gram, opening_places, places

_PARTY = "struct<nombre:string,nif:string>"
_CELL = "array<struct<li:int,n:int,text:string>>"


def _is_name(text: Column) -> Column:
    return looks_like_name(text, AMOUNT_CI)


def heading_of(word: Column) -> Column:
    """Which column of a detail table a normalised word heads; null for none."""
    bare = F.regexp_replace(word, "[.:]+$", "")
    return F.coalesce(*[F.when(bare.rlike("^(?:" + "|".join(names) + ")"), F.lit(column)) for column, names in R.TABLE_HEADERS.items()])


def is_table_header(line: Column) -> Column:
    holds = lambda column: line["plain"].rlike(r"(?<!\S)(?:" + "|".join(R.TABLE_HEADERS[column]) + ")")
    return holds("descripcion") & holds("importe")


def recipient_label(lines: Column) -> Column:
    """struct(rank, li, start, order, width) of the recipient's label: a firm phrase before "para:" and "a:", and these before loose
    words, which need a colon, the end of the line or a column gap after them and no "del", "de" or "id" before them."""

    def of_line(line: Column, li: Column) -> Column:
        words = line["words"]

        def at(i: Column, width: int) -> Column:
            return let(gram(words, i, width), lambda label: judged(label, i, width))

        def judged(label: Column, i: Column, width: int) -> Column:
            last = i + width - 1
            colon = F.get(words, last)["text"].endswith(":")
            before = F.coalesce(F.when(i + width > 1, F.get(words, last - 1)["plain"]), F.lit(""))
            after = F.get(words, last + 1)
            loose = ~before.isin("del", "de", "id.", "id") & (colon | after.isNull() | (after["x0"] - F.get(words, last)["x1"] > COLUMN_GAP))
            rank = F.when(label.isin(*R.RECIPIENT_STRONG), 0).when(label.isin(*R.RECIPIENT_COLON) & colon, 1).when(label.isin(*R.RECIPIENT_LOOSE) & loose, 2)
            return F.when(label.isin(*labels) & rank.isNotNull(), F.struct(rank.alias("rank"), li.alias("li"), i.alias("start"), F.lit(2 - width).alias("order"), F.lit(width).alias("width")))

        return F.array_compact(F.flatten(F.transform(opening_places(words, labels), lambda i: F.array(at(i, 2), at(i, 1)))))

    labels = (*R.RECIPIENT_STRONG, *R.RECIPIENT_COLON, *R.RECIPIENT_LOOSE)
    known = "|".join(labels)
    return F.array_min(F.flatten(F.transform(lines, lambda line, li: F.when(line["plain"].rlike(rf"(?=[a-z])\b(?:{known})\b"), of_line(line, li)).otherwise(F.array().cast("array<struct<rank:int,li:int,start:int,order:int,width:int>>")))))


def recipient_block(lines: Column, label: Column) -> Column:
    """Cells (li, n, text) of the recipient's block, in order; empty without a label.

    The block starts right of its label, or in the column of what stands within two lines (30 points) below it; it goes
    down 110 points in that column (12 points either way) and ends at a detail table or after 30 points without a cell."""

    def build(a: Column) -> Column:
        line, after = F.get(lines, a["label"]["li"]), a["label"]["start"] + a["label"]["width"]
        words, cells = line["words"], line["cells"]
        stop = lambda n: F.coalesce(F.get(cells, n + 1)["first"], F.size(words))
        beside = first_of(F.filter(F.transform(cells, lambda c, n: F.struct(n.alias("n"), F.greatest(c["first"], after).alias("at"), stop(n).alias("stop"))), lambda c: c["stop"] > after))
        own = lambda beside, held: F.when(
            beside.isNotNull() & ~F.regexp_replace(first_of(held)["plain"], "[.:]+$", "").isin(*R.LABEL_WORDS),
            F.struct(a["label"]["li"].alias("li"), beside["n"].alias("n"), F.array_join(F.transform(held, lambda w: w["text"]), " ").alias("text"), first_of(held)["x0"].alias("x0")),
        )
        x0 = F.get(words, a["label"]["start"])["x0"]
        near = lambda other: (other["page"] == line["page"]) & (other["y"] - line["y"] <= 30)
        under = F.transform(F.filter(F.slice(lines, a["label"]["li"] + 2, 2), near), lambda other: F.array_min(F.transform(F.filter(other["cells"], lambda c: c["x0"].between(x0 - 12, x0 + 80)), lambda c: c["x0"])))
        taken = let(beside, lambda b: own(b, F.slice(words, b["at"] + 1, b["stop"] - b["at"])))
        column = lambda o: F.coalesce(F.when(o.isNotNull(), o["x0"]).otherwise(first_of(F.array_compact(under))), x0)
        return let(let(taken, lambda o: F.struct(a["label"]["li"].alias("li"), o.alias("own"), column(o).alias("column"), line["page"].alias("page"), line["y"].alias("y"))), down)

    def down(b: Column) -> Column:
        first = F.when(b["own"].isNotNull(), F.array(F.struct(b["own"]["li"].alias("li"), b["own"]["n"].alias("n"), b["own"]["text"].alias("text")))).otherwise(F.array()).cast(_CELL)
        begin = F.struct(F.lit(True).alias("open"), b["y"].alias("last"), first.alias("cells"))

        def step(s: Column, k: Column) -> Column:
            line = F.get(lines, k)
            mine = F.filter(F.transform(line["cells"], lambda c, n: F.struct(k.alias("li"), n.alias("n"), c["text"].alias("text"), c["x0"].alias("x0"))), lambda c: F.abs(c["x0"] - b["column"]) <= 12)
            mine = F.transform(mine, lambda c: F.struct(c["li"].alias("li"), c["n"].alias("n"), c["text"].alias("text")))
            inside = s["open"] & ~is_table_header(line)

            def after(x: Column) -> Column:
                return F.when(
                    x["inside"],
                    F.struct(
                        ((F.size(x["mine"]) > 0) | (line["y"] - s["last"] <= 30)).alias("open"),
                        F.when(F.size(x["mine"]) > 0, line["y"]).otherwise(s["last"]).alias("last"),
                        F.concat(s["cells"], x["mine"]).alias("cells"),
                    ),
                ).otherwise(F.struct(F.lit(False).alias("open"), s["last"].alias("last"), s["cells"].alias("cells")))

            return F.when(s["open"], let(F.struct(inside.alias("inside"), mine.alias("mine")), after)).otherwise(s)

        below = F.filter(F.slice(places(F.size(lines)), b["li"] + 2, F.size(lines)), lambda k: (F.get(lines, k)["page"] == b["page"]) & (F.get(lines, k)["y"] - b["y"] <= 110))
        return F.aggregate(below, begin, step)["cells"]

    return F.coalesce(F.when(label.isNotNull(), let(F.struct(label.alias("label")), build)), F.array().cast(_CELL))


def by_tax_id(lines: Column, block: Column, country: Column) -> Column:
    """struct(emisor, receptor): the recipient from its block; the issuer is the first identifier outside it, one after an
    identifier label if there is any, and its name stands in the same cell, or above it in its column (130 points)."""

    def split(s: Column) -> Column:
        texts = F.transform(block, lambda c: F.struct(c["text"].alias("text"), F.get(ids_in(c["text"], country), F.lit(0)).alias("id")))
        placed = let(texts, lambda ts: F.struct(ts.alias("texts"), F.array_position(F.transform(ts, lambda t: t["id"].isNotNull()), True).alias("at")))

        def read(b: Column) -> Column:
            others = F.transform(F.filter(b["texts"], lambda t, n: n + 1 != b["at"]), lambda t: t["text"])
            return F.struct(clean_name(first_such(others, _is_name, "string")).alias("nombre"), F.when(b["at"] > 0, F.get(b["texts"], b["at"].cast("int") - 1)["id"]).alias("nif"))

        recipient = let(placed, read)
        return let(F.struct(s["cells"].alias("cells"), recipient.alias("recipient")), issuer)

    def outside(c: Column) -> Column:
        return ~F.exists(block, lambda b: (b["li"] == c["li"]) & (b["n"] == c["n"]))

    def issuer(s: Column) -> Column:
        cue = r"\b(?:" + "|".join(R.ID_CUES) + r")\.?:?\s*"

        def candidates(c: Column) -> Column:
            return F.transform(ids_in(c["text"], country), lambda i: F.struct(c.alias("cell"), i.alias("id"), F.regexp_like(norm(c["text"]), F.concat(F.lit(cue), F.lower(i))).alias("labelled")))

        found = F.flatten(F.transform(F.filter(s["cells"], lambda c: c["text"].rlike(r"\d{4}") & outside(c)), candidates))
        chosen = let(found, lambda f: F.coalesce(first_of(F.filter(f, lambda x: x["labelled"])), first_of(f)))
        return let(F.struct(s.alias("s"), chosen.alias("hit")), named)

    def named(t: Column) -> Column:
        s, hit = t["s"], t["hit"]
        cell = hit["cell"]
        parted = F.when(cell["text"].rlike("[|·ꞏ]"), F.split(cell["text"], r"\s*[|·ꞏ]\s*")).otherwise(F.array(cell["text"]))
        place = lambda pieces: F.array_position(F.transform(pieces, lambda p: F.contains(F.upper(p), hit["id"])), True).cast("int")
        same = let(parted, lambda pieces: first_such(F.slice(pieces, 1, F.greatest(place(pieces) - 1, F.lit(0))), _is_name, "string"))
        above = F.filter(s["cells"], lambda c: (c["page"] == cell["page"]) & (c["li"] < cell["li"]) & (cell["y"] - c["y"] <= 130) & (c["x1"] >= cell["x0"] - 10) & (c["x0"] <= cell["x1"] + 10))
        upwards = F.sort_array(F.transform(above, lambda c: F.struct((-c["li"]).alias("up"), c["n"].alias("n"), c["text"].alias("text"))))
        nearest = first_such(upwards["text"], _is_name, "string")
        anywhere = first_such(F.filter(s["cells"], outside)["text"], _is_name, "string")
        name = F.coalesce(F.when(hit.isNotNull(), F.coalesce(same, nearest)), anywhere)
        return F.struct(F.struct(clean_name(name).alias("nombre"), hit["id"].alias("nif")).cast(_PARTY).alias("emisor"), s["recipient"].cast(_PARTY).alias("receptor"))

    return let(F.struct(cells_flat(lines).alias("cells")), split)


def by_columns(lines: Column, country: Column) -> Column:
    """struct(emisor, receptor) where both are labelled, each in its own column: from a label to the next one, 40 points down.
    Valid identifiers of the document that neither has fill the gaps in order."""

    def anchor(labels: tuple[str, ...]) -> Column:
        place = let(first_label(lines, labels, 3), lambda p: F.struct(p.alias("p"), F.get(lines, p["li"]).alias("line")))
        return let(place, lambda a: F.when(a["p"].isNotNull(), F.struct(a["line"]["page"].alias("page"), a["line"]["y"].alias("y"), F.get(a["line"]["words"], a["p"]["start"])["x0"].alias("x0"))))

    def block(own: Column, other: Column) -> Column:
        right = F.when(other["x0"] > own["x0"] + 1, other["x0"] - 4.0).otherwise(F.lit(float("inf")))
        below = F.filter(lines, lambda line: (line["page"] == own["page"]) & (line["y"] > own["y"]) & (line["y"] - own["y"] <= 40))
        middle = lambda w: (w["x0"] + w["x1"]) / 2
        raw = F.transform(below, lambda line: F.array_join(F.transform(F.filter(line["words"], lambda w: (middle(w) >= own["x0"] - 6.0) & (middle(w) < right)), lambda w: w["text"]), " "))

        def read(b: Column) -> Column:
            texts, ids = b["texts"], b["ids"]
            name = first_of(F.filter(texts, lambda t: t.rlike("[A-Za-zÁ-Úá-ú]{3}") & ~F.exists(ids, lambda i: F.contains(F.upper(t), i))))
            return F.struct(F.trim(name).alias("nombre"), first_of(ids).alias("nif"))

        texts = F.filter(raw, lambda t: t != "")
        return F.when(own.isNotNull(), let(let(texts, lambda t: F.struct(t.alias("texts"), valid_ids_in(F.array_join(t, "\n"), country).alias("ids"))), read))

    def fill(p: Column) -> Column:
        rest = F.filter(p["ids"], lambda i: ~F.coalesce(i == p["e"]["nif"], F.lit(False)) & ~F.coalesce(i == p["r"]["nif"], F.lit(False)))
        taken = p["e"]["nif"].isNull().cast("int")
        return F.struct(
            F.struct(p["e"]["nombre"].alias("nombre"), F.coalesce(p["e"]["nif"], F.get(rest, F.lit(0))).alias("nif")).cast(_PARTY).alias("emisor"),
            F.struct(p["r"]["nombre"].alias("nombre"), F.coalesce(p["r"]["nif"], F.get(rest, taken)).alias("nif")).cast(_PARTY).alias("receptor"),
        )

    text = F.array_join(F.transform(lines, lambda line: line["text"]), "\n")
    anchors = F.struct(anchor(R.ISSUER_LABELS).alias("e"), anchor(R.RECIPIENT_LABELS).alias("r"))
    return let(let(anchors, lambda a: F.struct(block(a["e"], a["r"]).alias("e"), block(a["r"], a["e"]).alias("r"), valid_ids_in(text, country).alias("ids"))), fill)


def parties(lines: Column, country: Column) -> Column:
    """struct(emisor, receptor), each (nombre, nif): by labelled columns where the issuer is labelled, else by tax identifier."""
    labelled = first_label(lines, R.ISSUER_LABELS, 2)
    return F.when(labelled.isNotNull(), by_columns(lines, country)).otherwise(let(recipient_label(lines), lambda label: let(recipient_block(lines, label), lambda block: by_tax_id(lines, block, country))))
