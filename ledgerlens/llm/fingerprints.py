"""Fingerprints of documents as Merkle trees over sections, paragraphs and their parts.

A text is cut into sections (ended by an empty line, before a heading, or after a paragraph that its own hash elects),
these into paragraphs (lines), and a paragraph into runs of words, shorter ones at its start. A part's hash is that
of its bytes, a hash above that of the hashes below; so equal roots are equal texts, and where roots differ, only branches
that differ are followed down to the parts that were edited. All cuts depend on what stands near them and not on their
place, so an edit changes the branches that hold it and no others.

The fingerprint is the tree as text: the root, and for each section, paragraph and part a shortened hash, parts with their
length in characters.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import pick, text_or_empty

#: Texts of at most so many characters are cut into pieces of three; a run has to have so many at most before it may end,
#: which one word in so many does.
SHORT_TEXT, LONG_RUN, ONE_IN = 48, 64, 4
_LINE = re.compile(r"[^\n]*\n+|[^\n]+")
_WORD = re.compile(r"\s*\S+\s*|\s+")
_ROOT, _SECTION, _PARAGRAPH, _PART = 32, 8, 8, 6  # hexadecimal digits that a fingerprint shows

#: A node of a tree: its shown hash, its length in characters, its children (none of a part).
Node = tuple[str, int, tuple]


def _hash(level: bytes, content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16, person=level).digest()


def parts(paragraph: str) -> list[str]:
    """Runs of words, each ended by a word that its own hash elects once the run is long enough, or by any word once it is
    three times as long. Runs grow along the paragraph, from single words on, so a short paragraph has several too, and
    what follows later in a paragraph never changes the runs before."""
    out, run, size, before = [], [], 0, 0
    for word in _WORD.findall(paragraph):
        run.append(word)
        size += len(word)
        least = min(4 + before // 4, LONG_RUN)
        if size >= least and (size >= 3 * least or zlib.crc32(word.encode("utf-8", "replace")) % ONE_IN == 0):
            out.append("".join(run))
            before += size
            run, size = [], 0
    if run:
        out.append("".join(run))
    return out


def tree(text: str) -> Node:
    """The tree of a whole text; the parts in their order are the text."""
    sections, held, shas, section_shas = [], [], [], []

    def close() -> None:
        sha = _hash(b"section", b"".join(shas))
        sections.append((sha.hex()[:_SECTION], sum(p[1] for p in held), tuple(held)))
        section_shas.append(sha)
        held.clear()
        shas.clear()

    for line in _LINE.findall(text):
        if held and line.startswith("#"):
            close()
        cut = parts(line) if len(text) > SHORT_TEXT else [line[k : k + 3] for k in range(0, len(line), 3)]
        hashes = [_hash(b"part", x.encode("utf-8", "surrogatepass")) for x in cut]
        sha = _hash(b"paragraph", b"".join(hashes))
        held.append((sha.hex()[:_PARAGRAPH], len(line), tuple((h.hex()[:_PART], len(x), ()) for h, x in zip(hashes, cut, strict=True))))
        shas.append(sha)
        if line.endswith("\n\n") or sha[0] % 8 == 0:
            close()
    if held:
        close()
    return _hash(b"root", b"".join(section_shas)).hex()[:_ROOT], sum(s[1] for s in sections), tuple(sections)


def render(root: Node) -> str:
    return root[0] + "".join("/" + s[0] + "".join(";" + p[0] + "".join(f",{x[0]}{x[1]}" for x in p[2]) for p in s[2]) for s in root[2])


def parse(fingerprint: str) -> Node:
    """The tree that render() gave."""
    root, *sections = fingerprint.split("/")
    made = []
    for section in sections:
        name, *paragraphs = section.split(";")
        below = []
        for paragraph in paragraphs:
            sha, *cut = paragraph.split(",")
            leaves = tuple((x[:_PART], int(x[_PART:]), ()) for x in cut)
            below.append((sha, sum(x[1] for x in leaves), leaves))
        made.append((name, sum(p[1] for p in below), tuple(below)))
    return root, sum(s[1] for s in made), tuple(made)


def differing(mine: Node, other: Node) -> list[tuple[int, int]]:
    """Spans [start, stop) of the first text, in characters, whose branches the second one has not. Equal roots have none;
    else branches are matched by hash, each at most once, those that both texts begin or end with first, and only those
    left over are followed down."""
    if mine[0] == other[0]:
        return []
    left, right, spans = list(_below([(0, mine)])), list(other[2]), []
    while left:
        lead = _alike((node for _, node in left), right)
        left, right = left[lead:], right[lead:]
        tail = _alike((node for _, node in reversed(left)), reversed(right))
        left, right = left[: len(left) - tail], right[: len(right) - tail]
        have = Counter(node[:2] for node in right)
        gone, kept = Counter(), []
        for start, node in left:
            if gone[node[:2]] < have[node[:2]]:
                gone[node[:2]] += 1
            elif node[2]:
                kept.append((start, node))
            else:
                spans.append((start, start + node[1]))
        rest = []
        for node in right:
            if gone[node[:2]]:
                gone[node[:2]] -= 1
            else:
                rest.append(node)
        left, right = list(_below(kept)), [child for node in rest for child in node[2]]
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if merged and merged[-1][1] == start:
            merged[-1] = (merged[-1][0], stop)
        else:
            merged.append((start, stop))
    return merged


def _alike(mine: Iterable[Node], other: Iterable[Node]) -> int:
    """How many nodes both begin with."""
    n = 0
    for a, b in zip(mine, other, strict=False):
        if a[:2] != b[:2]:
            break
        n += 1
    return n


def _below(nodes: list[tuple[int, Node]]) -> Iterator[tuple[int, Node]]:
    for start, node in nodes:
        for child in node[2]:
            yield start, child
            start += child[1]


def likeness(mine: Node, other: Node, spans: list[tuple[int, int]] | None = None) -> float:
    """Share of both texts, by characters, that stands in branches of both; 1 for equal roots, 0 where no part is shared."""
    if mine[0] == other[0]:
        return 1.0
    spans = differing(mine, other) if spans is None else spans
    return 2 * (mine[1] - sum(b - a for a, b in spans)) / (mine[1] + other[1])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [tree(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[1] for t in trees], pa.int64()), pa.array([render(t) for t in trees], pa.string())], ["doc_id", "n_chars", "fingerprint"])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, fingerprint. Nothing is shuffled. A null text is the empty one, whose tree is a
    root alone; ids are handed on as they are."""
    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_each, "doc_id long, n_chars long, fingerprint string")


Key = tuple[bool, int, str]


def _key(doc_id: int | None, sha: str) -> Key:
    """Order of rows: null ids first, then by id, then by the hash of the text."""
    return doc_id is not None, doc_id or 0, sha


def range_starts(rows: DataFrame, ranges: int, per_range: int = 20) -> tuple[list[Key], bool]:
    """First keys of at most `ranges` ranges of about equal length of text, from a sample of the keys of rows(doc_id, sha,
    size); and whether a key is so frequent in it that its copies should be dealt out again. The sample, of about
    `ranges * per_range` keys, decides where ranges begin and nothing else. The very first key is exact."""
    n = rows.count()
    if n == 0:
        return [], False
    sample = rows if n <= ranges * per_range else rows.sample(ranges * per_range / n, seed=7)
    keys = sorted((_key(r["doc_id"], r["sha"]), r["size"]) for r in sample.collect())
    least = rows.agg(F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.min("doc_id").alias("least")).first()
    least_id = None if least["nulls"] else least["least"]
    first = _key(least_id, rows.filter(F.col("doc_id").eqNullSafe(F.lit(least_id).cast("long"))).agg(F.min("sha")).first()[0])
    starts, share, seen = [first], sum(size + 100 for _, size in keys) / ranges, 0
    for key, size in keys:
        if seen >= share * len(starts) and key > starts[-1]:
            starts.append(key)
        seen += size + 100
    return starts, max(Counter(key for key, _ in keys).values(), default=0) > per_range // 2


_DEALT = "target int, tail boolean, doc_id long, sha string, text string, times long"


def _deal(starts: list[Key]):
    """Each row to its range; the first row of a range also goes to the range before, behind its rows, and the very first to
    the last range. Of equal rows a task sends one with its text and the number of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again: Counter = Counter()
        seen: set[Key] = set()
        firsts = {key: (k - 1) % len(starts) for k, key in enumerate(starts)}
        for batch in batches:
            out = []
            for doc_id, sha, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                key = _key(doc_id, sha)
                if key in seen:
                    again[key] += 1
                    continue
                seen.add(key)
                text = text.as_py()
                out.append((bisect_right(starts, key) - 1, False, doc_id, sha, text, 1))
                if key in firsts:
                    out.append((firsts[key], True, doc_id, sha, text, 1))
            yield _record(out)
        yield _record([(bisect_right(starts, key) - 1, False, key[1] if key[0] else None, key[2], None, n) for key, n in again.items()])

    return run


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["target", "tail", "doc_id", "sha", "text", "times"])


_COMPARED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edit_start", pa.int64()), ("edit_stop", pa.int64()), ("times", pa.int64())])
COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_start long, edit_stop long"
_COPIES = 1000


def _compare(doc_id: int | None, text: str, mine: Node, following: str, other: Node) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    made = tree(edited)
    spans = differing(mine, made)
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
        render(mine),
        render(made),
        likeness(mine, made, spans),
        likeness(mine, other),
        spans[0][0] if spans else None,
        spans[-1][1] if spans else None,
    )


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, each held until the next one is there."""
    out: list[tuple] = []
    held: list | None = None  # target, doc_id, sha, text, tree, times

    def settle(following: str, other: Node) -> None:
        _, doc_id, _, text, mine, times = held
        out.append((*_compare(doc_id, text, mine, following, other), 1))
        if times > 1:  # equal rows follow each other
            same = _compare(doc_id, text, mine, text, mine)
            out.extend((*same, min(_COPIES, times - 1 - k)) for k in range(0, times - 1, _COPIES))

    for batch in batches:
        for target, tail, doc_id, sha, text, times in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), batch.column(5).to_pylist(), strict=True):
            if held and held[:3] == [target, doc_id, sha] and not tail:
                held[5] += times
                continue
            if held or not tail:
                text = text.as_py()
                node = tree(text)
                if held:
                    settle(text, node)
                held = None if tail else [target, doc_id, sha, text, node, times]
        if len(out) >= 500:
            yield pa.RecordBatch.from_pylist([dict(zip(_COMPARED.names, row, strict=True)) for row in out], _COMPARED)
            out.clear()
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(_COMPARED.names, row, strict=True)) for row in out], _COMPARED)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    edit_start, edit_stop.

    The edited text is the row's own with its last floor(n_chars / 2) characters replaced by the first as many (or all) of
    the next row's text; near_edited and near_next are the likeness of the row's fingerprint to that of the edited and of
    the next text. edit_start and edit_stop bound the branches of the row that the edited text has not (null: equal).
    Rows ascend by doc_id, null ids first, rows of one id by the hash of their text; after the last comes the first. Equal
    rows follow each other. Null texts are empty, a row alone follows itself, an empty table gives an empty result; other
    columns of the input are ignored.

    Texts are shuffled once, dealt by ranges of doc_id that hold about equally much text (as many as there are shuffle
    partitions); a task holds one text and the next. Copies of one row are counted where they are read.
    """
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    keyed = rows.select("doc_id", F.sha2("text", 256).alias("sha"), "text")
    starts, hot = range_starts(keyed.select("doc_id", "sha", F.length("text").alias("size")), ranges)
    if not starts:
        return docs.sparkSession.createDataFrame([], COMPARED)
    dealt = keyed.mapInArrow(_deal(starts), _DEALT).repartitionById(len(starts), F.col("target"))
    ordered = dealt.sortWithinPartitions("target", "tail", "doc_id", "sha", F.col("text").isNull())
    compared = ordered.mapInArrow(_follow, f"{COMPARED}, times long")
    if hot:
        compared = compared.repartition(ranges)
    return compared.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "copy")
