"""Exact deduplication by Grace hashing.

Every map task first collapses its own copies, then the distinct contents are dealt by a 64-bit hash. Each task that
receives a share partitions it, again and again by further bits of the hash, to spill files until a bucket fits an
open-addressing table, which compares complete contents. Hot groups of copies arrive as one row per map task.
Spill files are scratch space of one running task, as Spark's own spills are: no other task reads them, they go when
the task ends, and a task that is lost starts again from its shuffle input.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, join_by_class, pick

_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_RUNS = re.compile(rb" {2,}")
_HEAD = struct.Struct("<QqqBI")

CLASS_SCHEMA = "text_sha256 string, keep_id long, group_size long"


def normalise(text: str | None) -> bytes:
    """UTF-8 bytes with each run of blanks as one space; null is the empty text."""
    if not text:
        return b""
    return _RUNS.sub(b" ", text.encode("utf-8", "replace").translate(_BLANKS))


class ContentTable:
    """Open addressing with linear probing over whole contents; an entry is [hash, content, smallest id, rows]."""

    def __init__(self) -> None:
        self.entries: list[list] = []
        self.slots = [-1] * 64
        self.size = 0

    def add(self, code: int, content: bytes, doc_id: int | None, rows: int) -> None:
        mask = len(self.slots) - 1
        at = code & mask
        while (index := self.slots[at]) >= 0:
            entry = self.entries[index]
            if entry[0] == code and entry[1] == content:
                if entry[2] is None or (doc_id is not None and doc_id < entry[2]):
                    entry[2] = doc_id
                entry[3] += rows
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([code, content, doc_id, rows])
        self.size += len(content) + 200
        if len(self.entries) * 2 > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for index, entry in enumerate(self.entries):
            at = entry[0] & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = index
        self.slots = slots


def _pack(code: int, content: bytes, doc_id: int | None, rows: int) -> bytes:
    return _HEAD.pack(code, doc_id or 0, rows, doc_id is None, len(content)) + content


def _records(path: str) -> Iterator[tuple[int, bytes, int | None, int]]:
    with open(path, "rb") as file:
        while head := file.read(_HEAD.size):
            code, doc_id, rows, missing, size = _HEAD.unpack(head)
            yield code, file.read(size), None if missing else doc_id, rows


def grace(records: Iterator[tuple[int, bytes, int | None, int]], folder: str, table_bytes: int, fan_out: int, level: int = 0) -> Iterator[list]:
    """The distinct contents. Rows fill a table; once it is full, what it holds and all further rows go to `fan_out`
    spill files by further hash bits, each then treated alike. Copies collapse before they are spilled, and a bucket
    that holds one hash value only is never split again."""
    table, files, codes = ContentTable(), [], set()
    width = fan_out.bit_length() - 1
    last = level * width >= 64

    def spill(entries: list[list]) -> None:
        for code, content, doc_id, rows in entries:
            files[(code >> max(0, 64 - width * (level + 1))) % fan_out].write(_pack(code, content, doc_id, rows))

    try:
        for record in records:
            table.add(*record)
            if table.size > table_bytes and not last:
                if not files:
                    codes = {e[0] for e in table.entries}
                    if len(codes) == 1:
                        last = True
                        continue
                    files = [open(os.path.join(folder, f"{level}-{k}-{id(table)}"), "wb") for k in range(fan_out)]
                spill(table.entries)
                table = ContentTable()
        if not files:
            yield from table.entries
            return
        spill(table.entries)
        table = ContentTable()
    finally:
        for file in files:
            file.close()
    for file in files:
        yield from grace(_records(file.name), folder, table_bytes, fan_out, level + 1)
        os.remove(file.name)


def _collapse(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = normalise(text.as_py())
                table.add(xxhash.xxh64_intdigest(content), content, doc_id, 1)
                if table.size > table_bytes:
                    yield _rows(table.entries)
                    table = ContentTable()
        if table.entries:
            yield _rows(table.entries)

    return run


def _rows(entries: list[list]) -> pa.RecordBatch:
    codes, contents, ids, rows = zip(*entries, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([c - (1 << 64) if c >> 63 else c for c in codes], pa.int64()), pa.array(contents, pa.binary()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())], ["code", "content", "min_id", "n_rows"])


def _resolve(table_bytes: int, fan_out: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[int, bytes, int | None, int]]:
            for batch in batches:
                for code, content, doc_id, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    yield code & (1 << 64) - 1, content.as_py(), doc_id, rows

        out: list[tuple] = []
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            for _, content, doc_id, rows in grace(records(), folder, table_bytes, fan_out):
                out.append((hashlib.sha256(content).hexdigest(), doc_id, rows))
                if len(out) >= 10_000:
                    yield _classes(out)
                    out = []
        if out:
            yield _classes(out)

    return run


def _classes(out: list[tuple]) -> pa.RecordBatch:
    names, ids, rows = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())], ["text_sha256", "keep_id", "group_size"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [hashlib.sha256(normalise(text.as_py())).hexdigest() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], ["doc_id", "text_sha256"])


def content_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 48 << 20, fan_out: int = 16) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (smallest id), group_size."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    partial = rows.mapInArrow(_collapse(table_bytes), "code long, content binary, min_id long, n_rows long")
    return partial.repartition("code").mapInArrow(_resolve(table_bytes, fan_out), CLASS_SCHEMA)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 48 << 20, fan_out: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of blanks becomes one space; null counts as empty. Rows that repeat
    one id are counted one by one in group_size and share `kept`. A null id is kept only if its whole group has null
    ids. An empty table gives an empty result; other columns of the input are ignored.
    """
    classes = content_classes(docs, id_col, text_col, table_bytes, fan_out)
    members = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests, "doc_id long, text_sha256 string")
    return join_by_class(members, cut(classes), ["text_sha256"], "group_size").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
