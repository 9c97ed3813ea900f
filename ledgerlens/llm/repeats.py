"""Removal of long repeated byte strings, by merged Burrows-Wheeler transforms of text shards.

Every window of `length` bytes is routed by the least hash of its grams: equal windows meet under one key, wherever they
stand. Neighbouring windows with one key form a context; equal contexts collapse to one with a count. The contexts of
a share of the keys, cut into blocks of 16 bytes aligned at the key's gram, make up shards whose transforms are merged by
interleave refinement; the common prefixes that fall out give the repeated intervals. A window of 400 bytes that covers
24 blocks of such an interval may or may not repeat at its two ragged ends; these, and the few contexts in which the
gram occurs twice, are settled by comparing windows among the contexts of their key. A key with very many contexts is
split by longer grams, down to the window itself, so that no group grows with the corpus.

The polynomial hashes only route and order: what counts as equal is told by a BLAKE2b digest of the bytes (contexts) or
by the bytes themselves (windows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bwt import longest_repeats
from ledgerlens.llm.common import cut, join_by_class, pick

BLOCK = 16
LEVELS = (32, 352, 392, 0)  # gram lengths; 0 stands for the whole window
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_PIECE = 1 << 20  # bytes hashed at a time
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))])
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of all substrings of a byte string, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        power, self.inverse = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of [start, stop), each; lengths go in as well."""
        return _mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n] + np.uint64(size))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima over all runs of `width` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def contexts(texts: list[bytes], length: int, gram: int, longest: int = 512) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts: (text, first start, number of windows, key, digest of the context's bytes as two
    numbers, whether the key's gram stands in it more than once), a row per run of windows with one key. No run crosses
    texts or has over `longest` windows; where the gram is the window, each is a context of its own."""
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    longest = longest if gram else 1
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    if len(data) < length:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(0, bool))
    hashes = Hashes(data)
    grams = hashes.grams(gram or length)
    slack = length - (gram or length)
    keys = _least(grams, slack + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    whole = owner[: len(keys)] == owner[length - 1 :]
    fresh = whole.copy()
    fresh[1:] &= (keys[1:] != keys[:-1]) | ~whole[:-1]
    first = np.flatnonzero(fresh)
    # runs end where the next begins or windows cross into the next text
    stop = np.append(first[1:], len(keys))
    stop = np.minimum(stop, ends[owner[first]] - length + 1)
    count = stop - first
    parts = -(-count // longest)
    lap = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(first, parts) + lap * longest
    count = np.minimum(np.repeat(count, parts) - lap * longest, longest)
    text = owner[first]
    # how often each run's gram stands in its context: few grams are as small as the keys are
    key = keys[first]
    if not len(key):
        return text, first, count, key, np.zeros((0, 2), np.int64), np.zeros(0, bool)
    values, rank = np.unique(key, return_inverse=True)
    near = np.flatnonzero(grams <= values[-1])
    slot = np.minimum(np.searchsorted(values, grams[near]), len(values) - 1)
    same = values[slot] == grams[near]
    placed = np.sort(slot[same] * (len(data) + 1) + near[same])
    low = rank * (len(data) + 1) + first
    times = np.searchsorted(placed, low + count - 1 + slack, side="right") - np.searchsorted(placed, low)
    digest, view = hashlib.blake2b, memoryview(joined)
    codes = b"".join(digest(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (first + count - 1 + length).tolist(), strict=True))
    return text, first - (ends - sizes)[text], count, key, np.frombuffer(codes, np.int64).reshape(-1, 2), times > 1


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Overlapping parts that together hold every window once."""
    for at in range(0, max(len(text) - length + 1, 0), _PIECE):
        yield at, text[at : at + _PIECE + length - 1]


def _route(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row, text in enumerate(batch.column(0)):
                for at, piece in _pieces(text.as_py() or b"", length):
                    held.append((row, at, piece))
                    size += len(piece)
                    if size >= _PIECE:
                        yield _routed(held, batch, length, gram)
                        held, size = [], 0
            if held:
                yield _routed(held, batch, length, gram)

    return run


def _routed(held: list[tuple[int, int, bytes]], batch: pa.RecordBatch, length: int, gram: int) -> pa.RecordBatch:
    text, first, count, key, code, tied = contexts([piece for _, _, piece in held], length, gram)
    rows, at = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    other = [batch.column(k).take(pa.array(rows[text])) for k in range(1, batch.num_columns)]
    names = batch.schema.names[1:]
    columns = [pa.array(first + at[text]), pa.array(count), pa.array(key.view(np.int64)), pa.array(code[:, 0]), pa.array(code[:, 1]), pa.array(tied)]
    return pa.RecordBatch.from_arrays([*other, *columns], [*names, "first", "n", "key", "code", "code2", "tied"])


def _alike(data: np.ndarray, where: np.ndarray, code: np.ndarray, weight: np.ndarray, length: int, step: int = 1 << 15) -> np.ndarray:
    """For windows starting at `where`, of which equal ones have one code: the weight of all windows with the same bytes."""
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    same = np.ones(len(where), bool)
    for at in range(0, len(where), step):
        part = slice(at, at + step)
        same[part] = (windows[where[part]] == windows[where[first[inverse[part]]]]).all(1)
    out = np.bincount(inverse, weight * same)[inverse]
    if not same.all():  # classes of one code and several windows: by their bytes
        mixed = np.isin(inverse, inverse[~same])
        sums: dict[bytes, float] = {}
        for k in np.flatnonzero(mixed).tolist():
            window = windows[where[k]].tobytes()
            sums[window] = sums.get(window, 0) + weight[k]
        out[mixed] = [sums[windows[where[k]].tobytes()] for k in np.flatnonzero(mixed).tolist()]
    return out


def repeated_windows(datas: list[bytes], keys: np.ndarray, counts: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """For each context (keys sorted) the offsets of its windows that also start elsewhere among the contexts of its key.
    A context that occurs more than once repeats as a whole."""
    sizes = np.array([len(d) for d in datas])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    data = np.frombuffer(b"".join(datas), np.uint8)
    hashes = Hashes(data)
    n_windows = sizes - length + 1
    # where the key's gram stands in each context, and whether it does so once
    grams = hashes.grams(gram or length)
    hit = np.flatnonzero(grams == np.repeat(keys, sizes)[: len(grams)])
    owner = np.searchsorted(ends, hit, side="right")
    inside = hit + (gram or length) <= ends[owner]
    hit, owner = hit[inside], owner[inside]
    n_hits = np.bincount(owner, minlength=len(datas))
    at = np.zeros(len(datas), np.int64)
    at[owner[::-1]] = hit[::-1]
    group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    tied = (np.bincount(group, n_hits != 1) > 0)[group]

    # blocks of the contexts whose gram stands once, and their longest repeats from the merged transforms
    use = np.flatnonzero(~tied)
    left = (at[use] - starts[use]) // BLOCK
    n_blocks = left + (ends[use] - at[use]) // BLOCK
    origin = at[use] - left * BLOCK
    index = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    where = np.repeat(origin, n_blocks) + index * BLOCK
    words = np.lib.stride_tricks.sliding_window_view(data, BLOCK)[where] if len(where) else np.zeros((0, BLOCK), np.uint8)
    _, symbols = np.unique(np.ascontiguousarray(words).view(f"V{BLOCK}").ravel(), return_inverse=True)
    full = (length - BLOCK + 1) // BLOCK  # whole blocks that every window of ragged ends covers
    reach = longest_repeats(symbols.astype(np.int64).ravel() + 1, n_blocks, full + 2)

    # a window is in question if the blocks it covers repeat, or if its context is tied
    ask = np.zeros(len(data), bool)
    sure = np.zeros(len(data), bool)
    block_ends = np.cumsum(n_blocks)
    for b in np.flatnonzero(reach >= full):
        k = int(np.searchsorted(block_ends, b, side="right"))
        lo, hi = starts[use[k]], ends[use[k]] - length + 1
        p = int(where[b])
        ask[max(p - BLOCK + 1, lo) : min(p + 1, hi)] = True
        if reach[b] * BLOCK >= length:
            sure[max(p, lo) : min(p + int(reach[b]) * BLOCK - length + 1, hi)] = True
    for k in np.flatnonzero(tied):
        ask[starts[k] : starts[k] + n_windows[k]] = True
    single = np.repeat(counts == 1, sizes)
    open_group = np.zeros(group[-1] + 1, bool)
    of_byte = np.repeat(group, sizes)
    unsettled = ask & ~sure & single
    open_group[of_byte[unsettled]] = True
    where = np.flatnonzero(ask & open_group[of_byte])
    found = sure
    if len(where):
        found[where[_alike(data, where, hashes.of(where, where + length), np.repeat(counts, sizes)[where], length) > 1]] = True
    out = []
    for k in range(len(datas)):
        out.append(np.arange(n_windows[k]) if counts[k] > 1 else np.flatnonzero(found[starts[k] : starts[k] + n_windows[k]]))
    return out


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes covered by windows at the given starts, as maximal [from, to) intervals."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, breaks + 1)].tolist(), (starts[np.append(breaks, len(starts) - 1)] + length).tolist(), strict=True))


_CODE = ["pcode", "pcode2"]
_MARK = "pkey long, pcode long, pcode2 long, spans array<struct<a:int,b:int>>"


def _solve(length: int, gram: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        keys = group.column("key").to_numpy().view(np.uint64)
        counts = group.column("times").to_numpy()
        found = repeated_windows([d.as_py() for d in group.column("data")], keys, counts, length, gram)
        base = group.column("base").to_pylist()
        hit = [k for k, starts in enumerate(found) if counts[k] == 1 and len(starts)]
        spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        marked = pa.array([[{"a": a + base[k], "b": b + base[k]} for a, b in _runs(found[k], length)] for k in hit], spans)
        return group.select(["pkey", *_CODE]).take(pa.array(hit, pa.int64())).append_column("spans", marked)

    return run


def _slices(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
                data, rows = text.as_py(), wanted.as_py()
                parts = [data[r["first"] : r["first"] + r["n"] - 1 + length] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), *(pa.array([r[c] for r in rows], pa.int64()) for c in ("key", "code", "code2", "times"))], ["data", "key", "code", "code2", "times"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, n_spans, digests = [], [], [], []
        for data, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = data.as_py() or b""
            merged: list[list[int]] = []
            for s in sorted((s["a"], s["b"]) for s in spans.as_py() or []):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            sizes.append(len(data))
            removed.append(sum(b - a for a, b in merged))
            n_spans.append(len(merged))
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(rows: DataFrame, length: int = 400, bucket_bytes: int = 4 << 20, hot_contexts: int = 4096, levels: tuple[int, ...] = LEVELS, hot_share: int = 10_000) -> DataFrame:
    """rows(id, mark, data): id and mark tell texts apart. One row per text that has any: id, mark, spans."""
    same = ["key", "code", "code2"]
    routed = cut(rows.select("data", "id", "mark").mapInArrow(_route(length, levels[0]), "id long, mark long, first long, n long, key long, code long, code2 long, tied boolean"))
    distinct = routed.groupBy(*same).agg(F.count("*").alias("times"), F.max("tied").alias("tied"), F.min(F.struct("id", "mark", "first", "n")).alias("one"))
    per_key = distinct.groupBy("key").agg(F.count("*").alias("n_codes"), F.sum("times").alias("n_times"), F.max("tied").alias("any_tied")).filter("n_times > 1 or any_tied")
    live = cut(join_by_class(distinct, cut(per_key.select("key", "n_codes")), ["key"], "n_codes").filter("n_codes > 1 or times > 1 or tied"))

    # bytes of one member of every context that may share windows with another or with itself
    wanted = live.filter("n_codes > 1 or (tied and times = 1)").groupBy("one.id", "one.mark").agg(F.collect_list(F.struct(*same, "times", F.col("one.first").alias("first"), F.col("one.n").alias("n"))).alias("wanted"))
    sliced = rows.join(wanted, ["id", "mark"]).select("data", "wanted").mapInArrow(_slices(length), "data binary, key long, code long, code2 long, times long")
    own = [F.col(c).alias(f"p{c}") for c in same]
    work = cut(sliced.dropDuplicates(same).select(*own, F.lit(0).cast("long").alias("base"), *same, "times", "data"))
    marks = []
    for level, gram in enumerate(levels):
        per_key = work.groupBy("key").agg(F.count_distinct("code", "code2").alias("n_codes"), F.sum(F.length("data")).alias("mass"))
        per_key = cut(per_key)
        counted = join_by_class(work, per_key, ["key"], "n_codes")
        calm = counted.filter(F.col("n_codes") <= hot_contexts) if level + 1 < len(levels) else None
        if calm is not None:
            total = per_key.filter(F.col("n_codes") <= hot_contexts).agg(F.coalesce(F.sum("mass"), F.lit(0))).first()[0]
            buckets = max(1, int(total // bucket_bytes))
            once = calm.dropDuplicates(same) if level else calm
            marks.append(once.groupBy(F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket")).applyInArrow(_solve(length, gram), _MARK))
        if level + 1 == len(levels):
            break
        hot = counted.filter(F.col("n_codes") > hot_contexts)
        if hot.isEmpty():
            break
        # windows of hot keys under longer grams; the parent's place goes along
        finer = hot.select("data", "pkey", *_CODE, "base", F.col("times").alias("ptimes")).mapInArrow(_split(length, levels[level + 1]), "pkey long, pcode long, pcode2 long, base long, ptimes long, key long, code long, code2 long, data binary")
        finer = cut(finer)
        times = finer.groupBy(*same).agg(F.sum("ptimes").alias("times"))
        work = cut(finer.join(times, same).drop("ptimes"))
        spans = F.array(F.struct(F.col("base").cast("int").alias("a"), (F.col("base") + F.length("data")).cast("int").alias("b")))
        marks.append(work.filter("times > 1").select("pkey", *_CODE, spans.alias("spans")))

    found = marks[0]
    for more in marks[1:]:
        found = found.unionByName(more)
    # the spans of a context, and of one that occurs more than once the whole; a context has few windows
    found = found.groupBy("pkey", *_CODE).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = live.filter("times > 1").select(*own, F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    found = found.join(whole.select("pkey", *_CODE), ["pkey", *_CODE], "left_anti").unionByName(whole)
    found = found.select(*[F.col(f"p{c}").alias(c) for c in same], "spans")
    # contexts with more than a 10,000th of all places, of which there are fewer than 10,000, never meet in one task
    most = routed.count() // hot_share + 1
    hot = cut(live.filter(F.col("times") > most).select(*same))
    placed = routed.join(found, same)
    if not hot.isEmpty():
        spans_of_hot = F.broadcast(hot.withColumn("spans", F.lit(None).cast("array<struct<a:int,b:int>>")))
        placed = routed.join(F.broadcast(hot), same, "left_anti").join(found, same).unionByName(routed.join(spans_of_hot, same))
    everything = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + (length - 1)).cast("int").alias("b")))
    shifted = F.transform(F.coalesce("spans", everything), lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b")))
    return placed.select("id", "mark", shifted.alias("spans")).groupBy("id", "mark").agg(F.flatten(F.collect_set("spans")).alias("spans"))  # rows that repeat id and text tell the same


def _split(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            datas = [d.as_py() for d in batch.column(0)]
            text, first, count, key, code, _ = contexts(datas, length, gram)
            take = pa.array(text)
            base = batch.column(4).to_numpy()[text] + first
            parts = [datas[t][f : f + c - 1 + length] for t, f, c in zip(text.tolist(), first.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(take) for k in (1, 2, 3)), pa.array(base), batch.column(5).take(take), pa.array(key.view(np.int64)), pa.array(code[:, 0]), pa.array(code[:, 1]), pa.array(parts, pa.binary())],
                ["pkey", "pcode", "pcode2", "base", "ptimes", "key", "code", "code2", "data"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, bucket_bytes: int = 4 << 20, hot_contexts: int = 4096, hot_share: int = 10_000) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a string of `length` bytes that also starts anywhere else, in the same text or
    another; what is left is joined and hashed. Null and empty texts have no bytes. Rows that repeat an id or a text
    count as texts of their own, so a repeated row is removed where it has `length` bytes; a null id stays null. An
    empty table gives an empty result; other columns of the input are ignored.
    """
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("data").alias("mark"), "data")
    spans = repeated_spans(rows.drop("doc_id"), length, bucket_bytes, hot_contexts, hot_share=hot_share)
    return rows.join(spans, ["id", "mark"], "left").select("doc_id", "data", "spans").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
