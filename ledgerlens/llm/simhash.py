"""SimHash near-duplicates by a self-join of the binary trie of all fingerprints.

The trie is entered by blocks of bits, one of which two fingerprints within the budget share; below a shared block pairs
of nodes are walked down together: differing bits add up, and a pair is pruned as soon as they exceed the budget. Only
a spanning forest of the links of a group leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, join_by_class, pick
from ledgerlens.llm.components import components

_FULL = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 65_536):
        codes = np.array([digest(g, 42) for g in grams[at : at + 65_536]], ">u8")
        ones += np.unpackbits(codes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], ["doc_id", "fp"])

    return pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def trie_pairs(a: np.ndarray, b: np.ndarray, depth: int, budget: int, spent: int, starts: np.ndarray | None = None, step: int = 1 << 18, leaf: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted uint64 arrays that differ in at most `budget` bits; all elements of each array share
    their first `depth` bits, in which the two differ by `spent`. With `a is b`, each unordered pair comes once; then
    `starts` may give where the subtrees at that depth begin, each of which is joined with itself."""
    same = a is b
    begin = np.array([0]) if starts is None else starts
    end, far = np.append(begin[1:], len(a)), np.append(begin[1:], len(b))
    stack = [(begin, end, begin, far, np.full(len(begin), spent), depth)]
    while stack:
        al, ar, bl, br, err, d = stack.pop()
        small = ((ar - al) * (br - bl) <= leaf) | (d == 64)
        if small.any():
            yield from _compare(a, b, al[small], ar[small], bl[small], br[small], budget, same)
            al, ar, bl, br, err = (x[~small] for x in (al, ar, bl, br, err))
        if not len(al):
            continue
        bit = np.uint64(1 << (63 - d))
        high = np.uint64(_FULL ^ ((1 << (64 - d)) - 1))
        am = np.searchsorted(a, (a[al] & high) | bit)
        bm = np.searchsorted(b, (b[bl] & high) | bit)
        twin = (al == bl) & (ar == br) if same else np.zeros(len(al), bool)
        parts = [(al, am, bl, bm, err), (am, ar, bm, br, err), (al, am, bm, br, err + 1)]
        other = ~twin
        parts.append(tuple(x[other] for x in (am, ar, bl, bm, err + 1)))
        al, ar, bl, br, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (al < ar) & (bl < br) & (err <= budget)
        al, ar, bl, br, err = (x[keep] for x in (al, ar, bl, br, err))
        for at in range(0, len(al), step):
            part = slice(at, at + step)
            stack.append((al[part], ar[part], bl[part], br[part], err[part], d + 1))


def _compare(a, b, al, ar, bl, br, budget, same):
    nb = br - bl
    count = (ar - al) * nb
    owner = np.repeat(np.arange(len(al)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    i, j = al[owner] + within // nb[owner], bl[owner] + within % nb[owner]
    near = np.bitwise_count(a[i] ^ b[j]) <= budget
    if same:
        near &= i < j
    if near.any():
        yield i[near], j[near]


class _Forest:
    def __init__(self, size: int) -> None:
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], np.int64)


def _blocks(depth: int, budget: int) -> int:
    """Bits of each of budget + 1 blocks into which what is below `depth` is cut: of two fingerprints that differ in no
    more bits than the budget, one block is equal."""
    return (64 - depth) // (budget + 1)


def _turned(depth: int, by: int) -> Column:
    """The fingerprint `turned` with the bits below `depth` rotated by `by` places, so that another block comes first."""
    if not by:
        return F.col("turned")
    width = 64 - depth
    low = F.col("turned").bitwiseAND(F.lit((1 << width) - 1)) if depth else F.col("turned")
    high = F.shiftleft(F.shiftrightunsigned("turned", width), width) if depth else F.lit(0).cast("long")
    moved = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, width - by))
    return high.bitwiseOR(moved.bitwiseAND(F.lit((1 << width) - 1)) if depth else moved)


def links(points: DataFrame, budget: int = 2, leaf_rows: int = 16_384) -> DataFrame:
    """points(fp, rep), fp distinct. Edges (u, v) between reps whose fingerprints differ in at most `budget` bits:
    enough of them to connect what is connected.

    The trie is entered once for each of budget + 1 blocks of bits, turned so that the block comes first: fingerprints
    within the budget share a subtree under one of them. A subtree of more than `leaf_rows` fingerprints is entered
    again by the blocks of its further bits, down to so few bits that no more can follow; so nothing is dropped, and
    only crowded subtrees are dealt again."""
    ways, depth, out = budget + 1, 0, None
    rows = points.select(F.col("fp").alias("turned"), "rep", F.lit(0).alias("path"))

    def walk(depth: int):
        def run(group: pa.Table) -> pa.Table:
            fp, rep = group.column("turned").to_numpy().view(np.uint64), group.column("rep").to_numpy()
            order = np.argsort(fp)
            heads = fp[order] >> np.uint64(64 - depth)
            crowd = np.flatnonzero((np.append(False, heads[1:] == heads[:-1])) | np.append(heads[1:] == heads[:-1], False))
            order, heads = order[crowd], heads[crowd]
            fp, rep = fp[order], rep[order]
            forest, us, vs = _Forest(len(fp)), [], []
            if len(fp):
                starts = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
                for i, j in trie_pairs(fp, fp, depth, budget, 0, starts):
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        if forest.join(x, y):
                            us.append(int(rep[x]))
                            vs.append(int(rep[y]))
            return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

        return run

    while (size := _blocks(depth, budget)) > 0:
        turns = [F.struct(_turned(depth, k * size).alias("turned"), (F.col("path") * ways + k).alias("path")) for k in range(ways)]
        dealt = rows.select("rep", F.inline(F.array(*turns)))
        depth += size
        dealt = dealt.withColumn("head", F.shiftrightunsigned("turned", 64 - depth))
        counted = dealt.groupBy("path", "head").count()
        last = _blocks(depth, budget) == 0 or 1 << (64 - depth) <= leaf_rows
        crowded = None if last else cut(counted.filter(F.col("count") > leaf_rows).select("path", "head"))
        if crowded is not None and crowded.isEmpty():
            crowded = None
        calm = dealt if crowded is None else dealt.join(crowded, ["path", "head"], "left_anti")
        buckets = max(1, ways * points.count() // leaf_rows)
        found = calm.withColumn("bucket", F.pmod(F.xxhash64("head"), F.lit(buckets)).cast("int")).groupBy("path", "bucket").applyInArrow(walk(depth), "u long, v long")
        out = found if out is None else out.unionByName(found)
        if crowded is None:
            break
        rows = cut(dealt.join(crowded, ["path", "head"], "left_semi").select("turned", "rep", "path"))
    return out.distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2, leaf_rows: int = 16_384) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null, empty and blank texts have fingerprint zero and are linked like any other; equal fingerprints are one point
    of the trie, so copies are never paired. Rows that repeat an id are points of their own texts. A row with a null
    id belongs to its fingerprint's component; component_id is null only if no row of that fingerprint has an id.
    An empty table gives an empty result; other columns of the input are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")))
    known = points.filter("rep is not null").select("fp", "rep")
    roots = components(links(known, budget, leaf_rows))
    classes = points.join(roots, points["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"), "n_rows")
    placed = join_by_class(rows, classes, ["fp"], "n_rows")
    return placed.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SLICES, SLICE_BITS = 16, 28
_WORDS = SLICES * SLICE_BITS // 64
_STRIDE = np.arange(1, _WORDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
#: Places and sizes of three blocks of a slice's code: codes that differ in two bits share one of them.
_BLOCKS = ((0, 10), (10, 9), (19, 9))


def _shingles(text: str, shingle: int) -> set[bytes]:
    words = text.encode("utf-8", "replace").lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def signature(text: str | None, shingle: int = 5) -> bytes:
    """SimHash of SLICES x SLICE_BITS bits over the distinct word shingles; all zero without words."""
    if not text or not text.encode("utf-8", "replace").strip():
        return bytes(8 * _WORDS)
    digest = xxhash.xxh64_intdigest
    grams = _shingles(text, shingle)
    codes = np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64 * _WORDS, np.int64)
    for at in range(0, len(codes), 255):
        x = codes[at : at + 255, None] + _STRIDE
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(codes)).tobytes()


def _slice_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, sig to rep, sig, part, code: the slices of each signature as numbers."""
    for batch in batches:
        bits = np.unpackbits(np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), np.uint8)).reshape(-1, SLICES, SLICE_BITS)
        codes = bits @ (1 << np.arange(SLICE_BITS - 1, -1, -1, dtype=np.int64))
        each = pa.array(np.repeat(np.arange(len(bits)), SLICES))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), pa.array(np.tile(np.arange(SLICES, dtype=np.int32), len(bits))), pa.array(codes.ravel())], ["rep", "sig", "part", "code"])


def _bits_apart(sig: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sig[x] ^ sig[y]).sum(1, dtype=np.int64)


def _spread(owners: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `owners` the places start to start + count: (index into owners, place)."""
    n = count[owners]
    at = np.repeat(np.arange(len(owners)), n)
    return at, start[owners][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def _leaders(sig: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Within each run of rows: the leader of each row, at most `limit` bits from it, and each leader's farthest row."""
    lead, reach = np.arange(len(sig)), np.zeros(len(sig), np.int64)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        left = np.arange(a, b)
        while len(left) > 1:
            apart = _bits_apart(sig, left, left[:1])
            near = apart <= limit
            lead[left[near]], reach[left[0]] = left[0], apart[near].max()
            left = left[~near]
    return lead, reach


def _leader_pairs(codes: np.ndarray, size: int, budget: int, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted codes, repeats included, that share their first `size` bits and differ in at most `budget`."""
    plain, start, count = np.unique(codes, return_index=True, return_counts=True)
    blocks = plain >> np.uint64(64 - size)
    begin = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    twins = np.flatnonzero(count > 1)
    for i, j in chain([(twins, twins)], trie_pairs(plain, plain, size, budget, 0, begin)):
        at, x = _spread(i, start, count)
        far = j[at]
        total = np.cumsum(count[far])
        edges = np.searchsorted(total, np.arange(step, total[-1] + step, step), "right") if len(total) else []
        for a, b in zip([0, *edges], [*edges, len(far)]):
            for k in range(a, b, step):
                own, y = _spread(far[k : min(b, k + step)], start, count)
                own = x[k : min(b, k + step)][own]
                once = own < y
                yield own[once], y[once]


def _slice_links(signed: DataFrame, budget: int, limits: tuple[int, int], bucket_rows: int) -> DataFrame:
    """signed(rep, sig). Edges (u, v, sure) between reps of which one slice differs in at most `budget` bits and the whole
    signatures in at most limits[1]: of each bucket a spanning forest of the sure ones, in at most limits[0] bits, and
    one of all unsure ones, so that no bucket gives more edges than it has rows. An unsure pair is looked at in the first slice
    and block it shares. Two such slices share a block, so each goes to one bucket for each block, where equal blocks are
    joined with themselves. A bucket of too many rows is dealt into salts, and each pair of salts is a group.

    Rows of one slice code are put behind leaders at most limits[0] bits away, which joins them; leaders are paired,
    and the rows behind two leaders that stay apart are compared with each other unless they are too far by the
    distances to their leaders.
    """
    buckets = max(1, signed.count() // bucket_rows)
    turn = lambda at: F.shiftright("code", SLICE_BITS - at).bitwiseOR(F.shiftleft("code", at)).bitwiseAND(F.lit((1 << SLICE_BITS) - 1))
    ways = F.array(*[F.struct(F.lit(k).alias("block"), F.pmod(F.shiftright(turn(at), SLICE_BITS - size), F.lit(buckets)).cast("int").alias("bucket"), turn(at).alias("turned")) for k, (at, size) in enumerate(_BLOCKS)])
    sides = signed.mapInArrow(_slice_codes, "rep long, sig binary, part int, code long").select("part", "rep", "sig", F.inline(ways))
    bucket = ["part", "block", "bucket"]
    full = cut(sides.groupBy(*bucket).count().filter(F.col("count") > 2 * bucket_rows).select(*bucket, F.ceil(F.col("count") / bucket_rows).cast("int").alias("salts")))
    if not full.isEmpty():
        dealt = sides.join(F.broadcast(full), bucket, "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("sig"), F.col("salts")).cast("int"))
        sides = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*bucket, F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi"), "salt", "rep", "sig", "turned")
    else:
        sides = sides.select(*bucket, F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("salt"), "rep", "sig", "turned")

    def walk(group: pa.Table) -> pa.Table:
        _, size = _BLOCKS[group.column("block")[0].as_py()]
        codes = group.column("turned").to_numpy().astype(np.uint64) << np.uint64(64 - SLICE_BITS)
        order = np.argsort(codes)
        codes, rep = codes[order], group.column("rep").to_numpy()[order]
        sig = np.frombuffer(b"".join(x.as_py() for x in group.column("sig")), np.uint64).reshape(len(order), -1)[order]
        forest, edges, loose, unsure, wide = _Forest(len(rep)), [], _Forest(len(rep)), [], []

        part, block, side = group.column("part")[0].as_py(), group.column("block")[0].as_py(), group.column("salt").to_numpy()[order]
        two = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()

        def ask(x: np.ndarray, y: np.ndarray) -> None:
            for at in range(0, len(x), 1 << 16):
                one, other = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                bits = np.unpackbits((sig[one] ^ sig[other]).view(np.uint8), axis=1).reshape(-1, SLICES, SLICE_BITS)
                here = ~(bits[:, :part].sum(2) <= budget).any(1)
                for first_bit, width in _BLOCKS[:block]:
                    here &= bits[:, part, first_bit : first_bit + width].any(1)
                if two:
                    here &= side[one] != side[other]
                one, other = one[here], other[here]
                if len(one) > len(rep):  # most ends are joined by then
                    root = loose.roots()
                    new = root[one] != root[other]
                    one, other = one[new], other[new]
                unsure.extend((a, b) for a, b in zip(one.tolist(), other.tolist(), strict=True) if loose.join(a, b))

        def join(x: np.ndarray, y: np.ndarray) -> None:
            edges.extend((one, other) for one, other in zip(x.tolist(), y.tolist(), strict=True) if forest.join(one, other))

        _, start, count = np.unique(codes, return_index=True, return_counts=True)
        lead, reach = _leaders(sig, start[count > 1], (start + count)[count > 1], limits[0])
        behind = np.flatnonzero(lead != np.arange(len(lead)))
        join(behind, lead[behind])
        leaders, rows = np.flatnonzero(lead == np.arange(len(lead))), np.argsort(lead, kind="stable")
        first = np.searchsorted(lead[rows], np.arange(len(lead) + 1))
        for i, j in _leader_pairs(codes[leaders], size, budget):
            x, y = leaders[i], leaders[j]
            apart = _bits_apart(sig, x, y)
            near = apart <= limits[0]
            join(x[near], y[near])
            open_ = ~near & (apart - reach[x] - reach[y] <= limits[1])
            alone = (first[x + 1] - first[x]) * (first[y + 1] - first[y]) == 1
            ask(x[open_ & alone], y[open_ & alone])
            wide.append((x[open_ & ~alone], y[open_ & ~alone]))
        for one, other in ((a, b) for x, y in wide for a, b in zip(x.tolist(), y.tolist(), strict=True)):
            mine, theirs = rows[first[one] : first[one + 1]], rows[first[other] : first[other + 1]]
            step = max(1, (1 << 20) // len(theirs))
            for at in range(0, len(mine), step):
                if forest.root(one) == forest.root(other):
                    break
                x, y = np.repeat(mine[at : at + step], len(theirs)), np.tile(theirs, len(mine[at : at + step]))
                apart = _bits_apart(sig, x, y)
                near = np.flatnonzero(apart <= limits[0])[:1]
                join(x[near], y[near])
                far = (apart > limits[0]) & (apart <= limits[1])
                ask(x[far], y[far])
        root = forest.roots()
        ends = np.array(edges + [(x, y) for x, y in unsure if root[x] != root[y]], np.int64).reshape(-1, 2)
        u, v = rep[ends[:, 0]], rep[ends[:, 1]]
        return pa.table({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v)), "sure": pa.array(np.arange(len(u)) < len(edges))})

    return sides.groupBy(*bucket, "lo", "hi").applyInArrow(walk, "u long, v long, sure boolean")


def _sets(shingle: int):
    """doc_id, text to doc_id and the sorted 64-bit hashes of its distinct shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for text in batch.column(1):
                grams = _shingles(text.as_py(), shingle)
                held.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary()), pa.array([len(x) for x in held], pa.int64())], ["node", "grams", "size"])

    return run


def _alike(one: list[np.ndarray], other: list[np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of `one` the places in `other` of those it is alike to, by the counts of what they share."""
    sizes = np.array([len(x) for x in other])
    plain, place = np.unique(np.concatenate(other), return_inverse=True)
    owner = np.repeat(np.arange(len(other)), sizes)[np.argsort(place, kind="stable")]
    begin = np.searchsorted(np.sort(place), np.arange(len(plain) + 1))
    for k, mine in enumerate(one):
        at = np.searchsorted(plain, mine)
        at = at[(at < len(plain)) & (plain[np.minimum(at, len(plain) - 1)] == mine)]
        both = np.zeros(len(other), np.int64)
        for start in range(0, len(at), 4096):  # bounds what is held at once
            some = at[start : start + 4096]
            _, places = _spread(some, begin, np.diff(begin))
            both += np.bincount(owner[places], minlength=len(other))
        yield k, np.flatnonzero(both >= similarity * (len(mine) + sizes - both))


def _family_links(members: DataFrame, similarity: float, deal_bytes: int) -> DataFrame:
    """members(family, node, root, grams, size): edges (u, v) between roots of one family that have members alike, a
    spanning forest of each group. A family is dealt into salts of `deal_bytes` to eight times as many, and each pair of
    salts is a group, in which all sets are compared but those of its largest root with each other; pairs are never rows."""
    share = F.greatest(F.lit(deal_bytes), F.least(F.lit(8 * deal_bytes), F.sum("size") / 64))
    salts = cut(members.groupBy("family").agg(F.ceil(F.sum("size") / share).cast("int").alias("salts")).filter("salts > 1"))
    dealt = members.join(F.broadcast(salts), "family", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    sides = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("family", F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi"), "salt", "node", "root", "grams")

    def compare(group: pa.Table) -> pa.Table:
        salt, root, held = group.column("salt").to_numpy(), group.column("root").to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in group.column("grams")]
        plain, name = np.unique(root, return_inverse=True)
        forest, edges = _Forest(len(plain)), []
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        large = name == np.bincount(name).argmax()
        sides = [(np.flatnonzero((salt == lo) & ~large), np.flatnonzero(salt == hi))]
        if lo != hi:
            sides.append((np.flatnonzero((salt == hi) & ~large), np.flatnonzero((salt == lo) & large)))
        for first, second in sides:
            if len(first) and len(second):
                for k, found in _alike([held[x] for x in first], [held[x] for x in second], similarity):
                    mine = int(name[first[k]])
                    edges.extend((mine, x) for x in np.unique(name[second[found]]).tolist() if forest.join(mine, x))
        ends = plain[np.array(edges, np.int64).reshape(-1, 2)]
        return pa.table({"u": pa.array(ends.min(1)), "v": pa.array(ends.max(1))})

    return sides.groupBy("family", "lo", "hi").applyInArrow(compare, "u long, v long")


def _in_parts(placed: DataFrame) -> DataFrame:
    """Of placed(family, node, root) the rows of families with more than one root. Those of a large family never meet in
    one task."""
    families = placed.groupBy("family").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"))
    return join_by_class(placed, cut(families.filter("a <> b").select("family", "n")), ["family"], "n").drop("n")


def _moved_on(roots: DataFrame, moved: DataFrame) -> DataFrame:
    """roots(node, root), in which the roots that are nodes of moved(node, root) have gone over to theirs."""
    new = moved.select(F.col("node").alias("root"), F.col("root").alias("new"))
    classes = cut(roots.groupBy("root").agg(F.count("*").alias("n")).join(new, "root", "left"))
    return join_by_class(roots, classes, ["root"], "n").select("node", F.coalesce("new", "root").alias("root")).union(moved)


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, budget: int = 2, bucket_rows: int = 16_384, deal_bytes: int = 4 << 20) -> DataFrame:
    """One row per input row: doc_id, component_id (smallest doc_id reachable).

    Documents are near duplicates if the Jaccard similarity of their sets of word shingles is `similarity` or more.
    Pairs are found by a trie self-join of each 28-bit slice of a 448-bit SimHash: a pair at the threshold itself shares
    one of the 16 slices but for `budget` bits with a probability of 0.96, one at 0.85 with 0.99. The differing bits of
    the whole SimHash settle pairs that are clearly alike or not. What pairs in between chain together is a family; in a
    family that sure links leave in parts, all texts of different parts are compared by their sets of shingles (as 64-bit
    hashes), inside tasks. So every pair that shares a slice is judged, those of one slice code too, and pairs are never
    rows. Rows of equal SimHash are one; rows that repeat an id stand for one text. Nulls, empty texts, repeated rows,
    empty tables and further columns are treated as in `simhash_groups`.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits, error = SLICES * SLICE_BITS, np.sqrt(share * (1 - share) * SLICES * SLICE_BITS)
    limits = (int(bits * share - 2.5 * error), int(bits * share + 2.5 * error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signature(t.as_py(), shingle) for t in batch.column(1)], pa.binary())], ["doc_id", "sig"])

    rows = cut(pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sig binary"))
    points = cut(rows.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")))
    signed = points.filter("rep is not null").select("rep", "sig")
    edges = cut(_slice_links(signed, budget, limits, bucket_rows))
    roots = cut(components(edges.filter("sure").select("u", "v")))
    if not edges.filter("not sure").isEmpty():
        chained = cut(components(edges.select("u", "v")))
        nodes = chained.select("node", F.col("root").alias("family")).union(chained.select("root", "root").distinct())
        placed = cut(nodes.join(roots, "node", "left").select("family", "node", F.coalesce("root", "node").alias("root")))
        open_ = cut(_in_parts(placed))
        texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
        sets = texts.join(open_.select("node"), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(_sets(shingle), "node long, grams binary, size long")
        found = _family_links(open_.join(sets, "node"), similarity, deal_bytes)
        roots = cut(_moved_on(roots, cut(components(cut(found)))))
    classes = points.join(roots, points["rep"] == roots["node"], "left").select("sig", F.coalesce("root", "rep").alias("component_id"), "n_rows")
    return join_by_class(rows, classes, ["sig"], "n_rows").select("doc_id", "component_id")
