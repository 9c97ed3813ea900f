"""Exact dedup, SimHash groups, near duplicates and repeated strings against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from ledgerlens.llm.bwt import longest_repeats
from ledgerlens.llm.exact_dedup import exact_dedup
from ledgerlens.llm.repeats import remove_repeats
from ledgerlens.llm.simhash import _in_parts, _moved_on, near_duplicate_groups, simhash_groups, trie_pairs


def words(rng, n, size=400):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.mark.parametrize("table_bytes", [48 << 20, 2000])
def test_exact_dedup(frame, odd, empty, table_bytes):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(0, 40)) for _ in range(60)]
    texts += [t.replace(" ", rng.choice(["\n", "  ", "\t \r"])) for t in texts[:30]] + ["hot  text"] * 200 + ["a", " a"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r["doc_id"]: r for r in exact_dedup(frame(list(zip(ids, texts))), table_bytes=table_bytes, fan_out=4).collect()}
    groups = collections.defaultdict(list)
    for i, t in zip(ids, texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    assert len(got) == len(texts)
    for plain, members in groups.items():
        for i in members:
            assert tuple(got[i][c] for c in ("keep_id", "group_size", "kept", "text_sha256")) == (min(members), len(members), i == min(members), hashlib.sha256(plain.encode()).hexdigest())
    rows = exact_dedup(odd).collect()
    assert len(rows) == 10 and {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] in (1, 2, 4, 5)} == {(1, 1, 3), (2, 1, 3), (4, 4, 3), (5, 4, 3)}
    assert [r["kept"] for r in rows if r["doc_id"] is None and r["group_size"] == 1] == [True]
    assert exact_dedup(empty).count() == 0


def test_longest_repeats():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(0, 9, rng.integers(1, 9))
        text = rng.integers(1, 4, sizes.sum())
        depth, ends = int(rng.integers(1, 8)), np.cumsum(sizes)
        suffixes = [(i, tuple(text[i:b])) for a, b in zip(ends - sizes, ends) for i in range(a, b)]
        common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        expected = [max([min(common(x, y), depth) for j, y in suffixes if j != i], default=0) for i, x in suffixes]
        assert longest_repeats(text, sizes, depth, int(rng.integers(1, 5))).tolist() == expected


def covered(texts, length):
    starts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


@pytest.mark.parametrize("settings", [{}, {"hot_contexts": 2}, {"bucket_bytes": 10_000}, {"hot_share": 1 << 40}])
def test_repeated_strings(frame, odd, empty, settings):
    rng = random.Random(5)
    base = [words(rng, rng.randint(5, 250)) for _ in range(12)]
    passage = words(rng, 90)
    texts = base + base[:3] + [words(rng, rng.randint(0, 40)) + passage + words(rng, rng.randint(0, 40)) for _ in range(12)]
    for _ in range(12):
        edited = rng.choice(base).split(" ")
        edited[rng.randrange(len(edited))] = "changed"
        texts.append(" ".join(edited))
    texts += ["a" * 1500, "b" + "a" * 700, "ab" * 600, "x" * 400, "x" * 401, "y" * 400, "", (words(rng, 3) + " ") * 60, "é" * 300 + "q" * 200, "é" * 300 + "q" * 150]
    got = {r["doc_id"]: r for r in remove_repeats(frame(list(enumerate(texts))), **settings).collect()}
    datas = [t.encode() for t in texts]
    for i, mask in enumerate(covered(datas, 400)):
        left = np.frombuffer(datas[i], np.uint8)[~mask].tobytes()
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == (len(datas[i]), int(mask.sum()), runs, hashlib.sha256(left).hexdigest()), i
    if not settings:
        rows = remove_repeats(odd).collect()
        assert len(rows) == 10 and {r["doc_id"] for r in rows if r["n_removed"]} == {6, 7} and remove_repeats(empty).count() == 0


def test_repeated_rows_share_their_spans(frame):
    """Spans are told once for all rows of one id and text, however many there are."""
    from ledgerlens.llm.repeats import repeated_spans

    rng = random.Random(9)
    text, alone = words(rng, 400), words(rng, 300)
    found = {}
    for n in (3, 2000):
        rows = frame([(1, text)] * n + [(2, alone)]).repartition(6).selectExpr("doc_id AS id", "xxhash64(encode(text, 'UTF-8')) AS mark", "encode(text, 'UTF-8') AS data")
        got = repeated_spans(rows).collect()
        assert [r["id"] for r in got] == [1]
        found[n] = len(got[0]["spans"])
    assert found[2000] == found[3] < len(text)
    got = remove_repeats(frame([(1, text)] * 2000 + [(2, alone)])).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert {tuple(r) for r in got} == {(1, len(text), 1, 2000), (2, 0, 0, 1)}


def test_repeats_are_told_by_bytes(frame):
    """Two texts whose blocks follow the Thue-Morse order and its opposite have one polynomial hash modulo 2**64."""
    from ledgerlens.llm.repeats import _BASE, _BYTES, Hashes

    letters = np.frombuffer("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,;:-_+!?".encode(), np.uint8)
    first, second = (x.ravel() for x in np.meshgrid(letters, letters, indexing="ij"))
    low = (_BYTES[first] + _BYTES[second] * _BASE) & np.uint64((1 << 22) - 1)
    order = np.argsort(low, kind="stable")
    at = int(np.flatnonzero(low[order][1:] == low[order][:-1])[0])
    blocks = [bytes([first[k], second[k]]) for k in order[at : at + 2]]
    morse = [k.bit_count() % 2 for k in range(128)]
    rng = random.Random(17)
    lead = "".join(rng.choice("abcdefgh ") for _ in range(144)).encode()
    texts = [lead + b"".join(blocks[b ^ flip] for b in morse) for flip in (0, 1)]
    whole = [int(Hashes(np.frombuffer(t, np.uint8)).of(np.array([0]), np.array([400]))[0]) for t in texts]
    assert len(texts[0]) == 400 and texts[0] != texts[1] and whole[0] == whole[1]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(frame([(i, t.decode()) for i, t in enumerate([*texts, texts[0] + b"x"])])).collect()}
    assert got == {0: 400, 1: 0, 2: 400}


def fingerprint(text):
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    codes = [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + 3]), 42) for i in range(max(1, len(tokens) - 2))] if tokens else []
    return sum((2 * sum(c >> b & 1 for c in codes) > len(codes)) << b for b in range(64))


def components_of(n, edges):
    root = list(range(n))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("leaf_rows", [30_000, 8])
def test_simhash_groups(frame, odd, empty, leaf_rows):
    rng = random.Random(9)
    base = [words(rng, rng.randint(0, 1500)) for _ in range(40)]
    texts = list(base) + ["", "  ", "One", "one two", "ÀÉ x"]
    for _ in range(60):
        edited = rng.choice(base).split(" ")
        edited[rng.randrange(len(edited))] = rng.choice(["", "X", "new"])
        texts.append(" ".join(edited))
    codes = [fingerprint(t) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 2]
    expected = components_of(len(texts), edges)
    got = {r["doc_id"]: r for r in simhash_groups(frame(list(enumerate(texts))), leaf_rows=leaf_rows).collect()}
    assert len(edges) > 15 and [(got[i]["fingerprint"], got[i]["component_id"]) for i in range(len(texts))] == [(f"{c:016x}", e) for c, e in zip(codes, expected)]
    rows = simhash_groups(odd).collect()
    assert len(rows) == 10 and {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1} and simhash_groups(empty).count() == 0


def test_trie_pairs_find_all():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = seeds[rng.integers(0, 60, 200)] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    codes = np.unique(np.concatenate([seeds, near]))
    got = sorted((int(i), int(j)) for x, y in trie_pairs(codes, codes, 0, 2, 0, leaf=4, step=50) for i, j in zip(x, y))
    assert got == sorted((i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 2)


def test_near_duplicates(frame, odd, empty):
    rng = random.Random(4)
    texts = [words(rng, 120) for _ in range(40)]
    for k in range(40):
        edited = texts[k].split(" ")
        for _ in range(k % 4):
            edited[rng.randrange(len(edited))] = "zz"
        texts.append(" ".join(edited))
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = [shingles(t) for t in texts]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_groups(frame(list(enumerate(texts)))).collect()}
    for k in range(40):
        alike = len(sets[k] & sets[k + 40]) / len(sets[k] | sets[k + 40])
        assert got[k] == k and (got[k + 40] == k) == (alike >= 0.8), alike
    rows = near_duplicate_groups(odd).collect()
    assert len(rows) == 10 and {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1} and near_duplicate_groups(empty).count() == 0


def test_near_copies_inside_a_family(frame):
    rng = random.Random(12)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = own(200)
    texts = [f"{passage} {own(45)}" for _ in range(1200)]
    for k in range(1000, 1200):
        edited = texts[k].split(" ")
        for at in rng.sample(range(len(edited)), 3):
            edited[at] = "zz"
        texts.append(" ".join(edited))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_groups(frame(list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(1200)] == list(range(1200))
    assert [k for k in range(1200, 1400) if got[k] != k - 200] == []


def test_links_among_borderline_texts(frame):
    rng = random.Random(21)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = own(210)
    texts = [f"{passage} {own(40)}" for _ in range(300)]
    for k in range(100):
        edited = texts[k].split(" ")
        for at in rng.sample(range(len(edited)), 3):
            edited[at] = "zz"
        texts.append(" ".join(edited))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for bucket_rows in (16_384, 60):
        got = {r["doc_id"]: r["component_id"] for r in near_duplicate_groups(frame(list(enumerate(texts))), bucket_rows=bucket_rows).collect()}
        assert [got[k] for k in range(len(texts))] == components_of(len(texts), edges)


def test_recall_of_near_pairs(frame):
    """Lone pairs and clusters of 31 whose variants are at a similarity of 0.80 to 0.85 from their centre."""
    rng = random.Random(40)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts, pairs = [], []
    for size in [1] * 150 + [30] * 5:
        centre = own(300)
        texts.append(centre)
        at = len(texts) - 1
        for _ in range(size):
            while True:
                edited = list(centre)
                for place in rng.sample(range(len(edited)), 6):
                    edited[place] = f"z{rng.randrange(10**9)}"
                a, b = grams(centre), grams(edited)
                if 0.8 <= len(a & b) / len(a | b) <= 0.85:
                    break
            pairs.append((at, len(texts), size))
            texts.append(edited)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_groups(frame([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    for size in (1, 30):
        hits = [got[i] == got[j] for i, j, s in pairs if s == size]
        assert sum(hits) >= 0.95 * len(hits), (size, sum(hits), len(hits))


def test_large_family_does_not_meet_in_one_task(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = [(0, n, n % 2) for n in range(4000)]
        placed = spark.createDataFrame(large + [(5000 + n, 5000 + n + k, 5000 + n + k) for n in range(0, 40, 2) for k in (0, 1)] + [(7000, 7000 + n, 7000) for n in range(50)], "family long, node long, root long").repartition(8)
        found = _in_parts(placed)
        assert max(map(len, found.rdd.glom().collect())) <= 1000
        assert sorted(map(tuple, found.collect())) == sorted(x for x in map(tuple, placed.collect()) if x[0] != 7000)
        roots = spark.createDataFrame([(n, 1) for n in range(2, 4000)] + [(9001, 9000), (9003, 9002)], "node long, root long").repartition(8)
        moved = _moved_on(roots, spark.createDataFrame([(1, 0), (9002, 9000)], "node long, root long"))
        assert max(map(len, moved.rdd.glom().collect())) <= 1000
        assert sorted(map(tuple, moved.collect())) == [(n, 0) for n in range(1, 4000)] + [(n, 9000) for n in (9001, 9002, 9003)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
