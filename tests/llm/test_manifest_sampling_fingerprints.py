"""Merkle manifest, importance resampling and fingerprints against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle
from ledgerlens.llm.common import numbered
from ledgerlens.llm.fingerprints import compare_with_next, differing, fingerprint_documents, likeness, parse, parts, render, tree
from ledgerlens.llm.importance import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def whole(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("ranges", [1, 7])
def test_numbered(spark, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        rows = [("hot", k % 500 or None, str(k % 3)) for k in range(2000)] + [("b", 1, "x"), ("b", 1, "x"), ("a", None, "y")]
        got = numbered(spark.createDataFrame(rows, "g string, i long, t string").repartition(5), ["g"], ["i", "t"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for group in ("hot", "a", "b"):
        mine = sorted((r for r in got if r["g"] == group), key=lambda r: r["at"])
        assert [r["at"] for r in mine] == list(range(len(mine))) and {r["n"] for r in mine} == {len(mine)}
        assert [(r["i"], r["t"]) for r in mine] == sorted(((i, t) for g, i, t in rows if g == group), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_tree(nodes):
    steps, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(places):
            run = p // 16 * 16
            steps[i].append((nodes[run:p], nodes[p + 1 : run + 16]))
            places[i] = p // 16
        nodes = [sha(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], steps


def plain_manifest(rows):
    leaf = lambda r: sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    trees = []
    for group in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        members = sorted(groups[group], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((members, *plain_tree([leaf(r) for r in members])))
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (members, subroot, paths), top in zip(trees, tops):
        for r, path in zip(members, paths):
            seen = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                seen = (*r[:4], r[4].translate(LOWER))
            folded = leaf(seen)
            for before, after in path + top:
                folded = sha(*before, folded, *after)
            out.append((r[0], leaf(r), subroot, root, sha(*[x for step in path + top for side in step for x in side]), folded, folded == root))
    return whole(out)


def proven(docs):
    return whole(tuple(r)[:7] for r in merkle.merkle_manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect())


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows(n):
    rng = random.Random(n)
    rows = [(i if i % 97 else None, rng.choice(["a", "b", "é", "", None, "zz"]) if i % 3 else "hot", "en" if i % 7 else None, i, rng.choice([None, "", f"Some Text {i}", "plain"])) for i in range(n)]
    return rows + [(5, "x", "en", 1, "Tie A"), (5, "x", "en", 1, "Tie B"), (5, "x", "en", 1, "Tie A"), (9999, "solo", "en", 1, "One")]


@pytest.mark.parametrize("rows", [manifest_rows(1200), manifest_rows(1200)[:1], [(i, "s", "en", 1, "T") for i in range(17)], [(i, f"s{i:03}", "en", 1, "T") for i in range(40)]])
def test_manifest(spark, rows):
    assert proven(spark.createDataFrame(rows, DOCS).repartition(5)) == plain_manifest(rows)


def test_manifest_by_shuffle(spark, monkeypatch):
    """Nodes and trees beyond the bounds of broadcast are joined by shuffle."""
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 4)
    monkeypatch.setattr(merkle, "BROADCAST_TREES", 2)
    rows = manifest_rows(1200)
    assert proven(spark.createDataFrame(rows, DOCS)) == plain_manifest(rows)


def test_manifest_awkward(spark):
    empty = spark.createDataFrame([], DOCS)
    assert proven(empty) == []
    clashing = spark.createDataFrame([(i, "s", "en", 1, "T", 0, "y") for i in range(20)], f"{DOCS}, at int, tree string")
    rows = merkle.merkle_manifest(clashing).collect()
    assert len(rows) == 20 and all(r["verified"] for r in rows) and {r["n_siblings"] for r in rows} == {16, 4}
    long = "Very long text. " * 100_000
    two = merkle.merkle_manifest(spark.createDataFrame([(1, "s", "en", 1, long), (2, "s", "en", 1, long)], DOCS), tampered=F.col("doc_id") == 2).collect()
    assert {r["doc_id"]: r["verified"] for r in two} == {1: True, 2: False}


def plain_resample(docs, target, most=1):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    runs = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(1, most + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x in docs for f in runs(x)), Counter(bucket(f) for x in target for f in runs(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (all_s + 10_000) / ((s[k] + 1) * (all_t + 10_000)))) for k in range(10_000)]
    out = []
    for i, x in docs:
        features = runs(x)
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    may = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for place, r in enumerate(may[: len(may) * 10 // 100], 1):
        r[4] = place
    return whole(out)


@pytest.mark.parametrize(("most", "max_nodes"), [(1, 500_000), (1, 3), (3, 500_000), (2, 50)])
def test_resample(spark, frame, most, max_nodes):
    rng = random.Random(7)
    words = ["a", "Bc", "dé", "É", "x1", "the", "The", "ñu", "zz-top", "3.5"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs += [(None, "word " * 30), (None, "word " * 30), (4, "a " * 25), (4, "a " * 25), (500, None), (501, ""), (502, " \n.,"), (503, "x y " * 20_000)]
    target = [(1, "the a bc bc"), (2, None), (3, "É x1")]
    got = whole(resample(frame(docs).repartition(3), frame(target), most=most, max_nodes=max_nodes).collect())
    assert got == plain_resample(docs, [t for _, t in target], most)


def test_resample_empty(frame, odd, empty):
    assert resample(empty, odd).count() == 0
    rows = resample(odd, empty, min_words=1, percent=100).collect()
    assert len(rows) == 10 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 7)) and all(r["rank"] is None for r in rows if r["n_words"] == 0)


def texts(rng, n):
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(rng.randint(1, 40))) + rng.choice([".", "\n", "\n\n"])
    return ["".join(line() for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_trees():
    rng = random.Random(2)
    for text in [*texts(rng, 40), "", " ", "\n\n\n", "x", "ab" * 5000, "Der " * 3000, "# head\ntext\n# head\ntext", "é ñ. " * 40]:
        made = tree(text)
        assert parse(render(made)) == made and made[1] == len(text) and "".join(parts(text)) == text
        assert tree(text) == made and likeness(made, made) == 1.0 and differing(made, made) == []
        # an edit in the middle is found where it is, and leaves the other branches alone
        if len(text) > 400 and " " in text[:200]:
            at = len(text) // 2
            other = tree(text[:at] + " changed here " + text[at + 10 :])
            spans = differing(made, other)
            if text[:4] * 2 != text[:8]:  # in one word over and over, any of them may be told as the edited one
                assert spans[0][0] <= at + 1 and spans[-1][1] >= at + 9  # a blank may stand for a blank
            assert likeness(made, other) > 0.4 and all(0 <= a < b <= len(text) for a, b in spans)
    a, b = texts(rng, 2)
    assert likeness(tree(a), tree(b)) < 0.2
    assert tree("a b")[0] != tree("a\nb")[0] != tree("ab")[0]


def plain_next(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, sha(r[1] or "")))
    out = []
    for k, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = tree(text), tree(edited), tree(following)
        out.append((i, len(text), sha(edited), render(a), render(b), likeness(a, b), likeness(a, c)))
    return whole(out)


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_compare_with_next(spark, frame, odd, empty, ranges):
    rng = random.Random(3)
    rows = [(i * 3, t) for i, t in enumerate(texts(rng, 60))] + [(7, "hot row. it is.")] * 2500 + [(7, f"same id, text {k}") for k in range(200)] + [(1, None), (2, ""), (None, "no id"), (None, None)]
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = compare_with_next(frame(rows).repartition(6)).collect()
        assert whole(tuple(r)[:7] for r in got) == plain_next(rows)
        assert len(compare_with_next(odd).collect()) == 10 and compare_with_next(empty).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    by_text = {}
    for r in fingerprint_documents(frame(rows).dropDuplicates()).collect():
        by_text.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert all(len(sizes) == 1 for sizes in by_text.values()) and len(by_text) == len({t or "" for _, t in rows})
    # half of a text stays: its branches do too
    close = [r["near_edited"] for r in got if r["n_chars"] > 100]
    assert min(close) > 0.3
