"""Importance resampling towards a target, over word tries that live in one partition.

A feature is a run of words; its bucket is the CRC of its bytes. Each task keeps a trie of words: a node stands for the
feature on its path and holds how often it was seen and the CRC state, so a longer feature goes on from the state of the
shorter one. A task hands out its counts by bucket only, at most one row a bucket, and clears its trie when it has grown to
its limit, so its memory is bounded whatever the vocabulary. Bucket totals of corpus and target give each bucket's gain;
a second pass walks the tries with gains attached and sums them along each document's paths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, numbered, pick, text_or_empty

BUCKETS = 10_000
#: Bytes of words as they are, A-Z lower-cased, all others as blanks.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Node(dict):
    """A trie node; its children are made as they are asked for. `crc` is that of the feature's bytes, `gain` its bucket's."""

    __slots__ = ("crc", "count", "gain", "trie")

    def __init__(self, trie: Trie, crc: int) -> None:
        self.trie, self.crc, self.count = trie, crc, 0
        self.gain = trie.gains[crc % trie.buckets] if trie.gains else 0

    def __missing__(self, word: bytes) -> Node:
        trie = self.trie
        node = self[word] = Node(trie, zlib.crc32(word if self is trie.root else b" " + word, self.crc))
        trie.nodes += 1
        return node


class Trie:
    def __init__(self, buckets: int, gains: list[int] | None = None) -> None:
        self.buckets, self.gains, self.nodes = buckets, gains, 0
        self.root = Node(self, 0)

    def features(self, text: str, most: int) -> Iterator[list[Node]]:
        """The nodes of all runs of 1, 2, ... `most` words of a text; those of one length at a time."""
        words = text.encode("utf-8", "replace").translate(_WORDS).split()
        ends = [self.root[w] for w in words]
        yield ends
        for length in range(2, most + 1):
            ends = [node[w] for node, w in zip(ends, words[length - 1 :], strict=False)]
            yield ends

    def all(self) -> Iterator[Node]:
        """Every node but the root."""
        below = list(self.root.values())
        while below:
            node = below.pop()
            below.extend(node.values())
            yield node


def _count(most: int, buckets: int, max_nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie = [0] * buckets, Trie(buckets)

        def settle() -> None:
            for node in trie.all():
                totals[node.crc % buckets] += node.count

        for batch in batches:
            for text in batch.column(0):
                for nodes in trie.features(text.as_py(), most):
                    for node in nodes:
                        node.count += 1
                if trie.nodes > max_nodes:
                    settle()
                    trie = Trie(buckets)
        settle()
        held = [(k, n) for k, n in enumerate(totals) if n]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.int64()) for k in (0, 1)], ["bucket", "times"])

    return run


def bucket_totals(texts: DataFrame, text_col: str = "text", most: int = 1, buckets: int = BUCKETS, max_nodes: int = 500_000) -> DataFrame:
    """bucket, times: how often features of each bucket stand in all texts. Buckets without any have no row."""
    rows = pick(texts, text=text_col).select(text_or_empty().alias("text"))
    return rows.mapInArrow(_count(most, buckets, max_nodes), "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of all buckets, from the two tables of totals: 1000 times the log of how much likelier a feature of the
    bucket is in the target, each bucket counted once more than it was seen, rounded down."""
    both = corpus.select("bucket", F.col("times").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("times").alias("t")))
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    totals = cut(both.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")))
    sums = totals.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    whole = F.lit(float(buckets))
    ratio = (F.col("t") + 1) * (F.lit(sums["s"]) + whole) / ((F.col("s") + 1) * (F.lit(sums["t"]) + whole))
    return totals.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weigh(most: int, buckets: int, gains: list[int], max_nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets, gains)
        for batch in batches:
            out = []
            for text in batch.column(1):
                seen = [list(nodes) for nodes in trie.features(text.as_py(), most)]
                n = sum(map(len, seen))
                out.append((len(seen[0]), n, sum(node.gain for nodes in seen for node in nodes) // n if n else 0))
                if trie.nodes > max_nodes:
                    trie = Trie(buckets, gains)
            words, features, weights = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (words, features, weights)]], ["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(seed: int, doc_id: Column) -> Column:
    """A Gumbel draw told by seed and doc_id alone, in thousandths, rounded down; a null id draws as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", most: int = 1, buckets: int = BUCKETS, min_words: int = 20, percent: int = 10, seed: int = 2024, max_nodes: int = 500_000
) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank, n_words.

    Features are all runs of 1 to `most` words. weight is the floored mean gain of a document's features, 0 without any;
    score adds Gumbel noise, so that the highest scores are a draw without replacement in proportion to the weights.
    Of the N rows of at least `min_words` words the floor(percent * N / 100) highest scores are drawn and numbered in
    `rank`, ties by smaller doc_id, then fewer features; other rows have none. Null texts have no words and are never
    drawn where min_words is above 0. Rows are judged one by one, so ids may repeat or be null (a null id comes first on
    a tie). An empty table gives an empty result, an empty target gains that only tell rare buckets from usual ones;
    other columns of the input are ignored.

    The gains are at most `buckets` numbers, so they are handed to the tasks; texts are read twice and never shuffled.
    """
    made = bucket_gains(bucket_totals(docs, text_col, most, buckets, max_nodes), bucket_totals(target, target_col, most, buckets, max_nodes), buckets)
    gains = [r["gain"] for r in made.orderBy("bucket").collect()]
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    weighed = rows.mapInArrow(_weigh(most, buckets, gains, max_nodes), "doc_id long, n_words long, n_features long, weight long")
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))))
    may = scored.filter(F.col("n_words") >= min_words).withColumn("lower", -F.col("score")).withColumn("all", F.lit(0))
    placed = numbered(may, ["all"], ["lower", "doc_id", "n_features", "n_words", "weight"])
    drawn = placed.withColumn("rank", F.when(F.col("at") < F.floor(F.col("n") * percent / 100), F.col("at") + 1))
    out = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*out).unionByName(rest.select(*out))
