"""Merkle manifest of a dataset with coordinate lookup proofs, in DataFrame operations only.

Rows become leaves; the leaves of a group, in order, are the lowest nodes of its tree, and every 16 neighbours become one
node above. The groups' last nodes (subroots) are the leaves of a top tree, which ends in the root. All nodes are written
as one table (tree, level, at, digest), where `at` is the place within the level.

A proof is found by lookup, without walking the trees: a leaf's place and the size of its group tell the coordinates of all
siblings that it needs, level by level. These coordinates are exploded and joined with the node table, put in order,
concatenated and folded. Leaves of one run of 16 need the same siblings above their run, so these are looked up once for
the run.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import BROADCAST_ROWS, cut, join_by_class, numbered

ARITY = 16
TOP = "top"
#: Top proofs, some kilobytes each, are broadcast up to so many trees.
BROADCAST_TREES = 5_000
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_DEPTHS = [ARITY**k for k in range(15)]


class Manifest(NamedTuple):
    """leaves: the kept columns, tree, at, n, leaf. nodes: tree, level, at, digest, above the leaves. tops: one row per
    tree with its subroot as a leaf of the top tree. root: one row, or none for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    root: DataFrame


def field_bytes(values: Sequence[Column]) -> Column:
    """Values as one text from which each can be told: `-` for null, else its UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def depth(n: Column) -> Column:
    """Levels of a tree of n leaves that have more than one node; a lone leaf has none."""
    return F.size(F.filter(F.array(*[F.lit(k) for k in _DEPTHS]), lambda k: k < n))


def tree_name(group: Column) -> Column:
    """A group's tree: null groups come first, then groups in the order of their UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda x: x["digest"]), "")


def grow(level: DataFrame, depths: int) -> list[DataFrame]:
    """level(tree, at, n, digest) are the lowest nodes; the levels above, each of which is a 16th of the one below."""
    levels = []
    for _ in range(depths):
        runs = level.filter("n > 1").groupBy("tree", F.floor(F.col("at") / ARITY).alias("at"))
        above = runs.agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("place"), "digest"))).alias("run"), F.first("n").alias("n"))
        level = cut(above.select("tree", "at", F.ceil(F.col("n") / ARITY).alias("n"), digest(_joined(F.col("run"))).alias("digest")))
        levels.append(level)
    return levels


def _tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of leaves(tree, at, n, digest): the nodes above them, and tree, n, digest of each tree's last node."""
    depths = leaves.agg(F.max(depth(F.col("n")))).first()[0] or 0
    levels = grow(leaves, depths)
    sizes = leaves.filter("at = 0").select("tree", F.col("n").alias("leaves"))
    lasts = reduce(DataFrame.unionByName, [x.filter("n = 1").select("tree", "digest") for x in [leaves, *levels]])
    none = leaves.filter(F.lit(False)).select("tree", F.lit(0).alias("level"), "at", "digest")
    nodes = reduce(DataFrame.unionByName, [x.select("tree", F.lit(k).alias("level"), "at", "digest") for k, x in enumerate(levels, 1)], none)
    return nodes, lasts.join(sizes, "tree")


def build_manifest(rows: DataFrame, keep: Sequence[str] = ()) -> Manifest:
    """rows(tree, doc_id, leaf, ...) as a manifest; `keep` names further columns that the leaves keep."""
    leaves = cut(numbered(cut(rows.select("tree", "doc_id", "leaf", *keep)), ["tree"], ["doc_id", "leaf"]))
    nodes, lasts = _tree(leaves.select("tree", "at", "n", F.col("leaf").alias("digest")))
    tops = cut(numbered(lasts.select(F.lit(TOP).alias("tree"), F.col("tree").alias("group"), "digest", "leaves"), ["tree"], ["group"]))
    top_nodes, root = _tree(tops)
    return Manifest(leaves, nodes.unionByName(top_nodes), tops, root.select(F.col("digest").alias("root")))


def coordinates(runs: DataFrame) -> DataFrame:
    """runs(tree, run, n): tree, run, level, at, before. The siblings that the leaves of each run need above it."""
    levels = F.sequence(F.lit(1), depth(F.col("n")) - 1)
    steps = runs.filter(depth(F.col("n")) > 1).select("tree", "run", "n", F.explode(levels).alias("level"))
    size = F.lit(ARITY).cast("double")
    own = F.floor(F.col("run") / F.pow(size, F.col("level") - 1))  # whole numbers below 2**53
    last = F.ceil(F.col("n") / F.pow(size, F.col("level"))) - 1
    first = F.floor(own / ARITY) * ARITY
    placed = steps.select("tree", "run", "level", own.alias("own"), F.explode(F.sequence(first, F.least(first + ARITY - 1, last))).alias("at"))
    return placed.filter("at <> own").select("tree", "run", "level", "at", (F.col("at") < F.col("own")).alias("before"))


def look_up(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Coordinates with their digests. The upper levels, where few nodes are asked for by many runs, are broadcast as far as
    they hold at most BROADCAST_ROWS nodes together; each node of a level below is asked for by few."""
    counts = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}  # a row per level
    lowest = min((k for k in counts if sum(v for level, v in counts.items() if level >= k) <= BROADCAST_ROWS), default=max(counts, default=0) + 1)
    key = ["tree", "level", "at"]
    high = asked.filter(F.col("level") >= lowest).join(F.broadcast(nodes.filter(F.col("level") >= lowest)), key)
    return high if all(k >= lowest for k in counts) else high.unionByName(asked.filter(F.col("level") < lowest).join(nodes.filter(F.col("level") < lowest), key))


_STEPS = "array<struct<before:string,after:string>>"


def run_proofs(leaves: DataFrame, nodes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Of leaves(tree, at, n, digest and the columns of `keep`), one row per run: tree, n, members (the leaves in order) and
    above, what has to stand before and after the run's node at each level up to the tree's last node."""
    run = F.floor(F.col("at") / ARITY).alias("run")
    runs = leaves.groupBy("tree", run).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest", *keep))).alias("members"))
    asked = coordinates(leaves.filter(F.col("at") % ARITY == 0).select("tree", run, "n"))
    found = look_up(asked, nodes).groupBy("tree", "run").agg(F.array_sort(F.collect_list(F.struct("level", "at", "before", "digest"))).alias("upper"))
    side = lambda level, before: _joined(F.filter("upper", lambda x: (x["level"] == level) & (x["before"] == before)))
    levels = F.when(depth(F.col("n")) > 1, F.sequence(F.lit(1), depth(F.col("n")) - 1)).otherwise(F.array().cast("array<int>"))
    above = F.transform(levels, lambda level: F.struct(side(level, True).alias("before"), side(level, False).alias("after")))
    none = F.array().cast("array<struct<level:int,at:bigint,before:boolean,digest:string>>")
    return runs.join(found, ["tree", "run"], "left").withColumn("upper", F.coalesce("upper", none)).select("tree", "n", "members", above.alias("above"))


def leaf_steps(runs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Of run_proofs() rows, one row per leaf: digest, the kept columns, all other columns of the run, and steps: what stands
    before and after the leaf's node at each level of its tree."""
    others = [c for c in runs.columns if c not in ("n", "members", "above")]
    each = runs.select("*", F.explode("members").alias("one"))
    beside = lambda test: _joined(F.filter("members", lambda x: test(x["at"], F.col("one.at"))))
    own = F.struct(beside(lambda at, mine: at < mine).alias("before"), beside(lambda at, mine: at > mine).alias("after"))
    lowest = F.when(F.col("n") > 1, F.array(own)).otherwise(F.array().cast(_STEPS))
    return each.select(*others, *[F.col(f"one.{c}").alias(c) for c in ("digest", *keep)], F.concat(lowest, "above").alias("steps"))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, leaf, lambda node, x: digest(F.concat(x["before"], node, x["after"])))


def siblings(steps: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda x: F.concat(x["before"], x["after"])), "")


def merkle_manifest(docs: DataFrame, columns: Sequence[str] = LEAF_COLUMNS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source, n_siblings.

    A leaf is the hash of `columns`. Leaves of one `group_col` ascend by doc_id (null ids first, repeated ids by their
    leaf). folded_root folds the leaf of the row as it is found, whose text is lower-cased (A-Z) where `tampered` holds,
    with the siblings of the manifest; verified tells whether that is the root. A null condition counts as not tampered.

    Null values are leaves like any other (`-`), null groups are one group, which comes first. Equal rows have equal
    leaves, of which each has a place of its own. A table of one row has that leaf as subroot and root and an empty
    proof. An empty table gives an empty result; other columns of the input are ignored.
    """
    values = [docs[c] for c in columns]
    lower = F.translate(docs[text_col], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = digest(field_bytes([lower if c == text_col else docs[c] for c in columns]))
    rows = docs.select(docs[id_col].alias("doc_id"), tree_name(docs[group_col]).alias("tree"), digest(field_bytes(values)).alias("leaf"), F.when(F.lit(False) if tampered is None else tampered, found).alias("found"))
    made = build_manifest(rows, ["found"])
    root = made.root.first()
    of_tree = leaf_steps(run_proofs(made.tops, made.nodes.filter(F.col("tree") == TOP), ["group", "leaves"]), ["group", "leaves"])
    tops = cut(of_tree.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "leaves", F.col("steps").alias("top_steps")))
    runs = run_proofs(made.leaves.withColumnRenamed("leaf", "digest"), made.nodes.filter(F.col("tree") != TOP), ["doc_id", "found"])
    runs = runs.join(F.broadcast(tops), "tree") if tops.count() <= BROADCAST_TREES else join_by_class(runs, tops, ["tree"], "leaves")
    proven = leaf_steps(runs, ["doc_id", "found"]).withColumn("steps", F.concat("steps", "top_steps"))
    folded = proven.withColumn("proof", siblings(F.col("steps"))).withColumn("folded_root", fold(F.coalesce("found", "digest"), F.col("steps")))
    return folded.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(root["root"] if root else None).cast("string").alias("root"),
        digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.lit(root["root"] if root else None)).alias("verified"),
        F.when(F.col("tree").startswith("="), F.expr("substring(tree, 2)")).alias("source"),
        F.expr("length(proof) div 64").alias("n_siblings"),
    )
