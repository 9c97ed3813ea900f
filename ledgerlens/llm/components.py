"""Connected components by alternating star contraction, as joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut

#: Edges that one task takes: a graph of fewer is one task a round, without a shuffle.
TASK_EDGES = 100_000


def _star(edges: DataFrame, large: bool, hub: int, tasks: int) -> DataFrame:
    """Large star: each node's larger neighbours are linked to the smallest of its neighbours and itself.
    Small star: its smaller neighbours and itself are. Nodes of more than `hub` neighbours, of which there are few, are
    broadcast with their least one, so that no task holds all neighbours of a hub. At most `tasks` partitions."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = both.coalesce(tasks)
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hubs = least.filter(F.col("n") > hub).select("u", F.col("m").alias("of_hub"))
    marked = both.join(F.broadcast(hubs), "u", "left")
    joined = marked.filter("of_hub is not null").select("u", "v", F.col("of_hub").alias("m")).union(marked.filter("of_hub is null").join(least.filter(F.col("n") <= hub), "u").select("u", "v", "m"))
    moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").coalesce(tasks).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs; the result has one row (node, root) per node that is not itself the smallest of its
    component. Each round's edges are checkpointed; the star edges stop changing after about log n rounds. A round has as
    many tasks as its edges need, not as many as the session shuffles to: most graphs here are small, and each task of a
    shuffle leaves files behind."""
    stars = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        hub = now[0] // 5_000 + 1  # so fewer than 10,000 nodes are hubs
        tasks = now[0] // TASK_EDGES + 1
        stars = cut(_star(cut(_star(stars, True, hub, tasks)), False, hub, tasks))
