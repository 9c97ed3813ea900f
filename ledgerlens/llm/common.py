"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra or clashing columns of the input never reach a plan."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names its shared folder in spark.checkpoint.dir; a folder of our own is set only where that is unset
    and driver and executors are one process."""
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no shared folder for checkpoints")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def join_by_class(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, share: int = 10_000) -> DataFrame:
    """rows joined with classes, which has one row per key and in `size` how many of `rows` it has. A class of more than a
    10,000th of all rows, of which there are fewer than 10,000, is broadcast, so its rows never meet in one task."""
    total = classes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = classes.filter(F.col(size) > total // share + 1)
    if hot.isEmpty():
        return rows.join(classes, keys)
    calm = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(classes.filter(F.col(size) <= total // share + 1), keys)
    return calm.unionByName(rows.join(F.broadcast(hot), keys))


#: A table of at most so many short rows is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with `at`, from 0 on within each group in the given order (nulls first), and `n`, the rows of the group.

    Rows are sorted in ranges, so a group of any size is dealt over many tasks; what a range starts with is told by the
    counts of the ranges before it, one row per range and group. Ranges are written to the checkpoint before they are
    counted: they depend on a sample, which a second run need not repeat. `order` should leave no ties but equal rows.
    """
    placed = cut(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_row", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_row", 33)))
    of_range = placed.groupBy(*group, "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*group)
    before = F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(of_range.select(*group, "_range", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n")))
    small = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    return placed.join(small, [*group, "_range"]).withColumn("at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_range", "_first", "_before")
