"""Batches on disk: one folder per batch, a header table to list them by, and the CSV export."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.batch import expired, flat

RISKY = "=+-@\t\r"


def clean_batch_id(batch_id: str) -> str:
    """Letters, digits, dash and underscore, 64 at most; anything else never reaches a path."""
    kept = re.sub(r"[^A-Za-z0-9_-]", "", batch_id)[:64]
    if not kept:
        raise ValueError(f"no usable batch id in {batch_id!r}")
    return kept


def save(results: DataFrame, folder: str, batch_id: str, source: str, when: str) -> None:
    """Writes results and a header row. The header comes last, so a batch that is listed is whole."""
    batch_id = clean_batch_id(batch_id)
    results.write.mode("overwrite").parquet(f"{folder}/results/batch_id={batch_id}")
    head = results.agg(F.count("*").alias("total"), F.count_if("valid").alias("validas")).select(F.lit(source).alias("origen"), F.lit(when).cast("timestamp").alias("fecha"), "total", "validas")
    head.coalesce(1).write.mode("overwrite").parquet(f"{folder}/headers/batch_id={batch_id}")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Headers, newest first; results are not read."""
    return spark.read.parquet(f"{folder}/headers").withColumn("batch_id", F.col("batch_id").cast("string")).orderBy(F.desc("fecha"), F.desc("batch_id"))


def read(spark: SparkSession, folder: str, batch_id: str) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/results").parquet(f"{folder}/results/batch_id={clean_batch_id(batch_id)}")


def delete(spark: SparkSession, folder: str, batch_id: str) -> bool:
    """Removes the header first. True if there was such a batch."""
    gone = False
    for part in ("headers", "results"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}/batch_id={clean_batch_id(batch_id)}")
        gone |= path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def prune(spark: SparkSession, folder: str, keep: int = 100) -> list[str]:
    """Deletes all but the newest batches; returns their ids."""
    old = [r["batch_id"] for r in expired(listing(spark, folder), keep).select("batch_id").collect()]
    for batch_id in old:
        delete(spark, folder, batch_id)
    return old


def to_json(results: DataFrame, path: str) -> None:
    """The whole batch as JSON, one document a line, fields without a value left in."""
    results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def save_baseline(metrics: DataFrame, path: str, when: str) -> None:
    """Benchmark metrics as the line that later runs are held against; a table of one row."""
    metrics.withColumn("fecha", F.lit(when)).coalesce(1).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """The baseline, or nothing where none was written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.json(path)
    except AnalysisException:
        return None


def to_csv(audited: DataFrame, path: str, guard: bool = True) -> None:
    """The flat export as CSV. With `guard`, a text that a spreadsheet would take for a formula gets an apostrophe."""
    out = flat(audited)
    if guard:
        out = out.select(*[F.when(F.substring(c, 1, 1).isin(*RISKY), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in out.dtypes])
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
