"""The audit over documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ledgerlens.operators.classify import verdict
from ledgerlens.operators.rules import audit
from ledgerlens.operators.schema import from_json_text
from ledgerlens.sources import listing, readers
from ledgerlens.sources.readers import stem


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of invoice records, one JSON file each."""
    text = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return from_json_text(text.select(stem(F.col("_metadata.file_name")).alias("doc_id"), "value"))


def arriving_files(spark: SparkSession, folder: str, **options) -> DataFrame:
    """A stream of all files with their route (`readers.routed`), of those that cannot be read as well; options as in
    `listing.FolderFiles`."""
    return readers.routed(spark.readStream.format(listing.register(spark)).options(path=folder, maxBytes=readers.MAX_FILE_BYTES, **options).load())


def invoices(files: DataFrame) -> DataFrame:
    """The invoice records among routed files."""
    sound = files.filter("error is null and reader = 'json'")
    return from_json_text(sound.select(stem(F.col("path")).alias("doc_id"), F.col("content").cast("string").alias("value")))


def audited(stream: DataFrame, as_of: str) -> DataFrame:
    """The same audit as over a table: it has no state, so it runs on a stream as it is."""
    return audit(stream, as_of).withColumn("estado", verdict())


def counts_by_window(stream: DataFrame, time_col: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Verdicts per window of arrival time; rows later than `late` are left out and their state goes."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), "estado").agg(F.count("*").alias("documents"))


def to_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Each micro-batch goes to `sink` with its number, by which the sink can write a batch twice to the same place."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
