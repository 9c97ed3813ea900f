"""Progress that is told only when it changes: the stream against the table, and over a restart."""

import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.streaming.changes import changes, changes_of_table, use_state_store

START = dt.datetime(2025, 1, 1)
SCHEMA = "job string, ts timestamp, estado string, n int"


def rows_of(minutes):
    return [(job, START + dt.timedelta(minutes=m), estado, n) for job, m, estado, n in minutes]


FIRST = rows_of([("a", 0, "A", 1), ("a", 1, "A", 1), ("a", 2, "B", 1), ("a", 3, "A", 1), ("b", 0, "A", 1), ("b", 2, None, 1), ("b", 3, None, 1), (None, 1, "A", 1)])
SECOND = rows_of([("a", 4, "A", 1), ("a", 5, "A", 2), ("b", 30, None, 1), ("c", 31, "A", 1)])


def counted(rows):
    return collections.Counter((r["key"], r["at"], r["state"]) for r in rows)


def test_changes_over_a_table(spark):
    got = changes_of_table(spark.createDataFrame(FIRST, SCHEMA), "job", "ts", ["estado"]).collect()
    said = [(r["key"], (r["at"] - START).seconds // 60) for r in sorted(got, key=lambda r: (r["key"], r["at"]))]
    assert said == [("a", 0), ("a", 2), ("a", 3), ("b", 0), ("b", 2)]  # A, B, A are three rows
    assert changes_of_table(spark.createDataFrame([], SCHEMA), "job", "ts", ["estado"]).count() == 0


def test_changes_of_a_stream_and_a_restart(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    use_state_store(spark)
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def deliver(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = changes(spark.readStream.schema(SCHEMA).parquet(source), "job", "ts", ["estado", "n"])
        sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/part={number}")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return counted(spark.read.parquet(out).collect())

    table = lambda rows: counted(changes_of_table(spark.createDataFrame(rows, SCHEMA), "job", "ts", ["estado", "n"]).collect())
    assert deliver(FIRST) == table(FIRST)
    # a second query goes on from the checkpoint: nothing is told twice, an idle key is told again
    assert deliver(SECOND) == table(FIRST + SECOND)
    assert sum(table(FIRST + SECOND).values()) == sum(table(FIRST).values()) + 3
