"""Progress that is told only when it changes: one keyed state, the last row sent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

EXPIRY_MS = 15 * 60 * 1000
_ROW = "key string, at timestamp, state string"


class LastSent(StatefulProcessor):
    """Keeps per key the state that was sent last and when a row of the key was seen last. A row goes out if its state is
    another one, so a return to an earlier state is told. After `expiry_ms` of event time without a row the key is
    forgotten, and its next row goes out whatever it says."""

    def __init__(self, expiry_ms: int = EXPIRY_MS) -> None:
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, seen_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "state"], kind="stable", na_position="first")
        known = self.last.get() if self.last.exists() else None
        state, seen = (known[0], known[1]) if known else (None, None)
        fresh, kept = known is None, []
        for at, said in zip(batch["at"], batch["state"], strict=True):
            now = at.value // 1_000_000
            if fresh or said != state or now - seen > self.expiry_ms:
                kept.append((at, said))
            state, seen, fresh = said, max(now, seen or now), False
        self.last.update((state, seen))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(seen + self.expiry_ms)
        if kept:
            yield pd.DataFrame({"key": [key[0]] * len(kept), "at": [x[0] for x in kept], "state": [x[1] for x in kept]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _rows(stream: DataFrame, key: str, time_col: str, state: list[str]) -> DataFrame:
    return stream.select(F.col(key).cast("string").alias("key"), F.col(time_col).cast("timestamp").alias("at"), F.to_json(F.struct(*state), {"ignoreNullFields": "false"}).alias("state")).filter("key is not null and at is not null")


def changes(stream: DataFrame, key: str, time_col: str, state: list[str], late: str = "15 minutes", expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """key, at, state (the columns of `state` as JSON): the rows of a stream that differ from the row of their key before.

    A key's rows are taken in order of time, within a micro-batch; a row that comes in a later micro-batch comes later.
    Rows over `late` behind the newest are left out. Rows without a key or a time are too. The state of a key is one
    row, in the state store of the checkpoint, so a restart repeats none. A task holds the rows of one key of one
    micro-batch, which the source's limit of files per trigger bounds. The store needs RocksDB, which `use_state_store`
    names."""
    rows = _rows(stream, key, time_col, state).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(LastSent(expiry_ms), outputStructType=_ROW, outputMode="Append", timeMode="EventTime")


def changes_of_table(table: DataFrame, key: str, time_col: str, state: list[str], expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """The same rows from a whole table, by lag: what a stream that delivers the table in order of time gives."""
    order = Window.partitionBy("key").orderBy("at", "state")
    rows = _rows(table, key, time_col, state).withColumns({"before": F.lag("state").over(order), "seen": F.lag("at").over(order), "n": F.row_number().over(order)})
    idle = F.unix_millis("at") - F.unix_millis("seen") > expiry_ms
    return rows.filter((F.col("n") == 1) | (F.col("state") != F.col("before")) | idle).select("key", "at", "state")


def use_state_store(spark) -> None:
    """Arbitrary state with timers needs RocksDB; other streams of the session may use it as well."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
