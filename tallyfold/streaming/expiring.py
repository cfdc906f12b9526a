"""A cache as keyed state of a stream: each key's latest row, which goes when its kind's time is over.

Event time rules: a row's timer is set for the second after its time and its kind's limit,
and fires when the watermark has passed it, so that the state holds live keys and those of
the watermark's delay. Rows that come later than that delay are left out. Checkpoints hold
the state; live_rows reads it from there, at any time the caller names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import lexicon as L
from ..functions import text as T

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "kind string, value string, micros long, tie long"
CHANGES = "key string, kind string, value string, micros long, tie long, change string"


class ExpiringCache(StatefulProcessor):
    """Keeps the row of the largest (time, tie) of a key until it expires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", STATE)

    def _ends(self, kind: str, micros: int) -> int:
        return (micros // 1_000_000 + L.TTL.get(kind, L.TTL["default"]) + 1) * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = None
        for pdf in rows:
            r = pdf.sort_values(["micros", "tie"]).iloc[-1]
            got = (r["kind"], None if pd.isna(r["value"]) else r["value"], int(r["micros"]), int(r["tie"]))
            if new is None or got[2:] > new[2:]:
                new = got
        old = tuple(self.row.get()) if self.row.exists() else None
        if new is None or (old and old[2:] >= new[2:]):
            return
        if old:
            self.handle.deleteTimer(self._ends(old[0], old[2]))
        self.row.update(new)
        self.handle.registerTimer(self._ends(new[0], new[2]))
        yield self._told(key, new, "put")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.row.exists():
            old = tuple(self.row.get())
            if self._ends(old[0], old[2]) <= expiredTimerInfo.getExpiryTimeInMs():
                self.row.clear()
                yield self._told(key, old, "expired")

    def _told(self, key, row: tuple, change: str) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row, change)], columns=["key", "kind", "value", "micros", "tie", "change"])

    def close(self) -> None:
        pass


def cached(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """key, kind, value, micros, tie, change (put or expired) of a stream of rows (key, kind, value, ts, tie).

    The session needs RocksDB as the provider of state (PROVIDER).
    """
    r = rows.select(F.col("key").cast("string").alias("key"), "kind", F.col("value").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("ts"), F.col("tie").cast("long").alias("tie"))
    r = r.where("key is not null and ts is not null").withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
    return r.groupBy("key").transformWithStateInPandas(statefulProcessor=ExpiringCache(), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime")


def live_rows(spark: SparkSession, checkpoint: str, now) -> DataFrame:
    """key, kind, value, ts, tie of the stream's state that are not older than their kind allows at the time now."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "row").load()
    rows = state.select("key.key", "value.*").select("key", "kind", "value", F.timestamp_micros("micros").alias("ts"), "tie")
    return rows.where(F.unix_timestamp(now) - F.unix_timestamp("ts") <= T.ttl(F.col("kind")))
