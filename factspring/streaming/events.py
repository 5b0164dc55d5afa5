"""Event streams: windows with a watermark, sessions, first-seen rows, idempotent batches, a state per user."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(folder)


def windowed(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and kind; works on a table and on a stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    g = source.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    source = events.withWatermark("ts", late) if events.isStreaming else events
    g = source.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it is delivered."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def _running(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for frame in frames:
        n, total = n + len(frame), total + float(frame["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def running_totals(events: DataFrame) -> DataFrame:
    """A running count and sum of each user, kept in state."""
    ship(events.sparkSession)
    return events.groupBy("user_id").applyInPandasWithState(_running, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def idempotent_sink(folder: str):
    """For ``foreachBatch``: a batch that is delivered again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(str(PurePosixPath(folder) / f"batch={number}"))

    return write
