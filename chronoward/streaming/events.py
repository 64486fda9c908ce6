"""Structured Streaming over event files: tumbling, sliding and session windows, sustained onsets.

Each function takes a streaming (or batch) DataFrame and returns one; ``drain`` runs
a stream over the files that are there and returns its final result as a table in
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from chronoward.session import scratch_folder


def event_stream(spark: SparkSession, d: str, name: str = "events") -> DataFrame:
    """The table's files as a stream, event time with zone UTC for watermarks."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, so that a table stored as one file is accepted like a folder
    return spark.readStream.schema(schema).parquet(path[:-1] + "[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Count and sum per event type and window; late events beyond ``delay`` are dropped."""
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    )


def sliding(events: DataFrame, width: str, step: str, delay: str) -> DataFrame:
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", width, step), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("greatest"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "greatest")
    )


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Activity sessions per user: events less than ``gap`` apart."""
    return (
        events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select("user_id", "n", "first_ts", "last_ts")
    )


def followed_within(first: DataFrame, later: DataFrame, reach: str, delay: str) -> DataFrame:
    """Pairs of a user's event and a later one within ``reach``: an interval join of two streams.

    Both sides have a watermark, so state older than ``reach`` plus ``delay`` is dropped.
    """
    a = first.withWatermark("ts", delay).select(F.col("user_id").alias("user_a"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = later.withWatermark("ts", delay).select("user_id", F.col("event_id").alias("later_id"), F.col("ts").alias("later_ts"))
    near = (F.col("user_a") == F.col("user_id")) & (F.col("later_ts") > F.col("first_ts")) & (
        F.col("later_ts") <= F.col("first_ts") + F.expr(f"interval {reach}")
    )
    return a.join(b, near).select("user_id", "first_id", "later_id", "first_ts", "later_ts")


def sustained_onsets(events: DataFrame, threshold: float, sustain: int, delay: str, idle: str) -> DataFrame:
    """``user_id, onset_us``: the time of each ``sustain``-th consecutive low value of a user.

    State per user: the current run length and the last time seen, dropped when the
    watermark has passed the last event by ``idle`` (a run does not last over such a
    pause). Within a trigger a user's events are ordered by time, so one trigger's
    events of one user are held together: bound a trigger by the source's
    ``maxFilesPerTrigger``. Earlier events that arrive in a later trigger are dropped,
    as a run cannot be reopened.
    """
    pause = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        run, last = state.get if state.exists else (0, -1)
        parts = [np.array([f["t"], f["event_id"], f["value"] <= threshold], dtype=np.int64) for f in frames]
        t, order, low = np.concatenate(parts, axis=1)
        sort = np.lexsort((order, t))
        t, low = t[sort], low[sort]
        low = low[t >= last]
        t = t[t >= last]
        at = np.arange(1, len(t) + 1)
        reset = np.maximum.accumulate(np.where(low == 0, at, 0))
        length = np.where(low == 1, at - reset + np.where(reset == 0, run, 0), 0)
        if len(t):
            state.update((int(length[-1]), int(t[-1])))
            state.setTimeoutTimestamp(max(int(t[-1]) // 1000, state.getCurrentWatermarkMs()) + pause)
        onsets = t[length == sustain]
        yield pd.DataFrame({"user_id": [key[0]] * len(onsets), "onset_us": onsets})

    rows = events.withWatermark("ts", delay).select("user_id", "event_id", "value", "ts", F.unix_micros("ts").alias("t"))
    return rows.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, onset_us long", "run int, last long", "append", "EventTimeTimeout"
    )


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run ``stream`` over everything available and return what it wrote.

    Complete mode rewrites the result at each trigger, append mode adds to it.
    """
    spark = stream.sparkSession
    root = scratch_folder(spark, "stream")
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out")
