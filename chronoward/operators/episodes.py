"""Episodes: maximal runs of event steps, sustained starts and longest runs.

All take one row per (keys, minute) with a boolean ``event``; missing minutes end a
run. A run's label is the minute minus its place among the event minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Steps per block; a long series is worked on block by block.
BLOCK = 4096


def runs(bins: DataFrame, keys: list[str], flag: str = "event") -> DataFrame:
    """``keys..., start, end_exclusive, duration`` of every maximal run of true steps.

    Runs are found inside blocks of bounded size and stitched where a block border
    cuts them, so a key with a third of all rows is spread over many tasks.
    """
    placed = (
        bins.filter(F.col(flag)).withColumn("_block", F.floor(F.col("minute") / BLOCK).cast("long"))
        .groupBy(*keys, "_block").agg(F.array_sort(F.collect_set("minute")).alias("_minutes"))
        .select(*keys, "_block", F.posexplode("_minutes").alias("_place", "minute"))
    )
    pieces = placed.groupBy(*keys, "_block", (F.col("minute") - F.col("_place")).alias("_island")).agg(
        F.min("minute").alias("_a"), F.max("minute").alias("_b")
    )
    cut = (F.pmod("_a", F.lit(BLOCK)) == 0) | (F.pmod("_b", F.lit(BLOCK)) == BLOCK - 1)
    order = Window.partitionBy(*keys).orderBy("_a")
    joined = (
        pieces.filter(cut)
        .withColumn("_new", F.coalesce((F.col("_a") != F.lag("_b").over(order) + 1).cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    )
    both = pieces.filter(~cut).select(*keys, "_a", "_b").unionByName(joined.select(*keys, "_a", "_b"))
    return both.select(
        *keys, F.col("_a").alias("start"), (F.col("_b") + 1).alias("end_exclusive"),
        (F.col("_b") - F.col("_a") + 1).alias("duration"),
    )


def maximal_episodes(bins: DataFrame, keys: list[str], sustain: int) -> DataFrame:
    """Runs of at least ``sustain`` steps."""
    if sustain <= 0:
        raise ValueError("sustain must be positive")
    return runs(bins, keys).filter(F.col("duration") >= sustain)


def sustained_starts(bins: DataFrame, keys: list[str], sustain: int, collapse: bool) -> DataFrame:
    """``keys..., minute`` at which ``sustain`` consecutive event steps begin.

    Collapsed, starts closer than ``sustain`` to the last kept one are merged; as
    runs are maximal, those are start, start + sustain, ... within each run.
    """
    step = sustain if collapse else 1
    return maximal_episodes(bins, keys, sustain).select(
        *keys,
        F.explode(F.sequence("start", F.col("end_exclusive") - sustain, F.lit(step).cast("long"))).alias("minute"),
    )


def longest_run(bins: DataFrame, keys: list[str], min_length: int = 1) -> DataFrame:
    """The longest qualifying run per key; of equal ones the latest."""
    best = Window.partitionBy(*keys).orderBy(F.desc("duration"), F.desc("end_exclusive"))
    return (
        runs(bins, keys).filter(F.col("duration") >= min_length).withColumn("_n", F.row_number().over(best))
        .filter("_n = 1").drop("_n")
    )


def annotated(bins: DataFrame, keys: list[str], sustain: int) -> DataFrame:
    """``bins`` plus ``in_episode`` and ``starts_episode`` of episodes of at least ``sustain`` steps."""
    marks = maximal_episodes(bins, keys, sustain).select(
        *keys, "start", F.explode(F.sequence("start", F.col("end_exclusive") - 1)).alias("minute")
    ).select(*keys, "minute", F.lit(True).alias("in_episode"), (F.col("minute") == F.col("start")).alias("starts_episode"))
    return bins.join(marks, [*keys, "minute"], "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("in_episode", "starts_episode")}
    )
