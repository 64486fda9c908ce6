"""Minute-series features without windows over whole series.

Each step sends its value to the few steps it matters for (a bounded explode), and
one aggregation by (key, step) collects them: linear, and even for hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill_short_gaps(bins: DataFrame, keys: list[str], max_gap: int) -> DataFrame:
    """``keys..., minute, value, is_filled``: interior gaps of at most ``max_gap`` steps interpolated linearly."""
    spots = F.sequence(F.lit(-max_gap), F.lit(max_gap))
    wide = bins.select(*keys, "value", F.col("minute").alias("_from"), F.explode(spots).alias("_d")).withColumn(
        "minute", F.col("_from") + F.col("_d")
    )
    d, v = F.col("_d"), F.struct("_from", "value")
    agg = wide.groupBy(*keys, "minute").agg(
        F.max(F.when(d == 0, F.col("value"))).alias("_own"), F.max(F.when(d > 0, v)).alias("_left"),
        F.min(F.when(d < 0, v)).alias("_right"),
    )
    span = F.col("_right._from") - F.col("_left._from")
    between = F.col("_left.value") + (F.col("_right.value") - F.col("_left.value")) * (F.col("minute") - F.col("_left._from")) / span
    filled = F.when(F.col("_own").isNull() & (span - 1 <= max_gap), between)
    return agg.withColumn("value", F.coalesce("_own", filled)).filter("value is not null").select(
        *keys, "minute", "value", F.col("_own").isNull().alias("is_filled")
    )


def with_previous(bins: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``bins`` plus ``previous``: the value of the step before, null if that step is missing."""
    shifted = bins.select(*keys, (F.col("minute") + 1).alias("minute"), F.col(value).alias("previous"))
    return bins.join(shifted, [*keys, "minute"], "left")


def trailing(bins: DataFrame, keys: list[str], length: int, aggregates: list[Column]) -> DataFrame:
    """``keys..., minute`` and ``aggregates`` of ``value`` over the last ``length`` steps, only where all are present.

    ``offset`` (0 = oldest) is available to the aggregates.
    """
    wide = bins.select(
        *keys, "value", F.col("minute").alias("_from"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("_d")
    ).select(*keys, "value", (F.col("_from") + F.col("_d")).alias("minute"), (F.lit(length - 1) - F.col("_d")).alias("offset"))
    return wide.groupBy(*keys, "minute").agg(F.count(F.lit(1)).alias("_n"), *aggregates).filter(F.col("_n") == length).drop("_n")


def block_jumps(bins: DataFrame, keys: list[str], block: int, threshold: Column) -> DataFrame:
    """``keys..., n_blocks, n_jumps``: changes between neighbouring block medians above the threshold."""
    med = bins.groupBy(*keys, F.floor(F.col("minute") / block).alias("minute")).agg(F.median("value").alias("value"))
    both = with_previous(med, keys)
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(F.coalesce(F.abs(F.col("value") - F.col("previous")) > threshold, F.lit(False))).alias("n_jumps"),
    )
