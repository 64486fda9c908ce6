"""Minute timelines from irregular readings: bins, thresholds, overlays, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """``value`` as double, null unless it is a finite number."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def minute_index(time: Column, origin: Column, step: float = 60.0) -> Column:
    """Nearest grid step (ties to even) of a time in seconds."""
    return F.rint((time - origin) / step).cast("long")


def alignment_residual(time: Column, origin: Column, step: float = 60.0) -> Column:
    """Distance in seconds of a time to its grid step."""
    x = (time - origin) / step
    return F.abs(x - F.rint(x)) * step


def bin_median(rows: DataFrame, keys: list[str], minute: Column, value: Column, min_count: int = 1) -> DataFrame:
    """``keys..., minute, value, n``: exact median of the finite values per step.

    Steps with fewer than ``min_count`` finite values are left out (missing). The
    aggregation combines partially before its one shuffle on (keys, minute).
    """
    picked = rows.select(*keys, minute.alias("minute"), finite(value).alias("value")).filter(
        "value is not null and minute is not null"
    )
    out = picked.groupBy(*keys, "minute").agg(F.median("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return out if min_count <= 1 else out.filter(F.col("n") >= min_count)


def compare(value: Column, comparison: str, threshold: float) -> Column:
    """lt, le, gt or ge against a threshold; null and NaN compare false."""
    v = finite(value)
    operations = {"lt": v < threshold, "le": v <= threshold, "gt": v > threshold, "ge": v >= threshold}
    if comparison not in operations:
        raise ValueError(f"unsupported comparison: {comparison}")
    return F.coalesce(operations[comparison], F.lit(False))


def channel_events(channel: Column, value: Column, rules: dict[str, tuple[str, str, float]]) -> tuple[Column, Column]:
    """(event name, event flag) by channel; ``rules`` maps a channel to (event, comparison, threshold)."""
    name, flag = F.lit(None).cast("string"), F.lit(False)
    for ch, (event, comparison, threshold) in rules.items():
        name = F.when(channel == ch, F.lit(event)).otherwise(name)
        flag = F.when(channel == ch, compare(value, comparison, threshold)).otherwise(flag)
    return name, flag


def overlay_last_wins(rows: DataFrame, keys: list[str], slot: str, value: str, rank: list[str]) -> DataFrame:
    """``keys..., slot, value``: of overlapping windows, the last listed finite value per slot.

    ``rank`` orders the listing; it must be total, as Spark's sort is not stable.
    """
    rows = rows.withColumn("_v", finite(F.col(value))).filter("_v is not null")
    order = F.struct(*rank) if len(rank) > 1 else F.col(rank[0])
    return rows.groupBy(*keys, slot).agg(F.max_by("_v", order).alias(value))


def validity(bins: DataFrame, keys: list[str], extent: DataFrame) -> DataFrame:
    """``keys..., n_valid, n_steps, valid_fraction`` against ``extent(keys..., lo, hi)``."""
    counted = bins.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_valid"))
    return extent.join(counted, keys, "left").select(
        *keys, F.coalesce("n_valid", F.lit(0)).alias("n_valid"), (F.col("hi") - F.col("lo") + 1).alias("n_steps"),
        (F.coalesce("n_valid", F.lit(0)) / (F.col("hi") - F.col("lo") + 1)).alias("valid_fraction"),
    )
