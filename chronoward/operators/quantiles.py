"""Exact quantiles of groups of any size, without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoward.operators.ordered_scan import running_sums
from chronoward.session import settled_side


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], weight: str | None = None
) -> DataFrame:
    """``keys...`` and one column per named probability, linearly interpolated.

    ``weight`` (whole numbers) counts each row that often.

    Equal values are counted first; the counted values are range-sorted with running
    counts, so each order statistic is found where it lies. Null and NaN values are
    ignored; a group without values has no row.
    """
    label = F.concat_ws("\u0001", F.lit("g"), *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys])
    counts = (
        df.select(*keys, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")).filter("_v is not null and not isnan(_v)")
        .groupBy(*keys, "_v").agg(F.sum("_w").alias("_n")).withColumn("_label", label)
    )
    run = running_sums(counts, "_label", ["_v"], ["_n"])
    totals = settled_side(run.groupBy("_label").agg(F.sum("_n").alias("_total")))
    found = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for kind, target in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (target >= F.col("before__n")) & (target < F.col("before__n") + F.col("_n"))
            found.append(F.max(F.when(here, F.col("_v"))).alias(f"_{kind}_{name}"))
    agg = run.join(totals, "_label").groupBy("_label", *keys, "_total").agg(*found)

    def between(name: str, p: float):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name)

    return agg.select(*keys, *[between(n, p) for n, p in probabilities.items()])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys appear once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
