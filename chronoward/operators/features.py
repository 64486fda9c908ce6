"""Per-minute features: moments, clipping, imputation, deltas, ratios, history summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoward.operators.quantiles import exact_quantiles
from chronoward.operators.timeline import finite
from chronoward.session import settled_side


def long_features(df: DataFrame, keys: list[str], values: str, mask: str, names: list[str]) -> DataFrame:
    """``keys..., feature_name, value`` of array columns; masked or non-finite entries are null."""
    rows = df.select(
        *keys,
        F.explode(F.arrays_zip(
            F.array(*[F.lit(n) for n in names]).alias("name"), F.col(values).alias("v"), F.col(mask).alias("ok")
        )).alias("c"),
    )
    return rows.select(*keys, F.col("c.name").alias("feature_name"), F.when(F.col("c.ok"), finite(F.col("c.v"))).alias("value"))


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``n, mean, std`` (population, degenerate spread counts as 1) and excluded rows."""
    v = F.col(value)
    agg = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"),
        F.count_if(v.isNull()).alias("n_excluded"),
    )
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return agg.select(*keys, "n", "n_excluded", mean.alias("mean"), F.when(std < 1e-8, F.lit(1.0)).otherwise(std).alias("std"))


def clip_and_scale(df: DataFrame, bounds: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` plus ``scaled``: clipped to ``lo``/``hi``, z-scored with ``mean``/``std``, null as 0."""
    x = df.join(settled_side(bounds), keys)
    z = (F.least(F.greatest(F.col(value), "lo"), "hi") - F.col("mean")) / F.col("std")
    z = F.when(F.col(value).isNotNull(), z)  # greatest and least skip nulls
    return x.withColumn("scaled", F.coalesce(z, F.lit(0.0)))


def impute_normalise(long: DataFrame, train: Column, keys: list[str], value: str = "value") -> DataFrame:
    """``long`` plus ``scaled`` and ``was_missing``: train median for gaps, then train z-score.

    One aggregation over the training rows (one row per feature); a
    feature without training values is imputed 0 with mean 0 and spread 1.
    """
    v = F.when(train, F.col(value))
    fitted = long.groupBy(*keys).agg(
        F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"), F.count(v).alias("_n")
    )
    median = exact_quantiles(long.filter(train), keys, value, {"_median": 0.5})
    fitted = settled_side(fitted.join(median, keys, "left"))
    std = F.when(F.col("_std") > 1e-8, F.col("_std")).otherwise(1.0)
    filled = F.coalesce(F.col(value), F.when(F.col("_n") > 0, F.col("_median")).otherwise(0.0))
    x = long.join(fitted, keys)
    return x.withColumn("scaled", (filled - F.coalesce("_mean", F.lit(0.0))) / std).withColumn(
        "was_missing", F.col(value).isNull()
    ).drop("_median", "_mean", "_std", "_n")


def history_summary(long: DataFrame, keys: list[str], index: str, value: str, length: int) -> DataFrame:
    """Ten statistics of each feature over an anchor's minutes."""
    v, i = F.col(value), F.when(F.col(value).isNotNull(), F.col(index))
    agg = long.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.min_by(v, i).alias("first"), F.max_by(v, i).alias("last"),
        F.regr_slope(v, i.cast("double")).alias("_slope"), F.count(v).alias("_n"),
    )
    return agg.select(
        *keys, "mean", "median", "std", "min", "max", "first", "last", (F.col("last") - F.col("first")).alias("delta"),
        F.when(F.col("_n") >= 2, F.col("_slope")).when(F.col("_n") == 1, F.lit(0.0)).alias("slope"),
        (F.col("_n") / F.lit(length)).alias("valid_fraction"),
    )


def minute_deltas(long: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """``long`` plus ``delta`` to the previous minute, null unless both minutes are valid."""
    w = Window.partitionBy(*keys).orderBy(index)
    before = F.when(F.lag(index).over(w) == F.col(index) - 1, F.lag(value).over(w))
    return long.withColumn("delta", F.col(value) - before)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio, null where the denominator is almost zero."""
    return F.when(F.abs(denominator) >= 1e-8, numerator / denominator)


def agreement(a: Column, b: Column) -> Column:
    """1 / (1 + |a - b| / 10)."""
    return 1.0 / (1.0 + F.abs(a - b) / 10.0)


def shock_family(hr: Column, sbp: Column, dbp: Column, mean_pressure: Column) -> dict[str, Column]:
    """Fixed set of derived features: three rate-to-pressure ratios and two margins."""
    def ratio(a: Column, b: Column) -> Column:
        return F.when(F.abs(b) > 1e-8, a / b)

    return {
        "shock_index": ratio(hr, sbp), "modified_shock_index": ratio(hr, mean_pressure), "diastolic_shock_index": ratio(hr, dbp),
        "map_margin_65": mean_pressure - 65.0, "sbp_margin_90": sbp - 90.0,
    }
