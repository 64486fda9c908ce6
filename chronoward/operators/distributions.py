"""Distribution profiles, drift between samples, outlier concentration, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoward.operators.ordered_scan import running_sums
from chronoward.operators.quantiles import exact_quantiles, null_safe_join
from chronoward.session import checkpoint, settled_side


#: Quantiles of a profile.
PROFILE_QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts, moments (population) and exact quantiles per key; keys without values are left out.

    ``n_boundary`` counts values of a magnitude of at least 0.999.
    """
    v = F.col(value)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.skewness(v).alias("skewness"), F.kurtosis(v).alias("excess_kurtosis"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(v == 0).alias("n_zero"), F.count_if(v < 0).alias("n_negative"), F.count_if(F.abs(v) >= 0.999).alias("n_boundary"),
    )
    return null_safe_join(agg, exact_quantiles(df, keys, value, PROFILE_QUANTILES), keys)


def summary_of_counts(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """Counts, moments, quantiles, fences and outliers per key from rows ``keys, value, n`` (value null: no value)."""
    v, w = F.col(value), F.when(F.col(value).isNotNull(), F.col(n))
    mean = F.sum(v * w) / F.sum(w)
    agg = counts.groupBy(*keys).agg(
        F.sum(n).alias("n_total"), F.coalesce(F.sum(w), F.lit(0)).alias("n_valid"), mean.alias("mean"),
        (F.sum(v * v * w) / F.sum(w) - mean * mean).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"),
    )
    q = exact_quantiles(counts, keys, value, PROFILE_QUANTILES, weight=n)
    low, high = fences(F.col("p25"), F.col("p75"))
    x = settled_side(null_safe_join(agg, q, keys).withColumns({"lower_fence": low, "upper_fence": high}))
    outside = null_safe_join(counts, x.select(*keys, "lower_fence", "upper_fence"), keys).filter(
        (v < F.col("lower_fence")) | (v > F.col("upper_fence"))
    ).groupBy(*keys).agg(F.sum(n).alias("n_outliers_iqr"))
    return null_safe_join(x, outside, keys, "left").withColumns({
        "n_outliers_iqr": F.coalesce("n_outliers_iqr", F.lit(0)), "coverage": F.col("n_valid") / F.col("n_total"),
        "variance": F.greatest("variance", F.lit(0.0)), "range": F.col("max") - F.col("min"), "iqr": F.col("p75") - F.col("p25"),
    }).withColumns({
        "std": F.sqrt("variance"), "outlier_fraction_iqr": F.col("n_outliers_iqr") / F.col("n_valid"),
    })


def fences(p25: Column, p75: Column, k: float = 1.5) -> tuple[Column, Column]:
    """Lower and upper fence of the interquartile range."""
    return p25 - k * (p75 - p25), p75 + k * (p75 - p25)


def outlier_concentration(df: DataFrame, keys: list[str], entity: str, value: str, top: int = 5) -> DataFrame:
    """Share of the outliers held by the top entity and the top five, per key."""
    low, high = fences(F.col("_p25"), F.col("_p75"))
    q = settled_side(exact_quantiles(df, keys, value, {"_p25": 0.25, "_p75": 0.75}))
    out = df.join(q, keys).filter((F.col(value) < low) | (F.col(value) > high))
    per = checkpoint(out.groupBy(*keys, entity).agg(F.count(F.lit(1)).alias("c")))
    # the top few per part of the entities, then of all parts: no task ranks every entity of a key
    part = Window.partitionBy(*keys, "_part").orderBy(F.desc("c"), entity)
    some = per.withColumn("_part", F.pmod(F.xxhash64(entity), F.lit(64))).withColumn("_n", F.row_number().over(part)).filter(
        F.col("_n") <= top
    )
    rank = some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), entity))).filter(F.col("_n") <= top)
    best = rank.groupBy(*keys).agg(
        F.sum(F.when(F.col("_n") <= 1, F.col("c"))).alias("_one"), F.sum("c").alias("_top")
    )
    total = per.groupBy(*keys).agg(F.sum("c").alias("n_outliers"), F.count(F.lit(1)).alias("n_entities"))
    return total.join(best, keys).select(
        *keys, "n_outliers", "n_entities", (F.col("_one") / F.col("n_outliers")).alias("top1_share"),
        (F.col("_top") / F.col("n_outliers")).alias("top5_share"),
    )


def ks_statistic(df: DataFrame, key: Column, value: Column, side: Column) -> DataFrame:
    """``g, n_a, n_b, ks``: greatest distance of the two samples' distribution functions.

    ``side`` true is sample a. Equal values are counted before the sort.
    """
    levels = (
        df.select(F.coalesce(key.cast("string"), F.lit("\u0000")).alias("g"), value.cast("double").alias("v"), side.alias("a"))
        .filter("v is not null and a is not null").groupBy("g", "v")
        .agg(F.count_if(F.col("a")).alias("ca"), F.count_if(~F.col("a")).alias("cb"))
    )
    run = running_sums(levels, "g", ["v"], ["ca", "cb"])
    totals = settled_side(run.groupBy("g").agg(F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b")))
    fa = (F.col("before_ca") + F.col("ca")) / F.col("n_a")
    fb = (F.col("before_cb") + F.col("cb")) / F.col("n_b")
    return run.join(totals, "g").filter("n_a > 0 and n_b > 0").groupBy("g", "n_a", "n_b").agg(
        F.max(F.abs(fa - fb)).alias("ks")
    )


# Limits and names of the drift and shape labels.
MEANINGFUL_KS, MEANINGFUL_SHIFT = 0.12, 0.5
MILD_KS, MILD_SHIFT = 0.08, 0.25


def drift_label(ks: Column, median_shift_iqr: Column) -> Column:
    """Drift of a sample against the training sample; null measures count as no shift, a null distance as no data."""
    shift = F.coalesce(median_shift_iqr, F.lit(0.0))
    return (
        F.when(ks.isNull(), F.lit("insufficient data"))
        .when((ks >= MEANINGFUL_KS) | (shift >= MEANINGFUL_SHIFT), F.lit("possible meaningful shift"))
        .when((ks >= MILD_KS) | (shift >= MILD_SHIFT), F.lit("mild shift")).otherwise(F.lit("no clear shift"))
    )


def shape_flags(
    skew: Column, kurt: Column, zero_share: Column, outlier_share: Column, n_outliers: Column, top5_share: Column,
    multimodal: Column, boundary_share: Column, bounded: Column,
) -> Column:
    """Names of the shape properties that hold, in a fixed order, joined with ``;``.

    ``bounded`` says that the value is a coefficient and lies within -1.01 and 1.01.
    """
    names = F.concat_ws(
        ";", F.when(F.abs(skew) < 0.5, F.lit("approximately symmetric")).when(skew >= 0.5, F.lit("right-skewed"))
        .when(skew <= -0.5, F.lit("left-skewed")),
        F.when((kurt >= 3.0) | (outlier_share >= 0.05), F.lit("heavy-tailed")),
        F.when(multimodal, F.lit("possible multimodality")), F.when(zero_share >= 0.05, F.lit("zero-inflated")),
        F.when(bounded & (boundary_share >= 0.01), F.lit("bounded with spike at +/-1")),
        F.when(outlier_share >= 0.01, F.lit("affected by extreme values")),
        F.when((outlier_share >= 0.005) & (top5_share >= 0.5) & (n_outliers >= 100),
               F.lit("train outliers concentrated in a few patients")),
    )
    return F.when(names == "", F.lit("roughly compact/unimodal")).otherwise(names)


def multimodal(df: DataFrame, keys: list[str], value: str, least: int = 200, min_bins: int = 15) -> DataFrame:
    """``keys..., is_multimodal``: do two clear peaks of the histogram have a valley between them?

    Values between the 1st and 99th percentile are counted in equal bins of the
    Freedman-Diaconis width (twice the interquartile range over the cube root of their
    number). Counts are smoothed over three bins; peaks of at least a quarter of the
    highest, three or more bins apart, need a valley of at most three quarters of the
    smaller one. Fewer than ``least`` values or ``min_bins`` bins are not multimodal.
    """
    v = F.col(value)
    rows = df.filter(v.isNotNull())
    cut = settled_side(exact_quantiles(rows, keys, value, {"_a": 0.01, "_b": 0.99}))
    inner = rows.join(cut, keys).filter(v.between(F.col("_a"), F.col("_b"))).select(*keys, v.alias(value))
    spans = inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = 2.0 * (F.col("_p75") - F.col("_p25")) / F.cbrt("_n")
    bins = F.when(width > 0, F.greatest(F.ceil((F.col("_hi") - F.col("_lo")) / width), F.lit(1))).otherwise(1).cast("long")
    spans = settled_side(
        spans.join(exact_quantiles(inner, keys, value, {"_p25": 0.25, "_p75": 0.75}), keys).withColumn("_bins", bins)
    )
    place = F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_bins")).cast("long"), F.col("_bins") - 1)
    enough = spans.filter((F.col("_n") >= least) & (F.col("_bins") >= min_bins))
    counted = inner.join(enough, keys).groupBy(*keys, "_bins", place.alias("_i")).agg(F.count(F.lit(1)).alias("_c"))
    bins_of = counted.groupBy(*keys, "_bins").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_c"))).alias("_m"))
    n_bins = F.col("_bins").cast("int")

    def count_at(i: Column) -> Column:
        return F.coalesce(F.try_element_at("_m", i.cast("long")), F.lit(0))

    smooth = F.transform(F.sequence(F.lit(0), n_bins - 1), lambda i: (count_at(i - 1) + count_at(i) + count_at(i + 1)) / 3.0)
    x = bins_of.withColumn("_s", smooth).withColumn("_top", F.array_max("_s"))

    def s(i: Column) -> Column:
        return F.get("_s", i)

    peaks = F.filter(
        F.sequence(F.lit(2), n_bins - 3),
        lambda i: (s(i) > s(i - 1)) & (s(i) >= s(i + 1)) & (s(i) >= 0.25 * F.col("_top")),
    )
    x = x.withColumn("_p", peaks)
    clear = F.exists(
        F.sequence(F.lit(0), F.size("_p") - 2),
        lambda k: (F.get("_p", k + 1) - F.get("_p", k) >= 3) & (
            F.array_min(F.slice("_s", F.get("_p", k) + 1, F.get("_p", k + 1) - F.get("_p", k) + 1))
            <= 0.75 * F.least(s(F.get("_p", k)), s(F.get("_p", k + 1)))
        ),
    )
    found = x.select(*keys, F.when(F.size("_p") >= 2, clear).otherwise(False).alias("is_multimodal"))
    return rows.select(*keys).distinct().join(found, keys, "left").select(
        *keys, F.coalesce("is_multimodal", F.lit(False)).alias("is_multimodal")
    )


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """``keys..., bin, n``: equal-width counts between each key's least and greatest value."""
    span = settled_side(df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    x = df.filter(F.col(value).isNotNull()).join(span, keys)
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return x.groupBy(*keys, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` plus midranks of a column; equal values are counted before the sort."""
    levels = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_all", F.lit("all"))
    run = running_sums(levels, "_all", [value], ["_c"])
    rank = run.select(value, (F.col("before__c") + (F.col("_c") + 1) / 2.0).alias(out))
    return df.join(rank, value)


def correlations(wide: DataFrame, columns: list[str], least: int = 5) -> DataFrame:
    """``a, b, n, r`` of every pair of columns over rows where both are known (one aggregation)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    agg = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        agg += [F.count_if(both).alias(f"n{i}"), F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"r{i}")]
    one = wide.agg(*agg)
    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ])
    return one.select(F.explode(rows).alias("x")).select("x.*").filter(F.col("n") >= least)


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The Yeo-Johnson power transform."""
    up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    low = F.when(F.abs(lam - 2.0) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1.0 - x, 2.0 - lam) - 1.0) / (2.0 - lam))
    return F.when(x >= 0, up).otherwise(low)


def box_cox(x: Column, lam: Column) -> Column:
    """The Box-Cox power transform of positive values."""
    return F.when(F.abs(lam) < 1e-9, F.ln(x)).otherwise((F.pow(x, lam) - 1.0) / lam)


#: Power transforms: which values they take, the transform, and what the Jacobian adds per unit of the exponent.
TRANSFORMS = {
    "yeo_johnson": (lambda x: F.lit(True), yeo_johnson, lambda x: F.signum(x) * F.log1p(F.abs(x))),
    "box_cox": (lambda x: x > 0, box_cox, F.ln),
}


def power_fit(df: DataFrame, keys: list[str], value: str, kind: str, coarse: list[float], fine: list[float]) -> DataFrame:
    """``keys..., exponent, log_likelihood``: the exponent of the greatest profile likelihood, in two aggregations.

    The normal likelihood after the transform ``kind`` is tried at the ``coarse``
    exponents, then at the best one plus each of the ``fine`` steps (to two decimals).
    Ties go to the smaller exponent. Null and NaN values, and for Box-Cox values that
    are not positive, are ignored.
    """
    takes, transform, jacobian = TRANSFORMS[kind]
    x = F.col(value)
    rows = df.filter(x.isNotNull() & ~F.isnan(x)).filter(takes(x)).select(*keys, x.alias(value))

    def best(data: DataFrame, exponents: list[Column], more: list[str]) -> DataFrame:
        agg = data.groupBy(*keys, *more).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(jacobian(x)).alias("_j"),
            *[F.var_pop(transform(x, e)).alias(f"_v{i}") for i, e in enumerate(exponents)],
        )
        fits = F.array(*[
            F.struct((-F.col("_n") / 2.0 * F.ln(F.greatest(F.col(f"_v{i}"), F.lit(1e-300))) + (e - 1.0) * F.col("_j")).alias("l"),
                     (-e).alias("e"))
            for i, e in enumerate(exponents)
        ])
        top = agg.select(*keys, F.array_max(fits).alias("b"))
        return top.select(*keys, (-F.col("b.e")).alias("exponent"), F.col("b.l").alias("log_likelihood"))

    first = settled_side(best(rows, [F.lit(float(e)) for e in coarse], []).select(*keys, F.col("exponent").alias("_e")))
    near = rows.join(first, keys)
    return best(near, [F.round(F.col("_e") + step, 2) for step in fine], ["_e"])
