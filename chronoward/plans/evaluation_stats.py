"""Queries of distributions, metrics, resampling and significance.

Predictions: an order line's price against quantity times list price (model a) and
against quantity alone (model b); the cluster is the supplier. The binary label is a
returned line, scored by quantity (many ties) and by price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoward.operators import distributions as ds
from chronoward.operators import evaluation as ev
from chronoward.operators.quantiles import exact_quantiles
from chronoward.plans.anchors_features import NAMES, cache_rows, long_cache
from chronoward.session import checkpoint, table

REPLICATES = 200


def predictions(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    line = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    return line.join(part, line.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("cluster"), F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("pa"), (F.col("l_quantity") * 1000.0).alias("pb"),
        (F.col("l_returnflag") == "R").alias("label"), F.col("l_quantity").alias("score_a"),
        F.col("l_extendedprice").alias("score_b"), F.col("l_returnflag").alias("split"),
    )


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    x = p.groupBy("split").agg(*ev.regression_sums(F.col("y"), F.col("pa")))
    return _round(x.select("split", "n", *ev.regression_metrics_from_sums()), 5, "mae", "rmse", "r2")


def mean_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The training mean (split N) as a constant prediction for every split."""
    p = predictions(spark, d)
    mean = p.filter("split = 'N'").agg(F.avg("y").alias("m"))
    x = p.join(F.broadcast(mean)).groupBy("split").agg(*ev.regression_sums(F.col("y"), F.col("m")))
    m = _round(x.select("split", "n", *ev.regression_metrics_from_sums()), 5, "mae", "rmse", "r2")
    return m.withColumn("r2", F.col("r2") + 0.0)  # no negative zero


def persistence_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The value five minutes earlier as the prediction, per channel."""
    from chronoward.plans.anchors_features import future_target_center

    t = future_target_center(spark, d).filter("horizon = 5 and target is not null").select("segment_id", "channel_name", "minute", "target")
    from chronoward.plans.episodes_labels import timeline

    now = timeline(spark, d).select("segment_id", "channel_name", "minute", "value")
    x = t.join(now, ["segment_id", "channel_name", "minute"]).groupBy("channel_name").agg(
        *ev.regression_sums(F.col("target"), F.col("value"))
    )
    return _round(x.select("channel_name", "n", *ev.regression_metrics_from_sums()), 5, "mae", "rmse", "r2")


def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy("split").agg(*ev.confusion(F.col("y") > 30000.0, F.col("pa") > 30000.0))


def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AUROC, AUPRC and specificity at 85 % sensitivity of both scores."""
    p = predictions(spark, d)
    both = p.select("label", F.explode(F.array(
        F.struct(F.lit("quantity").alias("model"), F.col("score_a").alias("s")),
        F.struct(F.lit("price").alias("model"), F.col("score_b").alias("s")),
    )).alias("x"))
    m = ev.ranking_metrics(ev.score_levels(both, F.col("label"), F.col("x.s"), F.col("x.model")))
    return _round(m.withColumnRenamed("g", "model"), 8, "auroc", "auprc", "spec_at_sens")


def delong(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    out = ev.delong(p, F.col("label"), F.col("score_a"), F.col("score_b"))
    out = _round(out, 8, "auc_a", "auc_b", "difference", "variance", "ci_low", "ci_high")
    return _round(_round(out, 5, "z"), 6, "p_value")


def permutation_tests(spark: SparkSession, d: str) -> DataFrame:
    """Paired permutation tests of both models per split, for absolute and squared errors."""
    y, pa, pb = F.col("y"), F.col("pa"), F.col("pb")
    sums = predictions(spark, d).groupBy("split", "cluster").agg(
        F.sum(F.abs(y - pa)).alias("aa"), F.sum(F.abs(y - pb)).alias("ab"), F.sum((y - pa) * (y - pa)).alias("sa"),
        F.sum((y - pb) * (y - pb)).alias("sb"), F.count(F.lit(1)).alias("n"),
    )
    each = sums.select("split", "cluster", "n", F.explode(F.array(
        F.struct(F.lit("mae").alias("metric"), F.col("aa").alias("a"), F.col("ab").alias("b")),
        F.struct(F.lit("mse").alias("metric"), F.col("sa").alias("a"), F.col("sb").alias("b")),
    )).alias("x")).select("split", "cluster", "n", "x.*")
    out = ev.paired_permutation(each, "cluster", "a", "b", "n", REPLICATES, by=["metric", "split"])
    return _round(_round(out, 4, "observed"), 6, "p_value")


def holm(spark: SparkSession, d: str) -> DataFrame:
    """The permutation tests adjusted within each metric."""
    x = permutation_tests(spark, d).select("metric", "split", "p_value")
    return _round(ev.holm(x, ["metric"], "split", "p_value"), 6, "adjusted")


def _per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy("cluster").agg(*ev.regression_sums(F.col("y"), F.col("pa")))


def cluster_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.bootstrap_regression(_per_cluster(spark, d), "cluster", REPLICATES), 4, "low", "median", "high")


def paired_permutation(spark: SparkSession, d: str) -> DataFrame:
    x = predictions(spark, d).groupBy("cluster").agg(
        F.sum(F.abs(F.col("y") - F.col("pa"))).alias("a"), F.sum(F.abs(F.col("y") - F.col("pb"))).alias("b"),
        F.count(F.lit(1)).alias("n"),
    )
    return _round(ev.paired_permutation(x, "cluster", "a", "b", "n", REPLICATES), 6, "observed", "p_value")


def bland_altman(spark: SparkSession, d: str) -> DataFrame:
    x = ev.within_limits(predictions(spark, d).select("split", "y", "pa"), ["split"], F.col("y"), F.col("pa"))
    return _round(x, 5, "bias", "sd", "loa_low", "loa_high", "slope", "coverage")


def paired_bland_altman(spark: SparkSession, d: str) -> DataFrame:
    """Which model lies nearer to the truth, by bias and by width of the limits."""
    p = predictions(spark, d)
    a = p.groupBy("split").agg(*ev.bland_altman(F.col("y"), F.col("pa"))).select("split", F.abs("bias").alias("bias_a"), F.col("sd").alias("sd_a"))
    b = p.groupBy("split").agg(*ev.bland_altman(F.col("y"), F.col("pb"))).select("split", F.abs("bias").alias("bias_b"), F.col("sd").alias("sd_b"))
    x = a.join(b, "split")
    verdict = (
        F.when((F.col("bias_a") < F.col("bias_b")) & (F.col("sd_a") < F.col("sd_b")), F.lit("a_better"))
        .when((F.col("bias_a") > F.col("bias_b")) & (F.col("sd_a") > F.col("sd_b")), F.lit("b_better")).otherwise(F.lit("mixed"))
    )
    return _round(x.withColumn("verdict", verdict), 4, "bias_a", "sd_a", "bias_b", "sd_b")


def best_model_per_target(spark: SparkSession, d: str) -> DataFrame:
    """Per split the model with the greatest R2."""
    p = predictions(spark, d)
    both = p.select("split", "y", F.explode(F.array(
        F.struct(F.lit("a").alias("model"), F.col("pa").alias("p")), F.struct(F.lit("b").alias("model"), F.col("pb").alias("p")),
    )).alias("x"))
    m = both.groupBy("split", "x.model").agg(*ev.regression_sums(F.col("y"), F.col("x.p"))).select(
        "split", "model", *ev.regression_metrics_from_sums()
    )
    best = m.groupBy("split").agg(F.max_by(F.struct("model", "r2"), F.struct("r2", "model")).alias("b"))
    return best.select("split", F.col("b.model").alias("model"), F.round("b.r2", 6).alias("r2"))


def model_win_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many splits each model is best in."""
    return best_model_per_target(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n_wins"))


def _model_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two models' predictions as separate tables: model a has no lines over 45 pieces, model b none under 3."""
    p = predictions(spark, d)
    keys = ["l_orderkey", "l_linenumber"]
    return (
        p.filter("score_a <= 45").select(*keys, "y", F.col("pa").alias("p")),
        p.filter("score_a >= 3").select(*keys, "y", F.col("pb").alias("p")),
    )


def model_pair_audit(spark: SparkSession, d: str) -> DataFrame:
    return ev.prediction_audit(*_model_sides(spark, d), ["l_orderkey", "l_linenumber"], "y")


def model_pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of both models over the samples both have."""
    x = ev.align_predictions(*_model_sides(spark, d), ["l_orderkey", "l_linenumber"], "y")
    both = x.select("y", F.explode(F.array(
        F.struct(F.lit("a").alias("model"), F.col("p_a").alias("p")), F.struct(F.lit("b").alias("model"), F.col("p_b").alias("p")),
    )).alias("m"))
    m = both.groupBy("m.model").agg(*ev.regression_sums(F.col("y"), F.col("m.p")))
    return _round(m.select("model", "n", *ev.regression_metrics_from_sums()), 5, "mae", "rmse", "r2")


def agreement_pearson_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Pearson, Spearman, bias, mean and 95th percentile absolute difference of two price estimates."""
    p = predictions(spark, d).select("y", "pb")
    ranked = ds.average_ranks(ds.average_ranks(p, "y", "ry"), "pb", "rp")
    x = ranked.agg(
        F.count(F.lit(1)).alias("n"), F.corr("y", "pb").alias("pearson"), F.corr("ry", "rp").alias("spearman"),
        F.avg(F.col("pb") - F.col("y")).alias("bias"), F.avg(F.abs(F.col("pb") - F.col("y"))).alias("mae"),
    )
    apart = p.select(F.lit("all").alias("g"), F.abs(F.col("pb") - F.col("y")).alias("e"))
    x = x.join(F.broadcast(exact_quantiles(apart, ["g"], "e", {"p95": 0.95}).drop("g")))
    return _round(x, 5, "pearson", "spearman", "bias", "mae", "p95")


LINE_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long_lines(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.explode(F.array(*[
        F.struct(F.lit(c).alias("target"), F.col(c).alias("v")) for c in LINE_VALUES])).alias("x"))
    return x.select("l_suppkey", F.col("l_returnflag").alias("split"), "x.target", "x.v")


def target_summary_by_split(spark: SparkSession, d: str) -> DataFrame:
    """22 columns per target and split, and over all splits: values are counted once, "all" adds the counts."""
    counts = _long_lines(spark, d).groupBy("target", "split", "v").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("target", F.lit("all").alias("split"), "v").agg(F.sum("n").alias("n"))
    x = ds.summary_of_counts(checkpoint(counts.unionByName(whole)), ["target", "split"], "v", "n")
    x = _round(x, 5, "coverage", "mean", "min", "max", "range", *ds.PROFILE_QUANTILES, "iqr", "lower_fence", "upper_fence",
               "outlier_fraction_iqr")
    return _round(_round(x, 4, "std"), 1, "variance").select(
        "target", "split", "n_total", "n_valid", "coverage", "mean", "std", "variance", "min", "max", "range",
        *ds.PROFILE_QUANTILES, "iqr", "lower_fence", "upper_fence", "n_outliers_iqr", "outlier_fraction_iqr",
    )


def distribution_profile(spark: SparkSession, d: str) -> DataFrame:
    p = ds.profile(long_cache(spark, d), ["feature_name"], "value")
    numbers = ["mean", "std", "skewness", "excess_kurtosis", "p25", "p50", "p75"]
    return _round(p.select("feature_name", "n_rows", "n", "n_zero", "n_negative", *numbers), 4, *numbers)


def outlier_concentration(spark: SparkSession, d: str) -> DataFrame:
    x = ds.outlier_concentration(long_cache(spark, d).filter("value is not null"), ["feature_name"], "segment_id", "value")
    return _round(x, 8, "top1_share", "top5_share")


def _halves(spark: SparkSession, d: str):
    """Feature values with the side of the split: train against the rest."""
    x = long_cache(spark, d).filter("value is not null")
    return x.withColumn("a", F.coalesce(F.lower(F.trim("split_label")) == "train", F.lit(False)))


def ks_drift(spark: SparkSession, d: str) -> DataFrame:
    k = ds.ks_statistic(_halves(spark, d), F.col("feature_name"), F.col("value"), F.col("a"))
    return _round(k.withColumnRenamed("g", "feature_name"), 9, "ks")


def drift_label(spark: SparkSession, d: str) -> DataFrame:
    """Drift of the other splits against the training rows, per feature."""
    h = _halves(spark, d)
    p = ds.profile(h, ["feature_name", "a"], "value").groupBy("feature_name").agg(
        *[F.max(F.when(F.col("a") == side, F.col(c))).alias(f"{c}_{n}")
          for side, n in ((True, "a"), (False, "b")) for c in ("p50", "p25", "p75", "std")]
    )
    x = p.join(ks_drift(spark, d), "feature_name", "left")
    iqr = F.col("p75_a") - F.col("p25_a")
    shift = F.when(iqr != 0, F.abs(F.col("p50_a") - F.col("p50_b")) / F.greatest(iqr, F.lit(1e-8)))
    ratio = F.when(F.col("std_a") != 0, F.col("std_b") / F.col("std_a"))
    x = x.withColumn("median_shift_iqr", F.round(shift, 6)).withColumn("std_ratio", F.round(ratio, 6))
    return x.select("feature_name", "ks", "median_shift_iqr", "std_ratio",
                    ds.drift_label(F.col("ks"), F.col("median_shift_iqr")).alias("drift"))


def shape_flags(spark: SparkSession, d: str) -> DataFrame:
    """Shape of each feature over the training rows; none of these features is a correlation coefficient."""
    train = _halves(spark, d).filter("a")
    p = ds.profile(train, ["feature_name"], "value")
    few = ds.outlier_concentration(train, ["feature_name"], "segment_id", "value")
    peaks = ds.multimodal(train, ["feature_name"], "value")
    x = p.join(few, "feature_name", "left").join(peaks, "feature_name", "left")
    n_out, share = F.coalesce("n_outliers", F.lit(0)), F.coalesce(F.col("n_outliers") / F.col("n"), F.lit(0.0))
    flags = ds.shape_flags(
        F.round("skewness", 6), F.round("excess_kurtosis", 6), F.col("n_zero") / F.col("n"), share, n_out,
        F.coalesce("top5_share", F.lit(0.0)), F.col("is_multimodal"), F.col("n_boundary") / F.col("n"), F.lit(False),
    )
    return x.select("feature_name", F.round(share, 8).alias("outlier_share"), "is_multimodal",
                    F.round(F.col("n_boundary") / F.col("n"), 8).alias("boundary_share"), flags.alias("flags"))


def transform_compare(spark: SparkSession, d: str) -> DataFrame:
    """Skewness as it is and after log1p, for values above -1."""
    x = long_cache(spark, d).filter("value > -1").groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n"), F.skewness("value").alias("raw"), F.skewness(F.log1p("value")).alias("logged")
    )
    better = F.when(F.abs(F.round("logged", 4)) < F.abs(F.round("raw", 4)), F.lit("log1p")).otherwise(F.lit("none"))
    return _round(x.withColumn("recommendation", better), 4, "raw", "logged")


def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ds.histogram(_long_lines(spark, d), ["target"], "v", 20)


def correlation_flags(spark: SparkSession, d: str) -> DataFrame:
    wide = cache_rows(spark, d).select(*[
        F.when(F.get("feature_mask", F.lit(i)) & ~F.isnan(F.get("feature_values", F.lit(i)))
               & (F.abs(F.get("feature_values", F.lit(i))) < float("inf")),
               F.get("feature_values", F.lit(i)).cast("double")).alias(n)
        for i, n in enumerate(NAMES)
    ])
    x = ds.correlations(wide, NAMES)
    return x.select("a", "b", "n", F.round("r", 6).alias("r"), (F.abs("r") >= 0.95).alias("is_redundant"))


def bootstrap_ranking_ci(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of AUROC and AUPRC of the quantity score over resampled suppliers."""
    p = predictions(spark, d)
    return _round(ev.bootstrap_ranking(p, "cluster", F.col("label"), F.col("score_a"), 100), 7, "low", "high")


EXPONENTS = [-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0]
FINE_STEPS = [round(0.05 * k, 2) for k in range(-9, 10)]


def power_transform_fit(spark: SparkSession, d: str) -> DataFrame:
    """Best Yeo-Johnson exponent of all values and best Box-Cox exponent of the positive ones, per feature."""
    long = long_cache(spark, d).select("feature_name", "value")
    out = None
    for kind in ds.TRANSFORMS:
        x = ds.power_fit(long, ["feature_name"], "value", kind, EXPONENTS, FINE_STEPS).withColumn("transform", F.lit(kind))
        out = x if out is None else out.unionByName(x)
    return out.select("feature_name", "transform", F.round("exponent", 2).alias("exponent"), F.round("log_likelihood", 3).alias("log_likelihood"))


QUERIES = {
    f.__name__: f
    for f in (
        regression_metrics, mean_baseline, persistence_baseline, confusion_metrics, ranking_metrics, delong, permutation_tests, holm,
        model_win_counts, model_pair_audit, model_pair_metrics,
        cluster_bootstrap_ci, paired_permutation, bland_altman, paired_bland_altman, best_model_per_target,
        agreement_pearson_spearman, target_summary_by_split, distribution_profile, outlier_concentration, ks_drift,
        drift_label, shape_flags, transform_compare, value_histogram, correlation_flags,
        bootstrap_ranking_ci, power_transform_fit,
    )
}

from chronoward.plans.anchors_features import _C  # noqa: E402
from chronoward.plans.episodes_labels import _TL  # noqa: E402

_P = """
    pd as (select l_orderkey, l_linenumber, l_suppkey cluster, l_extendedprice y, l_quantity * p_retailprice pa,
                  l_quantity * 1000.0::double pb, l_returnflag = 'R' label, l_quantity score_a, l_extendedprice score_b,
                  l_returnflag split from lineitem join part on l_partkey = p_partkey)"""


def _reg(p: str, y: str = "y") -> str:
    return f"""count(*) n, round(avg(abs({y} - {p})), 5) mae, round(sqrt(avg(({y} - {p}) * ({y} - {p}))), 5) rmse,
               round(1 - sum(({y} - {p}) * ({y} - {p})) / (sum({y} * {y}) - sum({y}) * sum({y}) / count(*)), 5) r2"""


_LV = "(values ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) t(target)"
_LL = f"""
    ll as (select l_suppkey, l_returnflag split, target, case target when 'l_quantity' then l_quantity
                  when 'l_extendedprice' then l_extendedprice when 'l_discount' then l_discount else l_tax end v
           from lineitem, {_LV})"""
_SK = "avg(pow({v} - m, 3)) / pow(stddev_pop({v}), 3)"
_AUC = """
    lv as (select model, s, count(*) filter (where label) p, count(*) filter (where not label) q
           from (select 'quantity' model, score_a s, label from pd union all select 'price', score_b, label from pd)
           group by 1, 2),
    cu as (select *, sum(p) over w tp, sum(q) over w fp, sum(p) over (partition by model) m,
                  sum(q) over (partition by model) n from lv
           window w as (partition by model order by s desc rows unbounded preceding))"""
_PAIR = """
    kp as (select l_orderkey, l_linenumber, count(*) filter (where score_a <= 45) na, count(*) filter (where score_a >= 3) nb,
                  max(y) filter (where score_a <= 45) ya, max(y) filter (where score_a >= 3) yb,
                  max(pa) filter (where score_a <= 45) pa, max(pb) filter (where score_a >= 3) pb from pd group by 1, 2)"""
_PERM = f"""
    cl as (select split, cluster, unnest(['mae', 'mse']) metric,
                  unnest([sum(abs(y - pa)) - sum(abs(y - pb)), sum((y - pa) * (y - pa)) - sum((y - pb) * (y - pb))]) d, count(*) n
           from pd group by split, cluster),
    ob as (select metric, split, sum(d) / sum(n) observed, sum(n) total from cl group by 1, 2),
    fl as (select metric, split, replicate, sum(case when ((cluster::hugeint * 1103515245 + replicate * 12345 + 29) // 1024) % 2 = 0
                                              then d else -d end) s
           from cl, (select unnest(range(1, {REPLICATES} + 1)) replicate) group by 1, 2, 3),
    pv as (select metric, split, observed,
                  (1 + count(*) filter (where abs(s / total) >= abs(observed) - 1e-12)) / ({REPLICATES} + 1) p, count(*) n_replicates
           from fl join ob using (metric, split) group by 1, 2, 3)"""

SQL = {
    "regression_metrics": f"with {_P} select split, {_reg('pa')} from pd group by 1",
    "mean_baseline": f"""with {_P}, k as (select avg(y) m from pd where split = 'N')
        select split, n, mae, rmse, r2 + 0.0 r2 from (select split, {_reg('m')} from pd, k group by 1)""",
    "persistence_baseline": f"""with {_TL}, j as (select a.channel_name, a."value" p, b."value" y from tl a join tl b
            on a.segment_id = b.segment_id and a.channel_name = b.channel_name and b."minute" = a."minute" + 5)
        select channel_name, {_reg('p')} from j group by 1""",
    "confusion_metrics": f"""with {_P}, c as (select split, count(*) filter (where y > 30000 and pa > 30000) tp,
            count(*) filter (where y <= 30000 and pa > 30000) fp, count(*) filter (where y > 30000 and pa <= 30000) fn,
            count(*) filter (where y <= 30000 and pa <= 30000) tn from pd group by 1)
        select split, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) accuracy,
               round(tp / nullif(tp + fn, 0), 9) sensitivity, round(tn / nullif(tn + fp, 0), 9) specificity,
               round(tp / nullif(tp + fp, 0), 9) "precision", round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) f1,
               round((tp + fn) / (tp + fp + fn + tn), 9) prevalence from c""",
    "ranking_metrics": f"""with {_P},{_AUC}
        select model, cast(m as bigint) n_pos, cast(n as bigint) n_neg, round(sum(p * (n - fp + q / 2)) / (m * n), 8) auroc,
               round(sum(case when p > 0 then p * tp / (tp + fp) end) / m, 8) auprc,
               round(coalesce(max(case when tp >= 0.85 * m then 1 - fp / n end), -1), 8) spec_at_sens
        from cu group by model, m, n""",
    "delong": f"""with {_P},{_AUC},
        cp as (select model, s, (n - fp + q / 2) / n op, (tp - p + p / 2) / m oq from cu),
        pt as (select l_orderkey, l_linenumber, label, case when label then a.op else a.oq end a,
                      case when label then b.op else b.oq end b
               from pd join cp a on a.model = 'quantity' and a.s = score_a
               join cp b on b.model = 'price' and b.s = score_b),
        g as (select label, avg(a) ma, avg(b) mb, (var_samp(a) + var_samp(b) - 2 * covar_samp(a, b)) / count(*) v
              from pt group by 1),
        o as (select max(ma) filter (where label) auc_a, max(mb) filter (where label) auc_b, sum(v) variance from g),
        q as (select *, auc_a - auc_b df, (auc_a - auc_b) / sqrt(variance) z from o),
        t as (select *, abs(z) / sqrt(2) x, 1.0::double / (1.0::double + 0.3275911::double * abs(z) / sqrt(2)) t from q)
        select round(auc_a, 8) auc_a, round(auc_b, 8) auc_b, round(df, 8) difference,
               round(variance, 8) variance, round(z, 5) z,
               round(((((1.061405429::double * t - 1.453152027::double) * t + 1.421413741::double) * t - 0.284496736::double) * t
                      + 0.254829592::double) * t * exp(-x * x), 6) p_value,
               round(df - 1.959963984540054::double * sqrt(variance), 8) ci_low,
               round(df + 1.959963984540054::double * sqrt(variance), 8) ci_high from t""",
    "permutation_tests": f"""with {_P},{_PERM} select metric, split, round(observed, 4) observed, round(p, 6) p_value, n_replicates from pv""",
    "holm": f"""with {_P},{_PERM},
        r as (select metric, split, round(p, 6) p_value from pv),
        x as (select *, p_value * (count(*) over (partition by metric) - row_number() over (partition by metric order by p_value, split) + 1) x
              from r)
        select metric, split, p_value, round(least(1, max(x) over (partition by metric order by p_value, split
               rows unbounded preceding)), 6) adjusted from x""",
    "model_win_counts": f"""with {_P},
        m as (select split, 'a' model, 1 - sum((y - pa) * (y - pa)) / (sum(y * y) - sum(y) * sum(y) / count(*)) r2
              from pd group by 1 union all
              select split, 'b', 1 - sum((y - pb) * (y - pb)) / (sum(y * y) - sum(y) * sum(y) / count(*)) from pd group by 1),
        w as (select model from m qualify row_number() over (partition by split order by r2 desc, model desc) = 1)
        select model, count(*) n_wins from w group by 1""",
    "model_pair_audit": f"""with {_P},{_PAIR}
        select count(*) filter (where na > 0 and nb > 0) n_both, count(*) filter (where na > 0 and nb = 0) n_a_only,
               count(*) filter (where na = 0 and nb > 0) n_b_only, count(*) filter (where na > 1 or nb > 1) n_repeated,
               count(*) filter (where na = 1 and nb = 1 and ya <> yb) n_labels_differ from kp where na + nb > 0""",
    "model_pair_metrics": f"""with {_P},{_PAIR}, i as (select ya y, pa, pb from kp where na = 1 and nb = 1 and ya = yb)
        select 'a' model, {_reg('pa')} from i union all select 'b', {_reg('pb')} from i""",
    "cluster_bootstrap_ci": f"""with {_P},
        c as (select cluster, count(*) n, sum(abs(y - pa)) ae, sum((y - pa) * (y - pa)) se, sum(y) sy, sum(y * y) syy
              from pd group by 1),
        r as (select *, (((cluster::hugeint * 1103515245 + replicate * 12345 + 17) * 69069 + 1) % 1000003) / 1000003.0 u
              from c, (select unnest(range(1, {REPLICATES} + 1)) replicate)),
        w as (select *, case when u < 0.36787944 then 0 when u < 0.73575888 then 1 when u < 0.91969860 then 2
                             when u < 0.98101184 then 3 when u < 0.99634015 then 4 else 5 end k from r),
        s as (select replicate, sum(n * k) n, sum(ae * k) ae, sum(se * k) se, sum(sy * k) sy, sum(syy * k) syy
              from w group by 1 having sum(n * k) > 0),
        m as (select ae / n mae, sqrt(se / n) rmse, 1 - se / (syy - sy * sy / n) r2 from s),
        l as (select 'mae' metric, mae v from m union all select 'rmse', rmse from m union all select 'r2', r2 from m)
        select metric, count(*) n_replicates, round(quantile_cont(v, 0.025), 4) low, round(quantile_cont(v, 0.5), 4) median,
               round(quantile_cont(v, 0.975), 4) high from l group by 1""",
    "paired_permutation": f"""with {_P},
        c as (select cluster, sum(abs(y - pa)) - sum(abs(y - pb)) d, count(*) n from pd group by 1),
        o as (select sum(d) / sum(n) observed, sum(n) total from c),
        f as (select replicate, sum(case when ((cluster::hugeint * 1103515245 + replicate * 12345 + 29) // 1024) % 2 = 0
                                         then d else -d end) s
              from c, (select unnest(range(1, {REPLICATES} + 1)) replicate) group by 1)
        select round(observed, 6) observed,
               round((1 + count(*) filter (where abs(s / total) >= abs(observed) - 1e-12)) / ({REPLICATES} + 1), 6) p_value,
               count(*) n_replicates from f, o group by observed""",
    "bland_altman": f"""with {_P}, l as (select split, avg(pa - y) b, stddev_samp(pa - y) s from pd group by 1),
        c as (select split, avg(case when pa - y between b - 1.96 * s and b + 1.96 * s then 1.0::double else 0 end) c
              from pd join l using (split) group by 1)
        select split, count(*) n, round(avg(pa - y), 5) bias, round(stddev_samp(pa - y), 5) sd,
        round(avg(pa - y) - 1.96 * stddev_samp(pa - y), 5) loa_low, round(avg(pa - y) + 1.96 * stddev_samp(pa - y), 5) loa_high,
        round(regr_slope(pa - y, (pa + y) / 2), 5) slope, round(any_value(c), 5) coverage from pd join c using (split) group by 1""",
    "paired_bland_altman": f"""with {_P}, x as (select split, abs(avg(pa - y)) bias_a, stddev_samp(pa - y) sd_a,
            abs(avg(pb - y)) bias_b, stddev_samp(pb - y) sd_b from pd group by 1)
        select split, round(bias_a, 4) bias_a, round(sd_a, 4) sd_a, round(bias_b, 4) bias_b, round(sd_b, 4) sd_b,
               case when bias_a < bias_b and sd_a < sd_b then 'a_better' when bias_a > bias_b and sd_a > sd_b
                    then 'b_better' else 'mixed' end verdict from x""",
    "best_model_per_target": f"""with {_P},
        m as (select split, 'a' model, 1 - sum((y - pa) * (y - pa)) / (sum(y * y) - sum(y) * sum(y) / count(*)) r2
              from pd group by 1 union all
              select split, 'b', 1 - sum((y - pb) * (y - pb)) / (sum(y * y) - sum(y) * sum(y) / count(*)) from pd group by 1)
        select split, model, round(r2, 6) r2 from m
        qualify row_number() over (partition by split order by r2 desc, model desc) = 1""",
    "agreement_pearson_spearman": f"""with {_P},
        r as (select y, pb, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 ry,
                     rank() over (order by pb) + (count(*) over (partition by pb) - 1) / 2 rp from pd)
        select count(*) n, round(corr(y, pb), 5) pearson, round(corr(ry, rp), 5) spearman, round(avg(pb - y), 5) bias,
               round(avg(abs(pb - y)), 5) mae, round(quantile_cont(abs(pb - y), 0.95), 5) p95 from r""",
    "target_summary_by_split": f"""with {_LL}, b as (select * from ll union all select l_suppkey, 'all', target, v from ll),
        q as (select target, split, count(*) n_total, count(v) n_valid, avg(v) mean, stddev_pop(v) sd, var_pop(v) va, min(v) lo, max(v) hi,
                     quantile_cont(v, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) q from b group by 1, 2),
        f as (select *, q[3] - 1.5 * (q[5] - q[3]) fl, q[5] + 1.5 * (q[5] - q[3]) fh from q),
        o as (select b.target, b.split, count(*) k from b join f on b.target = f.target and b.split = f.split
              where v < fl or v > fh group by 1, 2)
        select target, split, n_total, n_valid, round(n_valid / n_total, 5) coverage, round(mean, 5) mean, round(sd, 4) "std",
               round(va, 1) variance, round(lo, 5) "min", round(hi, 5) "max", round(hi - lo, 5) "range",
               round(q[1], 5) p01, round(q[2], 5) p05, round(q[3], 5) p25, round(q[4], 5) p50, round(q[5], 5) p75,
               round(q[6], 5) p95, round(q[7], 5) p99, round(q[5] - q[3], 5) iqr, round(fl, 5) lower_fence, round(fh, 5) upper_fence,
               coalesce(k, 0) n_outliers_iqr, round(coalesce(k, 0) / n_valid, 5) outlier_fraction_iqr
        from f left join o using (target, split)""",
    "distribution_profile": f"""with {_C}, w as (select *, avg(v) over (partition by feature_name) m from lc)
        select feature_name, count(*) n_rows, count(v) n, count(*) filter (where v = 0) n_zero,
               count(*) filter (where v < 0) n_negative, round(avg(v), 4) mean, round(stddev_pop(v), 4) "std",
               round({_SK.format(v='v')}, 4) skewness,
               round(avg(pow(v - m, 4)) / pow(var_pop(v), 2) - 3, 4) excess_kurtosis, round(quantile_cont(v, 0.25), 4) p25,
               round(quantile_cont(v, 0.5), 4) p50, round(quantile_cont(v, 0.75), 4) p75 from w group by 1""",
    "outlier_concentration": f"""with {_C},
        q as (select feature_name, quantile_cont(v, 0.25) a, quantile_cont(v, 0.75) b from lc group by 1),
        o as (select feature_name, segment_id, count(*) c from lc join q using (feature_name)
              where v < a - 1.5 * (b - a) or v > b + 1.5 * (b - a) group by 1, 2),
        r as (select *, row_number() over (partition by feature_name order by c desc, segment_id) i from o)
        select feature_name, cast(sum(c) as bigint) n_outliers, count(*) n_entities,
               round(sum(c) filter (where i <= 1) / sum(c), 8) top1_share,
               round(sum(c) filter (where i <= 5) / sum(c), 8) top5_share from r group by 1""",
    "ks_drift": f"""with {_C},
        h as (select feature_name, v, coalesce(lower(trim(split_label)) = 'train', false) a from lc where v is not null),
        l as (select feature_name, v, count(*) filter (where a) ca, count(*) filter (where not a) cb from h group by 1, 2),
        c as (select feature_name, sum(ca) over w fa, sum(cb) over w fb, sum(ca) over (partition by feature_name) na,
                     sum(cb) over (partition by feature_name) nb from l
              window w as (partition by feature_name order by v rows unbounded preceding))
        select feature_name, cast(na as bigint) n_a, cast(nb as bigint) n_b, round(max(abs(fa / na - fb / nb)), 9) ks
        from c group by 1, 2, 3""",
    "drift_label": f"""with {_C},
        h as (select feature_name, v, coalesce(lower(trim(split_label)) = 'train', false) a from lc where v is not null),
        l as (select feature_name, v, count(*) filter (where a) ca, count(*) filter (where not a) cb from h group by 1, 2),
        c as (select feature_name, sum(ca) over w fa, sum(cb) over w fb, sum(ca) over (partition by feature_name) na,
                     sum(cb) over (partition by feature_name) nb from l
              window w as (partition by feature_name order by v rows unbounded preceding)),
        k as (select feature_name, round(max(abs(fa / na - fb / nb)), 9) ks from c group by 1),
        s as (select feature_name, quantile_cont(v, 0.5) filter (where a) ma, quantile_cont(v, 0.5) filter (where not a) mb,
                     quantile_cont(v, 0.75) filter (where a) - quantile_cont(v, 0.25) filter (where a) iq,
                     stddev_pop(v) filter (where a) sa, stddev_pop(v) filter (where not a) sb from h group by 1),
        x as (select feature_name, ks, round(case when iq <> 0 then abs(ma - mb) / greatest(iq, 1e-8) end, 6) median_shift_iqr,
                     round(case when sa <> 0 then sb / sa end, 6) std_ratio from s left join k using (feature_name))
        select *, case when ks is null then 'insufficient data'
                       when ks >= 0.12 or coalesce(median_shift_iqr, 0) >= 0.5 then 'possible meaningful shift'
                       when ks >= 0.08 or coalesce(median_shift_iqr, 0) >= 0.25 then 'mild shift' else 'no clear shift' end drift from x""",
    "shape_flags": f"""with {_C},
        t as (select feature_name, segment_id, v from lc where v is not null and lower(trim(split_label)) = 'train'),
        w as (select *, avg(v) over (partition by feature_name) m from t),
        p as (select feature_name, count(*) n, round({_SK.format(v='v')}, 6) sk,
                     round(avg(pow(v - m, 4)) / pow(var_pop(v), 2) - 3, 6) ku, count(*) filter (where v = 0) / count(*) z,
                     count(*) filter (where abs(v) >= 0.999) / count(*) bs, quantile_cont(v, 0.25) a, quantile_cont(v, 0.75) b
              from w group by 1),
        o as (select feature_name, segment_id, count(*) c from t join p using (feature_name)
              where v < a - 1.5 * (b - a) or v > b + 1.5 * (b - a) group by 1, 2),
        k as (select feature_name, sum(c) os, sum(c) filter (where i <= 5) / sum(c) t5
              from (select *, row_number() over (partition by feature_name order by c desc) i from o) group by 1),
        cu as (select feature_name, quantile_cont(v, 0.01) a, quantile_cont(v, 0.99) b from t group by 1),
        i as (select feature_name, v from t join cu using (feature_name) where v between a and b),
        sp as (select feature_name, count(*) n, min(v) lo, max(v) hi, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) iq
               from i group by 1),
        bi as (select *, cast(case when iq > 0 then greatest(ceil((hi - lo) / (2 * iq / cbrt(n))), 1) else 1 end as bigint) bins from sp),
        h as (select feature_name, least(cast(floor((v - lo) / (hi - lo) * bins) as bigint), bins - 1) j, count(*) c
              from i join bi using (feature_name) where n >= 200 and bins >= 15 group by 1, 2),
        al as (select feature_name, bins, unnest(range(0, bins)) j from bi where n >= 200 and bins >= 15),
        sm as (select feature_name, bins, j, sum(coalesce(c, 0)) over (partition by feature_name order by j
                      rows between 1 preceding and 1 following) / 3.0::double s from al left join h using (feature_name, j)),
        pk as (select feature_name, j, s from (select *, lag(s) over x pv, lead(s) over x nx, max(s) over (partition by feature_name) top
                      from sm window x as (partition by feature_name order by j))
               where j between 2 and bins - 3 and s > pv and s >= nx and s >= 0.25 * top),
        pp as (select *, lead(j) over (partition by feature_name order by j) j2, lead(s) over (partition by feature_name order by j) s2 from pk),
        mm as (select distinct feature_name from
               (select pp.feature_name, pp.j, min(sm.s) valley, least(any_value(pp.s), any_value(s2)) small from pp join sm
                on sm.feature_name = pp.feature_name and sm.j between pp.j and pp.j2 where pp.j2 - pp.j >= 3 group by 1, 2)
               where valley <= 0.75 * small),
        f as (select p.*, coalesce(os, 0) oc, coalesce(os, 0) / n osh, coalesce(t5, 0) tf, mm.feature_name is not null mu
              from p left join k using (feature_name) left join mm on mm.feature_name = p.feature_name),
        g as (select *, concat_ws(';', case when abs(sk) < 0.5 then 'approximately symmetric' when sk >= 0.5 then 'right-skewed'
                   when sk <= -0.5 then 'left-skewed' end, case when ku >= 3 or osh >= 0.05 then 'heavy-tailed' end,
                   case when mu then 'possible multimodality' end, case when z >= 0.05 then 'zero-inflated' end,
                   case when osh >= 0.01 then 'affected by extreme values' end,
                   case when osh >= 0.005 and tf >= 0.5 and oc >= 100 then 'train outliers concentrated in a few patients' end) fl from f)
        select feature_name, round(osh, 8) outlier_share, mu is_multimodal, round(bs, 8) boundary_share,
               case when fl = '' then 'roughly compact/unimodal' else fl end flags from g""",
    "transform_compare": f"""with {_C},
        w as (select feature_name, v, ln(1 + v) l, avg(v) over (partition by feature_name) m,
                     avg(ln(1 + v)) over (partition by feature_name) k from lc where v > -1),
        s as (select feature_name, count(*) n, round(avg(pow(v - m, 3)) / pow(stddev_pop(v), 3), 4) raw,
                     round(avg(pow(l - k, 3)) / pow(stddev_pop(l), 3), 4) logged from w group by 1)
        select *, case when abs(logged) < abs(raw) then 'log1p' else 'none' end recommendation from s""",
    "value_histogram": f"""with {_LL}, s as (select target, min(v) lo, max(v) hi from ll group by 1)
        select target, cast(case when hi > lo then least(floor((v - lo) / ((hi - lo) / 20)), 19) else 0 end as int) bin, count(*) n
        from ll join s using (target) group by 1, 2""",
    "correlation_flags": f"""with {_C},
        j as (select x.feature_name a, y.feature_name b, x.v u, y.v w, nx.i ia, ny.i ib from lc x
              join lc y on x.anchor_id = y.anchor_id and x.minute_idx = y.minute_idx
              join nm nx on nx.feature_name = x.feature_name join nm ny on ny.feature_name = y.feature_name
              where nx.i < ny.i and x.v is not null and y.v is not null)
        select a, b, count(*) n, round(corr(u, w), 6) r, abs(corr(u, w)) >= 0.95 is_redundant from j group by 1, 2
        having count(*) >= 5""",
    "bootstrap_ranking_ci": f"""with {_P},
        c as (select cluster, score_a s, count(*) filter (where label) p, count(*) filter (where not label) q from pd group by 1, 2),
        k as (select distinct cluster from c),
        r as (select *, (((cluster::hugeint * 1103515245 + replicate * 12345 + 41) * 69069 + 1) % 1000003) / 1000003.0 u
              from k, (select unnest(range(1, 101)) replicate)),
        w as (select *, case when u < 0.36787944 then 0 when u < 0.73575888 then 1 when u < 0.91969860 then 2
                             when u < 0.98101184 then 3 when u < 0.99634015 then 4 else 5 end t from r),
        l as (select replicate, s, sum(p * t) p, sum(q * t) q from c join w using (cluster) where t > 0 group by 1, 2),
        v as (select *, sum(p) over x tp, sum(q) over x fp, sum(p) over (partition by replicate) m,
                     sum(q) over (partition by replicate) n from l
              window x as (partition by replicate order by s desc rows unbounded preceding)),
        a as (select replicate, sum(p * (n - fp + q / 2)) / (m * n) auroc, sum(case when p > 0 then p * tp / (tp + fp) end) / m auprc
              from v where m > 0 and n > 0 group by replicate, m, n),
        z as (select 'auroc' metric, auroc v from a union all select 'auprc', auprc from a)
        select metric, count(*) n_replicates, round(quantile_cont(v, 0.025), 7) low, round(quantile_cont(v, 0.975), 7) high
        from z group by 1""",
    "power_transform_fit": f"""with {_C},
        e as (select round(unnest(range(-49, 50)) * 0.05::double, 2) ex),
        y as (select feature_name, ex, v, case
                  when v >= 0 and ex = 0 then ln(1 + v) when v >= 0 then (pow(v + 1, ex) - 1) / ex
                  when ex = 2 then -ln(1 - v) else -(pow(1 - v, 2 - ex) - 1) / (2 - ex) end t
              from lc, e where v is not null),
        b as (select feature_name, ex, v, case when ex = 0 then ln(v) else (pow(v, ex) - 1) / ex end t from lc, e where v > 0),
        l as (select feature_name, 'yeo_johnson' transform, ex,
                     -count(*) / 2 * ln(greatest(var_pop(t), 1e-300)) + (ex - 1) * sum(sign(v) * ln(1 + abs(v))) l from y group by 1, 2, 3
              union all select feature_name, 'box_cox', ex, -count(*) / 2 * ln(greatest(var_pop(t), 1e-300)) + (ex - 1) * sum(ln(v))
              from b group by 1, 2, 3)
        select feature_name, transform, ex exponent, round(l, 3) log_likelihood from l
        qualify row_number() over (partition by feature_name, transform order by l desc, ex) = 1""",
}
