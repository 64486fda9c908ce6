"""Evaluation of predictions: regression, ranking, agreement, resampling, significance.

Predictions are reduced to sufficient statistics per cluster or per distinct score
before anything is resampled or ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoward.operators.ordered_scan import Batches, partition_summaries, range_sorted, rescan, running_maximum, running_sums
from chronoward.session import settled_side


def regression_sums(y: Column, p: Column) -> list[Column]:
    """Sums from which the regression metrics follow."""
    return [
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(y - p)).alias("ae"), F.sum((y - p) * (y - p)).alias("se"),
        F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
    ]


def regression_metrics_from_sums() -> list[Column]:
    """MAE, RMSE and R2; R2 of a constant target is 1 if exact, else 0."""
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r2 = F.when(total > 1e-9 * F.abs(F.col("syy")), 1.0 - F.col("se") / total).otherwise(
        F.when(F.col("se") == 0, F.lit(1.0)).otherwise(0.0)
    )
    return [(F.col("ae") / F.col("n")).alias("mae"), F.sqrt(F.col("se") / F.col("n")).alias("rmse"), r2.alias("r2")]


def confusion(label: Column, predicted: Column) -> list[Column]:
    """Counts and rates of a binary prediction."""
    tp, fp = F.count_if(label & predicted), F.count_if(~label & predicted)
    fn, tn = F.count_if(label & ~predicted), F.count_if(~label & ~predicted)
    n = F.count(F.lit(1))

    def rate(a: Column, b: Column) -> Column:
        return F.round(F.try_divide(a, b), 9)

    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), rate(tp + tn, n).alias("accuracy"),
        rate(tp, tp + fn).alias("sensitivity"), rate(tn, tn + fp).alias("specificity"), rate(tp, tp + fp).alias("precision"),
        rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tp + fn, n).alias("prevalence"),
    ]


def score_levels(df: DataFrame, label: Column, score: Column, group: Column | None = None) -> DataFrame:
    """``g, score, pos, neg, before_pos, before_neg``: counts per distinct score and of all higher scores.

    Null labels or scores are left out. Rows are counted per score before the sort,
    so ties and repeated scores cost nothing.
    """
    g = F.lit("all") if group is None else F.coalesce(group.cast("string"), F.lit("\u0000"))
    levels = (
        df.select(g.alias("g"), score.cast("double").alias("score"), label.cast("boolean").alias("y"))
        .filter("score is not null and y is not null and not isnan(score)")
        .groupBy("g", "score").agg(F.count_if(F.col("y")).alias("pos"), F.count_if(~F.col("y")).alias("neg"))
        .withColumn("falling", -F.col("score"))
    )
    return running_sums(levels, "g", ["falling"], ["pos", "neg"]).drop("falling")


def ranking_metrics(levels: DataFrame, sensitivity: float = 0.85) -> DataFrame:
    """``g, n_pos, n_neg, auroc, auprc, spec_at_sens``: ties get midranks; -1 if no threshold qualifies.

    AUROC and AUPRC are null without both kinds of labels.
    """
    totals = settled_side(levels.groupBy("g").agg(F.sum("pos").alias("m"), F.sum("neg").alias("n")))
    x = levels.join(totals, "g")
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    below = F.col("n") - F.col("before_neg") - F.col("neg")
    spec = F.when(tp >= F.lit(sensitivity) * F.col("m"), 1.0 - F.try_divide(fp, F.col("n")))
    agg = x.groupBy("g", "m", "n").agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("u"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp))).alias("ap"), F.max(spec).alias("spec"),
    )
    both = (F.col("m") > 0) & (F.col("n") > 0)
    return agg.select(
        "g", F.col("m").alias("n_pos"), F.col("n").alias("n_neg"),
        F.when(both, F.col("u") / (F.col("m") * F.col("n"))).alias("auroc"),
        F.when(both, F.col("ap") / F.col("m")).alias("auprc"),
        F.when(both, F.coalesce("spec", F.lit(-1.0))).otherwise(-1.0).alias("spec_at_sens"),
    )


def _components(df: DataFrame, label: Column, score: Column, name: str) -> DataFrame:
    """Per distinct score: the share of the other class it beats (ties count half), for either class."""
    levels = score_levels(df, label, score)
    totals = levels.agg(F.sum("pos").alias("m"), F.sum("neg").alias("n"))
    return levels.join(F.broadcast(totals)).select(
        F.col("score").alias(name),
        F.try_divide(F.col("n") - F.col("before_neg") - F.col("neg") / 2.0, F.col("n")).alias(f"{name}_pos"),
        F.try_divide(F.col("before_pos") + F.col("pos") / 2.0, F.col("m")).alias(f"{name}_neg"),
    )


#: Fixed value: 97.5 % quantile of the normal law.
Z_95 = 1.959963984540054
#: Coefficients of the rational approximation of erfc (Abramowitz and Stegun 7.1.26).
ERFC_P, ERFC_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided_p(z: Column) -> Column:
    """Probability of a normal deviate at least as large as ``z`` in magnitude."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + ERFC_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERFC_A):
        poly = (poly + a) * t
    return poly * F.exp(-x * x)


def delong(df: DataFrame, label: Column, score_a: Column, score_b: Column) -> DataFrame:
    """Two correlated AUROCs on the same rows: ``auc_a, auc_b, difference, variance, z, p_value, ci_low, ci_high``.

    The two-sided p of the normal law is approximated to 1.5e-7, the interval covers 95 %.
    """
    rows = df.select(label.cast("boolean").alias("y"), score_a.cast("double").alias("a"), score_b.cast("double").alias("b"))
    rows = rows.filter("y is not null and a is not null and b is not null")
    x = rows.join(_components(rows, F.col("y"), F.col("a"), "a"), "a").join(
        _components(rows, F.col("y"), F.col("b"), "b"), "b"
    ).select("y", *[F.when(F.col("y"), F.col(f"{n}_pos")).otherwise(F.col(f"{n}_neg")).alias(n) for n in "ab"])
    agg = x.groupBy("y").agg(
        F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"),
        F.covar_samp("a", "b").alias("cab"), F.count(F.lit(1)).alias("k"),
    )
    one = agg.agg(
        F.max(F.when(F.col("y"), F.col("ma"))).alias("auc_a"), F.max(F.when(F.col("y"), F.col("mb"))).alias("auc_b"),
        F.sum((F.col("va") + F.col("vb") - 2 * F.col("cab")) / F.col("k")).alias("variance"),
    )
    return one.select(
        "auc_a", "auc_b", (F.col("auc_a") - F.col("auc_b")).alias("difference"), "variance",
        F.try_divide(F.col("auc_a") - F.col("auc_b"), F.sqrt("variance")).alias("z"),
    ).select(
        "*", two_sided_p(F.col("z")).alias("p_value"),
        (F.col("difference") - Z_95 * F.sqrt("variance")).alias("ci_low"), (F.col("difference") + Z_95 * F.sqrt("variance")).alias("ci_high"),
    )


def holm(pvalues: DataFrame, family: list[str], name: str, p: str) -> DataFrame:
    """``pvalues`` plus ``adjusted``: Holm's step-down within each family; ties by name.

    Ranks and the running maximum come from range sorts, so a family may be of any size.
    """
    label = F.concat_ws("\u0001", F.lit("f"), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in family])
    rows = pvalues.withColumns({"_f": label, "_p": F.col(p).cast("double"), "_one": F.lit(1).cast("long")}).filter("_p is not null")
    ranked = running_sums(rows, "_f", ["_p", name], ["_one"])
    size = settled_side(ranked.groupBy("_f").agg(F.count(F.lit(1)).alias("_k")))
    step = ranked.join(size, "_f").withColumn("_x", F.col("_p") * (F.col("_k") - F.col("before__one")))
    out = running_maximum(step, "_f", ["_p", name], "_x")
    return out.withColumn("adjusted", F.least("greatest", F.lit(1.0))).select(*pvalues.columns, "adjusted")


def bland_altman(y: Column, p: Column) -> list[Column]:
    """Bias, spread, limits of agreement and proportional slope."""
    diff, middle = p - y, (p + y) / 2.0
    bias, sd = F.avg(diff), F.stddev_samp(diff)
    return [
        F.count(F.lit(1)).alias("n"), bias.alias("bias"), sd.alias("sd"), (bias - 1.96 * sd).alias("loa_low"),
        (bias + 1.96 * sd).alias("loa_high"), F.regr_slope(diff, middle).alias("slope"),
    ]


def within_limits(df: DataFrame, keys: list[str], y: Column, p: Column) -> DataFrame:
    """:func:`bland_altman` per key plus ``coverage``, the share of rows within the limits."""
    limits = settled_side(df.groupBy(*keys).agg(*bland_altman(y, p)))
    inside = (p - y).between(F.col("loa_low"), F.col("loa_high")).cast("double")
    cover = df.join(limits.select(*keys, "loa_low", "loa_high"), keys).groupBy(*keys).agg(F.avg(inside).alias("coverage"))
    return limits.join(cover, keys)


def align_predictions(a: DataFrame, b: DataFrame, keys: list[str], label: str, strict: bool = False) -> DataFrame:
    """Rows of two models with the same sample: ``keys, label`` and both models' other columns with ``_a``/``_b``.

    Samples of one model only are left out, or with ``strict`` an error when the query
    runs, as are samples whose labels differ or that occur twice in a model.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(
            *[F.first(c).alias(f"{c}_{name}") for c in rest], F.count(F.lit(1)).alias(f"_n_{name}")
        )

    both = side(a, "a").join(side(b, "b"), keys, "full" if strict else "inner")
    wrong = (
        F.when(F.col("_n_a").isNull() | F.col("_n_b").isNull(), F.lit("sample of one model only"))
        .when((F.col("_n_a") > 1) | (F.col("_n_b") > 1), F.lit("repeated sample"))
        .when(~F.col(f"{label}_a").eqNullSafe(F.col(f"{label}_b")), F.lit("labels differ"))
    )
    checked = both.filter(F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean"))) if strict else both.filter(
        wrong.isNull()
    )
    rest = [c for c in checked.columns if c not in (*keys, f"{label}_a", f"{label}_b", "_n_a", "_n_b")]
    return checked.select(*keys, F.col(f"{label}_a").alias(label), *rest)


def prediction_audit(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One row: samples of both models, of one only, repeated ones, and (of those not repeated) of differing labels."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.first(label).alias(f"l{name}"), F.count(F.lit(1)).alias(f"n{name}"))

    x = side(a, "a").join(side(b, "b"), keys, "full")
    both = F.col("na").isNotNull() & F.col("nb").isNotNull()
    return x.agg(
        F.count_if(both).alias("n_both"), F.count_if(F.col("nb").isNull()).alias("n_a_only"),
        F.count_if(F.col("na").isNull()).alias("n_b_only"), F.count_if((F.col("na") > 1) | (F.col("nb") > 1)).alias("n_repeated"),
        F.count_if(both & (F.col("na") == 1) & (F.col("nb") == 1) & ~F.col("la").eqNullSafe(F.col("lb"))).alias("n_labels_differ"),
    )


def replicate_counts(clusters: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """``replicate, key, times``: deterministic resampling weights per replicate and cluster.

    A cluster's weight is drawn from Poisson(1) by an arithmetic hash that any engine
    repeats, so no list of clusters is ever gathered (the Poisson bootstrap).
    """
    u = F.pmod(
        (F.col(key).cast("decimal(38,0)") * 1103515245 + F.col("replicate") * 12345 + seed) * 69069 + 1,
        F.lit(1000003),
    ).cast("double") / 1000003.0
    # Poisson(1) quantiles
    times = (
        F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3)
        .when(u < 0.99634015, 4).otherwise(5)
    )
    return clusters.select(key, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn(
        "times", times
    )


def bootstrap_regression(per_cluster: DataFrame, key: str, replicates: int, seed: int = 17) -> DataFrame:
    """Percentile intervals of MAE, RMSE and R2 over resampled clusters.

    ``per_cluster`` holds :func:`regression_sums` per cluster; the resample joins
    these few rows, never the predictions.
    """
    weights = replicate_counts(per_cluster.select(key), key, replicates, seed)
    sums = per_cluster.join(weights, key).groupBy("replicate").agg(
        *[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("n", "ae", "se", "sy", "syy")]
    )
    m = sums.filter("n > 0").select("replicate", *regression_metrics_from_sums())
    long = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("mae", "rmse", "r2")])).alias("x"))
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return long.select("x.metric", "x.v").groupBy("metric").agg(q.alias("q"), F.count(F.lit(1)).alias("n_replicates")).select(
        "metric", "n_replicates", *[F.element_at("q", i + 1).alias(c) for i, c in enumerate(("low", "median", "high"))]
    )


def paired_permutation(
    per_cluster: DataFrame, key: str, a: str, b: str, n: str, replicates: int, by: list[str] | None = None, seed: int = 29
) -> DataFrame:
    """Swap the two models' error sums per cluster: ``by..., observed, p_value, n_replicates``.

    ``observed`` is the mean difference; the two-sided p is (1 + number of permuted
    differences at least as extreme) / (replicates + 1), for each of ``by``.
    """
    by = by or []
    x = per_cluster.select(*by, key, (F.col(a) - F.col(b)).alias("d"), F.col(n).alias("n"))
    coin = F.pmod(
        F.floor((F.col(key).cast("decimal(38,0)") * 1103515245 + F.col("replicate") * 12345 + seed) / 1024), F.lit(2)
    )
    # replicate 0 swaps nothing: the observed difference
    flips = x.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).groupBy(*by, "replicate").agg(
        F.sum(F.when((coin == 0) | (F.col("replicate") == 0), F.col("d")).otherwise(-F.col("d"))).alias("s"),
        F.sum("n").alias("total"),
    )
    mean = F.col("s") / F.col("total")
    per = flips.groupBy(*by).agg(
        F.max(F.when(F.col("replicate") == 0, mean)).alias("observed"),
        F.array_agg(F.when(F.col("replicate") > 0, F.abs(mean))).alias("_m"),
    )
    extreme = F.size(F.filter("_m", lambda m: m >= F.abs(F.col("observed")) - 1e-12))
    return per.select(*by, "observed", ((1 + extreme) / (replicates + 1)).alias("p_value"), F.size("_m").alias("n_replicates"))


#: Fixed value: modulus of the arithmetic hash that draws resampling weights.
_MODULUS = 1000003
#: Distribution function of Poisson(1) at 0 to 4.
_POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015)


def _times(key: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Rows x replicates: how often each key is drawn, as :func:`replicate_counts` draws it."""
    inner = (key[:, None] % _MODULUS) * (1103515245 % _MODULUS) + np.arange(1, replicates + 1)[None, :] * 12345 + seed
    u = ((inner % _MODULUS) * 69069 + 1) % _MODULUS / float(_MODULUS)
    return np.searchsorted(np.array(_POISSON), u, side="right")


@dataclass
class _Sweep:
    """A falling sweep over scores for every replicate at once: counts before, and the level that is still open."""

    tp: np.ndarray
    fp: np.ndarray
    score: float | None = None
    pos: np.ndarray | None = None
    neg: np.ndarray | None = None

    def closed(self) -> _Sweep:
        """The state once the open level has ended."""
        return self if self.score is None else _Sweep(self.tp + self.pos, self.fp + self.neg)


def _sweep(batches: Batches, state: _Sweep, replicates: int, seed: int, ended) -> _Sweep:
    """Read rows (score falling, key, p, q); call ``ended(state)`` for each level that ends; the state at the end."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4000):
            part = batch.slice(lo, 4000)
            score = part.column("score").to_numpy()
            times = _times(part.column("_k").to_numpy(), replicates, seed)
            starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
            pos = np.add.reduceat(times * part.column("p").to_numpy()[:, None], starts, axis=0)
            neg = np.add.reduceat(times * part.column("q").to_numpy()[:, None], starts, axis=0)
            for k, value in enumerate(score[starts]):
                if state.score is not None and value == state.score:
                    state = _Sweep(state.tp, state.fp, state.score, state.pos + pos[k], state.neg + neg[k])
                    continue
                if state.score is not None:
                    ended(state)
                before = state.closed()
                state = _Sweep(before.tp, before.fp, float(value), pos[k], neg[k])
    return state


def bootstrap_ranking(
    df: DataFrame, key: str, label: Column, score: Column, replicates: int, seed: int = 41
) -> DataFrame:
    """Percentile intervals of AUROC and AUPRC over resampled clusters (``key``, whole numbers).

    Rows are counted per score and cluster and range-sorted once; every task sweeps its
    part of the scores for all replicates together, so no row is ever repeated per
    replicate. One vector of counts per partition reaches the driver. Replicates with
    one class only are left out.
    """
    per = (
        df.select(F.col(key).cast("long").alias("_k"), score.cast("double").alias("score"), label.cast("boolean").alias("y"))
        .filter("_k is not null and score is not null and y is not null and not isnan(score)")
        .groupBy("_k", "score").agg(F.count_if(F.col("y")).alias("p"), F.count_if(~F.col("y")).alias("q"))
    )
    ordered = range_sorted(per.withColumn("falling", -F.col("score")), ["falling", "_k"])
    zero = np.zeros(replicates, dtype=np.int64)

    def summarise(batches: Batches, _) -> tuple | None:
        first: list[float] = []

        def looked(rows: Batches) -> Batches:
            for batch in rows:
                if batch.num_rows:
                    first.append(batch.column("score")[0].as_py())
                    del first[1:]
                    yield batch

        end = _sweep(looked(batches), _Sweep(zero, zero), replicates, seed, lambda state: None)
        return (first[0], end) if first else None

    parts = partition_summaries(ordered, summarise)
    state, before, pids = _Sweep(zero, zero), {}, sorted(parts)
    for place, pid in enumerate(pids):
        first, end = parts[pid]
        goes_on = place + 1 < len(pids) and parts[pids[place + 1]][0] == end.score
        joins = state.score is not None and state.score == first
        base = state if joins else state.closed()  # a level that does not go on was counted where it ended
        before[pid] = (base, goes_on)
        if joins and end.score == first:  # one level fills the partition
            state = _Sweep(state.tp, state.fp, first, state.pos + end.pos, state.neg + end.neg)
        else:
            more = (state.pos, state.neg) if joins else (zero, zero)
            state = _Sweep(base.tp + more[0] + end.tp, base.fp + more[1] + end.fp, end.score, end.pos, end.neg)
    totals = state.closed()
    given = {pid: (*entry, totals.tp, totals.fp) for pid, entry in before.items()}

    def measure(batches: Batches, known) -> Batches:
        if known is None:
            return
        start, goes_on, m, n = known
        area, precision = np.zeros(replicates), np.zeros(replicates)

        def ended(level: _Sweep) -> None:
            nonlocal area, precision
            area = area + level.pos * (n - level.fp - level.neg / 2.0)
            tp, fp = level.tp + level.pos, level.fp + level.neg
            precision = precision + level.pos * tp / np.maximum(tp + fp, 1)

        end = _sweep(batches, start, replicates, seed, ended)
        if end.score is not None and not goes_on:
            ended(end)
        both = (m > 0) & (n > 0)
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(area[at] / (m[at] * n[at])), pa.array(precision[at] / m[at])], names=["replicate", "auroc", "auprc"]
        )

    shares = rescan(ordered, given, measure, "replicate long, auroc double, auprc double")
    each = shares.groupBy("replicate").agg(F.sum("auroc").alias("auroc"), F.sum("auprc").alias("auprc"))
    long = each.select(F.explode(F.array(
        F.struct(F.lit("auroc").alias("metric"), F.col("auroc").alias("v")),
        F.struct(F.lit("auprc").alias("metric"), F.col("auprc").alias("v")),
    )).alias("x")).select("x.*")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n_replicates"), q.alias("q")).select(
        "metric", "n_replicates", F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high")
    )
