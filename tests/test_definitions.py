"""Definitions with fixed limits, ordered scans of charts, key alignment: brute force and awkward inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoward.functions import arrays as ar
from chronoward.operators import anchors as an
from chronoward.operators import cohort as co
from chronoward.operators import distributions as ds
from chronoward.operators import evaluation as ev
from chronoward.operators import intervals as iv
from chronoward.operators import ordered_scan
from chronoward.sources import sinks as sk

ARRAYS = [[], [2.0], [1.0, 1.0, 1.0], [0.0] * 30, [float(i % 7) for i in range(45)], [5.0] * 16 + [1.0, 9.0, 2.0]]


def test_array_statistics(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ARRAYS)], "i int, x array<double>")
    x = F.col("x")
    rows = df.select(
        "i", ar.robust_scale(x).alias("scale"), ar.flatline_fraction(x, 8).alias("flat"), ar.extreme_fraction(x).alias("extreme"),
        ar.poincare(x).alias("p"),
    ).orderBy("i").collect()
    for r in rows:
        a = np.array(ARRAYS[r.i])
        if not len(a):
            assert (r.scale, r.flat, r.p) == (1.0, 1.0, None)
            continue
        scale = 1.4826 * np.median(np.abs(a - np.median(a)))
        assert math.isclose(r.scale, scale if scale > 1e-8 else max(a.std(), 1.0))
        parts = [a[k : k + 8] for k in range(0, len(a), 8)]
        assert math.isclose(r.flat, np.mean([p.std() < 1e-4 for p in parts]))
        span = a.max() - a.min()
        near = np.minimum(a - a.min(), a.max() - a) <= max(0.01 * span, 1e-8)
        assert math.isclose(r.extreme, 1.0 if span < 1e-8 else near.mean())
        if len(a) <= 20:
            assert r.p is None
        else:
            step = np.diff(a).std()
            assert math.isclose(r.p.sd1, math.sqrt(0.5) * step)
            assert math.isclose(r.p.sd2, math.sqrt(max(2 * a.std() ** 2 - 0.5 * step**2, 0.0)), abs_tol=1e-12)


def test_drift_names(spark):
    rows = [(None, 0.9), (0.12, None), (0.08, 0.1), (0.01, 0.25), (0.01, 0.6), (0.079, 0.249), (0.05, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k double, m double")
    got = [r.d for r in df.select("i", ds.drift_label(F.col("k"), F.col("m")).alias("d")).orderBy("i").collect()]
    strong, mild, none = "possible meaningful shift", "mild shift", "no clear shift"
    assert got == ["insufficient data", strong, mild, mild, strong, none, none]


def brute_multimodal(v) -> bool:
    if len(v) < 200:
        return False
    lo, hi = np.percentile(v, [1, 99])
    v = v[(v >= lo) & (v <= hi)]
    counts, _ = np.histogram(v, bins="fd")
    if len(v) < 200 or len(counts) < 15:
        return False
    s = np.convolve(counts, [1 / 3] * 3, mode="same")
    at = [i for i in range(2, len(s) - 2) if s[i] > s[i - 1] and s[i] >= s[i + 1] and s[i] >= 0.25 * s.max()]
    return any(b - a >= 3 and s[a : b + 1].min() <= 0.75 * min(s[a], s[b]) for a, b in zip(at, at[1:]))


def test_multimodal(spark):
    rng = np.random.default_rng(4)
    samples = {
        "one": rng.normal(0, 1, 3000), "two": np.r_[rng.normal(0, 1, 12000), rng.normal(8, 1, 9000)], "few": rng.normal(0, 1, 150),
        "flat": rng.uniform(0, 1, 2000), "constant": np.full(500, 3.0), "skewed": rng.exponential(1, 3000),
    }
    df = spark.createDataFrame([(k, float(x)) for k, v in samples.items() for x in v] + [("one", None)], "k string, v double")
    got = {r.k: r.is_multimodal for r in ds.multimodal(df, ["k"], "v").collect()}
    assert got == {k: brute_multimodal(v) for k, v in samples.items()} and got["two"] and not got["one"]


def test_summary_counts_weights(spark):
    rows = [("a", 1.0, 3), ("a", 2.0, 1), ("a", 100.0, 1), ("a", None, 2), ("b", None, 4)]
    out = {r.k: r for r in ds.summary_of_counts(spark.createDataFrame(rows, "k string, v double, n long"), ["k"], "v", "n").collect()}
    v = np.array([1.0, 1.0, 1.0, 2.0, 100.0])
    a = out["a"]
    assert (a.n_total, a.n_valid, a.n_outliers_iqr) == (7, 5, 1) and math.isclose(a.p50, 1.0) and math.isclose(a.p75, 2.0)
    assert math.isclose(a["mean"], v.mean()) and math.isclose(a.variance, v.var()) and math.isclose(a.coverage, 5 / 7)


def brute_episodes(rows):
    """(start, end, first, greatest rate, rows) per episode, by reading a chart from the top."""
    out, rate, stopped = [], None, False
    for t, r, stop in rows:
        known = rate if r is None else r
        idle = rate == 0
        if (idle and known != 0) or (not idle and (stopped or (rate is None and (r or 0) > 0))):
            out.append([None, None, t, None, 0, t])
        if out:
            e = out[-1]
            e[0] = t if e[0] is None and r is not None else e[0]
            e[1] = t if e[1] is None and (stop or r == 0) else e[1]
            e[3] = r if e[3] is None or (r is not None and r > e[3]) else e[3]
            e[4] += 1
            e[5] = t
        rate, stopped = known, stop
    return [(e[0], e[5] if e[1] is None else e[1], e[2], e[3], e[4]) for e in out]


def test_charts_spread_over_partitions(spark):
    rng = random.Random(8)
    charts = {}
    for user, n in ((1, 4000), (2, 1), (3, 60), (4, 0), (5, 300)):
        charts[user] = [(t, rng.choice([None, None, 0.0, 0.0, 1.0, 5.0]), rng.random() < 0.1) for t in range(n)]
    charts[6] = [(t, None, False) for t in range(500)]  # nothing known
    charts[7] = [(0, 3.0, False)] + [(t, None, False) for t in range(1, 2500)] + [(2500, 0.0, False), (2501, 2.0, True), (2502, None, False)]
    df = spark.createDataFrame([(u, *r, 1) for u, c in charts.items() for r in c], "user long, t long, rate double, stopped boolean, n long")
    got = {}
    for r in co.charted_episodes(df, ["user"]).orderBy("user", "episode").collect():
        got.setdefault(r.user, []).append((r.start, r.end, r.first_time, r.max_rate, r.n))
    assert got == {u: brute_episodes(c) for u, c in charts.items() if brute_episodes(c)}
    assert co.charted_episodes(df.limit(0), ["user"]).count() == 0


def test_count_earlier(spark):
    rng = random.Random(2)
    rows = [("a", rng.randint(0, 50)) for _ in range(400)] + [("b", 5)]
    asked = [("a", t, t) for t in range(0, 60, 7)] + [("b", 5, 100), ("b", 6, 101), ("c", 1, 102)]
    got = {r.q: r.n for r in iv.count_earlier(
        spark.createDataFrame(asked, "label string, at long, q long"), spark.createDataFrame(rows, "label string, at long"), ["q"]
    ).collect()}
    assert got == {q: sum(k == label and t < at for k, t in rows) for label, at, q in asked}


def test_running_maximum_and_holm(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.random() - 0.5) for i in range(3000)] + [("cold", 0, -5.0), ("cold", 1, -7.0)]
    out = ordered_scan.running_maximum(spark.createDataFrame(rows, "k string, i long, v double"), "k", ["i"], "v").collect()
    got = {(r.k, r.i): r.greatest for r in out}
    top = -math.inf
    for k, i, v in rows[:3000]:
        top = max(top, v)
        assert got[k, i] == top
    assert got["cold", 1] == -5.0
    p = [("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", 0.005), ("g", "a", 0.7), ("g", "b", None)]
    adjusted = {(r.f, r.t): r.adjusted for r in ev.holm(spark.createDataFrame(p, "f string, t string, p double"), ["f"], "t", "p").collect()}
    want = {("f", "d"): 0.02, ("f", "a"): 0.03, ("f", "c"): 0.06, ("f", "b"): 0.06, ("g", "a"): 0.7}
    assert {k: round(v, 12) for k, v in adjusted.items()} == want


def test_normal_tail(spark):
    z = [0.0, 0.3, -1.96, 3.5, 8.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(ev.two_sided_p(F.col("z")).alias("p")).collect()]
    assert all(abs(a - math.erfc(abs(b) / math.sqrt(2))) < 3e-7 for a, b in zip(got, z, strict=True))


def test_model_pairs(spark):
    a = spark.createDataFrame([(1, 1.0, 0.5), (2, 2.0, 0.5), (3, 3.0, 0.5), (3, 3.0, 0.1)], "id long, y double, p double")
    b = spark.createDataFrame([(1, 1.0, 0.7), (2, 9.0, 0.7), (4, 4.0, 0.7)], "id long, y double, p double")
    audit = ev.prediction_audit(a, b, ["id"], "y").first()
    assert tuple(audit) == (2, 1, 1, 1, 1)
    rows = ev.align_predictions(a, b, ["id"], "y").collect()
    assert [(r.id, r.y, r.p_a, r.p_b) for r in rows] == [(1, 1.0, 0.5, 0.7)]
    with pytest.raises(Exception, match="sample|labels"):
        ev.align_predictions(a, b, ["id"], "y", strict=True).collect()
    assert ev.align_predictions(a.limit(0), b.limit(0), ["id"], "y", strict=True).count() == 0


def test_keys_columns_and_subsets(spark):
    a = spark.createDataFrame([(1, "s", 10.0), (2, "s", 20.0)], "anchor_id long, seg string, t double")
    good = spark.createDataFrame([("s", 10.0000000001, 5.0), ("s", 20.0, 6.0), ("s", 30.0, 7.0)], "seg string, t double, y double")
    choices = [["anchor_id"], ["seg", "t"]]
    rows = an.align_targets(a, good, choices, times=["t"]).orderBy("anchor_id").collect()
    assert [(r.anchor_id, r.y) for r in rows] == [(1, 5.0), (2, 6.0)]
    with pytest.raises(Exception, match="without targets"):
        an.align_targets(a, good.filter("t < 15"), choices, times=["t"]).collect()
    with pytest.raises(ValueError):
        an.best_key(a, good, [["anchor_id"]])
    side = spark.createDataFrame([(1, 0.1), (2, 0.2)], "anchor_id long, f double")
    assert an.concat_columns(a, side, ["anchor_id"]).count() == 2
    with pytest.raises(ValueError):
        an.concat_columns(a, side.withColumnRenamed("f", "t"), ["anchor_id"])
    with pytest.raises(Exception, match="one side"):
        an.concat_columns(a, side.limit(1), ["anchor_id"]).collect()
    assert an.subset_by_ids(a, side.limit(1), "anchor_id").count() == 1
    with pytest.raises(Exception, match="missing"):
        an.subset_by_ids(a, spark.createDataFrame([(9,)], "anchor_id long"), "anchor_id").collect()


def test_bundles(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], [True, False])], "id long, y array<double>, m array<boolean>")
    sk.write_bundle(df, f"file://{tmp_path}/b", "y", "m", ["five", "ten"], "1")
    row = sk.read_bundle(spark, f"file://{tmp_path}/b", "1").first()
    assert row.y == [1.0, 2.0] and row.target_names == ["five", "ten"]
    with pytest.raises(ValueError):
        sk.read_bundle(spark, f"file://{tmp_path}/b", "2")
    with pytest.raises(Exception, match="length"):
        sk.write_bundle(df, f"file://{tmp_path}/c", "y", "m", ["five"], "1")


def test_bootstrap_of_ranks_over_partitions(spark):
    """Levels of tied scores that straddle partitions, against the same replicates computed in one place."""
    rng = random.Random(6)
    rows = [(rng.randint(0, 30), rng.choice([1.0, 1.0, 1.0, 2.0, rng.random() * 3]), rng.random() < 0.3) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k long, s double, y boolean")
    got = {r.metric: r for r in ev.bootstrap_ranking(df, "k", F.col("y"), F.col("s"), 20).collect()}
    k, s, y = (np.array(c) for c in zip(*rows, strict=True))
    times = ev._times(k, 20, 41)
    auroc, auprc = [], []
    for r in range(20):
        w = times[:, r]
        m, n, tp, fp, area, precision = (w * y).sum(), (w * ~y).sum(), 0, 0, 0.0, 0.0
        for level in np.unique(s)[::-1]:
            p, q = (w * y)[s == level].sum(), (w * ~y)[s == level].sum()
            area += p * (n - fp - q / 2)
            tp, fp = tp + p, fp + q
            precision += p * tp / max(tp + fp, 1)
        auroc.append(area / (m * n))
        auprc.append(precision / m)
    for name, want in (("auroc", auroc), ("auprc", auprc)):
        low, high = np.percentile(want, [2.5, 97.5])
        assert math.isclose(got[name].low, low) and math.isclose(got[name].high, high) and got[name].n_replicates == 20
    assert ev.bootstrap_ranking(df.limit(0), "k", F.col("y"), F.col("s"), 5).count() == 0
