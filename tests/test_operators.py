"""Reference operators on hand-built frames: scenarios, edge cases, skew-safe forms."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoward.functions import kernels as kn
from chronoward.operators import anchors as an
from chronoward.operators import cohort as co
from chronoward.operators import episodes as ep
from chronoward.operators import evaluation as ev
from chronoward.operators import intervals as iv
from chronoward.operators import labels as lb
from chronoward.operators import ordered_scan, quantiles
from chronoward.operators import timeline as tl
from chronoward.sources import readers as rd
from chronoward.sources import sinks as sk


def brute_runs(minutes):
    out = []
    for m in sorted(minutes):
        if out and out[-1][1] == m:
            out[-1][1] = m + 1
        else:
            out.append([m, m + 1])
    return sorted((a, b) for a, b in out)


def test_runs_cross_block_borders(spark):
    rng = random.Random(1)
    minutes = {m for m in range(3 * ep.BLOCK + 50) if rng.random() < 0.9} | set(range(ep.BLOCK - 30, 2 * ep.BLOCK + 30))
    df = spark.createDataFrame([("k", m, True) for m in minutes], "key string, minute long, event boolean")
    got = sorted((r.start, r.end_exclusive) for r in ep.runs(df, ["key"]).collect())
    assert got == brute_runs(minutes)


def _series(spark, values, key="s"):
    bins = spark.createDataFrame(
        [(key, "low", m, v) for m, v in enumerate(values) if v is not None], "series string, event_name string, minute long, event boolean"
    )
    on = ["series", "event_name"]
    lengths = bins.groupBy(*on).agg((F.max("minute") + 1).alias("length"))
    return ep.annotated(bins, on, 5), lengths, on


def _label(spark, values, input_end, horizon=5, **kw):
    series, lengths, on = _series(spark, values)
    a = spark.createDataFrame([(1, "s", "low", input_end)], "anchor_id long, series string, event_name string, input_end long")
    r = lb.onset_labels(a, series, lengths, on, 5, [horizon], 5, **kw).first()
    return r.label, r.reason


def test_onset_scenarios(spark):
    clean, event = [False] * 5, [True] * 5
    assert _label(spark, clean + event + clean, 5) == (1, 0)
    assert _label(spark, event + clean + clean, 5) == (-1, lb.Reason.ACTIVE_IN_INPUT)
    assert _label(spark, clean + clean + clean, 5) == (0, 0)
    assert _label(spark, clean + [None] + clean[1:] + clean, 5) == (-1, lb.Reason.FORECAST_COVERAGE)
    assert _label(spark, [None] + clean[1:] + clean + clean, 5) == (-1, lb.Reason.INPUT_COVERAGE)
    assert _label(spark, clean + clean, 5) == (-1, lb.Reason.CONFIRMATION_COVERAGE)
    # positive although a later confirmation minute is missing
    assert _label(spark, clean + event + clean[1:] + [None, False], 5) == (1, 0)
    assert _label(spark, clean + [True] + clean + clean, 5, strict_clean=True) == (-1, lb.Reason.OUTCOME_MIXED)


def test_fixed_gap_already_running(spark):
    series, lengths, on = _series(spark, [False] * 5 + [True] * 10 + [False] * 5)
    a = spark.createDataFrame([(1, "s", "low", 5)], "anchor_id long, series string, event_name string, input_end long")
    got = {r.gap: (r.label, r.reason) for r in lb.fixed_gap_labels(a, series, lengths, on, 5, [0, 2], 5).collect()}
    assert got == {0: (1, 0), 2: (-1, lb.Reason.ACTIVE_BEFORE_OUTCOME)}


def test_filtered_negatives_attribute_in_order(spark):
    labels = spark.createDataFrame(
        [(1, "low", "g1", 0, 5), (2, "low", "g2", 0, 5), (3, "low", "g3", 0, 99), (4, "low", "g1", 1, 5), (5, "low", "g3", -1, 5)],
        "anchor_id long, event_name string, grp string, label int, t long",
    )
    pos = spark.createDataFrame([("low", "g1")], "event_name string, grp string")
    cut = spark.createDataFrame([("low", 50.0)], "event_name string, cutoff double")
    out = lb.filter_negatives(labels, "grp", pos, cut, F.col("t"))
    got = {r.anchor_id: (r.filtered_label, r.filter_reason) for r in out.collect()}
    assert got == {1: (-1, 3), 2: (0, 0), 3: (-1, 4), 4: (1, 2), 5: (-1, 1)}


def test_unknown_comparison_raises():
    with pytest.raises(ValueError):
        tl.compare(F.lit(1.0), "unsupported", 1.0)


def test_nan_never_counts_as_event(spark):
    df = spark.createDataFrame([(math.nan,), (None,), (120.0,)], "v double")
    assert [r.e for r in df.select(tl.compare(F.col("v"), "gt", 110.0).alias("e")).collect()] == [False, False, True]


def test_touching_intervals_do_not_overlap(spark):
    a = spark.createDataFrame([("k", 1, 0, 10)], "k string, a int, ls long, le long")
    b = spark.createDataFrame([("k", 2, 10, 20), ("k", 3, 9, 11), ("k", 4, 0, 100), (None, 5, 0, 5), ("k", 6, None, 4)],
                              "k string, b int, rs long, re long")
    assert sorted(r.b for r in iv.overlap_join(a, b, 4).collect()) == [3, 4]


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(2)
    def some(n):
        return [(rng.choice("xy"), i, s, s + rng.randint(0, 60)) for i, s in enumerate(rng.randint(0, 300) for _ in range(n))]
    a, b = some(80), some(80)
    got = iv.overlap_join(spark.createDataFrame(a, "k string, a int, ls long, le long"),
                          spark.createDataFrame(b, "k string, b int, rs long, re long"), 25).collect()
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[3] > x[2] and y[3] > y[2] and x[2] < y[3] and x[3] > y[2])
    assert sorted((r.a, r.b) for r in got) == want


def test_charted_state_machine(spark):
    rows = [(1, t, r, s) for t, r, s in [(0, 0.0, False), (10, 5.0, False), (20, None, False), (30, 7.0, False), (40, 0.0, False),
                                          (50, 3.0, False), (60, 3.0, True)]]
    df = spark.createDataFrame(rows, "user long, t long, rate double, stopped boolean")
    out = co.charted_episodes(co.charted_states(df, ["user"]), ["user"]).orderBy("episode").collect()
    assert [(r.start, r.end, r.max_rate) for r in out] == [(10, 40, 7.0), (50, 60, 3.0)]


def test_running_sums_of_a_hot_label(spark):
    rows = [("hot", i, 1 + i % 3) for i in range(5000)] + [("cold", i, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "label string, i long, n long")
    got = {(r.label, r.i): r.before_n for r in ordered_scan.running_sums(df, "label", ["i"], ["n"]).collect()}
    total = 0
    for i in range(5000):
        assert got[("hot", i)] == total
        total += 1 + i % 3
    assert got[("cold", 2)] == 4


def test_exact_quantiles_with_ties_and_null_keys(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.integers(0, 20, 999)] + [(None, 1.0), ("b", None), ("b", math.nan)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    v = [x for k, x in rows if k == "a"]
    assert set(got) == {"a", None}
    for name, p in (("p10", 10), ("p50", 50), ("p99", 99)):
        assert got["a"][name] == pytest.approx(np.percentile(v, p))
    assert got[None].p50 == 1.0


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.4, float(rng.randint(0, 5))) for _ in range(200)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    r = ev.ranking_metrics(ev.score_levels(df, F.col("y"), F.col("s"))).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert r.auroc == pytest.approx(auc)
    one = ev.ranking_metrics(ev.score_levels(df.filter("y"), F.col("y"), F.col("s"))).first()
    assert one.auroc is None and one.spec_at_sens == -1.0


def test_constant_target_r2(spark):
    for p, want in ((5.0, 1.0), (6.0, 0.0)):
        df = spark.createDataFrame([(5.0, p)] * 4, "y double, p double")
        got = df.agg(*ev.regression_sums(F.col("y"), F.col("p"))).select(*ev.regression_metrics_from_sums()).first()
        assert got.r2 == want


def test_constant_predictor_has_slope_minus_two(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(20)], "y double, p double")
    assert df.agg(*ev.bland_altman(F.col("y"), F.col("p"))).first().slope == pytest.approx(-2.0)


def test_duplicate_dimension_key_fails(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="duplicate key"):
        an.require_unique(df, ["k"]).collect()


def test_kernels_on_known_signals():
    fs = 125.0
    t = np.arange(1000) / fs
    x = np.sin(2 * np.pi * 1.5 * t)
    at, _ = kn.peaks(x, 40, 0.5)
    assert abs(60 * fs / np.diff(at).mean() - 90) < 1
    noisy = x + 0.5 * np.sin(2 * np.pi * 30 * t)
    assert np.abs(kn.zero_phase_butterworth(noisy, fs, None, 8) - x)[50:-50].max() < 0.05
    f, p = kn.welch(x, fs, 512)
    assert abs(f[np.argmax(p)] - 1.5) < 0.3
    grid = np.linspace(0.5, 4, 71)
    assert abs(grid[np.argmax(kn.lomb_scargle(t, x, grid))] - 1.5) < 0.06
    assert np.allclose(kn.savgol_derivative(t**2, step=1 / fs)[5:-5], 2 * t[5:-5], atol=1e-6)
    tau, r2 = kn.decay_constant(np.exp(-np.arange(120) / 12.0)[:100])
    assert abs(tau - 12) < 1.5 and r2 > 0.95
    rng = np.random.default_rng(1)
    assert kn.sample_entropy(rng.normal(size=200)) > kn.sample_entropy(np.sin(np.arange(200) / 5))
    assert 0.3 < kn.dfa_alpha(rng.normal(size=500)) < 0.7


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "r1.hea").write_text("# note\nr1/3 2 125 1000 12:00:00 01/02/2003\nx\n")
    (tmp_path / "h" / "r2.hea").write_text("r2 1\n")
    got = {r.record: r for r in rd.read_headers(spark, str(tmp_path / "h")).collect()}
    assert (got["r1"].n_segments, got["r1"].fs, got["r1"].n_samples) == (3, 125.0, 1000)
    assert got["r2"].fs is None
    (tmp_path / "m.json").write_text(json.dumps({"p1": {"file": "f", "sampling_rate_hz": 2.0, "samples_per_window": 4, "window_times": [10.0, 20.0]}}))
    rows = rd.read_window_manifest(spark, str(tmp_path / "m.json")).orderBy("window_index").collect()
    assert [(r.window_time, r.input_start_time, r.input_end_time) for r in rows] == [(10.0, 9.0, 11.0), (20.0, 19.0, 21.0)]
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    arr = rd.read_arrays(spark, str(tmp_path / "a.npy"), [1])
    assert arr.select(rd.cut_window(F.col("samples"), F.lit(-1), 3).alias("w")).first().w == [None, 3.0, 4.0]
    (tmp_path / "c.csv").write_text("a,b\n1,x\nq,y\n")
    assert [r.a for r in rd.read_typed_csv(spark, str(tmp_path / "c.csv"), "a int, b string", ["a"]).collect()] == [1, None]
    with pytest.raises(ValueError, match="missing columns"):
        rd.read_typed_csv(spark, str(tmp_path / "c.csv"), "a int", ["z"])
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, v double")
    sk.write_cache(df, str(tmp_path / "cache"), "r1")
    assert sk.read_cache(spark, str(tmp_path / "cache"), "r1").count() == 2
    with pytest.raises(ValueError):
        sk.read_cache(spark, str(tmp_path / "cache"), "r2")
    assert sk.merge_shards([df.filter("id = 1"), df.filter("id = 2")], df, ["id"]).count() == 2
    with pytest.raises(ValueError):
        sk.merge_shards([df, df], df, ["id"])
    assert sk.markdown_table(df, ["id"]).splitlines()[2] == "| 1 | 2.0 |"


def test_channels_by_alias(spark):
    df = spark.createDataFrame([(["HR", "ART Mean"],), (["HR"],)], "n array<string>")
    place = rd.resolve_channel(F.col("n"), "ABP Mean", rd.VITAL_ALIASES["ABP Mean"])
    assert [r.c for r in df.select(place.alias("c")).collect()] == [1, None]
    bad = spark.createDataFrame([(["ABP Mean", "ABPMean"],)], "n array<string>")
    with pytest.raises(Exception, match="ambiguous"):
        bad.select(place).collect()
    assert bad.select(rd.first_alias(F.col("n"), "ABP Mean", ["ABPMean"])).first()[0] == 0
    with pytest.raises(Exception, match="no supported"):
        df.select(rd.resolve_channel(F.col("n"), "RESP", [], required=True)).collect()
    with pytest.raises(Exception, match="finite"):
        df.select(rd.resolve_channel(F.col("n"), "HR", [], F.lit(0.2), 0.5)).collect()


def test_manifest_of_free_segments(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None), (None, True)], "s string, f boolean")
    assert [r.s for r in rd.free_segments(df, "s", "f").collect()] == ["a"]
    for extra in (("a", True), ("a", False)):
        with pytest.raises(Exception, match="segment"):
            rd.free_segments(df.union(spark.createDataFrame([extra], df.schema)), "s", "f").collect()


def test_forward_pairs_are_one_to_one(spark):
    from chronoward.operators import signals as sg

    rng = random.Random(8)
    a = [(s, rng.randint(0, 200)) for s in (1, 2) for _ in range(30)]
    b = [(s, rng.randint(0, 200)) for s in (1, 2) for _ in range(30)]
    schema = "seg int, position int"
    got = sg.forward_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "seg", 1, 8).collect()
    want = []
    for s in (1, 2):
        last = -1
        follow = sorted({p for k, p in b if k == s})
        for lead in sorted({p for k, p in a if k == s}):
            hit = next((p for p in follow if p > last and lead + 1 <= p <= lead + 8), None)
            if hit is not None:
                want.append((s, lead, hit))
                last = hit
    assert sorted((r.seg, r.lead, r["follow"]) for r in got) == want


def test_cyclic_variation_joins_beats_to_cycles(spark):
    from chronoward.operators import signals as sg

    beats = spark.createDataFrame([(1, 2, 4.0), (1, 5, 2.0), (1, 12, 9.0), (2, 3, 1.0)], "seg int, position int, height double")
    cycles = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20), (2, 0, 0, 10)], "seg int, cycle int, start int, end int")
    r = sg.cyclic_variation(beats, cycles, "seg").collect()
    assert [(x.seg, x.n_cycles, round(x.relative_variation, 6), x.amplitude_index) for x in r] == [(1, 1, round(2 / 3, 6), 0.5)]
