"""p1, p2 and p7: brute force and awkward inputs."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoward.operators import gridding, implausible, interval_islands

READ = "seg string, ch string, id long, t double, v double, k0 string, block int, h int"


def flags(spark, rows, spec=None):
    df = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], READ)
    spec = spec or implausible.SpikeSpec(limits={"HR": (20.0, 250.0, 0.5)})
    out = implausible.flag_implausible(df, ["seg", "ch"], "ch", "id", "t", ["v"], spec).collect()
    return {r.record_id: (r.is_spike, r.is_impossible, r.is_frozen) for r in out}


def series(values, seg="a", first_id=1):
    return [(seg, "HR", first_id + i, 60.0 * i, v) for i, v in enumerate(values)]


def noise(n, seed=1, level=80.0):
    rng = np.random.default_rng(seed)
    return (level + rng.normal(0, 1.5, n)).round(1).tolist()


def test_spike_impossible_frozen_are_found(spark):
    v = noise(120)
    v[40], v[41] = 125.0, 126.0
    v[60] = 999.0
    v[80:100] = [v[80]] * 20
    got = flags(spark, series(v))
    assert {41, 42} == {k for k, f in got.items() if f[0]}
    assert {61} == {k for k, f in got.items() if f[1]}
    assert set(range(81, 101)) <= {k for k, f in got.items() if f[2]}
    assert set(got) <= {41, 42, 61, *range(81, 102)}


def test_ramps_steps_and_noisy_sources_are_not_cases(spark):
    ramp = noise(30) + [80.0 + 5 * i for i in range(8)] + noise(30, 2, 120) + [120.0 - 5 * i for i in range(8)] + noise(30, 3)
    step = noise(60) + noise(60, 2, 110)
    rng = np.random.default_rng(5)
    wild = rng.uniform(40, 160, 120).round(0).tolist()
    coarse = [97.0] * 60 + [98.0] * 45 + [97.0] * 50
    rows = series(ramp, "r", 1) + series(step, "s", 1000) + series(wild, "w", 2000) + series(coarse, "c", 3000)
    assert flags(spark, rows) == {}


def test_awkward_readings(spark):
    v = noise(60)
    v[30] = 140.0
    rows = series(v) + [("a", "HR", 31, 1800.0, 140.0)]  # repeated row
    rows += [(None, "HR", 900, 0.0, 1.0), ("a", None, 901, 0.0, 1.0), ("a", "HR", None, 0.0, 1.0), ("a", "HR", 902, None, 1.0),
             ("a", "HR", 903, 5.0, None), ("a", "HR", 904, 5.0, math.nan), ("a", "HR", 905, 5.0, math.inf)]
    got = flags(spark, rows)
    assert {k for k, f in got.items() if f[0]} == {31}
    assert flags(spark, []) == {}
    assert flags(spark, [("a", "HR", 1, 0.0, -5.0)]) == {1: (False, True, False)}


#: Blocks of a day instead of a week, to cut short series.
DAY_BLOCKS = implausible.SpikeSpec(limits={"HR": (20.0, 250.0, 0.5)}, block_seconds=86400.0)


@pytest.mark.parametrize("spec", [None, DAY_BLOCKS])
def test_spikes_in_long_series_and_beside_midnight(spark, spec):
    v = noise(3000)
    for i in (1438, 1441, 2000):
        v[i] = 140.0
    assert {k for k, f in flags(spark, series(v), spec).items() if f[0]} == {1439, 1442, 2001}


def test_what_a_source_does_every_day_is_normal(spark):
    """A sharp rise of three minutes at eight each day is no spike; the same rise at another time is."""
    rng = np.random.default_rng(9)
    minutes = np.arange(20 * 1440)
    v = 80.0 + 15.0 * np.sin(2 * np.pi * minutes / 1440) + rng.normal(0, 1.0, len(minutes))
    v[(minutes % 1440 >= 480) & (minutes % 1440 < 483)] += 40.0
    v[9 * 1440 + 1000 : 9 * 1440 + 1003] += 40.0
    v[9 * 1440 + 2000] -= 40.0
    rows = series(v.round(1).tolist())
    odd = set(range(9 * 1440 + 1001, 9 * 1440 + 1004)) | {9 * 1440 + 2001}
    assert {k for k, f in flags(spark, rows).items() if f[0]} == odd
    without = implausible.SpikeSpec(limits={"HR": (20.0, 250.0, 0.5)}, min_days=99)
    assert len({k for k, f in flags(spark, rows, without).items() if f[0]}) > 40  # the short profile alone takes them for spikes


def test_frozen_runs_across_block_borders_are_stitched(spark):
    short = noise(120, 4)
    short[50:70] = [82.3] * 20  # 20 readings around midnight: 10 and 10
    late = [(s, c, i, t + 86400.0 - 3600.0, v) for s, c, i, t, v in series(short, "m", 50_000)]
    long = noise(3000, 5)
    long[1430:1448] = [79.9] * 18  # around the border of the source's first day
    long[1439] = 140.0  # a spike in the run, beside the border
    got = flags(spark, late + series(long, "n", 1), DAY_BLOCKS)
    frozen = {k for k, f in got.items() if f[2]}
    assert set(range(50_051, 50_069)) <= frozen
    assert {*range(1431, 1449)} - {1440} <= frozen and got[1440] == (True, False, False)
    assert len(frozen) <= 20 + 17 + 4
    days = [80.0 + (i % 5) for i in range(1430)] + [81.5] * (4 * 1440) + [80.0 + (i % 5) for i in range(100)]
    for spec in (DAY_BLOCKS, None):
        held = {k for k, f in flags(spark, series(days), spec).items() if f[2]}  # whole blocks of one value
        assert held == set(range(1431, 1431 + 4 * 1440))


GRID = "seg string, x double, v double, ok boolean, block int, k0 int, own int"


def grid(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], GRID)
    out = gridding.regular_grid(df, ["seg"], F.col("x"), F.col("v"), F.col("ok"), **kw)
    return {(r.seg, r.grid_index): r for r in out.collect()}


def test_grid_marks_missing_and_fits_lines(spark):
    rows = [("a", float(i) + 0.1, 2.0 * (i + 0.1), True) for i in range(10) if i not in (4, 5)]
    rows += [("a", 9.6, 0.0, False), ("a", -2.0, None, None)]
    got = grid(spark, rows)
    assert sorted(k[1] for k in got) == list(range(-2, 11))
    missing = {k[1] for k, r in got.items() if r.is_missing}
    assert missing == {-2, -1, 4, 5, 10}
    for (_, i), r in got.items():
        if 0 <= i <= 9:
            assert abs(r.value - 2.0 * i) < 1e-6
    assert got[("a", -2)].value is None or got[("a", -2)].effective_support >= 1.0
    narrow = grid(spark, rows, bandwidth=0.75)
    assert {k[1] for k, r in narrow.items() if r.is_missing} == missing
    only = grid(spark, rows, only_missing=True)
    assert {k[1] for k in only} == missing


def test_grid_of_long_series_crosses_blocks(spark):
    n = gridding.BLOCK_STEPS
    places = [0, 1, n - 1, n, 3 * n + 5]
    got = grid(spark, [("a", float(p), 1.0, True) for p in places])
    assert len(got) == 3 * n + 6
    assert {k[1] for k, r in got.items() if not r.is_missing} == set(places)
    assert got[("a", n + 1)].value == pytest.approx(1.0)  # fitted from both blocks' readings


def test_grid_awkward(spark):
    assert grid(spark, []) == {}
    got = grid(spark, [(None, 1.0, 1.0, True), ("a", None, 1.0, True), ("a", math.nan, 1.0, True), ("a", 3.0, math.inf, True),
                       ("a", 3.0, 2.0, None)])
    assert {k: r.is_missing for k, r in got.items()} == {("a", 3): True}


def brute_islands(intervals):
    out = []
    by = {}
    for k, s, e in intervals:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    for k, xs in by.items():
        merged = []
        for s, e in sorted(xs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


def islands(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "k string, s long, e long, kind string, island int")
    out = interval_islands.merge_intervals(df, F.lit("z"), F.col("k"), F.col("s"), F.col("e")).collect()
    return sorted((r.entity_id, r.piece, r.start_us, r.end_us) for r in out)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-20, 60)),
                          st.one_of(st.none(), st.integers(-20, 60))), max_size=60))
def test_islands_equal_brute_force(spark, rows):
    assert islands(spark, rows) == brute_islands(rows)


def test_islands_of_one_hot_entity_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [("hot", s, s + rng.randint(1, 40)) for s in (rng.randint(0, 60_000) for _ in range(4000))]
    rows += [("hot", 10, 30_000), ("cold", 5, 6), ("cold", 6, 9), ("cold", 5, 6)]
    assert islands(spark, rows) == brute_islands(rows)
