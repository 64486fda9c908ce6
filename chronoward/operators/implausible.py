"""Implausible measurements: spikes, impossible values and frozen stretches.

Per source the readings of a block (a week from the source's own start, and most of a
day of its neighbours) are laid out as profile matrices. Where a block holds several
days, its daily profile matrix (one row per day, one column per slot of the day) is
split by robust principal components, and the low-rank part, what the source does
every day, is taken off. The rest is laid out in short periods (``period_slots``) and
split again, into the low-rank local behaviour and a sparse part. Runs of sparse
entries that leave and come back abruptly and stay brief are spikes; ranges and
constant runs are tested separately, against how the same source usually behaves.
Constant runs cut by a block border are stitched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoward.operators.arrow_groups import whole_groups
from chronoward.session import broadcast_if_small, checkpoint


@dataclass(frozen=True)
class SpikeSpec:
    """Parameters of :func:`flag_implausible`.

    ``limits`` maps a channel, or a value column, to the closed range of possible
    values and the smallest scale that counts as its noise; ``default_limits``
    serves the others. ``resting_value`` (the value a source rests at, e.g. 0 for
    a fraction) never counts as frozen. ``edge_spikes`` accepts excursions at the
    very start or end of a source, where only one side can be compared. A block of
    ``block_seconds`` is judged with ``halo_share`` of a block on either side; one that
    spans at least ``min_days`` days has a daily profile of ``day_slots`` columns.
    """

    limits: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    default_limits: tuple[float, float, float] = (float("-inf"), float("inf"), 0.5)
    slot_seconds: float = 60.0
    period_slots: int = 12
    day_slots: int = 480
    min_days: int = 4
    block_seconds: float = 7 * 86400.0
    halo_share: float = 0.125
    spike_slots: int = 5
    spike_score: float = 5.5
    edge_share: float = 0.6
    edge_gap_slots: float = 3.0
    candidate_sigma: float = 3.0
    frozen_min_run: int = 12
    frozen_log10: float = -7.0
    resting_value: float | None = None
    edge_spikes: bool = False


def _segment_median(values: np.ndarray, seg: np.ndarray, n_seg: int) -> np.ndarray:
    """Median per segment; ``seg`` is non-decreasing."""
    order = np.lexsort((values, seg))
    counts = np.bincount(seg, minlength=n_seg)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    out = np.zeros(n_seg)
    some = counts > 0
    lo = order[first[some] + (counts[some] - 1) // 2]
    hi = order[first[some] + counts[some] // 2]
    out[some] = 0.5 * (values[lo] + values[hi])
    return out


def _row_median(matrix: np.ndarray) -> np.ndarray:
    """Median of each row without its NaN; 0 for rows of NaN only."""
    ordered = np.sort(matrix, axis=1)
    count = np.sum(~np.isnan(matrix), axis=1)
    rows = np.arange(len(matrix))
    lo = ordered[rows, np.maximum(count - 1, 0) // 2]
    hi = ordered[rows, np.minimum(count // 2, matrix.shape[1] - 1)]
    return np.where(count > 0, 0.5 * (lo + hi), 0.0)


def robust_low_rank(
    row_of: np.ndarray,
    col_of: np.ndarray,
    values: np.ndarray,
    row_seg: np.ndarray,
    n_seg: int,
    width: int,
    floor: np.ndarray,
    sigma_cut: float,
    rounds: int = 3,
) -> np.ndarray:
    """Residuals of ``values`` to a robust low-rank profile, per segment.

    Cells (``row_of``, ``col_of``) of a segment's rows form its matrix. The low
    rank part is the robust row level plus one or two principal components of
    what remains, fitted by alternating projections: entries beyond
    ``sigma_cut`` robust deviations are replaced by the current fit.
    """
    n_rows = len(row_seg)
    matrix = np.full((n_rows, width), np.nan)
    matrix[row_of[::-1], col_of[::-1]] = values[::-1]
    level = _row_median(matrix)
    short = np.flatnonzero(np.sum(~np.isnan(matrix), axis=1) < width // 2 + 1)
    if len(short):  # a row with few cells takes its level from its neighbours too
        near = [matrix[short]]
        for shift in (-2, -1, 1, 2):
            other = np.clip(short + shift, 0, n_rows - 1)
            same = (row_seg[other] == row_seg[short]) & (other == short + shift)
            near.append(np.where(same[:, None], matrix[other], np.nan))
        level[short] = _row_median(np.concatenate(near, axis=1))
    rest = matrix - level[:, None]
    hole = np.isnan(rest)
    seg_of_value = row_seg[row_of]
    fit = np.zeros_like(rest)
    starts = np.flatnonzero(np.r_[True, row_seg[1:] != row_seg[:-1]]) if n_rows else np.zeros(0, int)
    rows_in = np.bincount(row_seg, minlength=n_seg)
    present = row_seg[starts] if n_rows else np.zeros(0, int)
    residual = values - level[row_of]
    for _ in range(rounds):
        sigma = np.maximum(1.4826 * _segment_median(np.abs(residual), seg_of_value, n_seg), floor)
        sparse = np.abs(rest - fit) > sigma_cut * sigma[row_seg][:, None]
        filled = np.where(hole | sparse, fit, rest)
        gram = np.add.reduceat(filled[:, :, None] * filled[:, None, :], starts, axis=0)
        _, vectors = np.linalg.eigh(gram)
        top = vectors[:, :, -2:]
        top = top * np.stack([rows_in[present] >= 8, rows_in[present] >= 3], axis=1)[:, None, :]
        basis = np.zeros((n_seg, width, 2))
        basis[present] = top
        own = basis[row_seg]
        fit = np.einsum("rk,rpk->rp", np.einsum("rp,rpk->rk", filled, own), own)
        residual = values - level[row_of] - fit[row_of, col_of]
    return residual


def daily_profile(
    seg: np.ndarray, time: np.ndarray, value: np.ndarray, floor: np.ndarray, spec: SpikeSpec, rounds: int = 3
) -> np.ndarray:
    """What each reading's source does at that time of day, beside the day's level; 0 for segments of few days.

    Robust principal components of the segment's daily profile matrix (medians of the
    readings of a cell), started from the median of each slot over the days: entries
    far from the current fit are replaced by it before the next projection.
    """
    out = np.zeros(len(value))
    day = np.floor(time / 86400.0).astype(np.int64)
    slot = np.minimum(((time - day * 86400.0) * spec.day_slots / 86400.0).astype(np.int64), spec.day_slots - 1)
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    last = np.append(first[1:], len(seg))
    for a, b in zip(first, last, strict=True):
        if day[b - 1] - day[a] + 1 < spec.min_days:
            continue
        days, row = np.unique(day[a:b], return_inverse=True)
        if len(days) < spec.min_days:
            continue
        cell = row * spec.day_slots + slot[a:b]
        size = len(days) * spec.day_slots
        order = np.argsort(cell, kind="stable")
        middle = _segment_median(value[a:b][order], cell[order], size)
        hole = np.bincount(cell, minlength=size) == 0
        matrix = np.where(hole, np.nan, middle).reshape(len(days), -1)
        rest = matrix - _row_median(matrix)[:, None]
        fit = np.broadcast_to(_row_median(rest.T), rest.shape)  # the usual day
        for _ in range(rounds):
            off = np.abs(rest - fit)
            sigma = max(1.4826 * float(np.nanmedian(off)), float(floor[seg[a]]))
            filled = np.where(np.isnan(rest) | (off > spec.candidate_sigma * sigma), fit, rest)
            left, strength, right = np.linalg.svd(filled, full_matrices=False)
            rank = 2 if len(days) >= 8 else 1
            fit = (left[:, :rank] * strength[:rank]) @ right[:rank]
        out[a:b] = fit.ravel()[cell]
    return out


def _runs(same_as_previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of each run."""
    first = np.flatnonzero(~same_as_previous)
    return first, np.diff(np.append(first, len(same_as_previous)))


def _take_median(values: np.ndarray, seg: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Median of ``values`` at the positions ``at`` (runs x k) inside segment ``own``; NaN if fewer than two."""
    inside = (at >= 0) & (at < len(values))
    safe = np.clip(at, 0, max(len(values) - 1, 0))
    ok = inside & (seg[safe] == own[:, None])
    picked = np.where(ok, values[safe], np.nan)
    out = _row_median(picked)
    return np.where(ok.sum(axis=1) >= 2, out, np.nan)


def score_series(
    seg: np.ndarray, time: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray,
    n_seg: int, spec: SpikeSpec, cut: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Flags (bit 1 spike, 2 impossible, 4 frozen) of readings sorted by (seg, time), and the calm readings.

    ``low``, ``high`` and ``floor`` are per segment; ``value`` is finite. Calm are the
    positions of possible readings outside spikes. A segment that ``cut`` marks is a
    part of its source; its constant runs are left to the caller.
    """
    flag = np.zeros(len(value), dtype=np.int32)
    none = np.zeros(0, dtype=np.int64)
    if not len(value):
        return flag, none
    impossible = (value < low[seg]) | (value > high[seg])
    flag[impossible] |= 2
    keep = np.flatnonzero(~impossible)
    if not len(keep):
        return flag, none
    s, t, v = seg[keep], time[keep], value[keep]
    n = len(v)
    pos = np.arange(n)

    # constant runs, for the noise scale and the frozen test
    same = np.zeros(n, dtype=bool)
    same[1:] = (s[1:] == s[:-1]) & (v[1:] == v[:-1])
    first, length = _runs(same)
    long_run = np.repeat(length >= spec.frozen_min_run, length)

    # sparse part of the profile matrix
    seg_first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    t0 = np.zeros(n_seg)
    t0[s[seg_first]] = t[seg_first]
    slot = np.rint((t - t0[s]) / spec.slot_seconds).astype(np.int64)
    period = slot // spec.period_slots
    row_new = np.ones(n, dtype=bool)
    row_new[1:] = (s[1:] != s[:-1]) | (period[1:] != period[:-1])
    row_of = np.cumsum(row_new) - 1
    row_seg = s[row_new]
    raw, v = v, v - daily_profile(s, t, v, floor, spec)
    residual = robust_low_rank(
        row_of, slot % spec.period_slots, v, row_seg, n_seg, spec.period_slots, floor, spec.candidate_sigma
    )

    # usual scale of the source: deviation from the profile and from reading to reading
    lively = ~long_run
    enough = np.bincount(s, lively, n_seg) >= np.maximum(0.3 * np.bincount(s, minlength=n_seg), 10)
    counted = lively | ~enough[s]
    sigma = 1.4826 * _segment_median(np.abs(residual[counted]), s[counted], n_seg)
    step = np.zeros(n)
    step[1:] = np.where(s[1:] == s[:-1], np.abs(v[1:] - v[:-1]), np.nan)
    step[0] = np.nan
    moved = counted & ~np.isnan(step)
    usual_step = _segment_median(step[moved], s[moved], n_seg)
    bounded = np.minimum(step[moved], (3.0 * usual_step + floor)[s[moved]])
    jitter = np.bincount(s[moved], bounded, n_seg) / np.maximum(np.bincount(s[moved], minlength=n_seg), 1) / 1.128
    whole = np.ones(n_seg, dtype=bool)
    np.logical_and.at(whole, s, raw == np.rint(raw))
    coarse = np.where(whole & (floor >= 0.3), 0.5, 0.0)
    scale = np.maximum.reduce([sigma, jitter, floor, coarse])
    bulk = np.minimum(np.abs(residual), 2.0 * scale[s])
    mean_sq = np.bincount(s[counted], bulk[counted] ** 2, n_seg) / np.maximum(np.bincount(s[counted], minlength=n_seg), 1)
    scale = np.maximum(scale, np.sqrt(mean_sq))

    # brief excursions: runs of sparse entries of one sign with abrupt edges
    side = np.where(residual > 0, 1, -1) * (np.abs(residual) >= spec.candidate_sigma * np.maximum(sigma, floor)[s])
    joined = np.zeros(n, dtype=bool)
    joined[1:] = (s[1:] == s[:-1]) & (side[1:] == side[:-1])
    a, size = _runs(joined)
    peak = np.repeat(np.maximum.reduceat(np.abs(residual), a), size)
    side = side * (np.abs(residual) >= 0.3 * peak)  # shoulders of a peak are not part of it
    joined[1:] = (s[1:] == s[:-1]) & (side[1:] == side[:-1])
    a, size = _runs(joined)
    b = a + size - 1
    brief = (side[a] != 0) & (t[b] - t[a] < spec.spike_slots * spec.slot_seconds)
    a, b = a[brief], b[brief]
    own = s[a]
    last = n - 1
    has_left = (a > 0) & (s[np.maximum(a - 1, 0)] == own)
    has_right = (b < last) & (s[np.minimum(b + 1, last)] == own)
    inner = (has_left | has_right) if spec.edge_spikes else (has_left & has_right)
    a, b, own, has_left, has_right = a[inner], b[inner], own[inner], has_left[inner], has_right[inner]
    spike = np.zeros(n, dtype=bool)
    if len(a):
        k = np.arange(1, 6)
        left = _take_median(v, s, a[:, None] - k, own)
        right = _take_median(v, s, b[:, None] + k, own)
        width = int((b - a).max()) + 1
        at = a[:, None] + np.arange(width)
        body = np.where(at <= b[:, None], v[np.minimum(at, n - 1)], np.nan)
        top, bottom, middle = np.nanmax(body, axis=1), np.nanmin(body, axis=1), _row_median(body)
        before = np.where(has_left, v[np.maximum(a - 1, 0)], np.nan)
        after = np.where(has_right, v[np.minimum(b + 1, last)], np.nan)
        around_max = np.fmax(np.fmax(left, right), np.fmax(before, after))
        around_min = np.fmin(np.fmin(left, right), np.fmin(before, after))
        clear = np.maximum(bottom - around_max, around_min - top)
        base = np.where(np.isnan(left), right, np.where(np.isnan(right), left, 0.5 * (left + right)))
        depth = np.abs(middle - base)
        gap = np.maximum(
            np.where(has_left, slot[a] - slot[np.maximum(a - 1, 0)], 0),
            np.where(has_right, slot[np.minimum(b + 1, last)] - slot[b], 0),
        )
        hit = (
            (clear >= spec.spike_score * scale[own])
            & (clear >= spec.edge_share * depth)
            & (gap <= spec.edge_gap_slots)
        )
        for x, y in zip(a[hit], b[hit], strict=True):
            spike[x : y + 1] = True

    # frozen: a run far longer than chance, given how often the source repeats otherwise;
    # spikes inside a frozen stretch do not break it
    calm = np.flatnonzero(~spike)
    cs, cv = s[calm], raw[calm]
    same = np.zeros(len(calm), dtype=bool)
    same[1:] = (cs[1:] == cs[:-1]) & (cv[1:] == cv[:-1])
    first, length = _runs(same)
    run_seg = cs[first]
    total = np.bincount(run_seg, length, n_seg)[run_seg]
    runs = np.bincount(run_seg, minlength=n_seg)[run_seg].astype(float)
    others = total - length
    repeat = (others - (runs - 1) + 1.0) / (others + 2.0)
    log_chance = np.log10(np.clip(repeat, 1e-9, 1.0)) * (length - 1) + np.log10(np.maximum(total, 1))
    frozen = (length >= spec.frozen_min_run) & (log_chance < spec.frozen_log10) & (others >= 5)
    if spec.resting_value is not None:
        frozen &= cv[first] != spec.resting_value
    if cut is not None:
        frozen &= ~cut[run_seg]
    stuck = np.repeat(frozen, length)
    flag[keep[spike]] |= 1
    flag[keep[calm[stuck]]] |= 4
    return flag, keep[calm]


def _constant_runs(seg: np.ndarray, value: np.ndarray, spec: SpikeSpec) -> tuple[dict, dict]:
    """(edges, candidates) of the constant runs of blocks; readings sorted by (seg, time).

    edges: the first and the last run of each segment (``side`` 0 and 1; a segment of
    one run has no last one) with the segment's readings and runs, on its first.
    candidates: positions of readings that may be frozen, with the ``side`` (-1 inside)
    and length of their run.
    """
    same = np.zeros(len(seg), dtype=bool)
    same[1:] = (seg[1:] == seg[:-1]) & (value[1:] == value[:-1])
    first, length = _runs(same)
    run_seg = seg[first]
    opens = np.r_[True, run_seg[1:] != run_seg[:-1]][: len(first)]
    closes = np.r_[run_seg[1:] != run_seg[:-1], True][: len(first)]
    side = np.where(opens, 0, np.where(closes, 1, -1))
    edge = np.flatnonzero(side >= 0)
    n_seg = int(run_seg.max()) + 1 if len(first) else 0
    total = np.bincount(run_seg, length, n_seg).astype(np.int64)
    runs = np.bincount(run_seg, minlength=n_seg)
    edges = {
        "seg": run_seg[edge], "side": side[edge], "v": value[first[edge]], "n": length[edge],
        "total": np.where(side[edge] == 0, total[run_seg[edge]], 0), "runs": np.where(side[edge] == 0, runs[run_seg[edge]], 0),
    }
    may = (side >= 0) | (length >= spec.frozen_min_run)
    if spec.resting_value is not None:
        may &= value[first] != spec.resting_value
    at = np.flatnonzero(np.repeat(may, length))
    return edges, {"at": at, "side": np.repeat(side, length)[at], "n": np.repeat(length, length)[at]}


def _stitch_frozen(parts: DataFrame, source: list[str], spec: SpikeSpec) -> DataFrame:
    """``record_id, value_name`` of frozen readings of sources of several blocks, from rows of _constant_runs."""
    by = [*source, "value_name"]
    order = Window.partitionBy(*by).orderBy("block", "side")
    goes_on = (F.col("side") == 0) & (F.lag("v").over(order) == F.col("v"))
    edges = (
        parts.filter("record_id is null and side is not null")
        .withColumn("opens", F.coalesce((~goes_on).cast("int"), F.lit(1)))
        .withColumn("chain", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("whole", F.sum("n").over(Window.partitionBy(*by, "chain")))
    )
    usual = edges.groupBy(*by).agg(
        F.sum("total").alias("all_readings"), (F.sum("runs") - F.sum(1 - F.col("opens"))).alias("all_runs")
    )
    whole = edges.select(*by, "block", "side", "whole")
    length = F.coalesce("whole", "n")
    others = F.col("all_readings") - length
    repeat = (others - (F.col("all_runs") - 1) + 1.0) / (others + 2.0)
    log_chance = F.log10(F.greatest(F.least(repeat, F.lit(1.0)), F.lit(1e-9))) * (length - 1) + F.log10(
        F.greatest("all_readings", F.lit(1))
    )
    return (
        parts.filter("record_id is not null and side is not null").select("record_id", *by, "block", "side", "n")
        .join(whole, [*by, "block", "side"], "left").join(usual, by)
        .filter((length >= spec.frozen_min_run) & (log_chance < spec.frozen_log10) & (others >= 5))
        .select("record_id", "value_name")
    )


def flag_implausible(
    df: DataFrame,
    source: list[str],
    channel: str,
    record_id: str,
    time_seconds: Column | str,
    values: list[str],
    spec: SpikeSpec,
    usable: Column | None = None,
    max_broadcast_sources: int = 200_000,
) -> DataFrame:
    """Flagged records: ``record_id, value_name, is_spike, is_impossible, is_frozen``.

    A reading counts if ``usable`` holds, its source, id and time are known and its
    value is finite or infinite-free; null, NaN and infinite values are ignored.
    Repeated rows (same id, time) count once and tied times are ordered by id. A
    source is judged in blocks of ``spec.block_seconds`` from its first reading, each
    with a halo of its neighbours, so groups stay bounded for sources of any length and
    a source of one block is seen whole; only a block's own readings are reported. The
    frozen test counts a source's runs and readings over all its blocks, from two rows
    per block. Empty input gives an empty result. Other columns of
    ``df`` are dropped, so their names cannot clash.
    """
    spec_ = spec
    t = F.col(time_seconds) if isinstance(time_seconds, str) else time_seconds
    keys = [f"k{i}" for i in range(len(source))]
    cols = [F.col(f"`{c}`").alias(k) for c, k in zip(source, keys, strict=True)]
    vals = [F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(values)]
    picked = df if usable is None else df.filter(usable)
    picked = picked.select(
        *cols, F.col(f"`{channel}`").alias("channel"), F.col(f"`{record_id}`").cast("long").alias("id"),
        t.cast("double").alias("t"), *vals,
    )
    finite = [F.coalesce(~F.isnan(f"v{i}") & (F.abs(f"v{i}") < float("inf")), F.lit(False)) for i in range(len(values))]
    any_finite = finite[0]
    for f in finite[1:]:
        any_finite = any_finite | f
    picked = picked.filter(any_finite & F.col("t").isNotNull() & ~F.isnan("t") & F.col("id").isNotNull())
    for k in keys:
        picked = picked.filter(F.col(k).isNotNull())
    picked = picked.filter(F.abs("t") < float("inf"))
    spans = checkpoint(picked.groupBy(*keys).agg(F.min("t").alias("start"), F.max("t").alias("stop")))
    place = (F.col("t") - F.col("start")) / spec.block_seconds
    own = F.floor("place").cast("long")
    blocks = F.floor((F.col("stop") - F.col("start")) / spec.block_seconds).cast("long") + 1
    near = F.array_compact(
        F.array(
            F.col("own_block"),
            F.when((F.col("own_block") > 0) & (F.col("place") - F.col("own_block") < spec.halo_share), F.col("own_block") - 1),
            F.when(
                (F.col("own_block") + 1 < F.col("blocks"))
                & (F.col("place") - F.col("own_block") >= 1.0 - spec.halo_share), F.col("own_block") + 1,
            ),
        )
    )
    picked = (
        picked.join(broadcast_if_small(spans, max_broadcast_sources), keys)
        .withColumn("place", place).withColumn("own_block", own).withColumn("blocks", blocks)
        .withColumn("block", F.explode(near))
        .select(
            *keys, "channel", "id", "t", *[f"v{i}" for i in range(len(values))], "block",
            (F.col("block") == F.col("own_block")).alias("own"), (F.col("blocks") > 1).alias("cut"),
        )
        .withColumn("h", F.xxhash64(*keys, "block"))
    )
    group_keys = [*keys, "block"]
    arranged = picked.repartition(*group_keys).sortWithinPartitions("h", *group_keys, "t", "id")
    names = list(values)
    key_fields = [f for f in picked.schema.fields if f.name in keys]
    part_fields = ["side", "v", "n", "total", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group_keys):
            n = table.num_rows
            seg = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            ids = table.column("id").to_numpy()
            times = table.column("t").to_numpy()
            mine = table.column("own").to_numpy()
            fresh = np.ones(n, dtype=bool)
            fresh[1:] = (ids[1:] != ids[:-1]) | (seg[1:] != seg[:-1]) | (times[1:] != times[:-1])
            heads = table.take(pa.array(starts))
            channels = heads.column("channel").to_pylist()
            cut = heads.column("cut").to_numpy()
            kinds = {"side": pa.int32(), "v": pa.float64(), "n": pa.int64(), "total": pa.int64(), "runs": pa.int64()}

            def rows(name, segs, record_ids, bits, part):
                """One batch; ``part`` holds the columns of a constant run, if any."""
                where = heads.select(group_keys).take(pa.array(segs)).combine_chunks()
                columns = {c: where.column(c) for c in group_keys} | {
                    "record_id": pa.array(record_ids, pa.int64()) if record_ids is not None else pa.nulls(len(segs), pa.int64()),
                    "value_name": pa.array([name] * len(segs), pa.string()), "bits": pa.array(bits, pa.int32()),
                } | {c: pa.array(part[c], kinds[c]) if c in part else pa.nulls(len(segs), kinds[c]) for c in part_fields}
                yield from pa.table(columns).to_batches()

            for i, name in enumerate(names):
                known = spec_.limits.get(name, spec_.default_limits)
                bounds = np.array([spec_.limits.get(c, known) for c in channels], dtype=float)
                v = table.column(f"v{i}").to_numpy()
                use = np.flatnonzero(fresh & np.isfinite(v))
                flag, calm = score_series(
                    seg[use], times[use], v[use], bounds[:, 0], bounds[:, 1], bounds[:, 2], len(starts), spec_, cut
                )
                hit = np.flatnonzero((flag > 0) & mine[use])
                if len(hit):
                    yield from rows(name, seg[use[hit]], ids[use[hit]], flag[hit], {})
                calm = use[calm]
                calm = calm[cut[seg[calm]] & mine[calm]]
                if len(calm):
                    edges, may = _constant_runs(seg[calm], v[calm], spec_)
                    yield from rows(name, edges["seg"], None, np.zeros(len(edges["seg"]), np.int32), edges)
                    at = calm[may["at"]]
                    if len(at):
                        yield from rows(name, seg[at], ids[at], np.zeros(len(at), np.int32), {"side": may["side"], "n": may["n"]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    judged = checkpoint(
        arranged.mapInArrow(
            run, f"{schema}, block long, record_id long, value_name string, bits int, side int, v double, n long, total long, runs long"
        )
    )
    flags = judged.filter("bits > 0").select("record_id", "value_name", "bits")
    if not judged.filter("side is not null").isEmpty():
        flags = flags.unionByName(_stitch_frozen(judged, keys, spec).withColumn("bits", F.lit(4)))
    return flags.select(
        "record_id", "value_name", (F.col("bits").bitwiseAND(1) > 0).alias("is_spike"),
        (F.col("bits").bitwiseAND(2) > 0).alias("is_impossible"), (F.col("bits").bitwiseAND(4) > 0).alias("is_frozen"),
    )
