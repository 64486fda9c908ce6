"""Waveform segments to beats and spectral, entropy and morphology features.

One row is one segment; a segment's array is bounded, so each Arrow batch is worked
on by itself. Only requested families are computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoward.functions import kernels as kn


def _filled(values) -> np.ndarray | None:
    """The segment as an array, short gaps interpolated; None if under half of it is finite."""
    x = np.array([np.nan if v is None else v for v in (values or [])], dtype=float)
    ok = np.isfinite(x)
    if len(x) < 8 or ok.sum() < len(x) / 2:
        return None
    return np.interp(np.arange(len(x)), np.flatnonzero(ok), x[ok])


def _spectral(x: np.ndarray, fs: float) -> dict[str, float]:
    f, p = kn.welch(x, fs)
    total = max(p.sum(), 1e-12)
    grid = np.linspace(0.5, fs / 2, 24)
    lomb = kn.lomb_scargle(np.arange(len(x)) / fs, x, grid)
    return {
        "low_energy_ratio": float(p[f < fs / 8].sum() / total), "peak_frequency": float(f[np.argmax(p)]),
        "lomb_peak_frequency": float(grid[np.argmax(lomb)]), "lomb_peak_power": float(lomb.max()),
    }


def _entropy(x: np.ndarray, fs: float) -> dict[str, float]:
    return {"sample_entropy": kn.sample_entropy(x), "dfa_alpha": kn.dfa_alpha(x)}


def _morphology(x: np.ndarray, fs: float) -> dict[str, float]:
    low = kn.zero_phase_butterworth(x, fs, None, fs / 8)
    slope = kn.savgol_derivative(x, step=1.0 / fs)
    at, _ = kn.peaks(low, max(int(fs / 8), 1), 0.1 * (np.std(low) or 1.0))
    top = int(np.argmax(x))
    tau, r2 = kn.decay_constant(x[top:])
    corr, lag = kn.max_lagged_correlation(x, low, 6)
    return {
        "lowpass_rms_ratio": float(np.std(low) / max(np.std(x), 1e-12)), "max_slope": float(np.nanmax(slope)),
        "n_peaks": float(len(at)), "width_50": kn.width_at_level(x, top, 0.5), "width_75": kn.width_at_level(x, top, 0.75),
        "decay_tau": tau, "decay_r2": r2, "lagged_corr": corr, "lagged_corr_lag": float(lag),
    }


FAMILIES = {
    "spectral": (_spectral, ["low_energy_ratio", "peak_frequency", "lomb_peak_frequency", "lomb_peak_power"]),
    "entropy": (_entropy, ["sample_entropy", "dfa_alpha"]),
    "morphology": (_morphology, ["lowpass_rms_ratio", "max_slope", "n_peaks", "width_50", "width_75", "decay_tau", "decay_r2",
                                 "lagged_corr", "lagged_corr_lag"]),
}


def segment_features(df: DataFrame, segment_id: str, values: str, fs: float, families: list[str]) -> DataFrame:
    """``segment_id`` and one nullable double per feature of the chosen families.

    Null, short or mostly missing segments get nulls; NaN results become null.
    """
    names = [n for f in families for n in FAMILIES[f][1]]
    sid = df.schema[segment_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for values_ in batch.column("v").to_pylist():
                x = _filled(values_)
                found: dict[str, float] = {}
                if x is not None:
                    for f in families:
                        found |= FAMILIES[f][0](x, fs)
                rows.append([found.get(n, np.nan) for n in names])
            table = np.array(rows, dtype=float).reshape(len(rows), len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column("s")] + [pa.array(table[:, i], mask=~np.isfinite(table[:, i])) for i in range(len(names))],
                names=["s", *names],
            )

    out = df.select(F.col(segment_id).alias("s"), F.col(values).alias("v")).mapInArrow(
        run, f"s {sid}, " + ", ".join(f"{n} double" for n in names)
    )
    return out.withColumnRenamed("s", segment_id)


def beat_table(df: DataFrame, segment_id: str, values: str, fs: float) -> DataFrame:
    """``segment_id, beat, position, height, prominence``: one row per detected pulse."""
    sid = df.schema[segment_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for s, values_ in zip(batch.column("s").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = _filled(values_)
                if x is None:
                    continue
                at, prom = kn.peaks(x, max(int(fs / 8), 1), 0.5 * np.std(x))
                out += [(s, i, int(p), float(x[p]), float(q)) for i, (p, q) in enumerate(zip(at, prom, strict=True))]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.column("s").type), pa.array(columns[1], pa.int32()),
                     pa.array(columns[2], pa.int32()), pa.array(columns[3]), pa.array(columns[4])],
                    names=["s", "beat", "position", "height", "prominence"],
                )

    out = df.select(F.col(segment_id).alias("s"), F.col(values).alias("v")).mapInArrow(
        run, f"s {sid}, beat int, position int, height double, prominence double"
    )
    return out.withColumnRenamed("s", segment_id)


def cycle_table(df: DataFrame, segment_id: str, values: str, fs: float, cutoff: float) -> DataFrame:
    """``segment_id, cycle, start, end``: slow cycles between neighbouring maxima of the low-passed segment."""
    sid = df.schema[segment_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for s, values_ in zip(batch.column("s").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = _filled(values_)
                if x is None:
                    continue
                low = kn.zero_phase_butterworth(x, fs, None, cutoff)
                at, _ = kn.peaks(low, max(int(fs / (2 * cutoff)), 1), 0.1 * np.std(low))
                out += [(s, i, int(a), int(b)) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], batch.column("s").type), *(pa.array(x, pa.int32()) for x in c[1:])],
                    names=["s", "cycle", "start", "end"],
                )

    out = df.select(F.col(segment_id).alias("s"), F.col(values).alias("v")).mapInArrow(
        run, f"s {sid}, cycle int, start int, end int"
    )
    return out.withColumnRenamed("s", segment_id)


def cyclic_variation(beats: DataFrame, cycles: DataFrame, segment_id: str, min_beats: int = 2) -> DataFrame:
    """Per segment: how beat heights vary within slow cycles.

    Beats join the cycle that holds their position (equal segment, range inside).
    ``relative_variation`` divides by the mean of the greatest and least height,
    ``amplitude_index`` by the greatest; cycles with too few beats are left out.
    """
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("end"))
    c = cycles.withColumnRenamed(segment_id, "_s")
    per = beats.join(c, (F.col(segment_id) == F.col("_s")) & inside).groupBy(segment_id, "cycle").agg(
        F.count(F.lit(1)).alias("n"), F.max("height").alias("hi"), F.min("height").alias("lo")
    ).filter(F.col("n") >= min_beats)
    span, middle = F.col("hi") - F.col("lo"), F.abs(F.col("hi") + F.col("lo")) / 2.0
    return per.groupBy(segment_id).agg(
        F.count(F.lit(1)).alias("n_cycles"), F.avg(F.when(middle > 1e-8, span / middle)).alias("relative_variation"),
        F.avg(F.when(F.abs("hi") > 1e-8, span / F.abs("hi"))).alias("amplitude_index"),
    )


def forward_pairs(leading: DataFrame, following: DataFrame, segment_id: str, low: int, high: int) -> DataFrame:
    """``segment_id, lead, follow, delay``: one-to-one pairs of events, ``follow`` within [low, high] after ``lead``.

    ``leading`` and ``following`` hold (segment, position). Leads are served in time
    order and take the earliest event not yet taken. Both sides of a segment are
    collected as arrays (bounded by the segment) and folded JVM-side.
    """
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(segment_id).agg(F.array_sort(F.collect_set(F.col("position").cast("int"))).alias(name))

    both = listed(leading, "_a").join(listed(following, "_b"), segment_id)
    empty = F.array().cast("array<struct<lead:int,follow:int>>")
    taken = F.aggregate(
        "_a", F.struct(F.lit(-1).alias("last"), empty.alias("pairs")),
        lambda acc, a: F.transform(
            F.array(F.get(F.filter("_b", lambda b: (b > acc["last"]) & (b >= a + low) & (b <= a + high)), F.lit(0))),
            lambda b: F.when(
                b.isNotNull(),
                F.struct(b.alias("last"), F.concat(acc["pairs"], F.array(F.struct(a.alias("lead"), b.alias("follow")))).alias("pairs")),
            ).otherwise(acc),
        )[0],
        lambda acc: acc["pairs"],
    )
    return both.select(segment_id, F.explode(taken).alias("p")).select(
        segment_id, "p.lead", "p.follow", (F.col("p.follow") - F.col("p.lead")).alias("delay")
    )
