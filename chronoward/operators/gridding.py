"""Irregular readings onto a regular grid, by local polynomial regression.

Every grid time is evaluated by a weighted local line through the readings near
it; the kernel is compact, so only readings within ``bandwidth`` count and they
are found by their grid index. Each grid time carries its effective support, and
a mark where no reading falls into its own cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoward.operators.arrow_groups import whole_groups

#: Grid steps per block; a source longer than this is handled block by block.
BLOCK_STEPS = 4096
#: Effective support of one reading, less rounding: a step with less of its own is missing.
_ONE_READING = 1.0 - 1e-9


def _local_fit(
    base: np.ndarray, total: int, at: np.ndarray, position: np.ndarray, value: np.ndarray, bandwidth: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local-line estimates, effective support, and that of a cell's own readings, on a flat grid of ``total`` cells.

    ``base``/``position``: first cell of the reading's series and its position on
    that series in steps; ``at`` holds (first, last) cell of its series.
    """
    reach = int(np.ceil(bandwidth))
    s0, s1, s2, ss = (np.zeros(total) for _ in range(4))
    y0, y1 = np.zeros(total), np.zeros(total)
    nearest = np.rint(position).astype(np.int64)
    own = np.zeros(total)
    for shift in range(-reach, reach + 1):
        cell = nearest + shift
        x = position - cell
        u = np.abs(x) / bandwidth
        index = base + cell
        near = (u < 1.0) & (index >= at[:, 0]) & (index <= at[:, 1])
        index, x, u, y = index[near], x[near], u[near], value[near]
        w = (1.0 - u**3) ** 3
        s0 += np.bincount(index, w, total)
        s1 += np.bincount(index, w * x, total)
        s2 += np.bincount(index, w * x * x, total)
        ss += np.bincount(index, w * w, total)
        if not shift:  # the readings that round to the cell
            sums, squares = np.bincount(index, w, total), np.bincount(index, w * w, total)
            own = np.divide(sums * sums, squares, out=own, where=squares > 0)
        y0 += np.bincount(index, w * y, total)
        y1 += np.bincount(index, w * x * y, total)
    with np.errstate(divide="ignore", invalid="ignore"):
        support = np.where(s0 > 0, s0 * s0 / ss, 0.0)
        det = s0 * s2 - s1 * s1
        line = (s2 * y0 - s1 * y1) / det
        level = y0 / s0
    # a line needs readings at clearly different times; else the local level
    estimate = np.where((support >= 1.2) & (det > 1e-3 * s0 * s0), line, level)
    return estimate, support, own


def regular_grid(
    df: DataFrame,
    source: list[str],
    position: Column,
    value: Column,
    usable: Column,
    bandwidth: float = 2.5,
    min_support: float = 1.0,
    only_missing: bool = False,
) -> DataFrame:
    """One row per source and grid step between its lowest and highest step.

    ``position`` is the (fractional) time in grid steps; a reading belongs to the
    step it rounds to. Columns: the source columns, ``grid_index``, ``n_readings``
    (usable readings of the step), ``is_missing`` (the kernel's effective support from
    within half a step is less than one reading), ``value`` (local fit, null if the
    effective support is under ``min_support``), ``effective_support``.

    Rows without source or position are ignored; rows that are not ``usable`` or
    whose value is null or not finite only extend the range. Repeated rows weigh
    more in the fit but change no mark. A reading at an exact half step belongs to the
    even step, and ``bandwidth`` over half a step makes every reading bear on its own
    step. Empty input gives an empty result.
    ``only_missing`` keeps the steps without a usable reading.
    """
    keys = [f"k{i}" for i in range(len(source))]
    v = value.cast("double")
    ok = F.coalesce(usable & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    rows = df.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(source, keys, strict=True)],
        position.cast("double").alias("x"), F.when(ok, v).alias("v"),
    )
    rows = rows.filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < 1e15))
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    block = F.floor(F.rint("x") / BLOCK_STEPS).cast("long")
    rows = rows.withColumn("block", block)
    reach = int(np.ceil(bandwidth)) + 1

    # readings near a block's edge also serve the neighbouring block
    offset = F.rint("x").cast("long") - F.col("block") * BLOCK_STEPS
    homes = F.array_compact(
        F.array(
            F.lit(0),
            F.when((offset < reach) & F.col("v").isNotNull(), F.lit(-1)),
            F.when((offset >= BLOCK_STEPS - reach) & F.col("v").isNotNull(), F.lit(1)),
        )
    )
    spread = rows.withColumn("d", F.explode(homes)).select(
        *keys, (F.col("block") + F.col("d")).alias("block"), "x", "v",
        (F.col("d") == 0).cast("byte").alias("own"),
    )
    # sources of several blocks: the extent marks blocks that hold no row of their own
    extent = rows.groupBy(*keys).agg(F.min(F.rint("x")).alias("lo"), F.max(F.rint("x")).alias("hi"))
    first, last = F.floor(F.col("lo") / BLOCK_STEPS), F.floor(F.col("hi") / BLOCK_STEPS)
    marks = (
        extent.filter(last > first)
        .withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        .withColumn(
            "x",
            F.explode(
                F.array(
                    F.greatest(F.col("lo"), (F.col("block") * BLOCK_STEPS).cast("double")),
                    F.least(F.col("hi"), ((F.col("block") + 1) * BLOCK_STEPS - 1).cast("double")),
                )
            ),
        )
        .select(*keys, "block", "x", F.lit(None).cast("double").alias("v"), F.lit(1).cast("byte").alias("own"))
    )
    group = [*keys, "block"]
    arranged = (
        spread.unionByName(marks)
        .withColumn("h", F.xxhash64(*group))
        .repartition(*group)
        .sortWithinPartitions("h", *group)
    )
    key_types = [arranged.schema[k].dataType.simpleString() for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            n = table.num_rows
            sizes = np.diff(np.append(starts, n))
            seg = np.repeat(np.arange(len(starts)), sizes)
            x = table.column("x").to_numpy()
            v = table.column("v").to_numpy()
            own = table.column("own").to_numpy() > 0
            cell = np.rint(x).astype(np.int64)
            low = np.full(len(starts), np.iinfo(np.int64).max)
            high = np.full(len(starts), np.iinfo(np.int64).min)
            np.minimum.at(low, seg[own], cell[own])
            np.maximum.at(high, seg[own], cell[own])
            width = np.maximum(high - low + 1, 0)
            width[high < low] = 0
            begin = np.concatenate(([0], np.cumsum(width)[:-1]))
            total = int(width.sum())
            if not total:
                continue
            use = ~np.isnan(v) & (width[seg] > 0)
            counted = use & own
            index = begin[seg[counted]] + cell[counted] - low[seg[counted]]
            readings = np.bincount(index, minlength=total)
            u = np.flatnonzero(use)
            limits = np.stack([begin[seg[u]], begin[seg[u]] + width[seg[u]] - 1], axis=1)
            estimate, support, cell_support = _local_fit(begin[seg[u]], total, limits, x[u] - low[seg[u]], v[u], bandwidth)
            cell_seg = np.repeat(np.arange(len(starts)), width)
            step = np.arange(total) - begin[cell_seg] + low[cell_seg]
            missing = cell_support < _ONE_READING
            keep = np.flatnonzero(missing) if only_missing else np.arange(total)
            source_row = pa.array(starts[cell_seg[keep]])
            weak = support[keep] < min_support
            out = {k: table.column(k).take(source_row).combine_chunks() for k in keys}
            out["grid_index"] = pa.array(step[keep], pa.int64())
            out["n_readings"] = pa.array(readings[keep], pa.int64())
            out["is_missing"] = pa.array(missing[keep])
            out["value"] = pa.array(np.where(weak, np.nan, estimate[keep]), mask=weak)
            out["effective_support"] = pa.array(support[keep])
            yield from pa.table(out).to_batches()

    schema = ", ".join(f"{k} {t}" for k, t in zip(keys, key_types, strict=True))
    schema += ", grid_index long, n_readings long, is_missing boolean, value double, effective_support double"
    result = arranged.mapInArrow(run, schema)
    return result.select(
        *[F.col(k).alias(c) for c, k in zip(source, keys, strict=True)],
        "grid_index", "n_readings", "is_missing", "value", "effective_support",
    )
