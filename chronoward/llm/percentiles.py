"""Exact percentiles per group by a distributed sort with per-partition counts.

Equal values are counted first, so a value shared by a third of all rows is one
row of the sort. (group, value, count) rows are range-sorted over all partitions;
the per-partition counts of groups that straddle partitions give their offsets,
every target position is located inside one partition, and the neighbouring order
statistics are interpolated. The error is zero. The counted form
(:func:`value_counts`) of separate partitions or days combines by adding counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoward.operators.arrow_groups import group_starts
from chronoward.operators.ordered_scan import Batches, partition_summaries, range_sorted, rescan


def value_counts(df: DataFrame, group: dict[str, Column], value: Column) -> DataFrame:
    """Mergeable exact summary: one row per group and distinct value, with its count ``n``.

    Null, NaN and infinite values are ignored; a null group is a group of its own.
    """
    rows = df.select(*[c.alias(g) for g, c in group.items()], value.cast("double").alias("value"))
    rows = rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return rows.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))


def combine_counts(counts: DataFrame, group: list[str]) -> DataFrame:
    """Summaries of separate days or partitions as one, over the given group columns."""
    return counts.groupBy(*group, "value").agg(F.sum("n").alias("n"))


#: Rows (distinct values) of one group that a task may hold at a time.
HELD_ROWS = 100_000


def _edge_counts(batches: Batches, _) -> list[tuple[str, int]] | None:
    """Counts of the first and the last label of a partition and of labels of many rows between, in order."""
    found: list[tuple[str, int]] = []
    label, n, rows = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        starts = group_starts(table, ["label"])
        sums = np.add.reduceat(table.column("n").to_numpy(), starts)
        sizes = np.diff(np.append(starts, batch.num_rows))
        head, tail = table.column("label").take(pa.array([starts[0], starts[-1]])).to_pylist()
        if head == label:
            sums[0] += n
            sizes[0] += rows
        elif label is not None and (not found or rows >= HELD_ROWS):
            found.append((label, n))
        ended = np.flatnonzero(sizes[:-1] >= HELD_ROWS).tolist()
        if not found and len(starts) > 1 and 0 not in ended:
            ended.insert(0, 0)
        found += [(table.column("label")[int(starts[k])].as_py(), int(sums[k])) for k in ended]
        label, n, rows = tail, int(sums[-1]), int(sizes[-1])
    return None if label is None else [*found, (label, n)]


def _pieces(batches: Batches, known: dict[str, tuple[int, int]]) -> Iterator[tuple[pa.Table, np.ndarray, int]]:
    """(table, group starts, count of the first group in earlier tables) of sorted batches.

    A group whose total is ``known`` is passed on piece by piece; others (fewer than
    :data:`HELD_ROWS` rows) are held until they are whole.
    """
    held: list[pa.RecordBatch] = []
    rows, passed = 0, ("", 0)

    def carried(table: pa.Table) -> int:
        return passed[1] if table.column("label")[0].as_py() == passed[0] else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < HELD_ROWS:
            continue
        table = pa.Table.from_batches(held)
        starts = group_starts(table, ["label"])
        last = table.column("label")[int(starts[-1])].as_py()
        cut = table.num_rows if last in known else int(starts[-1])
        if cut:
            before = carried(table)
            yield table.slice(0, cut), starts if last in known else starts[:-1], before
            passed = ("", 0)
            if last in known:
                n = int(table.column("n").to_numpy()[starts[-1]:].sum())
                passed = (last, n + (before if len(starts) == 1 else 0))
            rest = table.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        table = pa.Table.from_batches(held)
        yield table, group_starts(table, ["label"]), carried(table)


def percentiles_of_counts(counts: DataFrame, group: list[str], probabilities: list[float]) -> DataFrame:
    """``group..., probability, value, n_values``: linearly interpolated percentiles.

    The position of probability p among n values is p * (n - 1). ``counts`` is a
    :func:`value_counts` summary. A group of one value gives that value; an empty
    summary gives an empty result.
    """
    probs = np.array(sorted(probabilities), dtype=float)
    keys = [f"g{i}" for i in range(len(group))]
    rows = counts.select(*[F.col(f"`{g}`").alias(k) for g, k in zip(group, keys, strict=True)], "value", "n")
    # one label per group: nulls stay apart, and a change of group is one comparison
    label = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys])
    ordered = range_sorted(rows.withColumn("label", label), ["label", "value"])

    # totals and offsets of the groups that straddle partitions or fill much of one
    edges = partition_summaries(ordered, _edge_counts)
    totals: dict[str, int] = {}
    straddling: dict[int, dict[str, tuple[int, int]]] = {}
    for pid, pairs in edges.items():
        for name, n in pairs:
            straddling.setdefault(pid, {})[name] = (totals.get(name, 0), 0)
            totals[name] = totals.get(name, 0) + n
    for by_name in straddling.values():
        for name, (offset, _) in by_name.items():
            by_name[name] = (offset, totals[name])

    def locate(batches: Batches, known: dict[str, tuple[int, int]] | None) -> Batches:
        known = known or {}
        for table, starts, passed in _pieces(batches, known):
            n = table.column("n").to_numpy()
            cumulative = np.cumsum(n)
            base = np.concatenate(([0], cumulative))[starts]
            local = np.add.reduceat(n, starts)
            names = table.column("label").take(pa.array(starts)).to_pylist()
            spans = [known.get(name) for name in names]
            offset = np.array([s[0] if s else 0 for s in spans])
            offset[0] += passed
            total = np.array([s[1] if s else x for s, x in zip(spans, local, strict=True)])
            position = probs[None, :] * (total[:, None] - 1)
            found = []
            for is_upper, target in ((False, np.floor(position)), (True, np.ceil(position))):
                inside = (target >= offset[:, None]) & (target < (offset + local)[:, None])
                g, p = np.nonzero(inside)
                at = base[g] + target[g, p] - offset[g]
                row = np.searchsorted(cumulative, at, side="right")
                found.append((g, p, row, np.full(len(g), is_upper)))
            g, p, row, upper = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(g):
                continue
            value = table.column("value").to_numpy()[row]
            out = {k: table.column(k).take(pa.array(starts[g])).combine_chunks() for k in keys}
            out["probability"] = pa.array(probs[p])
            out["lower"] = pa.array(value, mask=upper)
            out["upper"] = pa.array(value, mask=~upper)
            out["share"] = pa.array(position[g, p] - np.floor(position[g, p]))
            out["n_values"] = pa.array(total[g], pa.int64())
            yield from pa.table(out).to_batches()

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    located = rescan(
        ordered, straddling, locate, f"{types}, probability double, lower double, upper double, share double, n_values long"
    )
    result = located.groupBy(*keys, "probability").agg(
        F.max("lower").alias("lo"), F.max("upper").alias("hi"), F.max("share").alias("share"),
        F.max("n_values").alias("n_values"),
    )
    return result.select(
        *[F.col(k).alias(g) for g, k in zip(group, keys, strict=True)], "probability",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share")).alias("value"), "n_values",
    )
