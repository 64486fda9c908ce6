"""Scans of globally range-sorted rows with a state carried across partitions.

The rows are range-sorted by entity and order columns, so an entity that holds a
third of all rows is spread over many partitions. One pass reduces every
partition to one summary, the summaries (one per partition) are combined in
order, and a later pass rescans each partition with the state that precedes it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoward.operators.arrow_groups import group_starts
from chronoward.session import checkpoint

Batches = Iterator[pa.RecordBatch]


def range_sorted(df: DataFrame, order: list[str | Column], partitions: int | None = None) -> DataFrame:
    """Range-partition and sort, then checkpoint so that every later pass sees the
    same partitions (a recomputed range partitioning need not be the same)."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return checkpoint(ranged.sortWithinPartitions(*cols))


def partition_summaries(
    ordered: DataFrame, summarise: Callable[[Batches, Any], Any], given: dict[int, Any] | None = None
) -> dict[int, Any]:
    """``summarise(batches, given[pid])`` of each partition that is not empty, by partition number.

    ``summarise`` returns a small value, None for no rows; one value per partition
    reaches the driver, whatever the size of the data.
    """
    shared = ordered.sparkSession.sparkContext.broadcast(given or {})

    def summaries(batches: Batches) -> Batches:
        pid = TaskContext.get().partitionId()
        value = pickle.dumps(summarise(batches, shared.value.get(pid)))
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "value": pa.array([value], pa.binary())})

    rows = ordered.mapInArrow(summaries, "pid int, value binary").collect()
    loaded = {r["pid"]: pickle.loads(bytes(r["value"])) for r in rows}
    return {pid: loaded[pid] for pid in sorted(loaded) if loaded[pid] is not None}


def states_before(
    ordered: DataFrame,
    summarise: Callable[[Batches, Any], Any],
    combine: Callable[[Any, Any], Any],
    initial: Any,
    given: dict[int, Any] | None = None,
) -> dict[int, Any]:
    """The state before each non-empty partition of ``ordered`` (from :func:`range_sorted`).

    ``combine(state, summary)`` is the state after a partition with that summary.
    """
    before: dict[int, Any] = {}
    state = initial
    for pid, summary in partition_summaries(ordered, summarise, given).items():
        before[pid] = state
        state = combine(state, summary)
    return before


def rescan(
    ordered: DataFrame, states: dict[int, Any], scan: Callable[[Batches, Any], Batches], schema: str
) -> DataFrame:
    """``scan(batches, state before the partition)`` over every partition."""
    shared = ordered.sparkSession.sparkContext.broadcast(states)

    def run(batches: Batches) -> Batches:
        yield from scan(batches, shared.value.get(TaskContext.get().partitionId()))

    return ordered.mapInArrow(run, schema)


def running_sums(rows: DataFrame, label: str, order: list[str], columns: list[str]) -> DataFrame:
    """``rows`` plus ``before_<c>``: sums of earlier rows of the same ``label``, in a total ``order``.

    ``label`` is a string column without nulls, ``columns`` are whole numbers without
    nulls. A label is spread over as many tasks as its rows fill; partitions pass on
    the sums of the label that straddles them.
    """
    ordered = range_sorted(rows, [label, *order])

    def sums_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        starts = group_starts(pa.Table.from_batches([batch]), [label])
        values = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in columns])
        return starts, values

    def tail(batches: Batches, _) -> tuple[str, str, list[int]] | None:
        first = last = None
        total = np.zeros(len(columns), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, values = sums_of(batch)
            head, end = batch.column(label)[0].as_py(), batch.column(label)[batch.num_rows - 1].as_py()
            first = head if first is None else first
            if len(starts) == 1 and head == last:
                total = total + values.sum(axis=1)
            else:
                total = values[:, starts[-1]:].sum(axis=1)
            last = end
        return None if first is None else (first, last, total.tolist())

    def later(state, summary):
        first, last, total = summary
        if state is not None and state[0] == last == first:
            return (last, [a + b for a, b in zip(state[1], total, strict=True)])
        return (last, total)

    before = states_before(ordered, tail, later, None)
    names = ordered.columns

    def scan(batches: Batches, state) -> Batches:
        last, so_far = state or (None, [0] * len(columns))
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, values = sums_of(batch)
            sizes = np.diff(np.append(starts, batch.num_rows))
            cumulative = np.concatenate([np.zeros((len(columns), 1), np.int64), np.cumsum(values, axis=1)], axis=1)
            base = cumulative[:, starts].copy()
            if batch.column(label)[0].as_py() == last:
                base[:, 0] -= np.array(so_far, dtype=np.int64)
            earlier = cumulative[:, :-1] - np.repeat(base, sizes, axis=1)
            last = batch.column(label)[batch.num_rows - 1].as_py()
            so_far = (earlier[:, -1] + values[:, -1]).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x) for x in earlier)], names=[*names, *(f"before_{c}" for c in columns)]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return rescan(ordered, before, scan, schema + "".join(f", before_{c} long" for c in columns))


def running_maximum(rows: DataFrame, label: str, order: list[str], column: str) -> DataFrame:
    """``rows`` plus ``greatest``: the greatest ``column`` of the row and earlier ones of its ``label``.

    ``label`` is a string column and ``column`` a double, both without nulls; the order
    is total. Spread like :func:`running_sums`.
    """
    ordered = range_sorted(rows, [label, *order])

    def walk(batch: pa.RecordBatch, state: tuple[str, float] | None) -> tuple[np.ndarray, tuple[str, float]]:
        starts = group_starts(pa.Table.from_batches([batch]), [label])
        values = batch.column(column).to_numpy().astype(float)
        out = np.concatenate([np.maximum.accumulate(part) for part in np.split(values, starts[1:])])
        if state is not None and batch.column(label)[0].as_py() == state[0]:
            stop = starts[1] if len(starts) > 1 else len(out)
            out[:stop] = np.maximum(out[:stop], state[1])
        return out, (batch.column(label)[batch.num_rows - 1].as_py(), float(out[-1]))

    def tail(batches: Batches, _) -> tuple[str, tuple[str, float]] | None:
        first = state = None
        for batch in batches:
            if batch.num_rows:
                first = batch.column(label)[0].as_py() if first is None else first
                state = walk(batch, state)[1]
        return None if first is None else (first, state)

    def later(state, summary):
        first, end = summary
        return (end[0], max(end[1], state[1])) if state is not None and state[0] == first == end[0] else end

    before = states_before(ordered, tail, later, None)
    names = ordered.columns

    def scan(batches: Batches, state) -> Batches:
        for batch in batches:
            if batch.num_rows:
                out, state = walk(batch, state)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, "greatest"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return rescan(ordered, before, scan, schema + ", greatest double")
