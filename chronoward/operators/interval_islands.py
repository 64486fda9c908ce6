"""Merged periods and gaps of overlapping, nested and gapped intervals.

The intervals are globally range-sorted by entity and start. Every partition is
summarised by the greatest end of its last entity, the summaries are combined in
order, and rescans with the carried greatest end and island start label every
interval with its island. No entity is ever gathered into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoward.operators.arrow_groups import group_starts
from chronoward.operators.ordered_scan import range_sorted, rescan, states_before

_LOWEST = np.iinfo(np.int64).min


def _label(batch: pa.RecordBatch, carry: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Greatest end before each row in its entity, island start of each row, next carry.

    ``carry`` is (entity, greatest end, start of its open island).
    """
    table = pa.Table.from_batches([batch])
    starts = group_starts(table, ["kind", "entity"])
    s, e = table.column("s").to_numpy(), table.column("e").to_numpy()
    n = len(e)
    before, island = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    at = pa.array(starts)
    names = list(zip(table.column("kind").take(at).to_pylist(), table.column("entity").take(at).to_pylist(), strict=True))
    for name, a, b in zip(names, starts, np.append(starts[1:], n), strict=True):
        same = carry is not None and carry[0] == name
        running = np.maximum.accumulate(np.concatenate(([carry[1] if same else _LOWEST], e[a:b])))
        before[a:b] = running[:-1]
        opened = np.where(s[a:b] > running[:-1], s[a:b], _LOWEST)
        labels = np.maximum.accumulate(np.concatenate(([carry[2] if same else _LOWEST], opened)))
        island[a:b] = labels[1:]
        carry = (name, int(running[-1]), int(labels[-1]))
    return before, island, carry


def merge_intervals(
    df: DataFrame, entity_kind: Column, entity: Column, start_us: Column, end_us: Column
) -> DataFrame:
    """``entity_kind, entity_id, piece, start_us, end_us``: merged periods and gaps.

    Intervals with a null entity, start or end, or an end not after the start, are
    ignored. Touching intervals merge; nested and repeated ones change nothing.
    ``piece`` is ``period`` or ``gap`` (space between two neighbouring periods).
    Empty input gives an empty result. Only the derived columns are kept, so other
    columns of ``df`` cannot clash.
    """
    rows = df.select(
        entity_kind.cast("string").alias("kind"), entity.cast("string").alias("entity"),
        start_us.cast("long").alias("s"), end_us.cast("long").alias("e"),
    ).filter("kind is not null and entity is not null and s is not null and e is not null and e > s")
    # of equal starts only the longest matters; combined before the range sort
    rows = rows.groupBy("kind", "entity", "s").agg(F.max("e").alias("e"))
    ordered = range_sorted(rows, ["kind", "entity", "s"])

    def greatest_end(batches: Iterator[pa.RecordBatch], _):
        first, carry = None, None
        for batch in batches:
            if batch.num_rows:
                first = first or (batch.column("kind")[0].as_py(), batch.column("entity")[0].as_py())
                _, _, carry = _label(batch, carry)
        return None if carry is None else (first, carry)

    def later(state, summary):
        first, (name, end, island) = summary
        if state is not None and state[0] == name == first:  # one entity fills the partition
            return (name, max(state[1], end), max(state[2], island))
        return (name, end, island)

    ends = states_before(ordered, greatest_end, later, None)

    def last_island(batches: Iterator[pa.RecordBatch], state):
        first, carry = None, None if state is None else (state[0], state[1], _LOWEST)
        for batch in batches:
            if batch.num_rows:
                first = first or (batch.column("kind")[0].as_py(), batch.column("entity")[0].as_py())
                _, _, carry = _label(batch, carry)
        return None if first is None else (first, carry)

    islands = states_before(ordered, last_island, later, None, ends)
    carried = {
        pid: None if state is None else (state[0], state[1], islands[pid][2] if islands.get(pid) else _LOWEST)
        for pid, state in ends.items()
    }

    def scan(batches: Iterator[pa.RecordBatch], carry):
        for batch in batches:
            if not batch.num_rows:
                continue
            before, island, carry = _label(batch, carry)
            s = batch.column("s").to_numpy()
            no_gap = (before == _LOWEST) | (s <= before)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind"), batch.column("entity"), batch.column("s"), batch.column("e"),
                 pa.array(island), pa.array(before, mask=no_gap)],
                names=["kind", "entity", "s", "e", "island", "gap_from"],
            )

    labelled = rescan(
        ordered, carried, scan, "kind string, entity string, s long, e long, island long, gap_from long"
    )
    periods = (
        labelled.groupBy("kind", "entity", "island").agg(F.max("e").alias("end_us"))
        .select(
            F.col("kind").alias("entity_kind"), F.col("entity").alias("entity_id"), F.lit("period").alias("piece"),
            F.col("island").alias("start_us"), "end_us",
        )
    )
    gaps = labelled.filter("gap_from is not null").select(
        F.col("kind").alias("entity_kind"), F.col("entity").alias("entity_id"), F.lit("gap").alias("piece"),
        F.col("gap_from").alias("start_us"), F.col("s").alias("end_us"),
    )
    return periods.unionByName(gaps)
