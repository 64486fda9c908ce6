"""Whole groups out of Arrow batches that arrive sorted by their keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which the (non-null) keys change; the first is 0."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    if n > 1:
        for key in keys:
            col = table.column(key).combine_chunks()
            if isinstance(col, pa.ChunkedArray):
                col = pa.concat_arrays(col.chunks)
            new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str], min_rows: int = 100_000
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the row numbers where groups start.

    A group that straddles Arrow batches is held back until it is complete, so
    memory is ``min_rows`` plus one group; callers bound groups by time blocks.
    """
    held: list[pa.RecordBatch] = []
    rows, enough = 0, min_rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= enough:
            table = pa.Table.from_batches(held)
            starts = group_starts(table, keys)
            cut = int(starts[-1])
            if cut:
                yield table.slice(0, cut), starts[:-1]
                rest = table.slice(cut)
                held, rows = rest.to_batches(), rest.num_rows
            enough = max(min_rows, 2 * rows)  # a group is looked at again only when it has doubled
    if held:
        table = pa.Table.from_batches(held)
        yield table, group_starts(table, keys)
