"""Groups of sorted rows, one after the other, out of Arrow batches: for scans that are sequential within a group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sorted_groups(rows: DataFrame, by: list[str], *order) -> DataFrame:
    """rows with each group of `by` in one task and in a row, in `order`."""
    return rows.repartition(*by).sortWithinPartitions(*by, *order)


def groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, with where each begins and the end; a group is rows with the same first `keys` columns.

    Keys hold no nulls. A group that goes on in the next batch waits for it.
    """
    rest = None
    for batch in _with_end(batches):
        rows = [b for b in (rest, batch) if b is not None and b.num_rows]
        if not rows:
            continue
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        start = np.zeros(table.num_rows, bool)
        start[0] = True
        for i in range(keys):
            k = table.column(i).to_numpy(zero_copy_only=False)
            start[1:] |= k[1:] != k[:-1]
        edges = np.flatnonzero(np.append(start, batch is None))
        rest = table.slice(int(edges[-1]))
        if len(edges) > 1:
            yield table.slice(0, int(edges[-1])), edges


def _with_end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
