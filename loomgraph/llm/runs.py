"""Runs of rows with equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole runs of rows with equal first `keys` columns, of sorted batches; several runs a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for i in range(keys):
            c = batch.column(i).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if held and any(batch.column(i)[0] != held[-1].column(i)[held[-1].num_rows - 1] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for i in range(keys):
        c = table.column(i).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)
