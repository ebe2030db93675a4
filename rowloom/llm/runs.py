"""Whole groups out of the Arrow batches of a partition that is sorted by its group columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that split no group, with the offsets at which groups start and the end.

    A group is a run of equal ``keys`` (integers without nulls); only a group that is larger makes a table larger.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            at = starts(table)
            if len(at) > 1:
                yield table.slice(0, at[-1]), at
                table = table.slice(at[-1])
            held, count = table.to_batches(), 0
            rows = max(rows, 2 * table.num_rows)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(starts(table), table.num_rows)
