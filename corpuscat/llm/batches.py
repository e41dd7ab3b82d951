"""Arrow batches cut by bytes, and runs of rows with one key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """``start, end`` of runs of rows of about ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = 0
    while start < len(sizes):
        end, held = start, 0
        while end < len(sizes) and (end == start or held + sizes[end] <= most):
            held += sizes[end]
            end += 1
        yield start, end
        start = end


def runs(batches: Iterator[pa.RecordBatch], key: int = 0, most: int = 1) -> Iterator[pa.Table]:
    """Tables of whole runs of one key each, from batches sorted by column ``key``.

    With ``most`` above 1, several whole runs share a table of about that many rows.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key)
        if not len(keys):
            continue
        changed = pc.not_equal(keys[1:], keys[:-1])
        starts = [i + 1 for i, c in enumerate(changed.to_pylist()) if c]
        if held and keys[0].as_py() != last:
            starts.insert(0, 0)
        begin = 0
        for s in starts:
            if s > begin:
                held.append(batch.slice(begin, s - begin))
            if held and sum(b.num_rows for b in held) >= most:
                yield pa.Table.from_batches(held)
                held = []
            begin = s
        held.append(batch.slice(begin))
        last = keys[len(keys) - 1].as_py()
    if held:
        yield pa.Table.from_batches(held)
