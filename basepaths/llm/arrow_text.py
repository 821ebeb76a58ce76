"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` text bytes each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if v is None else v for v in binary_length(batch.column(text))], dtype=np.int64)
        marks = np.cumsum(sizes) // limit
        edges = np.flatnonzero(np.diff(marks)) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows]):
            if end > start:
                yield batch.slice(start, end - start)


def binary_length(column: pa.Array) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def byte_rows(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal keys; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(batch.num_rows - 1, dtype=bool) if batch.num_rows > 1 else np.zeros(0, dtype=bool)
        for column in columns:
            change |= column[1:] != column[:-1]
        edges = np.flatnonzero(change) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows]):
            key = tuple(c[start].item() for c in columns)
            if key != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(start, end - start))
    if held:
        yield current, pa.Table.from_batches(held)
