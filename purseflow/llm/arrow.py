"""Helpers for tasks that receive Arrow batches: bounded chunks, sorted groups, packed arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that a task works on at once. One longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def chunks(
    batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes in ``column``, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            yield batch.slice(start, stop - start)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's bytes, empty for null."""
    return [value or b"" for value in batch.column(column).to_pylist()]


def numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def grouped(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str]
) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal non-null integer keys; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [numbers(batch.column(k)) for k in keys]
        changed = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            key = tuple(int(c[start]) for c in columns)
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield current, pa.Table.from_batches(held)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i]; ``parent`` stays flat, each root the smallest of its tree."""
    while True:
        roots_a, roots_b = parent[a], parent[b]
        open_ = roots_a != roots_b
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        low = np.minimum(roots_a[open_], roots_b[open_])
        high = np.maximum(roots_a[open_], roots_b[open_])
        np.minimum.at(parent, high, low)
        while not np.array_equal(flat := parent[parent], parent):
            parent[:] = flat


def packed(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()
