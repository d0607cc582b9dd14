"""Cutting Arrow batches to a bounded number of text bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes in a batch; a longer text stands alone in its batch.
BATCH_BYTES = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and its n + 1 offsets; a null has no bytes."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def small(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of at most ``limit`` text bytes or one row."""
    for batch in batches:
        column = batch.column(text_col)
        if not len(column):
            continue
        _, ends = text_bytes(column)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
