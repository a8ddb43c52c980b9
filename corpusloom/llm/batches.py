"""Parts of Arrow batches of bounded text size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def parts(batch: pa.RecordBatch, column: int, most_bytes: int = 8 << 20, most_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``most_rows`` rows and ``most_bytes`` of text, so that long texts do not pile up; a longer text is a part of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (total + size > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)
