"""Arrow batches in small parts, for work that turns texts into Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 256


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows, ``rows`` at a time; memory that Arrow holds in reserve is given back after each batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()
