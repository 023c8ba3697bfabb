"""Arrow batches in pieces, for Python functions whose results are larger than a batch may be."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of a piece.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in pieces of at most PIECE_ROWS rows and PIECE_BYTES of a string or binary column; a row that has
    more is a piece of its own."""
    start = held = 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if at > start and (at - start >= PIECE_ROWS or held + size > PIECE_BYTES):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)
