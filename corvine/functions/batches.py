"""Arrow batches in pieces, so that what Python makes of them stays small however large the batches are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and bytes of a piece; a longer row is a piece of its own size.
ROWS, BYTES = 256, 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of at most ``rows`` rows and, by the batch's mean row, ``most`` bytes; empty batches give none."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most // max(batch.nbytes, 1)))
        for begin in range(0, batch.num_rows, step):
            yield batch.slice(begin, step)
