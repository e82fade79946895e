"""Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc


def small(batches: Iterable[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces with at most ``most`` bytes in column ``text``, or one row, so that what a worker makes of
    them doesn't grow with Spark's batches, which are bounded by rows."""
    for b in batches:
        at = held = 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(b[text]), 0).to_pylist()):
            if k > at and held + n > most:
                yield b.slice(at, k - at)
                at, held = k, 0
            held += n
        if at < b.num_rows:
            yield b.slice(at)
