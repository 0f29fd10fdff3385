"""Shared plumbing of the training-data operators: batches for Python, cut in small pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from folioscope.tables import components, cut, cuts_so_far, drop_all_but, drop_cut, shared_dir

__all__ = ["components", "cut", "cuts_so_far", "drop_all_but", "drop_cut", "pieces", "shared_dir"]

#: Bytes of a column that a worker turns into Python objects at once.
PIECE_BYTES = 1 << 20
#: Tasks of a shuffle whose groups are of one size; more groups share tasks.
MOST_TASKS = 50_000


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes of a column, one row at least, so that memory follows the longest row and not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        after = np.cumsum(lengths.astype(np.int64) + 64)
        lo = 0
        while lo < batch.num_rows:
            used = after[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(after, used + size, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
