"""Runs of rows: an Arrow batch holds ten thousand rows of any length, too many texts to hold as Python objects at once."""

from __future__ import annotations

from typing import Callable

import pyarrow as pa

#: Bytes of Arrow data that are turned into Python objects at once.
SLICE_BYTES = 1 << 20
#: Words whose reading a Python worker remembers, per kind of reading: a worker lives as long as its executor, and rare words never end.
WORDS_REMEMBERED = 100_000


def in_slices(work: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """`work` over runs of rows of about `SLICE_BYTES`, the results put together."""
    n = len(columns[0])
    step = max(1, n * SLICE_BYTES // max(1, sum(c.nbytes for c in columns)))
    return pa.concat_arrays([work(*[c.slice(i, step) for c in columns]) for i in range(0, n, step)] or [work(*columns)])
