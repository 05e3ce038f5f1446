"""What the operators share: inputs, Arrow slices of bounded size, tables that outlive a lost executor."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from colloquy.runtime import work_folder

T = TypeVar("T")
#: Text handled at once in a Python worker. A longer text is handled alone, whole.
SLICE_BYTES = 2 << 20


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def settle() -> None:
    """Give memory that is free in this Python worker back to the machine; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_HELD: dict[tuple, object] = {}


def held(make: Callable[..., T], *key: object) -> T:
    """`make(*key)`, kept in a Python worker from task to task until the worker is asked for anything else: one at a time."""
    if (make, key) not in _HELD:
        _HELD.clear()
        gc.collect()
        settle()
        _HELD[make, key] = make(*key)
    return _HELD[make, key]


class Remembered(dict):
    """A dictionary that forgets what two generations of use have not asked for; at most about `limit` entries."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def missing(self, keys: set) -> set:
        """The keys that are not known; known ones are kept for now."""
        if len(self) > self.limit // 2:
            self.older = dict(self)
            self.clear()
        # set operations would walk through all that is remembered, not through what is asked
        new, older = {k for k in keys if k not in self}, self.older
        found = {k for k in new if k in older}
        self.update((k, older[k]) for k in found)
        return new - found if found else new


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the plan above it never runs twice, whoever is lost."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array and the n + 1 places where its texts begin; null: empty."""
    raw_bytes = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if raw_bytes else "")
    column = column.cast(pa.large_binary() if raw_bytes else pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of whole rows with about `size` bytes of `column`."""
    for batch in batches:
        _, starts = text_offsets(batch.column(batch.schema.get_field_index(column)))
        row, n = 0, batch.num_rows
        while row < n:
            end = max(row + 1, int(np.searchsorted(starts, starts[row] + size, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end
    settle()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
