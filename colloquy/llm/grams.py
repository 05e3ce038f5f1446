"""Hashes of words and word sequences over the bytes of many texts at once, and the trip of keys to their buckets and back.

Operators that need a count for every word sequence of every text would move far too many rows if each were one. Texts are dealt
into chunks of bounded size; a chunk sends each bucket one row with its sorted distinct keys, a bucket answers each
chunk with one row of numbers in the same order. Chunks and buckets follow hashes, so no key, source or group of copies makes one large.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.tables import settle, text_offsets

#: Text of a chunk, about.
CHUNK_BYTES = 3 << 20
U = np.uint64
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread hash of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[:1] = U(1)
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; lengths are rounded up so that one table serves many calls."""
    return _powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end], whatever its place."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_STEP, len(values)), out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(_BACK, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of non-blank bytes, A-Z lowered) and the n + 1 places where the texts' words begin."""
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    inside = ~BLANK[raw]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    own = starts[:-1][np.diff(starts) > 0]
    edge[own] = inside[own]
    begin = np.flatnonzero(edge)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[own[1:] - 1] = inside[own[1:] - 1]
    end = np.flatnonzero(stop) + 1
    return spans_hash(BYTE_VALUES[LOWER[raw]], begin, end), np.searchsorted(begin, starts)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(df: DataFrame) -> int:
    """A power of two, one bucket per shuffle partition at least; 256 of them complete 40 sent bits to a key of 48."""
    return max(256, 1 << (partitions(df) - 1).bit_length())


def chunked(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """`_key`, `_text` (never null) and `more`, with the `_chunk` of bounded size that each row belongs to."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(3 * partitions(docs), -(-size // CHUNK_BYTES))
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(text, F.lit("")).alias("_text"), *more)
    return rows.withColumn("_chunk", F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(n)).cast("int"))


def whole(table: pa.Table) -> pa.RecordBatch:
    """A group's rows in one batch, in an order that does not depend on how they arrived."""
    settle()
    by = [(c, "ascending") for c in ("_key", "_text")]
    return (table.sort_by(by) if table.num_rows > 1 else table).combine_chunks().to_batches(max_chunksize=None)[0]


def text_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_offsets(batch.column(batch.schema.get_field_index("_text")))


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of sorted 48-bit keys begins; buckets are equal ranges."""
    return np.searchsorted(keys >> U(49 - buckets.bit_length()), np.arange(buckets + 1, dtype=np.uint64))


def packed5(keys: np.ndarray) -> bytes:
    """The low 40 bits of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked5(data: bytes, bucket: int = 0, buckets: int = 256) -> np.ndarray:
    """Keys of 48 bits, the top 8 from the bucket they came to."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel() | U(bucket >> (buckets.bit_length() - 9)) << U(40)


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, so that small ones compress to little."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
