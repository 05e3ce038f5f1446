"""Token ids kept as wavelet matrices, one compressed row per shard, with rank and select over the bit planes.

`write` encodes whole texts, closes each with an end id and writes them in ascending key order (null keys first, equal
keys side by side) to a Parquet folder: a row holds one shard of whole documents, its bit planes, the number of zeros of
each plane and the counts of ones before each block of bits. `read` gives every document back from the files;
`count` and `occurrences` answer from rank and select without decoding a shard. Null and empty texts are the end id
alone; an empty table writes no shard; columns other than key and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.tables import slices, texts_of
from colloquy.llm.vocab import encoder
from colloquy.runtime import work_folder

#: Tokens after which a shard is closed; a longer document is a shard of its own.
SHARD_TOKENS = 2 << 20
#: Bits between two counts of the rank directory.
BLOCK = 512

SCHEMA = (
    "part int, shard int, before long, n_tokens long, keys binary, nulls binary, ends binary, "
    "zeros binary, planes binary, ranks binary"
)


class WaveletMatrix:
    """Level by level the values' bits, highest first, each level ordered by the bit of the one above."""

    def __init__(self, n: int, zeros: np.ndarray, planes: np.ndarray, ranks: np.ndarray):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @staticmethod
    def build(values: np.ndarray) -> "WaveletMatrix":
        n = len(values)
        levels = max(1, int(values.max()).bit_length()) if n else 1
        current = values.astype(np.uint16 if levels <= 16 else np.uint32)
        blocks = -(-n // BLOCK)
        zeros, planes = np.zeros(levels, np.uint32), np.zeros((levels, blocks * BLOCK // 8), np.uint8)
        ranks = np.zeros((levels, blocks + 1), np.uint32)
        for level in range(levels):
            bit = current >> current.dtype.type(levels - 1 - level) & current.dtype.type(1) != 0
            packed = np.packbits(bit, bitorder="little")
            planes[level, : len(packed)] = packed
            ones = np.add.reduceat(bit, np.arange(0, n, BLOCK), dtype=np.uint32) if n else np.zeros(0, np.uint32)
            np.cumsum(ones, out=ranks[level, 1:])
            zeros[level] = n - int(ranks[level, -1])
            current = np.concatenate([np.compress(~bit, current), np.compress(bit, current)])
        return WaveletMatrix(n, zeros, planes, ranks)

    def row(self) -> dict[str, bytes]:
        return {"zeros": self.zeros.tobytes(), "planes": self.planes.tobytes(), "ranks": self.ranks.tobytes()}

    @staticmethod
    def open(n: int, zeros: bytes, planes: bytes, ranks: bytes) -> "WaveletMatrix":
        z = np.frombuffer(zeros, np.uint32)
        return WaveletMatrix(n, z, np.frombuffer(planes, np.uint8).reshape(len(z), -1), np.frombuffer(ranks, np.uint32).reshape(len(z), -1))

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        block = i // BLOCK
        tail = np.unpackbits(self.planes[level, block * BLOCK // 8 : (i + 7) // 8], bitorder="little")[: i - block * BLOCK]
        return int(self.ranks[level, block]) + int(tail.sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zero in enumerate(self.zeros.tolist()):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value, i = value << 1 | bit, zero + ones if bit else i - ones
        return value

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        """Where `value` of positions [low, high) lies below the last level."""
        levels = len(self.zeros)
        if value < 0 or value >> levels:
            return 0, 0
        for level, zero in enumerate(self.zeros.tolist()):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (zero + a, zero + b) if value >> (levels - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, value: int, i: int) -> int:
        """How often `value` stands before position i."""
        low, high = self._range(value, 0, i)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _place(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a level."""
        counts = self.ranks[level] if bit else np.arange(self.ranks.shape[1], dtype=np.int64) * BLOCK - self.ranks[level]
        block = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.unpackbits(self.planes[level, block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) `value`, or -1."""
        low, high = self._range(value, 0, self.n)
        if not 0 <= k < high - low:
            return -1
        i, levels = low + k, len(self.zeros)
        for level in range(levels - 1, -1, -1):
            bit = value >> (levels - 1 - level) & 1
            i = self._place(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All values in order, from the last level up."""
        levels, n = len(self.zeros), self.n
        values = np.zeros(n, np.uint32)
        for level in range(levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=n, bitorder="little").view(bool) if n else np.zeros(0, bool)
            zero, below, values = int(self.zeros[level]), values, np.empty(n, np.uint32)
            values[np.flatnonzero(~bit)] = below[:zero]
            values[np.flatnonzero(bit)] = below[zero:] | np.uint32(1 << (levels - 1 - level))
        return values


def write(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end: int = 0) -> None:
    """Encode `docs` and write them in ascending order of an integer key."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        closing = np.asarray([end], "<u4").tobytes()
        keys, nulls, ids, ends, held, shard, before = [], [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u4"))
            row = {
                "part": part, "shard": shard, "before": before, "n_tokens": matrix.n, "keys": np.asarray(keys, "<i8").tobytes(),
                "nulls": np.asarray(nulls, np.uint8).tobytes(), "ends": np.asarray(ends, "<u4").tobytes(), **matrix.row(),
            }
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in slices(batches, text, 4 << 20):
            for k, packed in zip(batch.column(0).to_pylist(), encode.encode(texts_of(batch, text)), strict=True):
                keys.append(k or 0)
                nulls.append(k is None)
                ids.append(packed + closing)
                held += len(packed) // 4 + 1
                ends.append(held)
                if held >= SHARD_TOKENS:
                    yield close()
                    before, shard = before + held, shard + 1
                    keys, nulls, ids, ends, held = [], [], [], [], 0
        if keys:
            yield close()

    spread = docs.select(F.col(key).cast("long").alias("key"), text).repartitionByRange("key").sortWithinPartitions("key")
    spread.mapInArrow(shards, SCHEMA).write.option("compression", "zstd").parquet(path)


ARROW = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("keys", pa.binary()), ("nulls", pa.binary()),
    ("ends", pa.binary()), ("zeros", pa.binary()), ("planes", pa.binary()), ("ranks", pa.binary()),
])


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The shards, each with the number of ids in all shards before it. Only one narrow row per part is ordered."""
    files = spark.read.schema(SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    return files.join(F.broadcast(starts), "part").withColumn("before", F.col("before") + F.col("_start")).drop("_start")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, WaveletMatrix, list]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
            keys = [None if null else k for k, null in zip(np.frombuffer(row["keys"], "<i8").tolist(), row["nulls"], strict=True)]
            yield row, WaveletMatrix.open(row["n_tokens"], row["zeros"], row["planes"], row["ranks"]), keys


def read(spark: SparkSession, path: str, key: str = "doc_id", digests: bool = False) -> DataFrame:
    """Per document: start (ids of all documents before it), n_tokens and its ids, or with `digests` their CRC-32."""
    last = "ids_crc32 long" if digests else "ids array<int>"

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix, keys in _shards(batches):
            ids, ends = matrix.decode().astype("<u4"), np.frombuffer(row["ends"], "<u4").astype(np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            if digests:
                raw = memoryview(ids.tobytes())
                made = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64())
            else:
                made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(begins + row["before"]), pa.array(ends - begins), made], names=[key, "start", "n_tokens", last.split()[0]])

    return opened(spark, path).mapInArrow(documents, f"`{key}` long, start long, n_tokens long, {last}")


def count(spark: SparkSession, path: str, token: int) -> DataFrame:
    """How often `token` stands in each shard, by rank alone."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix, _ in _shards(batches):
            yield pa.RecordBatch.from_pylist([{"part": row["part"], "shard": row["shard"], "n": matrix.count(token)}], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64())]))

    return opened(spark, path).mapInArrow(counted, "part int, shard int, n long")


def occurrences(spark: SparkSession, path: str, token: int, key: str = "doc_id") -> DataFrame:
    """Every place of `token`: its document, the place within it and the place among all ids, by select."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix, keys in _shards(batches):
            places = np.asarray([matrix.select(token, k) for k in range(matrix.count(token))], np.int64)
            ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
            owner = np.searchsorted(ends, places, "right")
            begins = np.concatenate([[0], ends])[owner]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in owner], pa.int64()), pa.array(places - begins), pa.array(places + row["before"])], names=[key, "place", "position"])

    return opened(spark, path).mapInArrow(found, f"`{key}` long, place long, position long")


def written(docs: DataFrame, vocabulary: str, **names: str) -> str:
    """Write `docs` to a new folder of the shared store and give its path."""
    path = work_folder(docs.sparkSession, "wavelet")
    write(docs, path, vocabulary, **names)
    return path
