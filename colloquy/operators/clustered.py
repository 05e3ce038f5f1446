"""Tables clustered by the hash of a key.

One folder per bucket, files sorted by the key inside. A batch of keys reads the folders of its own buckets only: a join on (bucket, key) with a
small filtered side prunes the others at run time, before a file is opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import runtime

#: Rows a bucket is meant to hold, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 250_000, 4_096
#: Bytes of rows that are packed at once, rows that a partition is meant to sort, and the pieces of a bucket that a frequent key fills.
RUN_BYTES, SORTED_ROWS, PIECES = 16 << 20, 1_000_000, 16


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    return max(1, min(MAX_BUCKETS, -(-rows // bucket_rows)))


def _packed(table: pa.Table, key: str, part: int) -> pa.RecordBatch:
    """A row per bucket with its rows as one compressed run, those of a key side by side."""
    bucket = table["bucket"].to_numpy()
    order = np.lexsort((table[key].combine_chunks().dictionary_encode().indices.to_numpy(), bucket))
    table, bucket = table.take(pa.array(order)), bucket[order]
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    often = 4 * len(bucket) // max(len(cuts) - 1, 1)
    rows = []
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.slice(a, z - a).combine_chunks())
        rows.append((int(bucket[a]), part % PIECES if z - a > often else 0, sink.getvalue().to_pybytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "piece", "run"])


def write(rows: DataFrame, path: str, *order: str, about: int = 0) -> None:
    """`rows` hold `bucket`; a bucket that a frequent key fills becomes several files. `about` so many rows are expected.

    Rows travel to their buckets as compressed runs, a fraction of what they take one by one.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= RUN_BYTES:
                yield _packed(pa.Table.from_batches(held), order[0], part)
                part, held, size = part + 1, [], 0
        if held:
            yield _packed(pa.Table.from_batches(held), order[0], part)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(2):
                yield from pa.ipc.open_stream(run.as_buffer())

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-about // SORTED_ROWS))
    placed = rows.mapInArrow(pack, "bucket int, piece int, run binary").repartition(parts, "bucket", "piece")
    placed.mapInArrow(unpack, rows.schema).sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(table: DataFrame, wanted: DataFrame, key: str, buckets: int, bound: int | None = None) -> DataFrame:
    """Rows of `table` beside those of `wanted` with the same key; keys are never empty. `bound` limits the rows of `wanted`, when known."""
    dealt = wanted.where(F.length(key) > 0).withColumn("bucket", bucket_of(F.col(key), buckets))
    return table.join(runtime.small_side(dealt, bound=bound), ["bucket", key]).drop("bucket")
