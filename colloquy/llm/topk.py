"""Exact top-k inner products by no-random-access aggregation.

Components become integers. In each block of vectors every dimension is a list sorted by value, read from its high end for
positive and its low end for negative query components. After each round of reading a candidate's score is bounded below and
above by what was read and by the last values seen; the lists are left once nobody outside can reach the k-th lower bound,
and only the candidates still open are scored out. Queries are broadcast in blocks of bounded size over one pass of the
vectors each, a task keeps k per query, and the k best are cut again after the shuffle.

Vectors that are null, or hold a null or non-finite component, take no part; vectors of unequal length do not meet. Equal
scores go to the smaller id; a query's own id is no candidate; rows with a null id take no part. Components must stay below
2^20 in size times 256, so that sums stay exact in doubles. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ordered import top_n

#: Queries broadcast at once, and vectors of a block.
QUERIES, BLOCK = 4096, 4096
#: Shares of the lists read after each round.
ROUNDS = (0.15, 0.4)


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`key` and floor(256 x) of every component, x as double; unfit vectors left out."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & whole).select(
        F.col(key).cast("long").alias("_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("_v")
    )


def aggregate(queries: np.ndarray, items: np.ndarray, k: int, floor: np.ndarray) -> list[np.ndarray]:
    """For each query the indices of items that may be among its best k, given scores `floor` known already."""
    n, dims = items.shape
    order = np.argsort(items, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], (n, dims)), axis=0)
    lists = np.take_along_axis(items, order, axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    high, low = lists[-1], lists[0]
    candidates = None
    for share in ROUNDS:
        depth = max(1, int(n * share))
        if depth >= n:
            break
        last_up, last_down = lists[n - depth], lists[depth - 1]
        read_up, read_down = place >= n - depth, place < depth
        # what was read, and for what was not: the last value read (above) or the far end of the list (below)
        seen = up @ np.where(read_up, items, 0).T + down @ np.where(read_down, items, 0).T
        above = seen + up @ np.where(read_up, 0, last_up).T + down @ np.where(read_down, 0, last_down).T
        below = seen + up @ np.where(read_up, 0, low).T + down @ np.where(read_down, 0, high).T
        if n > k:
            floor = np.maximum(floor, np.partition(below, n - k, axis=1)[:, n - k])
        candidates = above >= floor[:, None]
        if candidates.mean() < 0.05:
            break
    if candidates is None:
        return [np.arange(n)] * len(queries)
    return [np.flatnonzero(row) for row in candidates]


def _resolve(queries: np.ndarray, ids: np.ndarray, items: np.ndarray, keys: np.ndarray, k: int, best: list) -> None:
    """Read the open candidates out and keep the best k of each query, smaller ids first among equals."""
    floor = np.asarray([b[0][-1] if len(b[0]) >= k else -np.inf for b in best])
    # a query's own row may hold one of the k places while bounds are taken: keep one more
    for q, open_ in enumerate(aggregate(queries, items, k + 1, floor)):
        open_ = open_[keys[open_] != ids[q]]
        scores = np.concatenate([best[q][0], items[open_] @ queries[q]])
        who = np.concatenate([best[q][1], keys[open_]])
        first = np.lexsort((who, -scores))[:k]
        best[q] = (scores[first], who[first])


def search(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), `key` and score of the k best other rows for each row where `queries` holds."""
    items = integers(vectors, key, vector)
    asked = integers(vectors.where(queries), key, vector)
    parts = max(1, -(-asked.count() // block))
    found = [_block(items, asked.where(F.pmod(F.xxhash64("_id"), F.lit(parts)) == i), k) for i in range(parts)]
    cut = top_n(reduce(DataFrame.union, found), ["query_id"], [F.desc("score"), F.asc("_id")], k)
    return cut.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias(key), "score")


def _block(items: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    by_size: dict[int, list] = {}
    for r in asked.collect():  # a block of bounded size
        by_size.setdefault(len(r["_v"]), []).append((r["_id"], r["_v"]))
    sides = {d: (np.asarray([i for i, _ in rows], np.int64), np.asarray([v for _, v in rows], float).reshape(len(rows), d)) for d, rows in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: [(np.empty(0), np.empty(0, np.int64))] * len(ids) for d, (ids, _) in sides.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lists, keys = part.column(1), part.column(0).to_numpy()
                sizes = lists.value_lengths().to_numpy()
                for d in np.unique(sizes).tolist():
                    if d in sides:
                        rows = np.flatnonzero(sizes == d)
                        own = lists.take(pa.array(rows)).flatten().to_numpy().astype(float).reshape(len(rows), d)
                        ids, queries = sides[d]
                        for q in range(0, len(ids), 256):
                            some = best[d][q : q + 256]
                            _resolve(queries[q : q + 256], ids[q : q + 256], own, keys[rows], k, some)
                            best[d][q : q + 256] = some
        for d, kept in best.items():
            n = [len(s) for s, _ in kept]
            if sum(n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(sides[d][0], n)), pa.array(np.concatenate([w for _, w in kept])), pa.array(np.concatenate([s for s, _ in kept]).astype(np.int64))],
                    names=["query_id", "_id", "score"],
                )

    return items.mapInArrow(run, "query_id long, _id long, score long")
