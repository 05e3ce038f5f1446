"""Approximate nearest neighbours by a forest of random-projection trees.

A tree splits at the median of one random direction on every level; the forest (directions and medians, fitted on at most `SAMPLE` distinct vectors) is small
and goes to every task. Every vector lies in one leaf of each tree. A query walks all trees through one priority queue, ordered by the squared
distance to the cells, and visits the first `budget` leaves that come out; their rows are scored exactly in double precision. The budget is the least
that finds `AIM` of the true neighbours of `TRIALS` trial vectors, whose neighbours one scan of all rows tells. Largest inner products become
least distances by one more component, sqrt(1 - (norm / largest norm)^2), of the rows.

Equal vectors are folded into one row first, which keeps the `k + 1` smallest ids: no other id can be among the first `k`. Sibling leaves and the
queries that visit some of them meet in cells of bounded size: full leaves, or leaves that many queries visit, become a grid of cells. A query moves once for
the leaves of a cell, and at most `k + 1` rows for it leave.

Rows with a null id, a null, empty or zero vector, or a null or non-finite component take no part. Vectors of unequal length do not meet: each length
has a forest of its own. Equal scores go to the smaller id. Rows repeated exactly are one row. An id given with several vectors is a candidate with each, also
beside the query's own row, and a query for each. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.tables import stored
from colloquy.operators.ordered import top_n

#: Trees, rows a leaf is meant to hold, vectors the trees are fitted on, trial vectors, share of their neighbours to be found.
TREES, LEAF, SAMPLE, TRIALS, AIM = 4, 2_048, 131_072, 256, 0.95
#: Sampled vectors a leaf has at least, levels that sibling leaves of a cell differ in, rows or queries of a cell.
PER_LEAF, SIBLINGS, CELL = 16, 3, 16_384


@dataclass(frozen=True)
class Forest:
    """`directions` (trees, components + 1, levels) and `cuts` (trees, 2^levels - 1), the medians, level by level."""

    directions: np.ndarray
    cuts: np.ndarray
    largest: float

    @property
    def levels(self) -> int:
        return self.directions.shape[2]

    @property
    def leaves(self) -> int:
        return 1 << self.levels

    @staticmethod
    def fit(sample: np.ndarray, largest: float, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
        levels = max(0, min(int(np.ceil(np.log2(max(1, rows / leaf)))), int(np.log2(max(1, len(sample) / PER_LEAF)))))
        rng, width = np.random.default_rng(seed), sample.shape[1] + 1
        trees = trees if levels else 1
        directions, cuts = np.zeros((trees, width, levels)), np.zeros((trees, (1 << levels) - 1))
        lifted = lift(sample, largest)
        for t in range(trees):
            directions[t] = np.concatenate([np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-levels // width))] or [np.zeros((width, 0))], axis=1)[:, :levels]
            places = lifted @ directions[t]
            node = np.zeros(len(sample), np.int64)
            for level in range(levels):
                order = np.lexsort((places[:, level], node))
                edges = np.searchsorted(node[order], np.arange((1 << level) + 1))
                middle = np.minimum((edges[:-1] + edges[1:]) // 2, len(sample) - 1)
                cut = np.where(edges[1:] > edges[:-1], places[order[middle], level], 0.0)
                cuts[t, (1 << level) - 1 : (2 << level) - 1] = cut
                node = 2 * node + (places[:, level] >= cut[node])
        return Forest(directions, cuts, largest)

    def members(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered through all trees."""
        lifted = lift(vectors, self.largest)
        out = np.zeros((len(vectors), len(self.cuts)), np.int64)
        for t in range(len(self.cuts)):
            places, node = lifted @ self.directions[t], np.zeros(len(vectors), np.int64)
            for level in range(self.levels):
                node = 2 * node + (places[:, level] >= self.cuts[t, (1 << level) - 1 + node])
            out[:, t] = t * self.leaves + node
        return out

    def places(self, queries: np.ndarray) -> np.ndarray:
        """Queries on the directions of each tree: (queries, trees, levels)."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        return np.einsum("qd,tdl->qtl", unit, self.directions[:, :-1])

    def visits(self, place: np.ndarray, budget: int) -> list[int]:
        """The first `budget` leaves out of the queue that all trees share; `place` is one query of `places`."""
        levels, cuts, leaves = self.levels, self.cuts, self.leaves
        queue = [(0.0, t, 0, 0) for t in range(len(cuts))]
        out: list[int] = []
        while queue and len(out) < budget:
            cost, tree, level, node = heapq.heappop(queue)
            while level < levels:
                margin = place[tree][level] - cuts[tree, (1 << level) - 1 + node]
                near = 2 * node + (margin >= 0)
                heapq.heappush(queue, (cost + margin * margin, tree, level + 1, near ^ 1))
                node, level = near, level + 1
            out.append(tree * leaves + int(node))
        return out

    def costs(self, places: np.ndarray) -> np.ndarray:
        """The cost at which each leaf of the forest would come out, for some queries at once."""
        out = []
        for t in range(len(self.cuts)):
            cost = np.zeros((len(places), 1))
            for level in range(self.levels):
                margin = places[:, t, level, None] - self.cuts[t, (1 << level) - 1 : (2 << level) - 1]
                both = np.empty((len(places), 2 << level))
                both[:, 0::2], both[:, 1::2] = cost + np.where(margin >= 0, margin**2, 0), cost + np.where(margin < 0, margin**2, 0)
                cost = both
            out.append(cost)
        return np.concatenate(out, axis=1)


def lift(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Rows over the largest norm and one more component that makes them unit vectors."""
    small = vectors / largest
    rest = np.sqrt(np.maximum(0.0, 1.0 - (small * small).sum(axis=1)))
    return np.concatenate([small, rest[:, None]], axis=1)


def _matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)


def _fit_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    fit = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & whole & some)
    return fit.select(F.col(key).cast("long").alias("_id"), F.transform(vector, lambda x: x.cast("double") + 0.0).alias("_v"))


def search(
    vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", *, trees: int = TREES, leaf: int = LEAF,
    aim: float = AIM, cell: int = CELL,
) -> DataFrame:
    """query_id, rank (from 1), `key`, score of the `k` nearest found for each row where `queries` holds."""
    rows, asked = _fit_rows(vectors, key, vector), _fit_rows(vectors.where(queries), key, vector)
    # equal vectors: one row with the k + 1 smallest ids
    first = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("_v").orderBy("_id"))).where(F.col("_r") <= k + 1)
    items = stored(first.groupBy("_v").agg(F.array_sort(F.collect_set("_id")).alias("ids")), "vectors")
    wanted = stored(asked.groupBy("_v").agg(F.min("_id").alias("_q")), "queries")
    size = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    lengths = items.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("largest")).collect()
    found = [_of_length(items, wanted, r["d"], r["n"], r["largest"], k, trees, leaf, aim, cell) for r in sorted(lengths)]
    if not found:
        return items.selectExpr("ids[0] AS query_id", "1 AS rank", f"ids[0] AS `{key}`", "0.0D AS score").limit(0)
    # one list of bounded length for each distinct query vector, then for each of its ids
    best = reduce(DataFrame.union, found)
    mine = asked.distinct().join(wanted, "_v").select(F.col("_id").alias("query_id"), "_q").join(best, "_q")
    own = F.slice(F.filter("near", lambda x: ~x["same"] | (x["_id"] != F.col("query_id"))), 1, k)
    out = mine.select("query_id", F.posexplode(own).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x._id").alias(key), F.col("x.score").alias("score"))


def _of_length(items: DataFrame, wanted: DataFrame, d: int, n: int, largest: float, k: int, trees: int, leaf: int, aim: float, cell: int) -> DataFrame:
    """`_q` and `near`, the k + 1 best (score, _id, whether the vector is the query's), for the queries of one vector length."""
    items, wanted = items.where(F.size("_v") == d), wanted.where(F.size("_v") == d)
    sampled = items.orderBy(F.xxhash64("_v"), "_v").limit(SAMPLE).select("_v").toArrow()
    sample = _matrix(sampled["_v"], d)
    forest = Forest.fit(sample, largest, n, trees, leaf)
    budget = calibrated(items, forest, sample[:TRIALS], k, aim)

    kin = min(SIBLINGS, forest.levels)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = forest.members(_matrix(b.column(0), d))
            row = pa.array(np.repeat(np.arange(b.num_rows), leaves.shape[1]))
            leaf = leaves.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(leaf >> kin), pa.array(leaf), b.column(0).take(row), b.column(1).take(row)], names=["g", "leaf", "_v", "ids"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [np.sort(forest.visits(p, budget)) for p in forest.places(_matrix(b.column(0), d)).tolist()]
            row, leaf = np.repeat(np.arange(b.num_rows), [len(s) for s in seen]), np.concatenate(seen)
            begins = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(leaf >> kin) != 0)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(leaf)), pa.int32()), pa.array(leaf, pa.int64()))
            at = pa.array(row[begins])
            yield pa.RecordBatch.from_arrays([pa.array(leaf[begins] >> kin), lists, b.column(0).take(at), b.column(1).take(at)], names=["g", "leaves", "_v", "_q"])

    placed = items.select("_v", "ids").mapInArrow(deal, "g long, leaf long, _v array<double>, ids array<bigint>")
    coming = stored(wanted.select("_v", "_q").mapInArrow(route, "g long, leaves array<bigint>, _v array<double>, _q long"), "visits")
    blocks = lambda rows, name: rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell)).cast("int").alias(name))
    # at most trees x leaves of the fitted forest: bounded by the sample
    grid = F.broadcast(blocks(placed.select("g"), "ni").join(blocks(coming.select("g"), "nj"), "g"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(grid, "g").select("g", F.pmod(F.xxhash64("_v"), F.col("ni")).cast("int").alias("i"), every("nj").alias("j"), "leaf", "_v", "ids")
    right = coming.join(grid, "g").select("g", every("ni").alias("i"), F.pmod(F.xxhash64("_q"), F.col("nj")).cast("int").alias("j"), "leaves", "_v", "_q")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return visited(a, b, d, k + 1)

    met = left.groupBy("g", "i", "j").cogroup(right.groupBy("g", "i", "j")).applyInArrow(meet, "_q long, _id long, score double, same boolean")
    # a row that several trees have shown
    once = met.repartition("_q").groupBy("_q", "_id", "score").agg(F.max("same").alias("same"))
    cut = top_n(once, ["_q"], [F.desc("score"), F.asc("_id")], k + 1)
    near = F.array_sort(F.collect_list(F.struct("rank", "_id", "score", "same")))
    return cut.groupBy("_q").agg(near.alias("near"))


def visited(rows: pa.Table, queries: pa.Table, d: int, k: int) -> pa.Table:
    """The `k` best of a cell for each query, out of the leaves it visits."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))]
    if rows.num_rows and queries.num_rows:
        vectors, ids, leaf = _matrix(rows["_v"], d), rows["ids"].combine_chunks(), rows["leaf"].to_numpy()
        asked, names = _matrix(queries["_v"], d), queries["_q"].to_numpy()
        lists = queries["leaves"].combine_chunks()
        who, where = np.repeat(np.arange(len(names)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)
        for number in np.unique(leaf):
            own, some = np.flatnonzero(leaf == number), who[where == number]
            if len(some):
                found.append(nearest(asked[some], names[some], vectors[own], ids.take(pa.array(own)), k))
    name, own, score, same = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((own, -score, name))
    order = order[np.arange(len(order)) - np.searchsorted(name[order], name[order]) < k]
    return pa.table({"_q": pa.array(name[order]), "_id": pa.array(own[order]), "score": pa.array(score[order]), "same": pa.array(same[order])})


def nearest(queries: np.ndarray, names: np.ndarray, rows: np.ndarray, ids: pa.ListArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The `k` best (query, id, score, same vector) of each query; ids of one row share its score. Scores are summed alike whatever stands beside them."""
    counts, flat = ids.value_lengths().to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(counts) - counts
    out = []
    for at in range(0, len(queries), 256):
        some = queries[at : at + 256]
        rough = some @ rows.T
        q, r = np.nonzero(np.ones(rough.shape, bool))
        if rough.shape[1] > k:
            blur = 1e-9 * np.linalg.norm(some, axis=1) * np.sqrt((rows * rows).sum(axis=1).max())
            q, r = np.nonzero(rough >= (np.partition(rough, -k, axis=1)[:, -k] - blur)[:, None])
        exact, same = (some[q] * rows[r]).sum(axis=1), (some[q] == rows[r]).all(axis=1)
        many = counts[r]
        own = flat[np.repeat(starts[r], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        q, score, same = np.repeat(q, many), np.repeat(exact, many), np.repeat(same, many)
        order = np.lexsort((own, -score, q))
        order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]
        out.append((names[at + q[order]], own[order], score[order], same[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def calibrated(items: DataFrame, forest: Forest, trials: np.ndarray, k: int, aim: float) -> int:
    """The least number of leaves that finds a share `aim` of the `k` nearest rows of the trial vectors."""
    if not forest.levels or not len(trials):
        return len(forest.cuts)
    d, own = trials.shape[1], (trials * trials).sum(axis=1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(trials), k), -np.inf)
        leaf = np.zeros((len(trials), k, len(forest.cuts)), np.int64)
        for b in batches:
            rows = _matrix(b.column(0), d)
            leaves = forest.members(rows)
            score = trials @ rows.T
            q, r = np.nonzero(score >= own[:, None] * (1 - 1e-9))
            for i in range(0, len(q), 65_536):
                a, c = q[i : i + 65_536], r[i : i + 65_536]
                same = (rows[c] == trials[a]).all(axis=1)
                score[a[same], c[same]] = -np.inf
            top = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
            both = np.concatenate([best, np.take_along_axis(score, top, axis=1)], axis=1)
            where = np.concatenate([leaf, leaves[top]], axis=1)
            keep = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best, leaf = np.take_along_axis(both, keep, axis=1), np.take_along_axis(where, keep[:, :, None], axis=1)
        q, r = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[q, r]), pa.array(list(leaf[q, r]), pa.list_(pa.int64()))], names=["t", "score", "leaves"])

    # k rows for each trial vector
    true = top_n(items.select("_v").mapInArrow(scan, "t long, score double, leaves array<bigint>"), ["t"], [F.desc("score"), F.asc("leaves")], k).toArrow()
    trial, leaves = true["t"].to_numpy(), _matrix(true["leaves"], len(forest.cuts)).astype(np.int64)
    places, needed = forest.places(trials), []
    for at in range(0, len(trials), 16):
        costs = forest.costs(places[at : at + 16])
        ordered = np.sort(costs, axis=1)
        for q in range(len(costs)):
            least = costs[q][leaves[trial == at + q]].min(axis=1, initial=np.inf)
            needed.append(np.searchsorted(ordered[q], least, "right"))
    needed = np.sort(np.concatenate(needed))
    return int(max(len(forest.cuts), needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))])) if len(needed) else len(forest.cuts)
