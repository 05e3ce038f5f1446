"""Hard negatives of anchors by angular triangle filtering.

A vector of integers keeps its norm and its angles to a few reference directions (vectors of the table, chosen by hash). For an
anchor and a row each reference gives cos(s + t) <= cosine <= cos(s - t), s and t their angles to it; the narrowest interval, times both norms
and widened by more than all rounding, bounds the integer score. The first pass finds each anchor's best rows of its own label: a
row is scored where its upper bound reaches the anchor's last place. The second pass looks for the best rows of other labels inside the score window
of each positive: a row is scored where its bounds overlap a window and reach the window's last place. References decide only how much is
scored, never a result. Anchors are sent to the tasks in blocks of bounded size, each over two scans of the stored rows; a task keeps a few rows per anchor and window.

Rows with a null id, label or vector, or with a null or non-finite component take no part. Vectors of unequal length do not meet; the empty
vector and the zero vector score 0. Scores have to fit a long. Equal scores go to the smaller id. Rows that share the anchor's id are the anchor
itself, never its positives or negatives; other rows that repeat take a place each. Of rows that repeat an anchor's id the one with the least label and vector
is the anchor. A negative positive score has an empty window. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.tables import stored
from colloquy.operators.ordered import top_n

#: Anchors sent to the tasks at once, rows of a block, anchors bounded at once, references of a length.
ANCHORS, BLOCK, CHUNK, REFERENCES = 16_384, 4_096, 64, 16
#: Distinct vector lengths with references of their own; rows of rarer lengths are scored without bounds.
LENGTHS = 64
#: Share of the product of norms by which an interval is widened: angles are stored as floats, with an error under 2e-7 each.
SLACK = 1e-6
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95

_FOUND = "anchor long, place int, _id long, score long"


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """`_id`, `_l`, `_v`: the rows that take part, every component x as floor(256 x), x as double."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & whole)
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return fit.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("long").alias("_l"), ints.alias("_v"))


def _directions(rows: DataFrame) -> dict[int, np.ndarray]:
    """Up to `REFERENCES` rows of each of the commonest lengths, as unit vectors."""
    common = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).select("d").where("d > 0")
    some = rows.withColumn("d", F.size("_v")).join(F.broadcast(common), "d").where(F.exists("_v", lambda x: x != 0))
    picked = top_n(some.select("d", "_v"), ["d"], [F.xxhash64("_v").asc(), F.col("_v").asc()], REFERENCES).select("d", "_v").collect()
    out: dict[int, list] = {}
    for r in picked:
        out.setdefault(r["d"], []).append(r["_v"])
    return {d: (m := np.asarray(v, float)) / np.linalg.norm(m, axis=1, keepdims=True) for d, v in out.items()}


def _matrix(lists: pa.Array, kind: type = np.int64) -> np.ndarray:
    """Lists of one length as a matrix."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(len(lists), -1)


def _by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, lists if len(rows) == len(lists) else lists.take(pa.array(rows))


def measured(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """Adds `norm` and `angles` to the references of the row's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            norms, angles = np.zeros(n), [[]] * n
            for d, at, lists in _by_length(batch.column(2)):
                own = _matrix(lists, float) if d else np.zeros((len(at), 0))
                norms[at] = size = np.sqrt((own * own).sum(axis=1))
                if d in references:
                    cosines = own @ references[d].T / np.where(size > 0, size, 1)[:, None]
                    for i, row in zip(at.tolist(), np.arccos(np.clip(cosines, -1, 1)).astype(np.float32), strict=True):
                        angles[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms), pa.array(angles, pa.list_(pa.float32()))], names=[*batch.schema.names, "norm", "angles"])

    return rows.select("_id", "_l", "_v").mapInArrow(run, "_id long, _l long, _v array<bigint>, norm double, angles array<float>")


class Side:
    """Rows of one length: ids, labels, integer vectors, norms, cosines and sines of their angles."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray, angles: np.ndarray):
        self.ids, self.labels, self.vectors, self.norms = ids, labels, vectors, norms
        self.cos, self.sin = np.cos(angles, dtype=float), np.sin(angles, dtype=float)
        self.most = float(np.abs(vectors).max(initial=0))

    @staticmethod
    def read(batch: pa.RecordBatch) -> Iterator[tuple[int, Side]]:
        """The sides of a batch of measured rows, one for each length."""
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_l", "_v", "norm", "angles")]
        for d, at, lists in _by_length(columns[2]):
            ids, labels, norms = (c.to_numpy(zero_copy_only=False)[at] for c in (columns[0], columns[1], columns[3]))
            angles = columns[4].take(pa.array(at))
            yield d, Side(ids, labels, _matrix(lists) if d else np.zeros((len(at), 0), np.int64), norms, _matrix(angles, float) if len(angles.flatten()) else np.zeros((len(at), 0)))

    def take(self, at: np.ndarray) -> Side:
        out = object.__new__(Side)
        out.__dict__ = {k: v if k == "most" else v[at] for k, v in self.__dict__.items()}
        return out


def bounds(anchors: Side, rows: Side) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every score, wider than all rounding."""
    low, high = np.full((len(anchors.ids), len(rows.ids)), -1.0), np.full((len(anchors.ids), len(rows.ids)), 1.0)
    for r in range(anchors.cos.shape[1]):
        level, spread = np.outer(anchors.cos[:, r], rows.cos[:, r]), np.outer(anchors.sin[:, r], rows.sin[:, r])
        np.maximum(low, level - spread, out=low)
        np.minimum(high, level + spread, out=high)
    sizes = np.outer(anchors.norms, rows.norms)
    return (low - SLACK) * sizes, (high + SLACK) * sizes


def scores(anchors: Side, rows: Side, open_: np.ndarray) -> np.ndarray:
    """Integer scores where `open_`, elsewhere the least long. Rows that no anchor has open are not multiplied."""
    out = np.full(open_.shape, np.iinfo(np.int64).min)
    at = np.flatnonzero(open_.any(axis=0))
    if len(at):
        most = anchors.most * rows.most * anchors.vectors.shape[1]
        kind = np.float32 if most < 1 << 24 else float if most < 1 << 53 else np.int64
        exact = anchors.vectors.astype(kind) @ rows.vectors[at].astype(kind).T
        out[:, at] = np.where(open_[:, at], exact.astype(np.int64), out[:, at])
    return out


class Best:
    """The `k` best (score, id) of every place: greater scores first, then smaller ids."""

    def __init__(self, places: int, k: int):
        self.k = k
        self.score = np.full((places, k), np.iinfo(np.int64).min)
        self.id = np.zeros((places, k), np.int64)

    def floor(self, places: np.ndarray | slice) -> np.ndarray:
        return self.score[places, -1]

    def add(self, places: np.ndarray, ids: np.ndarray, found: np.ndarray) -> None:
        """`found`: scores by place and row, the least long where a row is none of the place's."""
        none = np.iinfo(np.int64).min
        floor = self.score[places, -1]
        if found.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(found, -self.k, axis=1)[:, -self.k])
        p, r = np.nonzero((found >= floor[:, None]) & (found != none))
        if not len(p):
            return
        old_p, old_k = np.nonzero(self.score[places] != none)
        p, score = np.concatenate([p, old_p]), np.concatenate([found[p, r], self.score[places][old_p, old_k]])
        ids = np.concatenate([ids[r], self.id[places][old_p, old_k]])
        order = np.lexsort((ids, -score, p))
        p, score, ids = p[order], score[order], ids[order]
        rank = np.arange(len(p)) - np.searchsorted(p, p)
        first = rank < self.k
        new_score, new_id = np.full((len(places), self.k), none), np.zeros((len(places), self.k), np.int64)
        new_score[p[first], rank[first]], new_id[p[first], rank[first]] = score[first], ids[first]
        self.score[places], self.id[places] = new_score, new_id


def _positives(anchors: Side, rows: Side, best: Best) -> None:
    """One place for each anchor: the best rows of its label."""
    for label in np.intersect1d(anchors.labels, rows.labels):
        mine, own = np.flatnonzero(anchors.labels == label), rows.take(np.flatnonzero(rows.labels == label))
        for at in range(0, len(mine), CHUNK):
            some = mine[at : at + CHUNK]
            part = anchors.take(some)
            low, high = bounds(part, own)
            other = part.ids[:, None] != own.ids
            floor = best.floor(some).astype(float)
            if other.shape[1] > best.k:
                sure = np.where(other, low, -np.inf)
                floor = np.maximum(floor, np.partition(sure, -best.k, axis=1)[:, -best.k])
            best.add(some, own.ids, scores(part, own, other & (high >= floor[:, None])))


def _negatives(anchors: Side, rows: Side, best: Best, least: np.ndarray, most: np.ndarray) -> None:
    """`best.score` has a place for each anchor and window; `least` and `most` are the windows' ends by anchor."""
    windows = least.shape[1]
    for at in range(0, len(anchors.ids), CHUNK):
        some = np.arange(at, min(at + CHUNK, len(anchors.ids)))
        part = anchors.take(some)
        low, high = bounds(part, rows)
        places = some[:, None] * windows + np.arange(windows)
        lowest = np.maximum(least[some], best.floor(places)).astype(float)
        open_ = np.zeros(low.shape, bool)
        for w in range(windows):
            open_ |= (high >= lowest[:, w, None]) & (low <= most[some, w, None])
        open_ &= (part.labels[:, None] != rows.labels) & (part.ids[:, None] != rows.ids)
        if not open_.any():
            continue
        found = scores(part, rows, open_)
        for w in range(windows):
            inside = open_ & (found >= least[some, w, None]) & (found <= most[some, w, None])
            held = np.flatnonzero(inside.any(axis=1))
            if len(held):
                best.add(places[held, w], rows.ids, np.where(inside[held], found[held], np.iinfo(np.int64).min))


def _scan(rows: DataFrame, sides: dict[int, Side], numbers: dict[int, np.ndarray], k: int, windows: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """One pass of a block of anchors; `numbers` are their rows in `windows` by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = windows[0].shape[1] if windows else 1
        best = {d: Best(len(s.ids) * count, k) for d, s in sides.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                for d, own in Side.read(batch.slice(at, BLOCK)):
                    if d not in sides:
                        continue
                    if windows is None:
                        _positives(sides[d], own, best[d])
                    else:
                        _negatives(sides[d], own, best[d], windows[0][numbers[d]], windows[1][numbers[d]])
        for d, b in best.items():
            place, rank = np.nonzero(b.score != np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sides[d].ids[place // count]), pa.array((place % count).astype(np.int32)), pa.array(b.id[place, rank]), pa.array(b.score[place, rank])],
                names=["anchor", "place", "_id", "score"],
            )

    found = rows.mapInArrow(run, _FOUND)
    return top_n(found, ["anchor", "place"], [F.desc("score"), F.asc("_id")], k)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where `anchors` holds.

    Negatives of a positive: the first rows of other labels with 50 * positive_score <= 100 * score <= 95 * positive_score.
    """
    plain = integers(vectors, key, vector, label)
    references = _directions(plain)
    rows = stored(measured(plain, references), "angles")
    asked = integers(vectors.where(anchors), key, vector, label).groupBy("_id").agg(F.min(F.struct("_l", "_v")).alias("x")).select("_id", "x._l", "x._v")
    asked = stored(measured(asked, references), "anchors")
    parts = max(1, -(-asked.count() // block))
    found = [_block(rows, asked.where(F.pmod(F.xxhash64("_id"), F.lit(parts)) == i), positives, negatives) for i in range(parts)]
    return reduce(DataFrame.union, found)


def _block(rows: DataFrame, asked: DataFrame, positives: int, negatives: int) -> DataFrame:
    table = asked.toArrow().combine_chunks()  # a block of bounded size
    sides = dict(Side.read(table.to_batches()[0])) if table.num_rows else {}
    best = _scan(rows, sides, {}, positives, None).toArrow()  # at most `positives` rows for each of them
    starts = np.cumsum([0, *(len(s.ids) for s in sides.values())])
    numbers = {d: np.arange(a, b) for d, a, b in zip(sides, starts, starts[1:], strict=False)}
    number = {i: n for d, s in sides.items() for i, n in zip(s.ids.tolist(), numbers[d].tolist(), strict=True)}
    least, most = np.ones((len(number), positives), np.int64), np.zeros((len(number), positives), np.int64)
    for anchor, rank, score in zip(*(best.column(c).to_pylist() for c in ("anchor", "rank", "score")), strict=True):
        if score >= 0:
            least[number[anchor], rank - 1], most[number[anchor], rank - 1] = -(-LOW * score // 100), HIGH * score // 100
    found = _scan(rows, sides, numbers, negatives, (least, most))
    renamed = pa.table({"a": best["anchor"], "p": pa.compute.subtract(best["rank"].cast(pa.int32()), 1), "positive_id": best["_id"], "positive_score": best["score"]})
    windows = rows.sparkSession.createDataFrame(renamed, "a long, p int, positive_id long, positive_score long")
    return found.join(F.broadcast(windows), (F.col("anchor") == F.col("a")) & (F.col("place") == F.col("p"))).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
