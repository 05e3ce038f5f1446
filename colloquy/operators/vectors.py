"""Vector operators: nearest neighbours, near-duplicates, and the two-axis projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import runtime
from colloquy import schema as sc
from colloquy.functions import text
from colloquy.operators.ordered import top_n
from colloquy.operators.sessions import stride_sample

SCORE_DIGITS = 6
#: Questions sent to every task at once, and the questions and rows that are scored at once in a task.
QUERY_BLOCK, QUERY_CELL, ROW_CELL = 4_096, 256, 4_096
REACH = ("exclude_session", "session", "since", "until", "scope", "include_hidden")


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """A list<float> column as a float32 matrix without a per-row copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


_FOUND = pa.schema([("query_id", pa.string()), ("id", pa.int64()), ("score", pa.float64())])
RESULT = "query_id string, id long, score double"


class _Block:
    """A block of questions and the best `k` rows of each so far: greater scores first, then greater ids."""

    def __init__(self, asked: pa.Table, k: int, by_vector: bool) -> None:
        n = asked.num_rows
        self.names, self.k = asked["query_id"], k
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        self.matrix = np.stack(asked["vec"].to_pylist()).astype(np.float64) if by_vector and n else None
        option = lambda c: asked[c].to_pylist() if c in asked.column_names else [None] * n
        text = lambda c, bare=False: [v.strip() if bare and v else v for v in option(c)]
        self.equal = {"session_id": (text("session"), True), "scope": (text("scope", True), True), "session_id ": (text("exclude_session"), False)}
        bound = lambda c, none: np.asarray([none if v is None else v for v in option(c)], float)
        self.since, self.until = bound("since", -np.inf), bound("until", np.inf)
        self.all_seen = np.asarray([bool(v) for v in option("include_hidden")], bool)

    def mask(self, rows: dict[str, np.ndarray], q: slice) -> np.ndarray | None:
        """Which rows the questions `q` may see; None when all see all."""
        tests = []
        for column, (wanted, equal) in self.equal.items():
            some, name = wanted[q], column.strip()
            if name in rows and any(some):
                same = np.stack([rows[name] == w if w else np.full(len(rows[name]), equal) for w in some])
                tests.append(same if equal else ~same)
        if "ts" in rows and (np.isfinite(self.since[q]).any() or np.isfinite(self.until[q]).any()):
            tests.append((rows["ts"] >= self.since[q, None]) & (rows["ts"] <= self.until[q, None]))
        if "hidden" in rows and rows["hidden"].any():
            tests.append(~rows["hidden"] | self.all_seen[q, None])
        return np.logical_and.reduce(tests) if tests else None

    def add(self, ids: np.ndarray, values: np.ndarray, rows: dict[str, np.ndarray]) -> None:
        """`values`: vectors, or one number per row that all questions share."""
        for at in range(0, len(self.score), QUERY_CELL):
            q = slice(at, min(at + QUERY_CELL, len(self.score)))
            found = np.round(self.matrix[q] @ values.T, SCORE_DIGITS) if values.ndim == 2 else np.broadcast_to(values, (q.stop - q.start, len(values)))
            seen = self.mask(rows, q)
            if seen is not None:
                found = np.where(seen, found, -np.inf)
            floor = self.score[q, -1]
            if found.shape[1] > self.k:
                floor = np.maximum(floor, np.partition(found, -self.k, axis=1)[:, -self.k])
            row, col = np.nonzero((found >= floor[:, None]) & (found > -np.inf))
            if not len(row):
                continue
            old, place = np.nonzero(self.score[q] > -np.inf)
            who = np.concatenate([row, old])
            score, best = np.concatenate([found[row, col], self.score[q][old, place]]), np.concatenate([ids[col], self.id[q][old, place]])
            order = np.lexsort((-best, -score, who))
            rank = np.arange(len(order)) - np.searchsorted(who[order], who[order])
            order, rank = order[rank < self.k], rank[rank < self.k]
            fresh_score, fresh_id = np.full(self.score[q].shape, -np.inf), np.full(self.id[q].shape, -1, np.int64)
            fresh_score[who[order], rank], fresh_id[who[order], rank] = score[order], best[order]
            self.score[q], self.id[q] = fresh_score, fresh_id

    def rows(self) -> pa.RecordBatch:
        row, place = np.nonzero(self.score > -np.inf)
        names = self.names.combine_chunks() if isinstance(self.names, pa.ChunkedArray) else self.names
        return pa.RecordBatch.from_arrays([names.take(pa.array(row)).cast(pa.string()), pa.array(self.id[row, place]), pa.array(self.score[row, place])], schema=_FOUND)


def local_top_k(
    items: DataFrame, queries: DataFrame, k: int, score: str, *, by_vector: bool, block: int = QUERY_BLOCK,
) -> DataFrame:
    """Top `k` items per question by (score desc, id desc), each question inside its own reach.

    `items`: `id`, `score` (a vector or a number), and whichever of `session_id, ts, scope, hidden` the reach
    needs. Questions are cut into blocks by hash; each block is sent to the tasks of one scan of the items, which never move. A task scores cells of
    `QUERY_CELL` x `ROW_CELL` by one product and keeps a running best per question, so only k rows per task and question are shuffled.
    """
    attrs = [c for c in ("session_id", "ts", "scope", "hidden") if c in items.columns and c != score]
    cols = list(dict.fromkeys(["id", score, *attrs]))
    asked = queries.select("query_id", *(["vec"] if by_vector else []), *[F.col(c) for c in REACH if c in queries.columns])
    if by_vector:
        asked = asked.where(F.col("vec").isNotNull())
    parts = max(1, -(-asked.count() // block))
    dealt = lambda i: asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)

    def scan(head: pa.Table) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Block(head, k, by_vector)
            for batch in batches:
                for at in range(0, batch.num_rows if head.num_rows else 0, ROW_CELL):
                    part = batch.slice(at, ROW_CELL)
                    column = lambda c, part=part: part.column(part.schema.get_field_index(c))
                    rows = {c: column(c).to_numpy(zero_copy_only=False) for c in attrs}
                    if "hidden" in rows:
                        rows["hidden"] = rows["hidden"].astype(bool)
                    values = matrix_of(column(score), best.matrix.shape[1]).astype(np.float64) if by_vector else column(score).to_numpy(zero_copy_only=False).astype(np.float64)
                    best.add(column("id").to_numpy(), values, rows)
            yield best.rows()

        return items.select(*cols).mapInArrow(run, RESULT)

    found = [scan(dealt(i).toArrow()) for i in range(parts)]
    return top_n(reduce(DataFrame.union, found), ["query_id"], [F.col("score").desc(), F.col("id").desc()], k)


def knn(vectors: DataFrame, queries: DataFrame, k: int, vec: str = "vec", **kw: int) -> DataFrame:
    """Exact nearest vectors by cosine (vectors are unit length)."""
    return local_top_k(vectors, queries, k, vec, by_vector=True, **kw)


def newest(turns: DataFrame, queries: DataFrame, k: int, **kw: int) -> DataFrame:
    """The newest `k` turns each question may see."""
    return local_top_k(turns, queries, k, "ts", by_vector=False, **kw)


# --- near duplicates ------------------------------------------------------------------------------
PIVOTS = 64
#: Vectors of a cell that travel as one block, and those of a block that are compared at once.
CELL_BLOCK, CELL_STEP = 16_384, 1_024


def near_duplicates(
    vectors: DataFrame, cosine: float = sc.DUPLICATE_COSINE, k: int = sc.DUPLICATE_PARTNERS, *,
    later: DataFrame | None = None, pivots: int = PIVOTS, block: int = CELL_BLOCK,
) -> DataFrame:
    """For each turn the best `k` earlier turns with cosine at or above the bound: `id, earlier, score, rank`.

    Exact. Equal vectors are folded into one row first. Each distinct vector belongs to the cell of its nearest
    pivot and visits every other cell that can hold a partner: partners within distance eps of y lie in the
    cell of p only if y is within eps of the plane halfway between its own pivot and p. Cells are cut
    into blocks, so a hot cell becomes many tasks. Only pairs that pass the bound leave a task, and per vector none that `k` pairs of the
    same task with strictly greater scores beat for every turn of that vector.
    """
    rows = vectors.select("id", F.col("vec").cast("array<float>").alias("vec"))
    width = rows.select(F.size("vec")).first()
    if width is None:
        return rows.select("id", F.col("id").alias("earlier"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    dim = width[0]
    tagged = rows.withColumn("_gh", F.xxhash64("vec"))
    groups = tagged.groupBy("_gh", "vec").agg(F.min("id").alias("gid"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    # Pivots only steer the work; any choice gives the same result.
    chosen = groups.orderBy(F.xxhash64("gid"), "gid").limit(pivots).select("vec").toArrow()
    centres = matrix_of(chosen.column(0), dim).astype(np.float64)
    eps = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine))) + 1e-6
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * centres @ centres.T))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix_of(b.column(1), dim).astype(np.float64)
            near = v @ centres.T
            home = near.argmax(axis=1)
            gap = near[np.arange(len(v)), home][:, None] - near
            visits = gap <= eps * np.maximum(apart[home], 1e-9) + 1e-9
            visits[np.arange(len(v)), home] = True
            row, cell = np.nonzero(visits)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array(cell.astype(np.int32)),
                 pa.array(cell == home[row])],
                names=["gid", "vec", "last", "cell", "native"],
            )

    placed = groups.select("gid", "vec", "last").mapInArrow(place, "gid long, vec array<float>, last long, cell int, native boolean")
    # A cell's own vectors are far fewer than its visitors: cut apart, so that a visitor is copied once per block of the former only.
    cut = lambda n: F.greatest(F.ceil(n / F.lit(block)), F.lit(1)).cast("int")
    sizes = F.broadcast(
        placed.groupBy("cell").agg(cut(F.count_if("native")).alias("own"), cut(F.count(F.lit(1))).alias("all"))
    )
    blocked = placed.join(sizes, "cell")
    dealt = lambda n: F.pmod(F.xxhash64("gid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = blocked.where("native").select("cell", dealt("own").alias("i"), every("all").alias("j"), "gid", "vec", "last")
    # New names, because both sides come from one table.
    rights = blocked.select(
        F.col("cell").alias("cell_r"), every("own").alias("i_r"), dealt("all").alias("j_r"),
        F.col("gid").alias("gid_r"), F.col("vec").alias("vec_r"),
    )

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        gids, others, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            mine, last, other = (c.to_numpy() for c in (left["gid"], left["last"], right["gid_r"]))
            order = np.argsort(other)
            other, b = other[order], matrix_of(right["vec_r"], dim)[order]
            a = matrix_of(left["vec"], dim)
            for x in range(0, len(mine), CELL_STEP):
                rows = slice(x, x + CELL_STEP)
                # Partners after a vector's last turn are earlier than none of its turns.
                reach = int(np.searchsorted(other, last[rows].max()))
                block = a[rows].astype(np.float64)
                floor = np.full(len(block), -np.inf)
                best = np.full((len(block), k), -np.inf)
                at, which, score = [], [], []
                for y in range(0, reach, CELL_STEP):
                    cols = slice(y, min(y + CELL_STEP, reach))
                    cos = block @ b[cols].astype(np.float64).T
                    p, q = np.nonzero(cos >= np.maximum(floor, cosine)[:, None] - 10.0**-SCORE_DIGITS)
                    found = np.round(cos[p, q], SCORE_DIGITS)
                    some = (found >= cosine) & (other[cols][q] < last[rows][p])
                    p, q, found = p[some], q[some], found[some]
                    at.append(p), which.append(other[cols][q]), score.append(found)
                    # The k-th best of those whose turns are all earlier than the vector's own.
                    sure = np.flatnonzero(other[cols][q] < mine[rows][p])
                    if len(sure):
                        who, value = np.concatenate([p[sure], np.repeat(np.arange(len(block)), k)]), np.concatenate([found[sure], best.ravel()])
                        by = np.lexsort((-value, who))
                        rank = np.arange(len(by)) - np.searchsorted(who[by], who[by])
                        by, rank = by[rank < k], rank[rank < k]
                        best[who[by], rank] = value[by]
                        floor = best[:, -1]
                if at:
                    p, q, found = np.concatenate(at), np.concatenate(which), np.concatenate(score)
                    keep = found >= floor[p]
                    gids.append(mine[rows][p[keep]]), others.append(q[keep]), scores.append(found[keep])
        return pa.table({"gid": np.concatenate(gids), "other": np.concatenate(others), "score": np.concatenate(scores)})

    pairs = lefts.groupBy("cell", "i", "j").cogroup(rights.groupBy("cell_r", "i_r", "j_r")).applyInArrow(
        match, "gid long, other long, score double"
    )
    member_of = tagged.join(groups.select("_gh", "vec", "gid"), ["_gh", "vec"]).select("id", "gid")
    asked = member_of if later is None else member_of.join(later.select("id"), "id", "left_semi")
    # A turn with k earlier equals needs no other partner, so only the first k+1 of equal turns look around.
    own = top_n(member_of, ["gid"], [F.col("id").asc()], k + 1, "_nth").drop("_nth")
    looking = asked.join(own.select("id"), "id", "left_semi")
    wide = looking.join(pairs, "gid").join(member_of.select(F.col("gid").alias("other"), F.col("id").alias("earlier")), "other")
    best = [F.col("score").desc(), F.col("earlier").desc()]
    around = top_n(wide.where("earlier < id").select("id", "earlier", "score"), ["id"], best, k)
    # Past the first k equals, the k just before in id order are the answer.
    by_id = Window.partitionBy("gid").orderBy("id")
    lags = F.array(*[F.struct(F.lag("id", i).over(by_id).alias("earlier"), F.lit(i).alias("rank")) for i in range(1, k + 1)])
    crowded = groups.where(F.col("n") > k + 1).select("gid")
    rest = (
        member_of.join(crowded, "gid", "left_semi").withColumn("_p", lags)
        .join(own.select("id"), "id", "left_anti")
    )
    if later is not None:
        rest = rest.join(later.select("id"), "id", "left_semi")
    rest = rest.select("id", F.explode("_p").alias("p")).select("id", "p.earlier", F.lit(1.0).alias("score"), "p.rank")
    return around.unionByName(rest)


# --- projection -----------------------------------------------------------------------------------
@dataclass
class Basis:
    mean: np.ndarray
    axes: np.ndarray
    variance_explained: tuple[float, float]


def moments(vectors: DataFrame, dim: int, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and 1/n covariance. Tasks send one d x d sum each; the driver sees d x d numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            v = matrix_of(b.column(0), dim).astype(np.float64)
            n, first, second = n + len(v), first + v.sum(axis=0), second + v.T @ v
        if n:
            flat = np.concatenate([[float(n)], first, second.ravel()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["pos", "x"]
            )

    sums = (
        vectors.where(F.size(vec) == dim).select(vec).mapInArrow(partial, "pos int, x double")
        .groupBy("pos").agg(F.sum("x").alias("x"))
    )
    got = sums.toPandas().set_index("pos")["x"] if dim else pd.Series(dtype=float)
    if not len(got):
        return 0, np.zeros(dim), np.zeros((dim, dim))
    flat = got.reindex(range(1 + dim + dim * dim), fill_value=0.0).to_numpy()
    n = int(flat[0])
    mean = flat[1 : 1 + dim] / n
    return n, mean, flat[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)


def _leading(cov: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Dominant eigenpair by power iteration, the largest component made positive."""
    v = 1.0 + np.arange(len(cov)) * 1e-3
    v /= np.linalg.norm(v)
    value = 0.0
    for _ in range(rounds):
        image = cov @ v
        value, size = float(image @ v), float(np.linalg.norm(image))
        if size == 0.0:
            break
        moved, v = float(np.abs(image / size - v).sum()), image / size
        if moved < tolerance:
            break
    return v * (-1.0 if v[np.abs(v).argmax()] < 0 else 1.0), max(value, 0.0)


def pca2(vectors: DataFrame, dim: int, vec: str = "vec") -> Basis:
    """The first two principal axes of a vector table."""
    n, mean, cov = moments(vectors, dim, vec)
    if n == 0:
        return Basis(mean, np.eye(2, max(dim, 2)), (0.0, 0.0))
    total = float(np.trace(cov))
    first, v1 = _leading(cov)
    second, v2 = _leading(cov - v1 * np.outer(first, first))
    share = (lambda v: v / total) if total > 0 else (lambda v: 0.0)
    return Basis(mean, np.stack([first, second]), (share(v1), share(v2)))


def project(df: DataFrame, basis: Basis, vec: str = "vec") -> DataFrame:
    """Adds `x` and `y`: the vector's place on the plane."""
    axes = [F.array(*[F.lit(float(a)) for a in axis]) for axis in basis.axes]
    shift = [float(basis.mean @ axis) for axis in basis.axes]
    return df.withColumns(
        {name: dot(F.col(vec), axis) - F.lit(s) for name, axis, s in zip(("x", "y"), axes, shift)}
    )


def projection(
    turns: DataFrame, vectors: DataFrame, dim: int, *, limit: int = sc.PROJECTION_POINTS, session: str | None = None
) -> tuple[DataFrame, Basis]:
    """A 2-D map of a stride sample of the vectors, each point labeled by its turn."""
    limit = min(max(limit, 1), sc.PROJECTION_MAX_POINTS)
    mine = turns if session is None else turns.where(F.col("session_id") == session)
    known = vectors.join(mine.select("id"), "id", "left_semi")
    sample = stride_sample(known, limit).where(F.size("vec") == dim)
    basis = pca2(sample, dim)
    points = project(sample, basis).drop("vec").join(
        mine.select("id", "session_id", "speaker", "ts", text.clip(F.col("text"), sc.POINT_CHARS).alias("text")), "id"
    )
    return points, basis


def overlay(
    vectors: DataFrame, queries: DataFrame, basis: Basis, session_of: DataFrame | None = None, session: str | None = None,
    near: int = 10, within: int = 200,
) -> DataFrame:
    """Where each question falls on the plane and its nearest turns in the full space.

    With a session, the nearest are those of its turns found among the overall top `within`.
    """
    found = knn(vectors, queries, near if session is None else within)
    if session is not None:
        mine = session_of.where(F.col("session_id") == session).select("id")
        found = top_n(found.drop("rank").join(mine, "id", "left_semi"), ["query_id"],
                      [F.col("score").desc(), F.col("id").desc()], near)
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("n"))
    placed = project(queries.select("query_id", "vec"), basis).drop("vec")
    return placed.join(listed.select("query_id", F.col("n.id").alias("neighbours")), "query_id", "left")
