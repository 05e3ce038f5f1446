"""Language-model scores by deleted interpolation.

A token's probability mixes three maximum-likelihood estimates: after the word before it, alone, and uniform over the
vocabulary and one unknown. The mixture depends on how frequent the context is (a bucket per power of two). Its weights
are learnt by expectation-maximisation on held-out counts: for each training token the counts without that occurrence. Every
training text is counted and every training token takes part in the weights; what EM reads is a table of bounded size
(context bucket and two rounded estimates), summed on the executors.

Word pairs are counted through `grams`: a chunk of texts asks each bucket once and gets its counts back in the same order. Null and
empty texts are their end alone. A null key is scored but not learnt from. Equal keys stay apart and count twice. Without
training texts every score is 0. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import grams
from colloquy.llm.grams import U
from colloquy.llm.tables import slices, stored

BEGIN, END = grams.mixed(np.array([11, 12], np.uint64)) >> U(16)
#: Context buckets, steps of the two rounded estimates, rounds of EM, least weight of the uniform estimate.
BUCKETS, STEPS, ROUNDS, LEAST = 48, 64, 80, 1e-6


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit hashes of all tokens (words and ends), of the pairs they close, and where each text begins."""
    found, at = grams.words(*grams.text_of(batch))
    ones = np.insert(found >> U(16), at[1:], END)
    at = at + np.arange(len(at))
    before = np.empty_like(ones)
    before[1:] = ones[:-1]
    before[at[:-1]] = BEGIN
    twos = grams.mixed(before * U(0x9E3779B97F4A7C15) + ones) >> U(16)
    return ones, twos, at


COUNTS = "_bucket int, _chunk int, ones binary, n_ones binary, twos binary, n_twos binary"
TOTALS = "_chunk int, _bucket int, ones binary, twos binary, types long, tokens long, begins long"
CODES = "kind int, _key long, held_out boolean, n_tokens long, n_known long, ones binary, twos binary, types long, tokens long, begins long"


def _batch(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.Table.from_pylist(rows, schema=pa.schema([(name, kinds[kind]) for name, kind in fields]))


def _counter(buckets: int):
    def count(table: pa.Table) -> pa.Table:
        batch = grams.whole(table)
        chunk, held = batch.column(batch.schema.get_field_index("_chunk"))[0].as_py(), np.asarray(batch.column(batch.schema.get_field_index("_held")).to_pylist(), bool)
        ones, twos, at = tokens(batch)
        learnt = np.repeat(~held, np.diff(at))
        ones = np.append(ones, BEGIN)
        keys1, back1 = np.unique(ones, return_inverse=True)
        keys2, back2 = np.unique(twos, return_inverse=True)
        n1 = np.bincount(back1, np.append(learnt, (~held).sum()), len(keys1)).astype(np.uint32)
        n2 = np.bincount(back2, learnt, len(keys2)).astype(np.uint32)
        cut1, cut2 = grams.cuts(keys1, buckets), grams.cuts(keys2, buckets)
        return _batch([
            {"_bucket": b, "_chunk": chunk, "ones": grams.packed5(keys1[a:z]), "n_ones": grams.planes(n1[a:z]), "twos": grams.packed5(keys2[c:y]), "n_twos": grams.planes(n2[c:y])}
            for b, (a, z, c, y) in enumerate(zip(cut1, cut1[1:], cut2, cut2[1:], strict=False)) if z > a or y > c
        ], COUNTS)

    return count


def _totals(table: pa.Table, buckets: int) -> pa.Table:
    """A bucket's sums over all chunks, for each chunk in the order of its keys."""
    rows = table.to_pylist()
    sums = []
    for keys, n in (("ones", "n_ones"), ("twos", "n_twos")):
        lists = [grams.unpacked5(r[keys], r["_bucket"], buckets) for r in rows]
        found, back = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(back, np.concatenate([grams.unplanes(r[n]) for r in rows]), len(found))
        sums.append((found, total, np.split(total[back], np.cumsum([len(x) for x in lists])[:-1])))
    (found, total, ones), (_, _, twos) = sums
    begin = found == BEGIN
    stats = {"types": int(((total > 0) & ~begin).sum()), "tokens": int(total[~begin].sum()), "begins": int(total[begin].sum())}
    answers = [{"_chunk": r["_chunk"], "_bucket": r["_bucket"], "ones": grams.planes(a), "twos": grams.planes(b)} for r, a, b in zip(rows, ones, twos, strict=True)]
    return _batch([*answers, {"_chunk": -1, "_bucket": rows[0]["_bucket"], **stats}], TOTALS)


def _codes(texts: pa.Table, totals: pa.Table) -> pa.Table:
    """Per text the counts of its tokens and pairs; the sums of the whole corpus pass through."""
    answers = sorted(totals.to_pylist(), key=lambda r: r["_bucket"])
    if not texts.num_rows:
        return _batch([{"kind": 1, **{k: r[k] for k in ("types", "tokens", "begins")}} for r in answers if r["_chunk"] < 0], CODES)
    batch = grams.whole(texts)
    ones, twos, at = tokens(batch)
    _, back1 = np.unique(np.append(ones, BEGIN), return_inverse=True)
    _, back2 = np.unique(twos, return_inverse=True)
    n1 = np.concatenate([grams.unplanes(r["ones"]) for r in answers])[back1[:-1]]
    n2 = np.concatenate([grams.unplanes(r["twos"]) for r in answers])[back2]
    keys, held = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_key", "_held"))
    return _batch([
        {"kind": 0, "_key": k, "held_out": h, "n_tokens": b - a, "n_known": int((n1[a:b] > 0).sum()), "ones": grams.planes(n1[a:b]), "twos": grams.planes(n2[a:b])}
        for k, h, a, b in zip(keys, held, at[:-1].tolist(), at[1:].tolist(), strict=True)
    ], CODES)


def _streams(batch: pa.RecordBatch, begins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of tokens, pairs and contexts of a batch of texts, and where each text begins."""
    names = batch.schema.names
    ones, twos = ([grams.unplanes(x.as_py()) for x in batch.column(names.index(c))] for c in ("ones", "twos"))
    at = np.concatenate([[0], np.cumsum([len(x) for x in ones])])
    c1, c2 = np.concatenate(ones).astype(float), np.concatenate(twos).astype(float)
    context = np.empty_like(c1)
    context[1:] = c1[:-1]
    context[at[:-1]] = begins
    return c1, c2, context, at


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context)[1], BUCKETS - 1)


def _share(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=np.asarray(b) > 0)


def held_out_counts(codes: DataFrame, stats: dict[str, int]) -> DataFrame:
    """Training tokens by context bucket and rounded estimates, each counted without itself; sums of the exact estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ones"):
            c1, c2, context, _ = _streams(batch, stats["begins"])
            p2, p1 = _share(c2 - 1, context - 1), _share(c1 - 1, stats["tokens"] - 1.0)
            with np.errstate(divide="ignore"):
                q2, q1 = (np.where(p > 0, 1 + np.clip(-np.log2(p) * fine, 0, STEPS - 2), 0).astype(np.int64) for p, fine in ((p2, 4), (p1, 2)))
            cell = (bucket_of(context - 1) * STEPS + q2) * STEPS + q1
            found, back = np.unique(cell, return_inverse=True)
            sums = [np.bincount(back, w, len(found)) for w in (np.ones_like(p1), p2, p1)]
            yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], names=["cell", "n", "p2", "p1"])

    cells = codes.where("kind = 0 AND NOT held_out AND _key IS NOT NULL").select("ones", "twos").mapInArrow(run, "cell long, n double, p2 double, p1 double")
    return cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "p2", "p1")))


def mixture(cells: list[tuple[int, float, float, float]], types: int) -> np.ndarray:
    """Weights (pair, single, uniform) per context bucket by expectation-maximisation."""
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    if not cells:
        weights[:] = (0, 0, 1)
        return weights
    cell, n, p2, p1 = (np.asarray(x) for x in zip(*sorted(cells), strict=True))
    bucket = (cell // (STEPS * STEPS)).astype(int)
    estimates = np.column_stack([p2 / n, p1 / n, np.full(len(n), 1.0 / (types + 1))])
    for _ in range(ROUNDS):
        parts = weights[bucket] * estimates
        parts *= (n / parts.sum(axis=1))[:, None]
        sums = np.column_stack([np.bincount(bucket, parts[:, i], BUCKETS) for i in range(3)])
        seen = sums.sum(axis=1) > 0
        weights[seen] = sums[seen] / sums[seen].sum(axis=1, keepdims=True)
    weights[:, 2] = np.maximum(weights[:, 2], LEAST)
    weights[0, 0] = 0.0  # nothing follows a context that was never seen
    return weights / weights.sum(axis=1, keepdims=True)


def scores(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document held_out, n_tokens, n_known, train_tokens, base_score (add-one) and score. `held` marks what is not learnt from."""
    buckets = grams.buckets_for(docs)
    rows = grams.chunked(docs.withColumn("_held", held | F.col(key).isNull()), key, text, "_held")
    counts = rows.groupBy("_chunk").applyInArrow(_counter(buckets), COUNTS)
    totals = counts.groupBy("_bucket").applyInArrow(lambda t: _totals(t, buckets), TOTALS)
    codes = stored(rows.groupBy("_chunk").cogroup(totals.groupBy("_chunk")).applyInArrow(_codes, CODES), "codes")
    found = codes.where("kind = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "begins"))).first().asDict()
    cells = [tuple(r) for r in held_out_counts(codes, found).collect()]  # at most BUCKETS * STEPS * STEPS
    weights, n, v = mixture(cells, found["types"]), found["tokens"], found["types"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ones"):
            c1, c2, context, at = _streams(batch, found["begins"])
            w = weights[bucket_of(context)]
            p = w[:, 0] * _share(c2, context) + w[:, 1] * (c1 / max(n, 1)) + w[:, 2] / (v + 1)
            made = [np.add.reduceat(np.log10(x), at[:-1]) for x in ((c1 + 1) / (n + v + 1), p)]
            own = [batch.column(i) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(batch.num_rows, n)), *map(pa.array, made)], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kept = codes.where("kind = 0").select("_key", "held_out", "n_tokens", "n_known", "ones", "twos")
    return kept.mapInArrow(run, f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
