"""A quality classifier: generalised additive model with pairwise interactions, learnt by cyclic boosting.

Features are shares and shapes counted over the whole text. Each is binned at quantiles of the sample. Boosting goes round the
features; each turn fits a tree of three leaves on one feature's bins to the gradient of the logistic loss and adds it to
that feature's lookup table. The pairs whose best four-cell cut explains most of what is left get tables of their own, boosted the
same way. A score is the sum of table entries through the logistic function.

Labels are learnt from a bounded sample (`SAMPLE` rows by hash order). Null and empty texts are scored like any other, by
their zero features. Without labels, or with one label only, the score is the smoothed share of label 1. Null labels and null
keys are not learnt from. A key that labels or documents hold several times counts as often as it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.langid import held_out
from colloquy.llm.tables import slices, text_offsets, texts_of

#: Labelled rows learnt from at most.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE = 250, 80, 0.15

CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "exclaim", "bar", "sign", "other", "control", "wide")
FEATURES = ("log_bytes", *CLASSES, "word_length", "distinct_words", "same_neighbours", "same_lines", "line_length", "capital_words", "signed_words")


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, CLASSES.index("other"), np.uint8)
    for name, members in (
        ("control", [*range(32), 127]), ("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", [32, 9]), ("newline", [10, 13]),
        ("stop", b".,;:?'\"-()"), ("exclaim", b"!"), ("bar", b"|"), ("sign", b"$%&*#@^~=+<>{}[]\\/_`"), ("wide", range(128, 256)),
    ):
        kinds[list(members)] = CLASSES.index(name)
    return kinds


KINDS = _byte_classes()


def features(batch: pa.RecordBatch, column: str = "text") -> np.ndarray:
    """A row of numbers per text."""
    raw, starts = text_offsets(batch.column(batch.schema.get_field_index(column)))
    n, sizes = batch.num_rows, np.diff(starts)
    owner = np.repeat(np.arange(n) * len(CLASSES), sizes)
    shares = np.bincount(owner + KINDS[raw], minlength=n * len(CLASSES)).reshape(n, len(CLASSES)) / np.maximum(sizes, 1)[:, None]
    shapes = np.zeros((n, 7))
    for i, text in enumerate(texts_of(batch, column)):
        words = text.split()
        if words:
            lines, k = text.split("\n"), len(words)
            shapes[i] = (
                len(text) / k, len(set(words)) / k, sum(map(eq, words, words[1:])) / k, 1 - len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)),
                sum(map(str.isupper, words)) / k, 1 - sum(map(str.isalpha, (w.rstrip(".,") for w in words))) / k,
            )
    return np.column_stack([np.log1p(sizes), shares, shapes])


@dataclass
class AdditiveModel:
    """Cut points and lookup tables; `pairs` have coarser cuts of their own."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _leaves(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step per bin of a tree with few leaves: the best cuts one after another."""
    edges = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(edges) <= leaves:
        best = (1e-9, -1)
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gain = _worth(cg[mid] - cg[a], ch[mid] - ch[a]) + _worth(cg[b] - cg[mid], ch[b] - ch[mid]) - _worth(cg[b] - cg[a], ch[b] - ch[a])
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(mid[k])))
        if best[1] < 0:
            break
        edges = sorted([*edges, best[1]])
    step = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return step


def _cells(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """The best cut of a table of gradients into four cells: gain and where."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gain = _worth(cg, ch) + _worth(cg[-1:] - cg, ch[-1:] - ch) + _worth(cg[:, -1:] - cg, ch[:, -1:] - ch)
    gain += _worth(cg[-1, -1] - cg[-1:] - cg[:, -1:] + cg, ch[-1, -1] - ch[-1:] - ch[:, -1:] + ch)
    inner = gain[:-1, :-1]
    if not inner.size:
        return 0.0, 0, 0
    a, b = np.unravel_index(int(inner.argmax()), inner.shape)
    return float(inner[a, b] - _worth(cg[-1, -1], ch[-1, -1])), int(a) + 1, int(b) + 1


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    quantiles = lambda k: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) for j in range(x.shape[1])]
    model.cuts, model.coarse = quantiles(BINS), quantiles(PAIR_BINS)
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    wide = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.coarse)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    margin = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for b, table in zip(bins, model.tables, strict=True):
            g, h = slopes()
            step = RATE * _leaves(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            table += step
            margin += step[b]
    g, h = slopes()
    flat = lambda a, b: wide[a] * (len(model.coarse[b]) + 1) + wide[b]
    shape = lambda a, b: (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
    sums = lambda a, b, v: np.bincount(flat(a, b), v, int(np.prod(shape(a, b)))).reshape(shape(a, b))
    gains = [(_cells(sums(a, b, g), sums(a, b, h))[0], a, b) for a, b in combinations(range(x.shape[1]), 2)]
    model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros(shape(a, b)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            sg, sh = sums(a, b, g), sums(a, b, h)
            _, i, j = _cells(sg, sh)
            step = np.zeros_like(table)
            for rows in (slice(0, i), slice(i, None)):
                for cols in (slice(0, j), slice(j, None)):
                    step[rows, cols] = RATE * sg[rows, cols].sum() / (sh[rows, cols].sum() + 1.0)
            table += step
            margin += step[wide[a], wide[b]]
    return model


def _with_features(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    kept = docs.select(*carry, text)
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = pa.array(list(features(batch, text)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), rows], names=[*carry, "features"])

    return kept.mapInArrow(run, f"{kinds}, features array<double>")


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> AdditiveModel:
    """Fit on at most `limit` labelled rows outside the held-out part."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key, 4)).select(F.col(key).alias("_k"), F.col(label).cast("double").alias("_y"))
    chosen = known.orderBy(F.xxhash64(F.col("_k").cast("string")), "_k", "_y").limit(limit)
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    rows = _with_features(texts.join(F.broadcast(chosen), "_k").select("_k", "_y", "_t"), "_t", ["_k", "_y"]).orderBy(F.xxhash64(F.col("_k").cast("string")), "_k").limit(2 * limit).collect()
    y = np.asarray([float(r["_y"] > 0.5) for r in rows])
    x = np.asarray([r["features"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, y)


def score(docs: DataFrame, model: AdditiveModel, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), least: float = 0.7) -> DataFrame:
    """Per document score (0 to 1, higher: label 1 likelier) and predicted (1 from `least` on)."""
    columns = list(dict.fromkeys([key, *carry, text]))
    kept = docs.select(*columns)
    out = [c for c in columns if c != text or text in carry]
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = model.score(features(batch, text))
            own = [batch.column(columns.index(c)) for c in out]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found), pa.array((found >= least).astype(np.int32))], names=[*out, "score", "predicted"])

    return kept.mapInArrow(run, f"{kinds}, score double, predicted int")
