"""Unordered pairs inside groups, spread so that neither a hot group nor copied groups hurt one task."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Key sets longer than this are cut into blocks and the block pairs spread over tasks.
BLOCK = 256
#: Parts that the items are dealt to when pairs are counted part by part, and the pairs that are held at once.
PARTS, PAIRS_HELD = 16, 4_000_000


def key_sets(mentions: DataFrame, group: str = "turn_id", item: str = "entity") -> DataFrame:
    """Distinct sorted items per group, equal sets folded into one row with their `copies`.

    The set is one turn's own mentions, so its size is bounded by the turn's text. Folding first means
    a text copied a million times emits its pairs once, with weight a million.
    """
    return (
        mentions.groupBy(group)
        .agg(F.array_sort(F.collect_set(item)).alias("items"))
        .where(F.size("items") > 1)
        .groupBy("items")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def pair_counts(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """`(a, b, n)`: in how many groups the items `a < b` occur together."""
    small = sets.where(F.size("items") <= block)
    # Long sets: every pair of blocks is its own row, shuffled before its item pairs are written out.
    blocks = F.transform(
        F.sequence(F.lit(1), F.ceil(F.size("items") / F.lit(block)).cast("int")),
        lambda i: F.slice("items", (i - 1) * block + 1, block),
    )
    large = (
        sets.where(F.size("items") > block)
        .select("copies", blocks.alias("blocks"))
        .select("copies", "blocks", F.posexplode("blocks").alias("i", "left"))
        .select("copies", "i", "left", F.posexplode("blocks").alias("j", "right"))
        .where("i <= j")
        .repartition(F.xxhash64("i", "j", "left"))
        .select("copies", "left", "right")
    )
    rows = small.select("copies", F.col("items").alias("left"), F.col("items").alias("right")).unionByName(large)
    pairs = rows.select("copies", F.explode("left").alias("a"), "right").select(
        "copies", "a", F.explode(F.filter("right", lambda b: b > F.col("a"))).alias("b")
    )
    return pairs.groupBy("a", "b").agg(F.sum("copies").alias("n"))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def pair_counts_by_parts(sets: DataFrame, parts: int = PARTS, held: int = PAIRS_HELD) -> DataFrame:
    """The same as `pair_counts`, for sets of hundreds of items: no pair is shuffled.

    Items are dealt to `parts` by hash. The items of two parts that meet in a set travel together to the cell of these parts, which counts all
    their pairs: an item is copied once per part, not once per other item. A cell writes its pairs out for a run of first items at a time, about `held` pairs.
    """
    kind = sets.schema["items"].dataType.elementType.simpleString()
    number = F.sequence(F.lit(0), F.lit(parts - 1))
    dealt = F.transform(number, lambda i: F.filter("items", lambda x: F.pmod(F.xxhash64(x), F.lit(parts)) == i))
    cells = (
        sets.select("copies", dealt.alias("dealt"))
        .select("copies", "dealt", F.posexplode("dealt").alias("i", "left"))
        .where(F.size("left") > 0)
        .select("copies", "i", "left", F.posexplode("dealt").alias("j", "right"))
        .where((F.col("i") < F.col("j")) & (F.size("right") > 0) | (F.col("i") == F.col("j")) & (F.size("left") > 1))
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        copies, same = table["copies"].to_numpy(), table["i"][0].as_py() == table["j"][0].as_py()
        left, right = table["left"].combine_chunks(), table["right"].combine_chunks()
        met = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
        order = pc.array_sort_indices(met.dictionary).to_numpy()
        names, rank = met.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[met.indices.to_numpy()]
        lengths = [pc.list_value_length(c).to_numpy().astype(np.int64) for c in (left, right)]
        first, other = np.split(code, [lengths[0].sum()])
        start = np.cumsum(lengths[1]) - lengths[1]
        row = np.repeat(np.arange(len(copies)), lengths[0])
        by = np.argsort(first, kind="stable")
        first, row = first[by], row[by]
        due = np.cumsum(lengths[1][row])
        at = 0
        while at < len(first):
            end = max(int(np.searchsorted(due, (due[at - 1] if at else 0) + held)), at + 1)
            end = int(np.searchsorted(first, first[end - 1], side="right"))
            sizes = lengths[1][row[at:end]]
            x, y = np.repeat(first[at:end], sizes), other[_runs(start[row[at:end]], sizes)]
            n = np.repeat(copies[row[at:end]], sizes)
            if same:
                x, y, n = x[x < y], y[x < y], n[x < y]
            pair = np.minimum(x, y) * len(names) + np.maximum(x, y)
            found, back = np.unique(pair, return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, back, n)
            at = end
            for s in range(0, len(found), 100_000):
                a, b = np.divmod(found[s : s + 100_000], len(names))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(total[s : s + 100_000])], names=["a", "b", "n"])

    # A set number of partitions, as adaptive coalescing would judge a cell by its bytes.
    return cells.repartition(parts * (parts + 1), "i", "j").groupBy("i", "j").applyInArrow(count, f"a {kind}, b {kind}, n long")
