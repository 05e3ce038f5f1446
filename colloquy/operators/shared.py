"""What questions share with turns, for batches of many questions: weights summed where blocks of both meet, never one row per pair of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns and questions that meet in one cell of the grid, and the blocks that even a small store is cut into.
TURN_BLOCK, QUESTION_BLOCK, LEAST_BLOCKS = 65_536, 65_536, 16
SUM_DIGITS = 9


def _best(sums: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` greatest sums above zero, equal ones from the end."""
    found = np.flatnonzero(sums > 0)
    if len(found) <= k:
        return found
    score = np.round(sums[found], SUM_DIGITS)
    floor = np.partition(score, -k)[-k]
    above, equal = found[score > floor], found[score == floor]
    return np.concatenate([above, equal[len(above) - k :]])


def top_shared(
    said: DataFrame, asked: DataFrame, k: int, *, turns: int, questions: int, key: str = "qn",
    turn_block: int = TURN_BLOCK, question_block: int = QUESTION_BLOCK,
) -> DataFrame:
    """The `k` turns with the greatest sums per question: `key, id, score`, up to `k` from every block of turns, ties to the greater id.

    `said` holds `id, word, w`, one row per turn and word; `asked` holds `key, word`. A turn's sum is that of `w` over the words it shares with the question, rounded to
    nine digits; turns that share none are left out. Words meet by 64-bit hashes. `turns` and `questions` are about how many there are; they only set the grid.
    """
    rows, cols = max(-(-turns // turn_block), min(LEAST_BLOCKS, -(-turns // 256)), 1), max(1, -(-questions // question_block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = said.select(
        F.pmod(F.xxhash64("id"), F.lit(rows)).cast("int").alias("i"), each(cols).alias("j"), "id", F.xxhash64("word").alias("word"), F.col("w").cast("double").alias("w")
    )
    words = asked.groupBy(key).agg(F.collect_set(F.xxhash64("word")).alias("words"))
    right = words.select(each(rows).alias("i_q"), F.pmod(F.xxhash64(key), F.lit(cols)).cast("int").alias("j_q"), key, "words")
    kind = asked.schema[key].dataType.simpleString()

    def match(turn_rows: pa.Table, question_rows: pa.Table) -> pa.Table:
        names = question_rows[key].combine_chunks()
        lists = question_rows["words"].combine_chunks()
        ids, at = np.unique(turn_rows["id"].to_numpy(), return_inverse=True)
        word, w = turn_rows["word"].to_numpy(), turn_rows["w"].to_numpy()
        order = np.argsort(word, kind="stable")
        at, w, word = at[order], w[order], word[order]
        known, starts = np.unique(word, return_index=True)
        ends = np.append(starts[1:], len(word))
        who, which, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(ids) and len(names):
            wanted, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            bounds = bounds - bounds[0]
            place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = known[place] == wanted
            for q in range(len(names)):
                some = slice(bounds[q], bounds[q + 1])
                mine = place[some][hit[some]]
                if not len(mine):
                    continue
                sums = np.zeros(len(ids))
                for s, e in zip(starts[mine], ends[mine]):
                    sums[at[s:e]] += w[s:e]
                best = _best(sums, k)
                who.append(np.full(len(best), q))
                which.append(ids[best])
                score.append(np.round(sums[best], SUM_DIGITS))
        return pa.table({key: names.take(pa.array(np.concatenate(who))), "id": np.concatenate(which), "score": np.concatenate(score)})

    # A set number of partitions, as adaptive coalescing would judge a cell by its bytes.
    parts = 2 * rows * cols
    return left.repartition(parts, "i", "j").groupBy("i", "j").cogroup(right.repartition(parts, "i_q", "j_q").groupBy("i_q", "j_q")).applyInArrow(
        match, f"{key} {kind}, id long, score double"
    )
