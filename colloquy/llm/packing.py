"""Best-fit packing of token sequences by a configuration linear program over the histogram of lengths.

Documents are cut into pieces of at most `capacity` tokens. Only the histogram of piece lengths (at most `capacity`
numbers) comes to the driver. There the covering program "least sequences, every length covered" is solved by
multiplicative weights: each round prices the lengths, a knapsack over the capacity finds the best filling, the prices of
what it covers sink. The fractional fillings are rounded down, the rest is packed by best fit, and both are taken up
as a plan: which ranks of a length go to which fillings. The plan's size depends on the capacity alone and is broadcast; pieces
get their rank within a length from counts by block, so no length is gathered in one task.

Null and empty texts are the end id alone; equal keys stay apart; an empty table gives an empty plan; columns other
than key and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.tables import settle, slices, stored, texts_of
from colloquy.llm.vocab import encoder

CAPACITY = 2048
#: Words and cores of words that a Python worker remembers, and how many behind other stages.
REMEMBERED, BEHIND_OTHERS = (1_000_000, 700_000), (120_000, 160_000)
#: Bytes of text taken at once, and behind other stages.
TEXT_BYTES, TEXT_BYTES_BEHIND = 4 << 20, 1 << 20
#: Rounds of multiplicative weights.
ROUNDS = 400


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> list[int]:
    """The filling (a list of indices) of most worth; a length may be used again and again."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    sizes, worth = lengths[order], prices[order]
    room = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        if k := room[c]:
            total = best[c - sizes[:k]] + worth[:k]
            j = int(total.argmax())
            best[c], pick[c] = total[j], j
    out, c = [], capacity
    while c > 0 and pick[c] >= 0:
        out.append(int(order[pick[c]]))
        c -= int(sizes[pick[c]])
    return out


def best_fit(left: Counter, capacity: int) -> Counter:
    """Longest first, each into the fullest sequence with room. Bins that are alike are held once, with their number."""
    bins: list[tuple[int, tuple[int, ...]]] = []  # (room, content) in order of room
    number: Counter = Counter()

    def put(content: tuple[int, ...], n: int) -> None:
        if content not in number:
            insort(bins, (capacity - sum(content), content))
        number[content] += n

    for size in sorted(left, reverse=True):
        todo = left[size]
        while todo:
            i = bisect_left(bins, (size, ()))
            if i == len(bins):
                fits = capacity // size
                whole, rest = divmod(todo, fits)
                if whole:
                    put((size,) * fits, whole)
                if rest:
                    put((size,) * rest, 1)
                todo = 0
            else:
                room, content = bins[i]
                fits = min(room // size, todo)
                n = min(number[content], todo // fits)
                number[content] -= n
                if not number[content]:
                    del number[content]
                    bins.pop(i)
                put(content + (size,) * fits, n)
                todo -= n * fits
    return number


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Counter:
    """Fillings (lengths, longest first) and how often each is used; together they hold the histogram exactly."""
    need = {k: v for k, v in histogram.items() if v > 0}
    plan: Counter = Counter({(capacity,): need.pop(capacity)} if capacity in need else {})
    left = Counter(need)
    if need:
        lengths = np.array(sorted(need))
        demand = np.array([need[x] for x in lengths], float)
        log_price, used, seen = -np.log(demand), Counter(), {}
        for _ in range(rounds):
            prices = np.exp(log_price - log_price.max())
            filling = tuple(sorted(knapsack(lengths, prices, capacity)))
            counts = np.bincount(filling, minlength=len(lengths))
            seen[filling] = counts
            step = float((demand[counts > 0] / counts[counts > 0]).min())  # of this filling until a demand is met
            used[filling] += step
            log_price -= 0.5 * step * counts / demand
        covered = sum(seen[f] * n for f, n in used.items())
        scale = float((covered / demand).max()) or 1.0  # no demand is passed: what is over goes to the rest
        for filling, n in used.items():
            if times := int(n / scale):
                content = tuple(sorted((int(lengths[i]) for i in filling), reverse=True))
                plan[content] += times
                for size, k in Counter(content).items():
                    left[size] -= times * k
    plan.update(best_fit(+left, capacity))
    return plan


def assignments(plan: Counter) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, pieces in a sequence, first sequence, offset): where each run of ranks goes."""
    rows, given, sequence = [], Counter(), 0
    for content, times in sorted(plan.items(), reverse=True):
        offset = 0
        for size, k in sorted(Counter(content).items(), reverse=True):
            rows.append((size, given[size], k * times, k, sequence, offset))
            given[size] += k * times
            offset += k * size
        sequence += times
    return rows


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", end: int = 0, keep_ids: bool = True, remember: tuple[int, int] = REMEMBERED, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Each document's ids and an end id, cut only where longer than `capacity`."""
    kept = docs.select(key, text)
    kind = kept.schema[key].dataType.simpleString()
    tail = ", ids array<int>" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()  # what a stage before this one left in the worker
        encode, closing = encoder(vocabulary, *remember), np.asarray([end], "<u4").tobytes()
        for batch in slices(batches, text, text_bytes):
            rows, number, starts, lengths, sums, ids = [], [], [], [], [], []
            for i, packed in enumerate(encode.encode(texts_of(batch, text))):
                packed += closing
                for p, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    rows.append(i)
                    number.append(p)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            made = [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                made.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(made, names=names)

    return kept.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long{tail}")


def place(cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, length: str = "length") -> DataFrame:
    """Rows of a stored table with a length of 1 to `capacity` get `sequence_id` and `offset`, gapless within a sequence."""
    spark = cut.sparkSession
    rows = cut.withColumn("_block", F.input_file_name()).withColumn("_in", F.monotonically_increasing_id())
    counts = stored(rows.groupBy(length, "_block").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r[length]: r["n"] for r in counts.groupBy(length).agg(F.sum("_n").alias("n")).collect()}
    plan = assignments(solve(histogram, capacity, rounds))
    before = Window.partitionBy(length).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(length, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(length, "_block").orderBy("_in")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(firsts.hint("merge"), [length, "_block"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    table = spark.createDataFrame(plan, f"{length} long, _from long, _ranks long, _k long, _sequence long, _offset long")
    on = [length]
    at = F.col("_rank") - F.col("_from")
    return (
        ranked.join(F.broadcast(table), on).where(at.between(0, F.col("_ranks") - 1))
        .withColumn("sequence_id", F.col("_sequence") + F.floor(at / F.col("_k")))
        .withColumn("offset", F.col("_offset") + at % F.col("_k") * F.col(length))
        .drop("_block", "_in", "_rank", "_first", "_from", "_ranks", "_k", "_sequence", "_offset")
    )


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, rounds: int = ROUNDS, keep_ids: bool = True, **names) -> DataFrame:
    """The pieces of `docs`, each with its sequence and place; with `keep_ids` their token ids too."""
    cut = stored(pieces(docs, vocabulary, capacity, keep_ids=keep_ids, **names), "pieces")
    return place(cut, capacity, rounds)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ids in order of place. A sequence is as long as the capacity at most."""
    gathered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(gathered, lambda x: x["ids"])).alias("ids"))
