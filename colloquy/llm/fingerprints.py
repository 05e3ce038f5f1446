"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text's terms are its pairs of neighbouring words (the last word alone), weighted by how often they occur. Weights are whole
numbers: a term of weight w stands for its copies 1 to w. For each of `SAMPLES` numbers k every copy draws a number from a hash of
term, copy and k, whatever the text; the copy of least number is the sample. Two texts share a sample with the
probability of their generalised Jaccard similarity, sum of least weights over sum of greatest, as the copies that both hold are the
least of the two weights. The least number stands for the sample. `near_edited` and `near_next` are the share of samples that agree, with a
standard error of sqrt(J (1 - J) / SAMPLES): 0.05 at J = 0.8.

`edited` replaces the last half of a text by the start of the next document in descending order of keys (after the last: the
first). Rows with equal keys stay apart; where the next key has several, its least text counts. A null key comes last.
Texts that are null or hold no word have the fingerprint of no terms, which is like itself alone. Columns other than key and
text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.tables import stored

#: Samples of a document.
SAMPLES = 64
#: The bits of one half of a hash.
HALF = 0xFFFFFFFF
#: Samples drawn by one row, two by a hash.
LANE = 8
LOWEST = -(1 << 63)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`_k` (the key's place in the order), `text`, `next_k`, the needed start of the next document and `n_chars`.

    Texts move once, by `_k`; from there each sends the document before it only the start that one needs.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("_k"), F.coalesce(text, F.lit("")).alias("text"))
    narrow = rows.groupBy("_k").agg(F.max(F.length("text")).alias("_n"), F.count("*").alias("_rows"))
    keys = stored(narrow.repartitionByRange(F.desc("_k")).withColumn("_slice", F.spark_partition_id()), "order")
    inside = Window.partitionBy("_slice").orderBy(F.desc("_k"))
    firsts = keys.groupBy("_slice").agg(F.max("_k").alias("_first"))
    # one narrow row per slice: what comes after it, and for the last the very first
    after = firsts.select("_slice", F.coalesce(F.lead("_first").over(Window.orderBy("_slice")), F.max("_first").over(Window.partitionBy())).alias("_after"))
    order = keys.withColumn("_lead", F.lead("_k").over(inside)).join(F.broadcast(after), "_slice")
    asked = order.select(F.coalesce("_lead", "_after").alias("_k"), F.col("_k").alias("_asker"), F.floor(F.col("_n") / 2).cast("int").alias("_need"))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(parts, "_k")
    sent = placed.join(asked.repartition(parts, "_k"), "_k").select(F.col("_asker").alias("_k"), F.col("_k").alias("next_k"), F.expr("left(text, _need)").alias("_next"))
    if not keys.where("_rows > 1").isEmpty():
        sent = sent.groupBy("_k", "next_k").agg(F.min("_next").alias("_next"))
    return placed.join(sent.repartition(parts, "_k"), "_k").withColumn("n_chars", F.length("text").cast("long"))


def edited() -> Column:
    half = "cast(floor(n_chars / 2) as int)"
    return F.expr(f"concat(left(text, cast(n_chars as int) - {half}), left(_next, {half}))")


def terms(text: str) -> Column:
    """Hashes of neighbouring words."""
    return F.expr(f"transform(filter(split({text}, '\\\\s+'), w -> w != ''), w -> xxhash64(w))")


def _draws(k: int) -> Column:
    """The draws of a copy of a term for samples 2k and 2k + 1 of its lane: the halves of one hash."""
    return F.xxhash64(F.col("_x").bitwiseXOR(F.shiftleft(F.col("_lane") * (LANE // 2) + k, 48)))


def sampled(weights: DataFrame, keys: list[str], columns: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """`weights`: rows of keys, `_t` (a term's hash) and columns of ln weight (null: absent). Gives a fingerprint per named column."""
    number = {name: F.coalesce(F.round(F.exp(w)).cast("int"), F.lit(0)) for name, w in columns.items()}
    counted = weights.select(*keys, "_t", *(n.alias(name) for name, n in number.items()))
    return drawn(counted, keys, list(columns), samples)


def drawn(counts: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """`counts`: rows of keys, `_t` (a term's hash) and columns of whole weights (0: absent). Gives a fingerprint per column.

    A row draws `LANE` samples; further samples are lanes of their own, so that the compiled loop stays short.
    """
    lanes = -(-samples // LANE)
    most = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    copies = counts.withColumn("_copy", F.explode(F.sequence(F.lit(1), most))).withColumn("_x", F.xxhash64("_t", "_copy"))
    kept = copies.withColumn("_lane", F.explode(F.array(*(F.lit(i).cast("long") for i in range(lanes)))))
    kept = kept.withColumns({f"_h{k}": _draws(k) for k in range(LANE // 2)})
    # unsigned halves as numbers: the high one by an unsigned shift, the low one by a mask
    halves = [part for k in range(LANE // 2) for part in (F.shiftrightunsigned(f"_h{k}", 32), F.col(f"_h{k}").bitwiseAND(F.lit(HALF)))]
    least = [F.min(F.when(F.col("_copy") <= F.col(name), half)).alias(f"{name}_{k}") for name in columns for k, half in enumerate(halves)]
    found = kept.groupBy(*keys, "_lane").agg(*least)
    code = lambda c: F.lpad(F.lower(F.hex(F.coalesce(F.col(c), F.lit(0)))), 8, "0")
    rows = found.select(*keys, "_lane", *(F.concat(*(code(f"{name}_{k}") for k in range(LANE))).alias(name) for name in columns))
    lane = lambda name, i: F.max(F.when(F.col("_lane") == i, F.col(name)))
    return rows.groupBy(*keys).agg(*(F.substring(F.concat(*(lane(name, i) for i in range(lanes))), 1, 8 * samples).alias(name) for name in columns))


def likeness(a: str, b: str, samples: int = SAMPLES, width: int = 8) -> Column:
    """Share of the first `samples` samples, `width` characters or bytes each, that two fingerprints have in common."""
    same = f"substring({a}, {width} * k + 1, {width}) = substring({b}, {width} * k + 1, {width})"
    return F.expr(f"aggregate(sequence(0, {samples - 1}), 0, (n, k) -> n + if({same}, 1, 0))") / F.lit(float(samples))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per document n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    least = Window.partitionBy("_k").orderBy("text")
    joined = with_next(docs, key, text).withColumn("_row", F.row_number().over(least)).withColumn("_edited", edited())
    # both uses of `joined` read the same columns of its two exchanges, which then run once
    hashed = joined.select("_k", "_row", "next_k", terms("text").alias("_a"), terms("_edited").alias("_b"))
    pairs = "transform({0}, (x, i) -> struct(xxhash64(x, get({0}, i + 1)) AS t, {1} AS a, {2} AS b))"
    # a document's rows are already in one place: neither the counts nor the minima move
    rows = hashed.select("_k", "_row", "next_k", F.explode(F.expr(f"concat({pairs.format('_a', 1, 0)}, {pairs.format('_b', 0, 1)})")).alias("_p"))
    ids = ["_k", "_row", "next_k"]
    counts = rows.groupBy(*ids, F.col("_p.t").alias("_t")).agg(F.sum("_p.a").alias("_a"), F.sum("_p.b").alias("_b"))
    found = drawn(counts.select(*ids, "_t", F.col("_a").cast("int").alias("_own"), F.col("_b").cast("int").alias("_theirs")), ids, ["_own", "_theirs"], samples)
    # bytes on the way, digits in the result
    found = found.select(*ids, *(F.unhex(c).alias(c) for c in ("_own", "_theirs")))
    none = F.unhex(F.lit("0" * 8 * samples))
    own = joined.select(*ids, "n_chars", F.unhex(F.sha2("_edited", 256)).alias("_sha")).join(found, ids, "left")
    own = own.withColumns({c: F.coalesce(c, none) for c in ("_own", "_theirs")})
    own = stored(own.withColumn("near_edited", likeness("_own", "_theirs", samples, 4)), "fingerprints")
    following = own.where("_row = 1").select(F.col("_k").alias("next_k"), F.col("_own").alias("_following"))
    out = own.join(following, "next_k").withColumn("near_next", likeness("_own", "_following", samples, 4))
    shown = F.when(F.col("_k") != LOWEST, F.col("_k")).alias(key)
    digits = lambda c: F.lower(F.hex(c))
    prints = [digits("_own").alias("fingerprint"), digits("_theirs").alias("edited_fingerprint"), "near_edited", "near_next"]
    return out.select(shown, "n_chars", digits("_sha").alias("edited_sha256"), *prints)
