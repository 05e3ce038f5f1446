"""The inverted index and BM25 over batches of questions.

The index is a table on disk: postings dealt to buckets by the hash of their term, one folder per bucket, files sorted by term; beside it the document
frequency of every term and one row with the number of turns and their mean length. A batch of questions reads the buckets of its own vocabulary: the
join with the vocabulary prunes the other folders at run time, before a file is opened.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import runtime
from colloquy import schema as sc
from colloquy.functions import lexicon as lx
from colloquy.functions import porter, text
from colloquy.functions.embed import light_stem
from colloquy.functions.mentions import without_technical
from colloquy.functions.slices import in_slices
from colloquy.operators import clustered, shared
from colloquy.operators.ordered import top_n

_POSTINGS = T.ArrayType(sc.struct(term=T.StringType(), positions=T.ArrayType(T.IntegerType())))
ANALYZERS = {"porter": porter.porter_terms, "light": text.index_terms}
#: What a question may see is decided by these columns of a turn.
SEEN_BY = ("session_id", "ts", "scope")


def _grouped(rows: list[list[str]]) -> pa.Array:
    """Terms of each turn with the positions they occur at, built column by column."""
    terms, places, turn_ends, place_ends = [], [], [0], [0]
    for row in rows:
        at: dict[str, list[int]] = {}
        for i, t in enumerate(row):
            at.setdefault(t, []).append(i)
        terms.extend(at)
        for p in at.values():
            places.extend(p)
            place_ends.append(len(places))
        turn_ends.append(len(terms))
    positions = pa.ListArray.from_arrays(pa.array(place_ends, pa.int32()), pa.array(places, pa.int32()))
    items = pa.StructArray.from_arrays([pa.array(terms, pa.string()), positions], names=["term", "positions"])
    return pa.ListArray.from_arrays(pa.array(turn_ends, pa.int32()), items)


@F.arrow_udf(_POSTINGS)
def _positions(terms: pa.Array) -> pa.Array:
    return in_slices(lambda part: _grouped([row or [] for row in part.to_pylist()]), terms)


@F.arrow_udf(_POSTINGS)
def _porter_positions(texts: pa.Array) -> pa.Array:
    return in_slices(lambda part: _grouped([porter.terms(t or "") for t in part.to_pylist()]), texts)


def with_postings(turns: DataFrame, analyzer: str = "porter", column: str = "text") -> DataFrame:
    """Adds `dl` (terms in the turn) and `postings` (term and its positions). Narrow."""
    source = F.col(column)
    rows = turns.withColumn("postings", _porter_positions(source) if analyzer == "porter" else _positions(ANALYZERS[analyzer](source)))
    return rows.withColumn("dl", F.aggregate("postings", F.lit(0), lambda n, p: n + F.size(p["positions"])))


def postings(entries: DataFrame, *carry: str) -> DataFrame:
    """One row per (turn, term) with the turn's `carry` columns beside it."""
    # An inner explode would have the planner ask for texts with postings beneath the shuffle that deals texts out, and make all postings twice.
    return entries.select("id", "dl", *carry, F.explode_outer("postings").alias("p")).where("p IS NOT NULL").select(
        "id", "dl", *carry, "p.term", "p.positions"
    )


def text_size(turns: DataFrame) -> tuple[int, int]:
    """The number of turns and the bytes of their texts."""
    n, size = turns.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return n, size or 0


@dataclass(frozen=True)
class Index:
    """`rows`: bucket, term, id, dl, positions and the columns of `SEEN_BY` there are; `terms`: bucket, term, df."""

    rows: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    buckets: int
    analyzer: str


def _postings_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([f for f in rows.schema.fields if f.name != "bucket"] + [T.StructField("bucket", T.IntegerType())])


#: Bytes of text per posting, about.
POSTING_BYTES = 12


def write_index(
    entries: DataFrame, path: str, analyzer: str = "porter", bucket_postings: int = clustered.BUCKET_ROWS, size: tuple[int, int] | None = None
) -> Index:
    """Write the postings of `entries` (as `with_postings` leaves them) under `path`.

    With `size`, the number of turns and the bytes of their texts, entries are read once and need not be kept: postings go to the table as they are made.
    """
    spark = entries.sparkSession
    if size is None:
        n, length, count = entries.agg(F.count(F.lit(1)), F.sum("dl"), F.sum(F.size("postings"))).first()
    else:
        n, length, count = size[0], None, size[1] // POSTING_BYTES
    buckets = clustered.buckets_for(count or 0, bucket_postings)
    carry = [c for c in SEEN_BY if c in entries.columns]
    rows = postings(entries, *carry).withColumn("bucket", clustered.bucket_of(F.col("term"), buckets))
    clustered.write(rows, f"{path}/postings", "term", "id", about=count or 0)
    stored = spark.read.schema(_postings_schema(rows)).parquet(f"{path}/postings")
    if size is not None:
        length = stored.agg(F.sum(F.size("positions"))).first()[0]
    clustered.write(stored.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")), f"{path}/terms", "term")
    told = spark.range(1).select(*[F.lit(v).cast(t).alias(k) for k, v, t in (
        ("n", n, "long"), ("avgdl", (length or 0) / n if n else 0.0, "double"), ("buckets", buckets, "int"), ("analyzer", analyzer, "string"), ("carry", ",".join(carry), "string"))])
    told.write.mode("overwrite").parquet(f"{path}/size")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    size = spark.read.parquet(f"{path}/size").first()
    kinds = {"session_id": "string", "ts": "long", "scope": "string"}
    carry = "".join(f", {c} {kinds[c]}" for c in size["carry"].split(",") if c)
    rows = spark.read.schema(f"id long, dl int{carry}, term string, positions array<int>, bucket int").parquet(f"{path}/postings")
    terms = spark.read.schema("term string, df long, bucket int").parquet(f"{path}/terms")
    return Index(rows, terms, size["n"], size["avgdl"], size["buckets"], size["analyzer"])


def family_stems() -> list[str]:
    return sorted({light_stem(m) for m in lx.PREDICATE_FAMILY if " " not in m})


def search_phrases(tokens: Column) -> Column:
    """What to look up for a question's tokens: themselves, plus the relation words one of them opens."""
    opens = F.exists(tokens, lambda t: text.stem_normalised(t).isin(family_stems()))
    family = F.array(*[F.lit(m) for m in lx.PREDICATE_FAMILY])
    return F.when(opens, F.array_union(tokens, family)).otherwise(F.array_distinct(tokens))


def numbered(df: DataFrame, column: str, number: str, bound: int | None) -> DataFrame:
    """A short number per distinct value, so that the joins that follow move integers. Large sets keep the value."""
    if bound is None or runtime.crowded(bound):
        return df.withColumn(number, F.col(column))
    return df.withColumn(number, F.dense_rank().over(Window.orderBy(column)))


def _phrase_runs(hits: DataFrame, carry: list[str]) -> DataFrame:
    """`(id, pn, tf)` of every phrase of several terms that occurs in a turn: its terms' postings meet by turn and phrase."""
    parts = F.array_sort(F.collect_list(F.struct("idx", "positions")))
    runs = hits.groupBy("id", "dl", *carry, "pn", "m").agg(parts.alias("parts")).where(F.size("parts") == F.col("m"))
    starts = F.filter(
        F.col("parts")[0]["positions"],
        lambda p: F.forall("parts", lambda part: F.array_contains(part["positions"], p + part["idx"])),
    )
    return runs.select("id", "dl", *carry, "pn", F.size(starts).alias("tf")).where("tf > 0")


def bm25(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    """Contribution of one phrase to one turn, with the full-text engine's public defaults."""
    raw = F.ln((n - df + 0.5) / (df + 0.5))
    idf = F.when(raw <= 0, F.lit(sc.BM25_IDF_FLOOR)).otherwise(raw)
    return idf * tf * (sc.BM25_K1 + 1) / (tf + sc.BM25_K1 * (1 - sc.BM25_B + sc.BM25_B * dl / avgdl))


def lexical_top(
    index: Index, asked: DataFrame, *, limit: int = sc.VIEW_LIMIT, reach: Column | None = None, carry: list[str] | None = None,
    options: list[str] | None = None, marks: DataFrame | None = None, bound: int | None = None, key: str = "query_id",
    questions: int | None = None,
) -> DataFrame:
    """BM25 top turns per question: `key, id, score, rank`. `asked` holds `key, phrases`.

    Term and turn counts are over all indexed rows; `reach` over the `carry` columns (and `hidden`, where `marks` tells the hidden turns) then
    says what a question may see, before the cut. A phrase of one term is weighed as its posting is read, with the stored document frequency. Questions share
    the work on a phrase: it is matched and weighed once per turn, however many ask for it. `bound` limits the phrases of the whole batch, and
    `questions` its questions, when known; a batch too large to broadcast meets the turns in blocks.
    """
    carry, options = carry or [], options or []
    small = lambda df: runtime.small_side(df, bound=bound)
    wanted = asked.select(key, *options, F.explode("phrases").alias("phrase"))
    phrases = numbered(wanted.select("phrase").distinct(), "phrase", "pn", bound)
    analysed = phrases.withColumn("terms", ANALYZERS[index.analyzer](F.col("phrase")))
    vocabulary = analysed.select("pn", F.size("terms").alias("m"), F.posexplode("terms").alias("idx", "term"))
    known = clustered.lookup(index.terms, vocabulary, "term", index.buckets, bound)

    def read(some: str) -> DataFrame:
        return clustered.lookup(index.rows, known.where(some), "term", index.buckets, bound).drop("term")

    weight = bm25(F.col("tf"), F.col("dl"), F.col("df"), F.lit(index.n), F.lit(index.avgdl))
    one = read("m = 1").withColumn("tf", F.size("positions")).select("id", *carry, "pn", weight.alias("w"))
    many = _phrase_runs(runtime.place(read("m > 1"), "id"), carry)
    spread = many.groupBy("pn").agg(F.count(F.lit(1)).alias("df"))
    weighed = one.unionByName(many.join(small(spread), "pn").select("id", *carry, "pn", weight.alias("w")))
    if marks is not None:
        weighed = weighed.join(runtime.small_side(marks), "id", "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))
    if reach is None and runtime.crowded(bound):
        # nothing narrows what is seen, so a turn's words meet the questions where both are, and only the best leave
        best = shared.top_shared(
            weighed.select("id", F.col("pn").alias("word"), "w"), wanted.select(key, F.col("phrase").alias("word")), limit,
            turns=index.n, questions=questions or bound, key=key,
        )
        return top_n(best, [key], [F.col("score").desc(), F.col("id").desc()], limit)
    per_query = wanted.join(small(phrases), "phrase").drop("phrase")
    # placed by turn before questions multiply the rows; sums per question and turn stay in that placement
    pairs = runtime.place(weighed, "id").join(small(per_query), "pn")
    if reach is not None:
        pairs = pairs.where(reach)
    scored = pairs.groupBy(key, "id").agg(F.round(F.sum("w"), 9).alias("score"))
    return top_n(scored, [key], [F.col("score").desc(), F.col("id").desc()], limit)


# --- words a turn holds ----------------------------------------------------------------------------------
def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _related(stems: Column) -> Column:
    """Whether a run of stems is one of the relation words."""
    runs = sorted({" ".join(light_stem(w) for w in m.split()) for m in lx.PREDICATE_FAMILY})
    line = F.concat(F.lit(" "), F.array_join(stems, " "), F.lit(" "))
    found = F.arrays_overlap(stems, F.array(*[F.lit(r) for r in runs if " " not in r]))
    for run in runs:
        if " " in run:
            found = found | F.contains(line, F.lit(f" {run} "))
    return F.coalesce(found, F.lit(False))


def _said(source: Column) -> Column:
    stems = F.transform(text.normalised_words(source), text.stem_normalised)
    return F.transform(F.array(stems), lambda s: F.struct(F.array_distinct(_hashes(s)).alias("stems"), _related(s).alias("family")))[0]


def word_hashes(whole: Column) -> Column:
    """Hashes of the distinct words of a text."""
    return F.array_distinct(_hashes(F.array_distinct(text.normalised_words(whole))))


def with_words(turns: DataFrame) -> DataFrame:
    """Adds what questions look for in a turn, read once: `words` (hashes of its distinct words), `said` (hashes of its stems, and whether a relation word
    occurs), and `plain`, the same outside paths, symbols and env vars where `m` holds any of these. Narrow."""
    technical = F.exists("m", lambda x: x["kind"].isin("env", "path", "symbol"))
    rows = turns.withColumns({"_t": technical, "_bare": without_technical(F.when(technical, F.col("text")))})
    whole = F.coalesce("text", F.lit(""))
    return rows.withColumns({"words": word_hashes(whole), "said": _said(whole), "plain": F.when(F.col("_t"), _said(F.col("_bare")))}).drop("_t", "_bare")


def asked_stems(tokens: Column) -> Column:
    """A question's tokens as `coverage` counts them: hashes of their stems, those of tokens that share one, the number of relation words."""
    stems = F.transform(tokens, text.stem_normalised)
    related = lambda s: s.isin(family_stems())
    plain = F.transform(F.array(_hashes(F.filter(stems, lambda s: ~related(s)))), lambda h: F.struct(
        F.array_distinct(h).alias("stems"), F.filter(h, lambda x, i: F.array_position(h, x) <= i).alias("again")))[0]
    return F.struct(plain["stems"].alias("stems"), plain["again"].alias("again"), F.size(F.filter(stems, related)).alias("related"))


def coverage(asks: Column, said: Column) -> Column:
    """How many of a question's words (`asked_stems`) a turn holds; a relation word counts by any member of its family."""
    again = F.filter(asks["again"], lambda x: F.array_contains(said["stems"], x))
    return F.size(F.array_intersect(said["stems"], asks["stems"])) + F.size(again) + F.when(said["family"], asks["related"]).otherwise(0)
