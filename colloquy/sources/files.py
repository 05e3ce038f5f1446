"""Files in and out: turns, transcripts, nested benchmarks, corpora, ranked lists, recordings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import schema as sc
from colloquy.functions import dates
from colloquy.operators.ingest import SCOPE_MAX_CHARS, reject_reason
from colloquy.operators.ordered import Ordered, numbered

TURN_GAP_MS = 60_000


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """One turn per line; blank lines are skipped and any bad line fails the read."""
    return spark.read.schema(sc.TURN_INPUT).option("mode", "FAILFAST").json(path)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """`file, line (1-based), value`. Line numbers follow the file's own blocks, however the scan is split."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value",
    )
    return Ordered.of(raw, ["file"], ["_block", "_row"]).rank("line").done().drop("_block", "_row")


def read_turns_lenient(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good turns, and `file, line, reason` of every line that is not one."""
    corrupt = T.StructType([*sc.TURN_INPUT.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(F.col("value"), corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = _numbered_lines(spark, path).where(F.col("value").rlike(r"\S"))
    rows = lines.withColumns({"t": parsed, "_v": F.try_parse_json("value")})
    object_like = F.col("value").rlike(r"^\s*\{")
    reason = (
        F.when(F.col("_v").isNull(), "not JSON").when(~object_like, "(root): expected an object")
        .when(F.col("t._bad").isNotNull(), "a field has the wrong type")
        .otherwise(reject_reason(F.col("t.session_id"), F.col("t.speaker"), F.col("t.text")))
    )
    long_scope = F.when(F.length("t.scope") > SCOPE_MAX_CHARS, f"scope: at most {SCOPE_MAX_CHARS} characters")
    judged = rows.withColumn("reason", F.coalesce(reason, long_scope))
    turns = judged.where("reason IS NULL").select("file", "line", *[F.col(f"t.{f.name}").alias(f.name) for f in sc.TURN_INPUT.fields])
    return turns, judged.where("reason IS NOT NULL").select("file", "line", "reason")


def parse_transcript(lines: DataFrame, session_id: Column, scope: Column | None = None) -> DataFrame:
    """Agent-transcript lines (`value`) as turns: only what the user or the assistant said in words."""
    v = F.try_parse_json("value")
    blocks = F.try_variant_get("_c", "$", "array<variant>")
    said = F.filter(
        F.transform(
            blocks,
            lambda b: F.when(F.try_variant_get(b, "$.type", "string") == "text", F.try_variant_get(b, "$.text", "string")),
        ),
        lambda t: t.isNotNull(),
    )
    kind = F.schema_of_variant("_c")
    body = F.when(kind == "STRING", F.try_variant_get("_c", "$", "string")).when(
        kind.startswith("ARRAY") & (F.size(said) > 0), F.array_join(said, "\n\n")
    )
    own = scope if scope is not None else F.lit(None).cast("string")
    rows = lines.select("*", v.alias("_v")).withColumns(
        {"_kind": F.try_variant_get("_v", "$.type", "string"), "_c": F.try_variant_get("_v", "$.message.content", "variant")}
    )
    out = rows.where(F.col("_kind").isin("user", "assistant")).select(
        session_id.alias("session_id"), F.col("_kind").alias("speaker"), body.alias("text"),
        dates.rfc3339_ms(F.try_variant_get("_v", "$.timestamp", "string")).alias("ts"),
        F.try_variant_get("_v", "$.uuid", "string").alias("uuid"), own.alias("scope"),
    )
    return out.where(F.col("text").rlike(r"\S"))


def read_transcripts(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """Transcript files as turns, one session per file, named after it."""
    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_transcript(lines, stem, F.lit(scope) if scope is not None else None)


_ID = T.StringType()
QA_ITEM = T.StructType(
    [
        T.StructField("question_id", _ID), T.StructField("question_type", _ID), T.StructField("question", _ID),
        T.StructField("haystack_session_ids", T.ArrayType(_ID)), T.StructField("haystack_dates", T.ArrayType(_ID)),
        T.StructField("haystack_sessions", T.ArrayType(T.ArrayType(sc.MESSAGE))), T.StructField("answer_session_ids", T.ArrayType(_ID)),
    ]
)


@dataclass
class Corpus:
    turns: DataFrame
    queries: DataFrame
    probes: DataFrame | None = None
    report: DataFrame | None = None


def import_qa(items: DataFrame) -> Corpus:
    """A nested question file as one corpus: every session once, one labeled question per item.

    `items` follows `QA_ITEM` plus `n`, the item's place in the file.
    """
    asked = items.where("question IS NOT NULL").withColumns(
        {
            "id": F.coalesce(F.when(F.col("question_id") != "", F.col("question_id")), F.format_string("q%05d", "n")),
            "kind": F.coalesce(F.when(F.col("question_type") != "", F.col("question_type")), F.lit("unknown")),
        }
    )
    sessions = asked.select(
        "n", "id", "haystack_session_ids", "haystack_dates", F.posexplode("haystack_sessions").alias("s", "messages")
    ).select(
        "n", "s", F.col("id").alias("query_id"),
        F.coalesce(
            F.when(F.get("haystack_session_ids", "s") != "", F.get("haystack_session_ids", "s")), F.format_string("%s-s%03d", "id", "s")
        ).alias("session_id"),
        dates.loose_date_ms(F.get("haystack_dates", "s")).alias("start"), "messages",
    ).where("messages IS NOT NULL")
    place = F.struct("n", "s")
    first = sessions.groupBy("session_id").agg(F.min_by(F.struct("start", "messages"), place).alias("f"))
    stored = first.select(
        "session_id", F.coalesce("f.start", F.lit(0)).alias("start"), F.col("f.start").isNull().alias("undated"), F.col("f.messages").alias("messages")
    )
    turns = stored.select("session_id", "start", F.posexplode("messages").alias("t", "m")).where(F.col("m.content").rlike(r"\S")).select(
        "session_id", F.coalesce(F.when(F.col("m.role") != "", F.col("m.role")), F.lit("user")).alias("speaker"),
        F.col("m.content").alias("text"), (F.col("start") + F.col("t") * TURN_GAP_MS).alias("ts"),
        F.concat("session_id", F.lit("#"), "t").alias("uuid"),
    )
    marked = sessions.select("query_id", "session_id", F.posexplode("messages").alias("t", "m")).where("m.has_answer").select(
        "query_id", F.concat("session_id", F.lit("#"), "t").alias("uuid")
    ).join(turns.select("uuid"), "uuid", "left_semi").select("query_id", "uuid", F.lit(2).alias("grade"))
    answers = asked.select(F.col("id").alias("query_id"), F.posexplode("answer_session_ids").alias("pos", "session_id"))
    dated = answers.join(stored.select("session_id", "start"), "session_id", "left")
    latest = dated.groupBy("query_id").agg(F.max_by("session_id", F.struct(F.coalesce("start", F.lit(0)), "pos")).alias("latest_session_id"))
    by_session = answers.join(turns.select("session_id", "uuid"), "session_id").join(
        marked.select("query_id").distinct(), "query_id", "left_anti"
    ).select("query_id", "uuid", F.lit(1).alias("grade"))
    relevant = marked.unionByName(by_session).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("uuid", "grade"))).alias("relevant"), F.max("grade").alias("_g")
    ).withColumnRenamed("query_id", "id")
    refusal = F.col("id").endswith("_abs")
    labeled = asked.select("n", "id", "kind", F.col("question").alias("query")).join(relevant, "id", "left").join(
        latest.withColumnRenamed("query_id", "id"), "id", "left"
    )
    none = F.array().cast(T.ArrayType(sc.RELEVANCE))
    queries = labeled.where(~refusal & F.col("relevant").isNotNull()).select(
        "id", "kind", "query", F.coalesce("latest_session_id", F.lit("")).alias("latest_session_id"), "relevant", F.lit("current").alias("ask")
    )
    probes = labeled.where(refusal).select(
        "id", "kind", "query", F.lit("").alias("latest_session_id"), none.alias("relevant"), F.lit("abstain").alias("ask")
    )
    rows = F.count(F.lit(1))
    report = labeled.agg(
        rows.alias("questions"), F.count_if(refusal).alias("abstain"), F.count_if(~refusal & (F.col("_g") == 2)).alias("labeled_by_turn"),
        F.count_if(~refusal & (F.col("_g") == 1)).alias("labeled_by_session"), F.count_if(~refusal & F.col("_g").isNull()).alias("unlabeled"),
    ).withColumns(
        {
            "turns": turns.agg(rows.alias("n")).scalar(), "sessions": stored.agg(rows.alias("n")).scalar(),
            "undated_sessions": stored.agg(F.count_if("undated").alias("n")).scalar(),
        }
    )
    return Corpus(turns, queries, probes, report)


def read_qa(spark: SparkSession, path: str, per_line: bool = False) -> Corpus:
    """A JSON array of questions, which one task reads; `per_line` takes one question a line instead, split at will."""
    return import_qa(numbered(spark.read.schema(QA_ITEM).option("multiLine", not per_line).json(path), "n"))


def read_corpus(spark: SparkSession, folder: str) -> Corpus:
    """`turns.jsonl`, `queries.jsonl` and, when there, `probes.jsonl`."""
    def labeled(name: str) -> DataFrame:
        rows = spark.read.schema(sc.LABELED_QUERY).option("mode", "FAILFAST").json(f"{folder}/{name}")
        return rows.withColumn("ask", F.coalesce("ask", F.lit("current")))

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/probes.jsonl")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return Corpus(read_turns(spark, f"{folder}/turns.jsonl"), labeled("queries.jsonl"), labeled("probes.jsonl") if there else None)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One document per line."""
    df.write.mode(mode).json(path)


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(sc.RANKED).json(path)


def read_eval_history(spark: SparkSession, path: str) -> DataFrame:
    """Recordings; lines that are comments or not recordings are skipped."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S") & ~F.ltrim("value").startswith("#"))
    rows = lines.select(F.from_json("value", sc.EVAL_RUN, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.where("recorded_at IS NOT NULL AND commit IS NOT NULL AND profile IS NOT NULL AND embedder IS NOT NULL")
