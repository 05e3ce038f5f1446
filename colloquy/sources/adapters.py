"""The shared parquet tables read in the roles the operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.runtime import ms_of

ORIGIN_MS = 1_736_154_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Dialogue as turns; residues 3 and 4 of the conversation number pause long enough to split windows."""
    c, t = F.col("conv_id"), F.col("turn")
    ts = F.lit(ORIGIN_MS) + c * 3_600_000 + t * (60_000 + (c % 5) * 600_000)
    return table(spark, sf, "conversations").select(
        (c * 1000 + t).alias("id"),
        F.concat(F.lit("u"), c, F.lit("-"), t).alias("uuid"),
        F.concat(F.lit("c"), c).alias("session_id"),
        F.col("role").alias("speaker"),
        "text",
        ts.alias("ts"),
        ts.alias("created_at"),
        F.lit("turn").alias("kind"),
        F.when(c % 3 == 0, "").otherwise(F.concat(F.lit("project:"), c % 3)).alias("scope"),
    )


def document_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Long turns: one session per source."""
    d = F.col("doc_id")
    ts = F.lit(ORIGIN_MS) + d * 700_000
    return table(spark, sf, "documents").select(
        d.alias("id"),
        F.concat(F.lit("d"), d).alias("uuid"),
        F.col("source").alias("session_id"),
        F.col("lang").alias("speaker"),
        "text",
        ts.alias("ts"),
        ts.alias("created_at"),
        F.lit("turn").alias("kind"),
        F.lit("").alias("scope"),
    )


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Each passage asked whole, its blanks collapsed."""
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("query")
    )


def event_turns(spark: SparkSession, sf: str, session: Column | None = None) -> DataFrame:
    """Events as turns with two keys each: the event type and its `k`."""
    user = F.col("user_id") % 5 if session is None else session
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("s"), user).alias("session_id"),
        ms_of("ts").alias("ts"),
        F.array_sort(
            F.array(F.col("event_type"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")))
        ).alias("keys"),
    )


def event_actions(spark: SparkSession, sf: str) -> DataFrame:
    """An action log: the event type picks the op, the user and its neighbour the turns acted on."""
    e, u = F.col("event_id"), F.col("user_id")
    op = (
        F.when(F.col("event_type") == "click", "hide").when(F.col("event_type") == "view", "supersede")
        .when(F.col("event_type") == "purchase", "unhide").when(F.col("event_type") == "error", "alias")
        .otherwise("run_end")
    )
    ms = ms_of("ts")
    turns = F.array(F.concat(F.lit("t"), u), F.concat(F.lit("t"), u + 1))
    none = F.lit(None).cast("string")
    return table(spark, sf, "events").select(
        e.alias("id"),
        F.concat(F.lit("r"), u % 20).alias("run_id"),
        F.concat(F.lit("a"), u % 3).alias("actor"),
        ms.alias("ts"),
        op.alias("op"),
        F.struct(
            F.when(op.isin("hide", "unhide", "supersede"), turns).alias("turns"),
            F.when(op == "supersede", F.concat(F.lit("t"), u + 2 + e % 3)).alias("by"),
            F.when(op == "alias", F.concat(F.lit("k"), u)).alias("alias"),
            F.when(op == "alias", F.concat(F.lit("k"), u + 100)).alias("canonical"),
            none.alias("entity"), none.alias("session_id"), none.alias("scope"), none.alias("note"),
            none.alias("brief"), none.alias("previous"), F.lit(None).cast("array<string>").alias("sources"),
            F.when(op == "run_end", F.concat(F.lit("end "), e)).alias("summary"),
            F.when(op == "run_end", e * 10).alias("cursor"),
        ).alias("payload"),
        F.lit("from the event log").alias("reason"),
        F.when(F.col("value") > 40, ms + 1000).alias("undone_at"),
        F.when(F.col("value") > 40, "a9").alias("undone_by"),
    )
