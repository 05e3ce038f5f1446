"""The temporal hierarchy: session, window, episode. A pure function of the turns in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import schema as sc
from colloquy.functions import text
from colloquy.operators.ordered import Ordered, top_n


def turn_keys(turns: DataFrame, mentions: DataFrame) -> DataFrame:
    """Turns with the distinct entity keys they mention; turns without any keep an empty array."""
    keys = mentions.groupBy("turn_id").agg(F.array_sort(F.collect_set("entity")).alias("keys"))
    return turns.join(keys.withColumnRenamed("turn_id", "id"), "id", "left").withColumn(
        "keys", F.coalesce("keys", F.array().cast("array<string>"))
    )


def window_numbers(turns: DataFrame, **split: int) -> DataFrame:
    """Adds `run` (stretch without a long silence) and `part` (its pieces of at most fifty turns)."""
    opened = F.col("_prev").isNull() | (F.col("ts") - F.col("_prev") > sc.WINDOW_GAP_MS)
    return (
        Ordered.of(turns, ["session_id"], ["ts", "id"], **split)
        .lag("_prev", "ts")
        .running_sum("run", F.when(opened, 1).otherwise(0).cast("long"))
        .rank("_rn")
        .running_max("_opened_at", F.when(opened, F.col("_rn")))
        .done()
        .withColumn("part", F.floor((F.col("_rn") - F.col("_opened_at")) / sc.WINDOW_MAX_TURNS).cast("long"))
        .drop("_prev", "_rn", "_opened_at")
    )


def _top_keys(counts: DataFrame, group: list[str]) -> DataFrame:
    best = top_n(counts, group, [F.col("n").desc(), F.col("entity").asc()], sc.SEGMENT_ENTITIES)
    listed = F.array_sort(F.collect_list(F.struct("rank", "entity")))
    return best.groupBy(*group).agg(F.transform(listed, lambda e: e["entity"]).alias("entities"))


def _bounds() -> list:
    at = F.struct("ts", "id")
    return [
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.min(at)["id"].alias("first_turn_id"),
        F.max(at)["id"].alias("last_turn_id"), F.count(F.lit(1)).alias("turns"),
    ]


def segments(keyed: DataFrame, **split: int) -> DataFrame:
    """Window and episode rows of turns that carry `id, session_id, ts, keys`."""
    win = ["session_id", "run", "part"]
    none = F.array().cast("array<string>")
    numbered = window_numbers(keyed.select("id", "session_id", "ts", "keys"), **split)
    key_counts = numbered.select(*win, F.explode("keys").alias("entity")).groupBy(*win, "entity").agg(
        F.count(F.lit(1)).alias("n")
    )
    windows = (
        numbered.groupBy(*win).agg(*_bounds()).join(_top_keys(key_counts, win), win, "left")
        .withColumn("entities", F.coalesce("entities", none))
    )
    changed = F.col("_before").isNotNull() & (
        text.jaccard(F.col("_before"), F.col("entities"), 1.0) < sc.EPISODE_MIN_OVERLAP
    )
    staged = (
        Ordered.of(windows, ["session_id"], ["run", "part"], **split).lag("_before", "entities")
        .running_sum("episode", F.when(changed, 1).otherwise(0).cast("long")).done().drop("_before")
    )
    ep = ["session_id", "episode"]
    first, last = F.struct("start_ts", "first_turn_id"), F.struct("end_ts", "last_turn_id")
    rows = staged.groupBy(*ep).agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"),
        F.min(first)["first_turn_id"].alias("first_turn_id"), F.max(last)["last_turn_id"].alias("last_turn_id"),
        F.sum("turns").alias("turns"),
    )
    ep_counts = key_counts.join(staged.select(*win, "episode"), win).groupBy(*ep, "entity").agg(F.sum("n").alias("n"))
    episodes = rows.join(_top_keys(ep_counts, ep), ep, "left").withColumn("entities", F.coalesce("entities", none))
    cols = ["session_id", "start_ts", "end_ts", "first_turn_id", "last_turn_id", "turns", "entities"]
    return staged.select(F.lit("window").alias("level"), *cols).unionByName(
        episodes.select(F.lit("episode").alias("level"), *cols)
    )
