"""Incremental upkeep: turns arrive as files, derived tables follow, and every batch can be replayed.

A store is a folder of parquet tables partitioned by `batch`. A micro-batch writes only its own partition, in
overwrite mode, so a batch that is run again after a failure replaces what it left behind.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy import runtime
from colloquy import schema as sc
from colloquy.functions.embed import EmbedFn, embed, hash_embed_fn
from colloquy.functions.mentions import extract_mentions
from colloquy.operators import graph, ingest, timeline


@dataclass
class Store:
    """The tables of one store under `root`."""

    spark: SparkSession
    root: str

    def _read(self, name: str, before: int | None = None) -> DataFrame | None:
        try:
            df = self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as missing:  # a table that no batch has written yet; anything else is a fault of the store
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return df if before is None else df.where(F.col("batch") < before)

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def turns(self, before: int | None = None) -> DataFrame | None:
        found = self._read("turns", before)
        return None if found is None else found.drop("batch")

    def mentions(self) -> DataFrame:
        return self._read("mentions").drop("batch")

    def stats(self) -> DataFrame:
        """Per-batch partials merged; counts add up because a turn is stored in one batch only."""
        return self._read("stats").groupBy("entity").agg(
            F.sum("turns").alias("turns"), F.min("kind").alias("kind"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
        )

    def edges(self) -> DataFrame:
        return self._read("edges").groupBy("a", "b").agg(F.sum("turns").alias("turns"))

    def segments(self) -> DataFrame:
        """Each session as the last batch that touched it left it."""
        rows = self._read("segments")
        newest = rows.groupBy("session_id").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["session_id", "batch"]).drop("batch")

    def vectors(self, model: str) -> DataFrame | None:
        found = self._read("vectors")
        return None if found is None else found.drop("batch").where(F.col("model") == model)

    def absorb(self, inputs: DataFrame, batch: int, now_ms: int) -> None:
        """One micro-batch: new turns, their mentions and partial aggregates, and the sessions they touch."""
        arrived = inputs.withColumn("seq", F.monotonically_increasing_id())
        done = ingest.ingest(arrived, self.turns(batch), now_ms)
        self._write(done.turns, "turns", batch)
        fresh = self.spark.read.schema(sc.TURN).parquet(f"{self.root}/turns/batch={batch}")
        self._write(extract_mentions(runtime.spread_scan(fresh)), "mentions", batch)
        found = self.spark.read.schema(sc.MENTIONS).parquet(f"{self.root}/mentions/batch={batch}")
        self._write(graph.entity_stats(found, fresh), "stats", batch)
        self._write(graph.edges(found), "edges", batch)
        # A late turn changes its session's windows, so touched sessions are segmented again in full.
        touched = runtime.small_side(fresh.select("session_id").distinct())
        mine = self._read("turns").where(F.col("batch") <= batch).join(touched, "session_id", "left_semi")
        said = self._read("mentions").where(F.col("batch") <= batch).join(
            mine.select(F.col("id").alias("turn_id")), "turn_id", "left_semi"
        )
        self._write(timeline.segments(timeline.turn_keys(mine, said)), "segments", batch)

    def embed_batch(self, turns: DataFrame, batch: int, embed_fn: EmbedFn, model: str) -> None:
        have = self._read("vectors")
        todo = turns.select("id", "text")
        if have is not None:
            done = have.where((F.col("model") == model) & (F.col("batch") < batch)).select("id")
            todo = todo.join(done, "id", "left_anti")
        self._write(embed(todo, embed_fn).select("id", "vec", F.lit(model).alias("model")), "vectors", batch)


def _available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    )
    query.awaitTermination()
    return query


def ingest_files(spark: SparkSession, source: str, root: str, checkpoint: str, now_ms: int, files_per_batch: int | None = None) -> Store:
    """Absorb the JSONL files that have arrived under `source`; run again for the ones that arrive later."""
    store = Store(spark, root)
    reader = spark.readStream.schema(sc.TURN_INPUT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    _available(reader.json(source), lambda df, batch: store.absorb(df, batch, now_ms), checkpoint)
    return store


def drain_backlog(store: Store, checkpoint: str, embed_fn: EmbedFn = hash_embed_fn, model: str = "hash-384") -> None:
    """Embed every stored turn that has no vector yet."""
    turns = store.spark.readStream.schema("id long, text string, batch int").parquet(f"{store.root}/turns")
    _available(turns, lambda df, batch: store.embed_batch(df, batch, embed_fn, model), checkpoint)


def distinct_in_flight(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop re-sent turns inside the delay; the anti join against the store makes it exact."""
    return stream.withColumn("_at", F.timestamp_millis("ts")).withWatermark("_at", delay).dropDuplicatesWithinWatermark(["uuid"]).drop("_at")


def gap_windows(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Runs without a 30-minute silence, online: one row per session and run, with its size in fifty-turn parts.

    In append mode a run comes out once the watermark says it is closed.
    """
    at = F.timestamp_millis("ts")
    n = F.count(F.lit(1))
    return (
        stream.withColumn("at", at).withWatermark("at", delay)
        .groupBy("session_id", F.session_window("at", "30 minutes")).agg(
            F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), n.alias("turns"),
            F.ceil(n / sc.WINDOW_MAX_TURNS).cast("long").alias("parts"),
        ).drop("session_window")
    )


def minute_counts(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Operational counts per minute from an event stream of `ts, kind, duration_ms, turns`."""
    return (
        stream.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay).groupBy(F.window("at", "1 minute").alias("w")).agg(
            F.count_if(F.col("kind") == "recall").alias("recalls"),
            F.sum(F.when(F.col("kind") == "ingest", F.col("turns")).otherwise(0)).alias("ingested"),
            F.count_if(F.col("kind") == "error").alias("errors"),
            F.max(F.when(F.col("kind") == "recall", F.col("duration_ms"))).alias("max_ms"),
        ).select(F.unix_millis("w.start").alias("minute"), "recalls", "ingested", "errors", "max_ms")
    )


def run_to_table(stream: DataFrame, keys: list[str], folder: str, mode: str = "update") -> DataFrame:
    """Run a stream over what is available; the newest row per key is its result."""

    def each(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    _available(stream, each, f"{folder}/state", mode)
    rows = stream.sparkSession.read.parquet(f"{folder}/rows")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
