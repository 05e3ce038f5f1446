"""The streaming twins, run over the shared tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import runtime
from colloquy.sources import adapters
from colloquy.streaming import live
from colloquy.suite.registry import query
from colloquy.suite.scoring import _LOG


def _events(spark, sf) -> DataFrame:
    schema = adapters.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("streaming_minute_counts", f"""WITH {_LOG} SELECT ts // 60000 * 60000 AS minute, count(*) FILTER (WHERE kind = 'recall') AS recalls,
 coalesce(sum(turns) FILTER (WHERE kind = 'ingest'), 0)::BIGINT AS ingested, count(*) FILTER (WHERE kind = 'error') AS errors,
 max(duration_ms) FILTER (WHERE kind = 'recall') AS max_ms FROM g GROUP BY 1""")
def _(spark, sf):
    kind = F.when(F.col("event_type").isin("view", "click"), "recall").when(F.col("event_type") == "error", "error").otherwise("ingest")
    log = _events(spark, sf).select(
        runtime.ms_of("ts").alias("ts"), kind.alias("kind"), F.col("value").alias("duration_ms"), F.col("user_id").alias("turns")
    )
    return live.run_to_table(live.minute_counts(log), ["minute"], runtime.work_folder(spark, "minutes"))


@query("streaming_gap_windows", """WITH t AS (SELECT 'u'||user_id AS session_id, epoch_us(ts)//1000 AS ts, event_id FROM events),
 g AS (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prev FROM t),
 r AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
 SELECT session_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS turns, ceil(count(*) / 50)::BIGINT AS parts FROM r GROUP BY session_id, run
 HAVING max(ts) + 1800000 <= (SELECT max(ts) FROM t)""")
def _(spark, sf):
    turns = _events(spark, sf).select(F.concat(F.lit("u"), "user_id").alias("session_id"), runtime.ms_of("ts").alias("ts"))
    return live.run_to_table(live.gap_windows(turns, "0 seconds"), ["session_id", "start_ts"], runtime.work_folder(spark, "gaps"), "append")


@query("streaming_distinct", "SELECT 'k'||user_id AS uuid, 1 AS n FROM events GROUP BY user_id")
def _(spark, sf):
    """One row per user however often its events repeat inside the delay."""
    rows = _events(spark, sf).select(F.concat(F.lit("k"), "user_id").alias("uuid"), runtime.ms_of("ts").alias("ts"))
    folder = runtime.work_folder(spark, "distinct")
    out = live.distinct_in_flight(rows, "60 days")

    def each(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    live._available(out, each, f"{folder}/state")
    return spark.read.parquet(f"{folder}/rows").groupBy("uuid").agg(F.count(F.lit(1)).alias("n"))


@query("streaming_ingest")
def _(spark, sf):
    """The conversations absorbed from files, batch after batch, and the tables that result."""
    folder = runtime.work_folder(spark, "ingest")
    adapters.conversation_turns(spark, sf).select("session_id", "speaker", "text", "ts", "uuid", "scope").repartition(3, "uuid").write.json(
        f"{folder}/in"
    )
    store = live.ingest_files(spark, f"{folder}/in", f"{folder}/store", f"{folder}/state", adapters.ORIGIN_MS, 1)
    rows = F.count(F.lit(1))
    segments = store.segments()
    return store.turns().agg(rows.alias("turns")).withColumns(
        {
            "entities": store.stats().agg(rows.alias("n")).scalar(), "edges": store.edges().agg(rows.alias("n")).scalar(),
            "windows": segments.where("level = 'window'").agg(rows.alias("n")).scalar(),
            "episodes": segments.where("level = 'episode'").agg(rows.alias("n")).scalar(),
        }
    )
