"""Operational figures from an event log of recalls, ingests and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ordered import Ordered
from colloquy.schema import MINUTE_MS

SERIES_MINUTES = 60


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: dict[str, int]) -> DataFrame:
    """Nearest-rank percentiles per group: the value at position ceil(p / 100 * n).

    Equal values are counted before anything is ordered, and the cumulative count is a sliced scan, so
    neither a hot group nor a hot value lands in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cumulated = Ordered.of(counts, keys, [value]).running_sum("_cum", F.col("_c")).done()
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = cumulated.join(sizes, keys) if keys else cumulated.withColumn("_n", sizes.scalar())

    def at(p: int) -> Column:
        need = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_n") / F.lit(100)))
        return F.min(F.when(F.col("_cum") >= need, F.col(value)))

    return joined.groupBy(*keys).agg(*[at(p).alias(name) for name, p in percents.items()])


def _minute(ts: Column) -> Column:
    return (F.floor(ts / F.lit(MINUTE_MS)) * MINUTE_MS).cast("long")


def minute_series(log: DataFrame, now_ms: Column, minutes: int = SERIES_MINUTES) -> DataFrame:
    """One row per minute of the last hour up to `now_ms`, empty minutes included.

    `log` carries `ts, kind (recall, ingest, error), duration_ms, turns`.
    """
    spark = log.sparkSession
    last = _minute(now_ms)
    spine = spark.range(minutes).select((last - F.col("id") * MINUTE_MS).alias("minute"))
    recent = log.withColumn("minute", _minute(F.col("ts"))).where(
        F.col("minute").between(last - (minutes - 1) * MINUTE_MS, last)
    )
    counts = recent.groupBy("minute").agg(
        F.count_if(F.col("kind") == "recall").alias("recalls"),
        F.sum(F.when(F.col("kind") == "ingest", F.col("turns")).otherwise(0)).alias("ingested"),
        F.count_if(F.col("kind") == "error").alias("errors"),
    )
    ranks = nearest_rank(recent.where("kind = 'recall'"), ["minute"], "duration_ms", {"p50_ms": 50, "p95_ms": 95})
    return spine.join(counts, "minute", "left").join(ranks, "minute", "left").fillna(
        0, ["recalls", "ingested", "errors"]
    )


def headline(log: DataFrame) -> DataFrame:
    """Counts, errors, percentiles and the maximum over the whole log, one row."""
    ranks = nearest_rank(log.where("kind = 'recall'"), [], "duration_ms", {"p50_ms": 50, "p95_ms": 95})
    counts = log.agg(
        F.count_if(F.col("kind") == "recall").alias("recalls"), F.count_if(F.col("kind") == "error").alias("errors"),
        F.max(F.when(F.col("kind") == "recall", F.col("duration_ms"))).alias("max_ms"),
        F.count_if(F.col("kind") == "ingest").alias("ingest_calls"),
        F.sum(F.when(F.col("kind") == "ingest", F.col("turns")).otherwise(0)).alias("ingest_turns"),
    )
    return counts.withColumns({p: ranks.select(p).scalar() for p in ("p50_ms", "p95_ms")})
