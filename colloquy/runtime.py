"""Session settings, size checks and lineage cuts used by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its derived bound proves it is below this.
BROADCAST_ROWS = 500_000
#: Rows of a partition whose texts are blown up into postings, words or vectors.
TEXT_ROWS = 4_096
#: A group above this many rows is split over several tasks.
HOT_GROUP_ROWS = 2_000_000


def local_session(cores: str | int = "*", app: str = "colloquy", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("COLLOQUY_DRIVER_MEMORY", "12g"),
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, bound: int | None = None) -> DataFrame:
    """Hint a broadcast when `bound`, a limit on the rows that the caller has derived, proves the side small.

    Without a bound the planner decides, and once more at run time by the bytes that were really shuffled. Estimates are of
    compressed files and prove nothing.
    """
    return F.broadcast(df) if bound is not None and bound <= rows else df


def crowded(bound: int | None) -> bool:
    """Whether the caller's own count says that a side is too large to broadcast."""
    return bound is not None and bound > BROADCAST_ROWS


def has_hot_group(df: DataFrame, keys: list[str], rows: int | None = None) -> bool:
    """Whether one value of `keys` holds more than `rows` rows; a table of fewer rows than that holds none."""
    rows = HOT_GROUP_ROWS if rows is None else rows
    narrow = df.select(*keys) if keys else df.select(F.lit(1).alias("_one"))
    if narrow.limit(rows + 1).count() <= rows:
        return False
    if not keys:
        return True
    return not narrow.groupBy(*keys).count().where(F.col("count") > rows).isEmpty()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`; a local session may make its own."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage on the shared folder. Reliable: it outlives the executor that wrote it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run's tables on the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread_scan(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Deal rows out to every core before per-row text work; no look at the plan, which could start a job.

    With `rows`, a partition holds about that many, so that what is made of the texts and kept grows in number of partitions, not in their size;
    this counts the table.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        parts = max(parts, -(-df.count() // rows))
    return df.repartition(parts) if len(df.inputFiles()) < parts else df


def place(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Hash-place rows that are about to multiply. A fixed count keeps adaptive coalescing from judging by input bytes.

    With `rows`, a partition holds about that many at most; this counts the table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        parts = max(parts, df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, *keys)


def ms_of(column: Column | str) -> Column:
    """Milliseconds since the epoch of a timestamp column, NTZ read as UTC."""
    col = F.col(column) if isinstance(column, str) else column
    return F.floor(F.unix_micros(col.cast("timestamp")) / F.lit(1000)).cast("long")
