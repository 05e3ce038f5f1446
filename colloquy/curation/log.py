"""The action log as a table: rows appended, rows taken back, and what labels would have a curator do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ordered import Ordered


class UnknownAction(LookupError):
    """Nothing live in the log answers to the id asked for."""


def append_log(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with `entries` at its end: log columns, but `index` in place of `id`; ids go on from the largest in use."""
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    ranked = Ordered.of(entries, [], ["index"]).rank("_place").done()
    numbered = ranked.crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_place"))  # `top` is one row
    return log.unionByName(numbered.select(*log.columns))


def undo(
    log: DataFrame, turns: DataFrame, *, actor: str, now: int, action_id: int | None = None, run_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Take back one action or the live ones of a run: its rows are marked, the turns they wrote leave the store."""
    asked = (F.col("run_id") == run_id) if action_id is None else (F.col("id") == action_id)
    open_rows = asked & F.col("undone_at").isNull()
    rows, live = log.agg(F.count_if(asked), F.count_if(open_rows)).first()
    if rows == 0 or (live == 0 and action_id is not None):
        raise UnknownAction(f"run {run_id}" if action_id is None else f"action {action_id}")
    authored = log.where(open_rows).select(F.explode(F.array("payload.note", "payload.brief")).alias("uuid")).where("uuid IS NOT NULL")
    marks = {"undone_by": F.lit(actor), "undone_at": F.lit(now).cast("long")}
    marked = log.withColumns({c: F.when(open_rows, v).otherwise(F.col(c)) for c, v in marks.items()})
    return marked, turns.join(authored.distinct(), "uuid", "left_anti").select(*turns.columns)


def oracle_supersession(labels: DataFrame, turns: DataFrame) -> DataFrame:
    """What a curator who knew the labels would replace: `query_id, by, turn_ids`.

    Every turn graded 1 gives way to the latest turn graded 2 of the first question that lists it, unless some
    question grades it 2. `labels` holds `query_id, seq, uuid, grade`.
    """
    ids = turns.select("uuid", "id")
    graded = labels.join(ids, "uuid")
    latest = graded.where("grade = 2").groupBy("query_id").agg(F.max("id").alias("by"))
    current = graded.where("grade = 2").select("uuid").distinct()
    old = graded.where("grade = 1").join(current, "uuid", "left_anti").join(latest, "query_id")
    first = old.groupBy("uuid", "id").agg(F.min_by(F.struct("query_id", "by"), "seq").alias("q"))
    return first.groupBy(F.col("q.query_id").alias("query_id"), F.col("q.by").alias("by")).agg(
        F.array_sort(F.collect_list("id")).alias("turn_ids")
    )
