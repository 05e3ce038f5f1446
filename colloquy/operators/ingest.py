"""Turns in: validation, identity, first-write-wins dedup, reports, and the derived tables' rebuild."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import hashing
from colloquy.operators.ordered import Ordered

SCOPE_MAX_CHARS = 200


def reject_reason(session_id: Column, speaker: Column, text: Column) -> Column:
    """Why a turn cannot be stored; null when it can."""

    def blank(c: Column) -> Column:
        return F.coalesce(~c.rlike(r"\S"), F.lit(True))

    return (
        F.when(blank(session_id), "session_id: must not be blank")
        .when(blank(speaker), "speaker: must not be blank")
        .when(blank(text), "text: must not be blank")
    )


def fill_scope(scope: Column, default: Column | str = "") -> Column:
    """The line's own scope wins; the default fills blanks."""
    own = F.trim(scope)
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.when(own != "", own), F.trim(fallback), F.lit(""))


def with_identity(inputs: DataFrame, now_ms: Column | int, default_scope: str = "") -> DataFrame:
    """Stored form of raw turns: derived uuid, stamped ts, filled scope, and `reason` where refused."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    uuid = F.coalesce(
        F.when(F.trim("uuid") != "", F.col("uuid")),
        hashing.derived_uuid(F.col("session_id"), F.col("speaker"), F.col("text"), F.col("ts")),
    )
    return inputs.withColumns(
        {
            "reason": reject_reason(F.col("session_id"), F.col("speaker"), F.col("text")),
            "uuid": uuid,
            "ts": F.coalesce("ts", now),
            "created_at": now.cast("long"),
            "scope": fill_scope(F.col("scope"), default_scope),
        }
    )


@dataclass
class Ingested:
    turns: DataFrame
    report: DataFrame


def ingest(
    inputs: DataFrame, stored: DataFrame | None, now_ms: Column | int, *, seq: str = "seq", kind: str = "turn",
    default_scope: str = "", first_id: int | None = None,
) -> Ingested:
    """New turns and the indexed / duplicates / rejected report.

    `seq` is the arrival order. Copies of one uuid meet in a partial aggregate, so a uuid that makes up
    a third of the input still leaves each map task as one row.
    """
    known = with_identity(inputs, now_ms, default_scope)
    valid = known.where("reason IS NULL")
    row = F.struct(seq, "session_id", "speaker", "text", "ts", "created_at", "scope")
    firsts = valid.groupBy("uuid").agg(F.min_by(row, seq).alias("row"), F.count(F.lit(1)).alias("copies"))
    if stored is not None:
        firsts = firsts.join(stored.select("uuid", F.lit(True).alias("known")), "uuid", "left")
    else:
        firsts = firsts.withColumn("known", F.lit(None).cast("boolean"))
    fresh = firsts.where("known IS NULL").select("uuid", "row.*", F.lit(kind).alias("kind"))
    base = first_id
    if base is None:
        top = stored.agg(F.max("id")).first()[0] if stored is not None else None
        base = (top or 0) + 1
    # the order is taken over identities alone: texts stay where their identity has put them
    numbers = Ordered.of(fresh.select("uuid", F.col(seq).alias("_seq")), [], ["_seq"]).rank("_n").done().select("uuid", "_n")
    turns = fresh.join(numbers, "uuid").select(
        (F.col("_n") + F.lit(base - 1)).alias("id"), "uuid", "session_id", "speaker", "text", "ts", "created_at", "kind", "scope"
    )
    landed = F.when(F.col("known").isNull(), 1).otherwise(0)
    counts = firsts.agg(
        F.coalesce(F.sum(landed), F.lit(0)).alias("indexed"),
        F.coalesce(F.sum(F.col("copies") - landed), F.lit(0)).alias("duplicates"),
    )
    rejected = known.agg(F.count_if(F.col("reason").isNotNull()).alias("n")).scalar()
    report = counts.select("indexed", "duplicates", rejected.alias("rejected"))
    return Ingested(turns, report)


def forget_session(turns: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    """The turns that stay and the count removed; derived tables follow from the turns that stay."""
    return turns.where(F.col("session_id") != session_id), turns.where(F.col("session_id") == session_id).agg(
        F.count(F.lit(1)).alias("removed")
    )


def upsert_vectors(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Newest vector per (turn, model) by sequence; a re-embedded turn replaces its older vector."""
    both = stored.unionByName(rows)
    return both.groupBy("turn_id", "model").agg(F.max_by(F.struct("seq", "vec"), "seq").alias("v")).select(
        "turn_id", "model", "v.seq", "v.vec"
    )


def vectors_after(vectors: DataFrame, seq: int, model: str, dim: int) -> DataFrame:
    """Change feed: vectors of this model and length written after `seq`."""
    return vectors.where((F.col("seq") > seq) & (F.col("model") == model) & (F.size("vec") == dim))


def without_vector(turns: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Turns that still need a vector of `model`."""
    have = vectors.where(F.col("model") == model).select(F.col("turn_id").alias("id"))
    return turns.join(have, "id", "left_anti")
