"""Reads over the action log and what it says about turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import runtime
from colloquy import schema as sc
from colloquy.curation import fold
from colloquy.functions import text
from colloquy.operators import graph


def turn_facts(turns: DataFrame, flags: DataFrame, note_sources: DataFrame) -> DataFrame:
    """Per turn: hidden, superseded_by, and how many turns it supersedes, notes cover it, sources it stands for."""
    count = F.count(F.lit(1))
    replaced = flags.where("superseded_by IS NOT NULL").groupBy(F.col("superseded_by").alias("id")).agg(count.alias("supersedes"))
    covered = note_sources.groupBy(F.col("turn_id").alias("id")).agg(F.array_sort(F.collect_list("note_id")).alias("covered_by"))
    sources = note_sources.groupBy(F.col("note_id").alias("id")).agg(F.array_sort(F.collect_list("turn_id")).alias("sources"))
    none = F.array().cast("array<bigint>")
    return (
        turns.select("id").join(flags, "id", "left").join(replaced, "id", "left").join(covered, "id", "left").join(sources, "id", "left")
        .select("id", F.coalesce("hidden", F.lit(False)).alias("hidden"), "superseded_by",
                F.coalesce("supersedes", F.lit(0)).alias("supersedes"), F.coalesce("covered_by", none).alias("covered_by"),
                F.coalesce("sources", none).alias("sources"))
    )


def superseded_turns(flags: DataFrame, by: int) -> DataFrame:
    return flags.where(F.col("superseded_by") == by).select("id").orderBy("id")


def curated_turns(
    turns: DataFrame, mentions: DataFrame, facts: DataFrame, *, ids: DataFrame | None = None, session: str | None = None,
    entity: str | None = None, aliases: DataFrame | None = None, limit: int = 100,
) -> DataFrame:
    """Turns by ids, by session or by entity (followed through its aliases), with what curation says about each."""
    limit = min(max(limit, 1), 500)
    if ids is not None:
        chosen = turns.join(runtime.small_side(ids.select("id").distinct()), "id", "left_semi")
    elif session is not None:
        chosen = turns.where(F.col("session_id") == session)
    elif entity is not None:
        key = turns.sparkSession.range(1).select(text.name_key(F.lit(entity)).alias("alias"))
        if aliases is not None:
            closed = graph.alias_closure(aliases)
            key = key.join(closed, "alias", "left").select(F.coalesce("canonical", "alias").alias("alias"))
        said = mentions.join(F.broadcast(key.withColumnRenamed("alias", "entity")), "entity", "left_semi").select(F.col("turn_id").alias("id"))
        chosen = turns.join(said.distinct(), "id", "left_semi")
    else:
        raise ValueError("pass ids, session or entity")
    page = chosen.orderBy("ts", "id").limit(limit)
    return page.join(facts, "id", "left")


def runs(actions: DataFrame) -> DataFrame:
    """One row per curation run, with live op counts and the last live summary."""
    alive = F.col("undone_at").isNull()
    ended = alive & (F.col("op") == "run_end")
    base = actions.groupBy("run_id").agg(
        F.min("actor").alias("actor"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        F.count(F.lit(1)).alias("actions"), F.count_if(~alive).alias("undone"), F.max("id").alias("last_id"),
        F.max_by(F.when(ended, F.col("payload.summary")), F.when(ended, F.col("id"))).alias("summary"),
        F.count_if(ended).alias("_ends"),
    )
    ops = actions.where(alive).groupBy("run_id", "op").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("op", "n")))).alias("ops")
    )
    return base.join(ops, "run_id", "left").select(
        "run_id", "actor", "started_at", "ended_at", "actions", "undone", "last_id", F.coalesce("ops", F.create_map().cast("map<string,bigint>")).alias("ops"),
        F.when(F.col("summary") != "", F.col("summary")).alias("summary"), (F.col("_ends") > 0).alias("finished"),
    )


def action_targets(actions: DataFrame, turns: DataFrame) -> DataFrame:
    """Every turn an action touches, in the order it names them: `id, pos, uuid, turn_id, session_id, text`."""
    none = F.array().cast("array<string>")
    p = F.col("payload")
    uuids = F.array_compact(
        F.concat(F.array(p["note"], p["brief"]), F.coalesce(p["turns"], none), F.array(p["by"]), F.coalesce(p["sources"], none))
    )
    named = actions.select("id", F.posexplode(uuids).alias("pos", "uuid"))
    heads = turns.select("uuid", F.col("id").alias("turn_id"), "session_id", text.clip(F.col("text"), sc.TARGET_CHARS).alias("text"))
    return named.join(heads, "uuid", "left")


def action_list(actions: DataFrame, run_id: str | None = None) -> DataFrame:
    rows = actions if run_id is None else actions.where(F.col("run_id") == run_id)
    return rows.orderBy(F.col("id").desc())


def brief_of(turns: DataFrame, scope: str = "") -> DataFrame:
    """The standing brief of a scope, if one was written."""
    return turns.where((F.col("kind") == "brief") & (F.col("scope") == scope.strip())).orderBy(
        F.col("ts").desc(), F.col("id").desc()
    ).limit(1)


def snapshot(
    turns: DataFrame, mentions: DataFrame, stats: DataFrame, edges: DataFrame, segments: DataFrame, actions: DataFrame | None = None,
    vectors: DataFrame | None = None, note_sources: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every table keyed by uuid instead of id, so that two stores can be compared row for row."""
    ids = turns.select("id", "uuid")
    first = ids.withColumnsRenamed({"id": "first_turn_id", "uuid": "first_uuid"})
    last = ids.withColumnsRenamed({"id": "last_turn_id", "uuid": "last_uuid"})
    out = {
        "turns": turns.select("uuid", "session_id", "speaker", "text", "ts", "kind", "scope"),
        "mentions": mentions.join(ids.withColumnRenamed("id", "turn_id"), "turn_id").select("uuid", "start", "end", "entity", "kind", "surface"),
        "entity_stats": stats.select("entity", "kind", "turns", "first_ts", "last_ts"),
        "edges": edges.select("a", "b", "turns"),
        "segments": segments.join(first, "first_turn_id").join(last, "last_turn_id").select(
            "session_id", "level", "start_ts", "end_ts", "first_uuid", "last_uuid", "turns", "entities"
        ),
    }
    if vectors is not None:
        out["vectors"] = vectors.join(ids, "id").drop("id")
    if note_sources is not None:
        notes = ids.withColumnsRenamed({"id": "note_id", "uuid": "note_uuid"})
        out["note_sources"] = note_sources.join(notes, "note_id").join(ids.withColumnRenamed("id", "turn_id"), "turn_id").select("note_uuid", "uuid")
    if actions is not None:
        out["flags"] = fold.flags(actions)
        out["aliases"] = fold.aliases(actions).select("alias", "canonical")
        out["blocklist"] = fold.blocklist(actions).select("entity")
    return out


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
