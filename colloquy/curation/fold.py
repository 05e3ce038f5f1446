"""The action log folded into what is in force. The log is the truth; nothing else is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import runtime

#: Links followed, or strides laid out, between two lineage cuts.
HOPS_PER_JOB = 4


def live(actions: DataFrame) -> DataFrame:
    return actions.where("undone_at IS NULL")


def flags(actions: DataFrame) -> DataFrame:
    """Per turn uuid: hidden by its last live hide or unhide, superseded by its last live supersede."""
    acts = live(actions).where(F.col("op").isin("hide", "unhide", "supersede")).select(
        "id", "op", "payload.by", F.explode("payload.turns").alias("uuid")
    )
    sees = F.col("op").isin("hide", "unhide")
    return (
        acts.groupBy("uuid")
        .agg(
            F.coalesce(F.max_by(F.when(sees, F.col("op") == "hide"), F.when(sees, F.col("id"))), F.lit(False)).alias("hidden"),
            F.max_by(F.when(~sees, F.col("by")), F.when(~sees, F.col("id"))).alias("superseded_by"),
        )
        .where("hidden OR superseded_by IS NOT NULL")
    )


def turn_flags(actions: DataFrame, turns: DataFrame) -> DataFrame:
    """The fold by turn id: `id, hidden, superseded_by`. Turns that are gone drop out."""
    by_uuid = flags(actions)
    ids = turns.select("uuid", "id")
    replaced = ids.select(F.col("uuid").alias("superseded_by"), F.col("id").alias("_by"))
    return (
        by_uuid.join(ids, "uuid").join(replaced, "superseded_by", "left")
        .select("id", "hidden", F.col("_by").alias("superseded_by")).where("hidden OR superseded_by IS NOT NULL")
    )


def aliases(actions: DataFrame) -> DataFrame:
    """Aliases in force: `alias, canonical, action_id`."""
    return (
        live(actions).where(F.col("op").isin("alias", "unalias")).select("id", "op", "payload.alias", "payload.canonical")
        .groupBy("alias").agg(F.max_by(F.struct("op", "canonical", "id"), "id").alias("l"))
        .where("l.op = 'alias'").select("alias", "l.canonical", F.col("l.id").alias("action_id"))
    )


def blocklist(actions: DataFrame) -> DataFrame:
    return (
        live(actions).where(F.col("op").isin("block", "unblock")).select("id", "op", "payload.entity")
        .groupBy("entity").agg(F.max_by(F.struct("op", "id"), "id").alias("l"))
        .where("l.op = 'block'").select("entity", F.col("l.id").alias("action_id"))
    )


def cursor(actions: DataFrame) -> DataFrame:
    """How far curation has read: the last live run end."""
    ends = live(actions).where("op = 'run_end'")
    return ends.agg(F.coalesce(F.max_by("payload.cursor", "id"), F.lit(0)).alias("cursor"))


def note_sources(actions: DataFrame, turns: DataFrame) -> DataFrame:
    """`note_id, turn_id` of every live note."""
    notes = live(actions).where("op = 'note'").select("payload.note", F.explode("payload.sources").alias("uuid"))
    ids = turns.select("uuid", "id")
    return notes.join(ids.withColumnsRenamed({"uuid": "note", "id": "note_id"}), "note").join(
        ids.withColumnRenamed("id", "turn_id"), "uuid"
    ).select("note_id", "turn_id")


def links(turn_flags: DataFrame) -> DataFrame:
    return turn_flags.where("superseded_by IS NOT NULL AND superseded_by <> id").select("id", F.col("superseded_by").alias("by"))


def _doubled(moving: DataFrame, known: DataFrame) -> DataFrame:
    """Every pointer of `moving` goes as far again, by the pointers of `known`; `_moved` where there was a way on.

    `low` is the least turn among those a pointer has passed. Turns of two stretches in a row differ unless the chain goes
    round, so equal lows tell a cycle, and whatever leads to a turn of which that is known goes round too.
    """
    ahead = known.select(F.col("id").alias("latest"), F.col("latest").alias("_next"), F.col("low").alias("_low"), F.col("loop").alias("_loop"))
    on = F.col("_next").isNotNull()
    return moving.join(ahead, "latest", "left").select(
        "id", F.coalesce("_next", "latest").alias("latest"), F.least("low", "_low").alias("low"),
        (F.col("loop") | F.coalesce(F.col("_loop") | (F.col("low") == F.col("_low")), F.lit(False))).alias("loop"), on.alias("_moved"),
    )


def _pointers(step: DataFrame) -> DataFrame:
    return step.select("id", F.col("by").alias("latest"), F.col("by").alias("low"), F.lit(False).alias("loop"))


def chain_ends(turn_flags: DataFrame, ids: DataFrame | None = None, bound: int | None = None) -> DataFrame:
    """`id, latest`: the end of every replaced turn's chain, by pointer jumping. Turns that come upon a cycle have no end.

    A round makes strides four times as long. Pointers that have arrived or go round stay as they are; only the rest is
    written again, so the rounds follow the longest chain and not the number of links.
    """
    columns = ["id", "latest", "low", "loop"]
    resting: DataFrame | None = None
    moving = _pointers(links(turn_flags))
    while True:
        known = moving if resting is None else resting.unionByName(moving)
        once = _doubled(moving, known).select(columns)
        twice = runtime.checkpoint(_doubled(once, once if resting is None else resting.unionByName(once)))
        rest = twice.where("loop OR NOT _moved").select(columns)
        resting = rest if resting is None else resting.unionByName(rest)
        moving = twice.where("NOT loop AND _moved").select(columns)
        if moving.isEmpty():
            break
    ends = resting.where("NOT loop").select("id", "latest")
    return ends if ids is None else ends.join(runtime.small_side(ids.select("id"), bound=bound), "id", "left_semi")


def _near(start: DataFrame, step: DataFrame, bound: int | None = None) -> DataFrame:
    """`id, chain, _open`: successors in order, `HOPS_PER_JOB` of them after the first. `start` is small; cycles stop on re-entry."""
    at = start.select("id", F.array("by").alias("chain"), F.lit(True).alias("_open"))
    hop = step.select(F.col("id").alias("_at"), F.col("by").alias("_next"))
    for _ in range(HOPS_PER_JOB):
        onward = F.col("_open") & F.col("_next").isNotNull() & ~F.array_contains("chain", F.col("_next")) & (F.col("_next") != F.col("id"))
        at = hop.join(runtime.small_side(at, bound=bound), F.col("_at") == F.element_at("chain", -1), "right").select(
            "id", F.when(onward, F.concat("chain", F.array("_next"))).otherwise(F.col("chain")).alias("chain"),
            F.coalesce(onward, F.lit(False)).alias("_open"),
        )
    return runtime.checkpoint(at)


def _far(ids: DataFrame, step: DataFrame) -> DataFrame:
    """`id, chain` however long: tables of the 2^k-th successor, laid end to end from the longest stride down.

    A table holds only the turns whose chain is that long; once all that are left go round, longer strides meet no new turn.
    """
    strides = [_pointers(step)]
    while True:
        last = strides[-1]
        onward = runtime.checkpoint(_doubled(last, last).where("_moved").drop("_moved"))
        if onward.isEmpty():
            break
        strides.append(onward)
        if onward.where("NOT loop").isEmpty():
            break
    places = ids.select("id", F.col("id").alias("at"), F.lit(0).cast("long").alias("place"))
    for k in reversed(range(len(strides))):
        hop = strides[k].select(F.col("id").alias("at"), F.col("latest").alias("_next"))
        here = F.struct("at", "place")
        there = F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("at"), (F.col("place") + (1 << k)).alias("place")))
        both = F.filter(F.array(here, there), lambda x: x.isNotNull())
        places = places.join(hop, "at", "left").select("id", F.explode(both).alias("_p")).select("id", "_p.*")
        if k % HOPS_PER_JOB == 0:
            places = runtime.checkpoint(places)
    first = places.where("at <> id").groupBy("id", "at").agg(F.min("place").alias("place"))
    return first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "at")))["at"].alias("chain"))


def chains(turn_flags: DataFrame | None, ids: DataFrame, bound: int | None = None) -> DataFrame:
    """`id, chain` for the replaced turns among `ids`. On a cycle the chain ends before it meets a turn again."""
    if turn_flags is None:
        return ids.select("id", F.array().cast("array<bigint>").alias("chain")).limit(0)
    step = links(turn_flags)
    near = _near(step.join(runtime.small_side(ids.select("id"), bound=bound), "id", "left_semi"), step, bound)
    longer = near.where("_open").select("id")
    done = near.where("NOT _open").drop("_open")
    return done if longer.isEmpty() else done.unionByName(_far(longer, step))


def covering(sources: DataFrame | None, ids: DataFrame, bound: int | None = None) -> DataFrame:
    """`id, covered_by`: the notes standing for each of `ids`."""
    if sources is None:
        return ids.select("id", F.array().cast("array<bigint>").alias("covered_by")).limit(0)
    mine = sources.join(runtime.small_side(ids.select(F.col("id").alias("turn_id")), bound=bound), "turn_id", "left_semi")
    return mine.groupBy(F.col("turn_id").alias("id")).agg(F.array_sort(F.collect_list("note_id")).alias("covered_by"))


def valid_until(
    turn_flags: DataFrame, turns: DataFrame, ids: DataFrame | None = None, bound: int | None = None
) -> DataFrame:
    """`id, valid_until`: when a replaced turn stopped holding, the time its replacement was said."""
    pairs = links(turn_flags)
    if ids is not None:
        pairs = pairs.join(runtime.small_side(ids.select("id"), bound=bound), "id", "left_semi")
    said = turns.select(F.col("id").alias("by"), F.col("ts").alias("valid_until"))
    return said.join(runtime.small_side(pairs, bound=bound), "by").select("id", "valid_until")


