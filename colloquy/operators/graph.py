"""The entity graph: stats, co-mention edges, neighbours, and the reads drawn from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy import runtime
from colloquy import schema as sc
from colloquy.operators import clustered
from colloquy.operators.ordered import top_n
from colloquy.operators.pairs import key_sets, pair_counts, pair_counts_by_parts

ALIAS_HOPS = 8


def alias_closure(aliases: DataFrame, hops: int = ALIAS_HOPS) -> DataFrame:
    """`alias -> canonical` with chains followed to their end, at most `hops` steps."""
    step = runtime.small_side(aliases.select(F.col("alias").alias("_at"), F.col("canonical").alias("_next")))
    out = aliases.select("alias", "canonical")
    reached = 1
    while reached < hops:
        out = out.join(step, F.col("canonical") == F.col("_at"), "left").select(
            "alias", F.coalesce("_next", "canonical").alias("canonical")
        )
        reached += 1
    return out


def apply_entity_rules(mentions: DataFrame, aliases: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Drop blocked keys, rewrite aliases, drop what rewrites to a blocked key."""
    blocked = runtime.small_side(blocklist.select(F.col("entity")))
    closed = runtime.small_side(alias_closure(aliases).select(F.col("alias").alias("entity"), "canonical"))
    return (
        mentions.join(blocked, "entity", "left_anti").join(closed, "entity", "left")
        .withColumn("entity", F.coalesce("canonical", "entity")).drop("canonical")
        .join(blocked, "entity", "left_anti")
    )


@dataclass(frozen=True)
class KeyIndex:
    """Which turns mention a key: `rows` hold bucket, entity, id, session_id, ts, scope, one row per key and turn, clustered by key."""

    rows: DataFrame
    buckets: int


def write_keys(entries: DataFrame, path: str, bucket_rows: int = clustered.BUCKET_ROWS) -> KeyIndex:
    """Write the distinct keys of the entries' mentions (`m`) under `path`."""
    keys = F.array_distinct(F.transform("m", lambda m: m["key"]))
    buckets = clustered.buckets_for(entries.agg(F.sum(F.size(keys))).first()[0] or 0, bucket_rows)
    said = entries.select(F.explode(keys).alias("entity"), "id", "session_id", "ts", "scope")
    clustered.write(said.withColumn("bucket", clustered.bucket_of(F.col("entity"), buckets)), path, "entity", "id")
    schema = "entity string, id long, session_id string, ts long, scope string, bucket int"
    return KeyIndex(entries.sparkSession.read.schema(schema).parquet(path), buckets)


def turns_of_keys(
    index: KeyIndex, keys: DataFrame, aliases: DataFrame | None = None, blocklist: DataFrame | None = None, bound: int | None = None
) -> DataFrame:
    """The turns of `keys` (`entity, ...`), as `apply_entity_rules` would rewrite what was said: keys are turned back into the surfaces that mean them."""
    if aliases is None and blocklist is None:
        return clustered.lookup(index.rows, keys, "entity", index.buckets, bound)
    if blocklist is not None:
        keys = keys.join(runtime.small_side(blocklist.select("entity")), "entity", "left_anti")
    said = keys
    if aliases is not None:
        closed = runtime.small_side(alias_closure(aliases).select(F.col("alias").alias("_said"), F.col("canonical").alias("entity")))
        kept = keys.join(closed.select(F.col("_said").alias("entity")), "entity", "left_anti")
        said = kept.unionByName(closed.join(keys, "entity").drop("entity").withColumnRenamed("_said", "entity"))
    if blocklist is not None:
        said = said.join(runtime.small_side(blocklist.select("entity")), "entity", "left_anti")
    return clustered.lookup(index.rows, said, "entity", index.buckets).drop("entity").distinct()


def entity_stats(mentions: DataFrame, turns: DataFrame) -> DataFrame:
    """Per key: distinct turns, kind, first and last mention. Hot keys shrink in the partial aggregate."""
    return (
        mentions.select("turn_id", "entity", "kind")
        .join(turns.select(F.col("id").alias("turn_id"), "ts"), "turn_id")
        .groupBy("entity")
        .agg(F.countDistinct("turn_id").alias("turns"), F.min("kind").alias("kind"), F.min("ts").alias("first_ts"),
             F.max("ts").alias("last_ts"))
    )


def edges(mentions: DataFrame, group: str = "turn_id", item: str = "entity", *, wide: bool = False) -> DataFrame:
    """Undirected edges `a < b` weighted by the turns that mention both. `wide` groups hold hundreds of items: their pairs are then not shuffled."""
    count = pair_counts_by_parts if wide else pair_counts
    return count(key_sets(mentions, group, item)).withColumnRenamed("n", "turns")


def adjacency(edge_list: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    ends = [("a", "b"), ("b", "a")]
    return reduce(
        DataFrame.unionAll,
        [edge_list.select(F.col(x).alias("entity"), F.col(y).alias("other"), "turns") for x, y in ends],
    )


def degrees(edge_list: DataFrame) -> DataFrame:
    return adjacency(edge_list).groupBy("entity").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edge_list: DataFrame, limit: int, of: DataFrame | None = None, bound: int | None = None) -> DataFrame:
    """The `limit` strongest neighbours of every entity, or of those in `of`."""
    adjacent = adjacency(edge_list)
    if of is not None:
        adjacent = adjacent.join(runtime.small_side(of.select("entity").distinct(), bound=bound), "entity", "left_semi")
    return top_n(adjacent, ["entity"], [F.col("turns").desc(), F.col("other").asc()], limit)


def top_entities(stats: DataFrame, limit: int, kind: str | None = None) -> DataFrame:
    rows = stats if kind is None else stats.where(F.col("kind") == kind)
    return rows.orderBy(F.col("turns").desc(), F.col("entity").asc()).limit(limit)


@dataclass
class GraphSnapshot:
    nodes: DataFrame
    edges: DataFrame
    totals: DataFrame


def _snapshot(ranked: DataFrame, stats: DataFrame, edge_list: DataFrame, min_weight: int, limit: int) -> GraphSnapshot:
    """`ranked` holds `entity, _n`; rows past `limit` only tell that the cap cut."""
    chosen = runtime.small_side(ranked.where(F.col("_n") <= limit).select("entity"))
    degree = adjacency(edge_list).join(chosen, "entity", "left_semi").groupBy("entity").agg(
        F.count(F.lit(1)).alias("degree")
    )
    nodes = stats.join(chosen, "entity", "left_semi").join(degree, "entity", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0))
    )
    induced = (
        edge_list.where(F.col("turns") >= min_weight)
        .join(chosen.withColumnRenamed("entity", "a"), "a", "left_semi")
        .join(chosen.withColumnRenamed("entity", "b"), "b", "left_semi")
    )
    rows = F.count(F.lit(1))
    totals = stats.agg(rows.alias("total_entities")).select(
        "total_entities",
        edge_list.agg(rows.alias("n")).scalar().alias("total_edges"),
        ranked.agg((rows > limit).alias("over")).scalar().alias("truncated"),
    )
    return GraphSnapshot(nodes, induced, totals)


def graph_snapshot(
    stats: DataFrame, edge_list: DataFrame, *, limit: int = 200, min_weight: int = 1, kind: str | None = None
) -> GraphSnapshot:
    """The most mentioned entities and the edges among them."""
    limit, min_weight = min(max(limit, 1), sc.GRAPH_MAX_NODES), max(min_weight, 1)
    ranked = top_entities(stats, limit + 1, kind)
    keys = ranked.withColumn("_n", F.row_number().over(Window.orderBy(F.col("turns").desc(), "entity")))
    return _snapshot(keys, stats, edge_list, min_weight, limit)


def k_hop(
    stats: DataFrame, edge_list: DataFrame, focus: str, *, hops: int = 1, limit: int = 200, min_weight: int = 1
) -> DataFrame:
    """Entities within `hops` of the focus in breadth-first order, strongest neighbours first, capped at `limit`.

    Returns `entity, depth, pos`; one more row than `limit` means the cap cut it short. Each hop keeps at most
    `limit` rows, so the frontier stays small enough to broadcast.
    """
    hops, limit = min(hops, sc.GRAPH_MAX_HOPS), min(max(limit, 1), sc.GRAPH_MAX_NODES)
    adjacent = adjacency(edge_list)
    reached = stats.where(F.col("entity") == focus).select(
        "entity", F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("pos")
    )
    for depth in range(1, hops + 1):
        frontier = reached.where(F.col("depth") == depth - 1).select(F.col("entity").alias("parent"), "pos")
        near = adjacent.join(runtime.small_side(frontier), F.col("entity") == F.col("parent")).select(
            "parent", "pos", "other", "turns"
        )
        # A parent offers its strongest `limit` neighbours, whether or not they were met before.
        offered = top_n(near, ["parent"], [F.col("turns").desc(), F.col("other").asc()], limit)
        met = (
            offered.where(F.col("turns") >= max(min_weight, 1))
            .join(runtime.small_side(reached.select(F.col("entity").alias("other"))), "other", "left_anti")
            .groupBy("other").agg(F.min(F.struct("pos", "rank")).alias("first"))
            .orderBy("first", "other").limit(limit + 1)
        )
        at = Window.orderBy("first", "other")
        placed = met.select(
            F.col("other").alias("entity"), F.lit(depth).cast("long").alias("depth"),
            F.row_number().over(at).cast("long").alias("_n"),
        )
        so_far = reached.agg(F.count(F.lit(1)).alias("n")).scalar()
        placed = placed.select("entity", "depth", (F.col("_n") + so_far).alias("pos"))
        reached = reached.unionByName(placed.where(F.col("pos") <= limit + 1))
    return reached


def neighbourhood(
    stats: DataFrame, edge_list: DataFrame, focus: str, *, hops: int = 1, limit: int = 200, min_weight: int = 1,
    kind: str | None = None,
) -> GraphSnapshot:
    """Snapshot around a focus; a kind filter keeps the focus itself."""
    found = k_hop(stats, edge_list, focus, hops=hops, limit=limit, min_weight=min_weight).withColumnRenamed("pos", "_n")
    if kind is not None:
        keep = stats.where(F.col("kind") == kind).select("entity").unionAll(
            stats.where(F.col("entity") == focus).select("entity")
        )
        found = found.join(keep, "entity", "left_semi")
    return _snapshot(found, stats, edge_list, max(min_weight, 1), min(max(limit, 1), sc.GRAPH_MAX_NODES))
