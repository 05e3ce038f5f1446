"""Mentions, entity statistics and the co-mention graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import runtime
from colloquy.functions.mentions import extract_mentions, mentions_of, split_mentions
from colloquy.operators import graph, sessions
from colloquy.plans.memory import Memory
from colloquy.sources import adapters
from colloquy.suite import sql
from colloquy.suite.registry import query

M = f"{sql.TURNS}, {sql.mentions()}"
STATS = """stats AS (SELECT entity, count(DISTINCT turn_id) AS turns, min(kind) AS kind, min(ts) AS first_ts, max(ts) AS last_ts
 FROM mentions JOIN turns ON turns.id = turn_id GROUP BY entity)"""
EDGES = """pairs AS (SELECT DISTINCT turn_id, entity FROM mentions),
 edges AS (SELECT x.entity AS a, y.entity AS b, count(*) AS turns FROM pairs x JOIN pairs y ON x.turn_id = y.turn_id AND x.entity < y.entity
 GROUP BY 1, 2), adj AS (SELECT a AS entity, b AS other, turns FROM edges UNION ALL SELECT b, a, turns FROM edges)"""


def _mentions(spark, sf) -> DataFrame:
    return extract_mentions(runtime.spread_scan(adapters.conversation_turns(spark, sf)))


def _stats(spark, sf) -> DataFrame:
    return graph.entity_stats(_mentions(spark, sf), adapters.conversation_turns(spark, sf))


@query("mentions", f"WITH {M} SELECT turn_id, entity, kind, count(*) AS n FROM mentions GROUP BY ALL")
def _(spark, sf):
    return _mentions(spark, sf).groupBy("turn_id", "entity", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("mentions_documents")
def _(spark, sf):
    """The full extractor over whole documents, numbers, paths and addresses included."""
    return extract_mentions(runtime.spread_scan(adapters.document_turns(spark, sf))).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("keys"), F.min("start").alias("first_byte")
    )


@query("mention_spans_cover_text", "SELECT doc_id AS id, strlen(text) AS bytes, md5(text) AS digest FROM documents")
def _(spark, sf):
    """The pieces of a text cut at its mentions put the text together again."""
    docs = runtime.spread_scan(adapters.document_turns(spark, sf))
    pieces = docs.select("id", split_mentions("text", mentions_of("text")).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return pieces.select("id", F.octet_length(whole).cast("long").alias("bytes"), F.md5(whole).alias("digest"))


@query("entity_stats", f"WITH {M}, {STATS} SELECT * FROM stats")
def _(spark, sf):
    return _stats(spark, sf)


@query("edges", f"WITH {M}, {EDGES} SELECT * FROM edges")
def _(spark, sf):
    return graph.edges(_mentions(spark, sf))


@query("edges_orders", """SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS turns FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) x
 JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2""")
def _(spark, sf):
    """Suppliers that meet in one order: the same edges over a bigger table."""
    return graph.edges(adapters.table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query("edges_blocked", """SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS turns FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x
 JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) y ON x.l_suppkey = y.l_suppkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2""")
def _(spark, sf):
    """Parts of one supplier: groups of hundreds of keys, cut into blocks."""
    return graph.edges(adapters.table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", wide=True)


@query("degrees", f"WITH {M}, {EDGES} SELECT entity, count(*) AS degree FROM adj GROUP BY 1")
def _(spark, sf):
    return graph.degrees(graph.edges(_mentions(spark, sf)))


@query("neighbours", f"""WITH {M}, {EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY turns DESC, other) AS rank
 FROM adj) SELECT entity, other, turns, rank FROM r WHERE rank <= 5""")
def _(spark, sf):
    return graph.neighbours(graph.edges(_mentions(spark, sf)), 5)


@query("top_entities", f"WITH {M}, {STATS} SELECT entity, turns FROM stats WHERE kind = 'name' ORDER BY turns DESC, entity LIMIT 25")
def _(spark, sf):
    return graph.top_entities(_stats(spark, sf), 25, "name").select("entity", "turns")


@query("known_keys", f"""WITH {M}, {STATS} SELECT entity, turns FROM stats WHERE turns <= greatest(1, floor(0.4 * (SELECT count(*) FROM turns)))""")
def _(spark, sf):
    total = adapters.conversation_turns(spark, sf).agg(F.count(F.lit(1)).alias("n")).scalar()
    return _stats(spark, sf).where(F.col("turns") <= F.greatest(F.lit(1), F.floor(total * 0.4))).select("entity", "turns")


_TOP = "top AS (SELECT entity FROM stats ORDER BY turns DESC, entity LIMIT 40)"


@query("graph_nodes", f"""WITH {M}, {STATS}, {EDGES}, {_TOP} SELECT s.entity, s.turns, coalesce(d.degree, 0) AS degree FROM stats s
 JOIN top USING (entity) LEFT JOIN (SELECT entity, count(*) AS degree FROM adj GROUP BY 1) d USING (entity)""")
def _(spark, sf):
    snap = graph.graph_snapshot(_stats(spark, sf), graph.edges(_mentions(spark, sf)), limit=40)
    return snap.nodes.select("entity", "turns", "degree")


@query("graph_edges", f"""WITH {M}, {STATS}, {EDGES}, {_TOP} SELECT a, b, turns FROM edges WHERE turns >= 2 AND a IN (SELECT entity FROM top)
 AND b IN (SELECT entity FROM top)""")
def _(spark, sf):
    return graph.graph_snapshot(_stats(spark, sf), graph.edges(_mentions(spark, sf)), limit=40, min_weight=2).edges


@query("graph_totals", f"""WITH {M}, {STATS}, {EDGES} SELECT (SELECT count(*) FROM stats) AS total_entities, (SELECT count(*) FROM edges)
 AS total_edges, (SELECT count(*) FROM stats) > 40 AS truncated""")
def _(spark, sf):
    return graph.graph_snapshot(_stats(spark, sf), graph.edges(_mentions(spark, sf)), limit=40).totals


@query("k_hop", f"""WITH {M}, {STATS}, {EDGES}, f AS (SELECT entity FROM stats ORDER BY turns DESC, entity LIMIT 1),
 h1 AS (SELECT other AS entity, row_number() OVER (ORDER BY turns DESC, other) AS p FROM (SELECT * FROM adj WHERE entity = (SELECT entity FROM f)
  ORDER BY turns DESC, other LIMIT 30) WHERE turns >= 2),
 o2 AS (SELECT h1.p, a.other, a.turns, row_number() OVER (PARTITION BY a.entity ORDER BY a.turns DESC, a.other) AS r FROM h1 JOIN adj a
  ON a.entity = h1.entity),
 h2 AS (SELECT other AS entity, min((p, r)) AS k FROM o2 WHERE r <= 30 AND turns >= 2 AND other NOT IN (SELECT entity FROM h1)
  AND other NOT IN (SELECT entity FROM f) GROUP BY 1),
 n AS (SELECT (SELECT count(*) FROM h1) AS c)
 SELECT * FROM (SELECT entity, 0 AS depth, 1 AS pos FROM f UNION ALL SELECT entity, 1, 1 + p FROM h1
 UNION ALL SELECT entity, 2, 1 + (SELECT c FROM n) + row_number() OVER (ORDER BY k, entity) FROM h2) WHERE pos <= 30""")
def _(spark, sf):
    stats = _stats(spark, sf)
    focus = graph.top_entities(stats, 1).first()["entity"]
    found = graph.k_hop(stats, graph.edges(_mentions(spark, sf)), focus, hops=2, limit=30, min_weight=2)
    return found.where("pos <= 30")


_RULES = """a0 AS (SELECT 'k'||user_id AS alias, 'k'||(user_id*3+1) AS canonical FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 = 1),
 blocked AS (SELECT DISTINCT 'k'||user_id AS entity FROM events WHERE user_id % 17 = 3),
 m AS (SELECT event_id AS turn_id, 'k'||json_extract_string(props,'$.k') AS entity FROM events)"""


@query("entity_rules", f"""WITH RECURSIVE {_RULES}, c(alias, canonical, hop) AS (SELECT alias, canonical, 1 FROM a0 UNION ALL
 SELECT c.alias, a0.canonical, hop + 1 FROM c JOIN a0 ON a0.alias = c.canonical WHERE hop < 8),
 closed AS (SELECT alias, arg_max(canonical, hop) AS canonical FROM c GROUP BY 1),
 r AS (SELECT turn_id, coalesce(canonical, entity) AS entity FROM m LEFT JOIN closed ON alias = entity
  WHERE entity NOT IN (SELECT entity FROM blocked))
 SELECT entity, count(*) AS n FROM r WHERE entity NOT IN (SELECT entity FROM blocked) GROUP BY 1""")
def _(spark, sf):
    events = adapters.table(spark, sf, "events")
    users = events.select("user_id").distinct()
    aliases = users.where("user_id % 4 = 1").select(
        F.concat(F.lit("k"), "user_id").alias("alias"), F.concat(F.lit("k"), F.col("user_id") * 3 + 1).alias("canonical")
    )
    blocked = users.where("user_id % 17 = 3").select(F.concat(F.lit("k"), "user_id").alias("entity"))
    rows = events.select(
        F.col("event_id").alias("turn_id"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("entity")
    )
    return graph.apply_entity_rules(rows, aliases, blocked).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("store_stats", f"""WITH {M}, {STATS}, {EDGES} SELECT (SELECT count(*) FROM turns) AS turns, (SELECT count(DISTINCT session_id) FROM turns) AS sessions,
 (SELECT count(*) FROM stats) AS entities, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM mentions) AS mentions,
 (SELECT sum(strlen(text))::BIGINT FROM turns) AS text_bytes""")
def _(spark, sf):
    memory = Memory.build(adapters.conversation_turns(spark, sf), embed_fn=None)
    out = sessions.store_stats(memory.turns(), memory.stats(), memory.edges(), memory.segments(), memory.mentions())
    return out.select("turns", "sessions", "entities", "edges", "mentions", "text_bytes")


@query("session_inspector", f"""WITH {M} SELECT t.id, count(entity) AS mentions, min(entity) AS first_key FROM turns t LEFT JOIN mentions m ON m.turn_id = t.id
 WHERE session_id = 'c7' GROUP BY 1""")
def _(spark, sf):
    turns = adapters.conversation_turns(spark, sf)
    rows = sessions.inspect_session(turns, extract_mentions(turns), None, "c7")
    return rows.select(
        "id", F.coalesce(F.size("entities"), F.lit(0)).cast("long").alias("mentions"),
        F.array_min(F.transform("entities", lambda e: e["key"])).alias("first_key"),
    )
