"""The action log folded, the finders, and the curation reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import runtime
from colloquy.curation import finders, fold, reads
from colloquy.functions.mentions import extract_mentions
from colloquy.operators import graph, timeline
from colloquy.sources import adapters
from colloquy.suite import sql
from colloquy.suite.entities import EDGES, M, STATS
from colloquy.suite.registry import query
from colloquy.suite.store import _segments_sql

ACTS = """acts AS (SELECT event_id AS id, 'r'||(user_id%20) AS run_id, 'a'||(user_id%3) AS actor, epoch_us(ts)//1000 AS ts,
 CASE event_type WHEN 'click' THEN 'hide' WHEN 'view' THEN 'supersede' WHEN 'purchase' THEN 'unhide' WHEN 'error' THEN 'alias' ELSE 'run_end' END AS op,
 user_id AS u, CASE WHEN value > 40 THEN 1 END AS undone FROM events),
 live AS (SELECT * FROM acts WHERE undone IS NULL),
 touched AS (SELECT id, op, u + 2 + id % 3 AS nxt, UNNEST([u, u + 1]) AS t FROM live WHERE op IN ('hide', 'unhide', 'supersede')),
 flags AS (SELECT * FROM (SELECT t, coalesce(arg_max(op = 'hide', id) FILTER (WHERE op <> 'supersede'), false) AS hidden,
 arg_max(nxt, id) FILTER (WHERE op = 'supersede') AS nxt FROM touched GROUP BY 1) WHERE hidden OR nxt IS NOT NULL)"""


def _targets(spark, sf) -> DataFrame:
    return adapters.document_turns(spark, sf).withColumn("uuid", F.concat(F.lit("t"), "id"))


@query("flags_fold", f"WITH {ACTS} SELECT 't'||t AS uuid, hidden, 't'||nxt AS superseded_by FROM flags")
def _(spark, sf):
    return fold.flags(adapters.event_actions(spark, sf))


@query("turn_flags", f"WITH {ACTS} SELECT t AS id, hidden, CASE WHEN nxt IN (SELECT doc_id FROM documents) THEN nxt END AS superseded_by FROM flags WHERE t IN (SELECT doc_id FROM documents) AND (hidden OR nxt IN (SELECT doc_id FROM documents))")
def _(spark, sf):
    return fold.turn_flags(adapters.event_actions(spark, sf), _targets(spark, sf))


@query("valid_until", f"WITH {ACTS} SELECT t AS id, 1736154000000 + nxt * 700000 AS valid_until FROM flags WHERE t IN (SELECT doc_id FROM documents) AND nxt IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    turns = _targets(spark, sf)
    return fold.valid_until(fold.turn_flags(adapters.event_actions(spark, sf), turns), turns)


@query("successor_ends", f"""WITH RECURSIVE {ACTS}, n AS (SELECT t AS id, nxt FROM flags WHERE nxt IS NOT NULL AND t IN (SELECT doc_id FROM documents)
 AND nxt IN (SELECT doc_id FROM documents)), c(id, latest, hop) AS (SELECT id, nxt, 1 FROM n UNION ALL SELECT c.id, n.nxt, hop + 1 FROM c JOIN n ON n.id = c.latest)
 SELECT id, arg_max(latest, hop) AS latest FROM c GROUP BY 1""")
def _(spark, sf):
    flags = fold.turn_flags(adapters.event_actions(spark, sf), _targets(spark, sf))
    return fold.chain_ends(flags, flags.select("id"))


@query("alias_fold", f"WITH {ACTS} SELECT 'k'||u AS alias, 'k'||(u+100) AS canonical, max(id) AS action_id FROM live WHERE op = 'alias' GROUP BY u")
def _(spark, sf):
    return fold.aliases(adapters.event_actions(spark, sf))


@query("cursor_fold", f"WITH {ACTS} SELECT coalesce(max(id) * 10, 0) AS cursor FROM live WHERE op = 'run_end'")
def _(spark, sf):
    return fold.cursor(adapters.event_actions(spark, sf))


@query("run_summary", f"""WITH {ACTS}, o AS (SELECT run_id, string_agg(op || '=' || n, ',' ORDER BY op) AS ops FROM (SELECT run_id, op, count(*) AS n FROM live GROUP BY 1, 2) GROUP BY 1)
 SELECT run_id, min(actor) AS actor, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS actions, count(undone) AS undone, max(id) AS last_id, max(ops) AS ops,
 'end ' || max(id) FILTER (WHERE undone IS NULL AND op = 'run_end') AS summary, count(*) FILTER (WHERE undone IS NULL AND op = 'run_end') > 0 AS finished
 FROM acts LEFT JOIN o USING (run_id) GROUP BY run_id""")
def _(spark, sf):
    rows = reads.runs(adapters.event_actions(spark, sf))
    ops = F.array_join(F.transform(F.map_entries("ops"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.withColumn("ops", ops)


@query("action_targets", f"""WITH {ACTS}, x AS (SELECT id, UNNEST(CASE WHEN op = 'supersede' THEN [u, u + 1, u + 2 + id % 3] WHEN op IN ('hide', 'unhide') THEN [u, u + 1] ELSE [] END) AS t FROM acts)
 SELECT id, 't'||t AS uuid, doc_id AS turn_id, source AS session_id, md5(CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END) AS head FROM x LEFT JOIN documents ON doc_id = t""")
def _(spark, sf):
    rows = reads.action_targets(adapters.event_actions(spark, sf), _targets(spark, sf))
    return rows.select("id", "uuid", "turn_id", "session_id", F.md5("text").alias("head"))


@query("turn_facts", f"""WITH {ACTS}, d AS (SELECT doc_id AS id FROM documents), f AS (SELECT t AS id, hidden, CASE WHEN nxt IN (SELECT id FROM d) THEN nxt END AS nxt FROM flags WHERE t IN (SELECT id FROM d)),
 n AS (SELECT doc_id - doc_id % 10 AS note_id, doc_id AS turn_id FROM documents WHERE doc_id % 10 > 6)
 SELECT d.id, coalesce(hidden, false) AS hidden, nxt AS superseded_by, (SELECT count(*) FROM f x WHERE x.nxt = d.id) AS supersedes,
 (SELECT count(*) FROM n WHERE n.turn_id = d.id) AS covered_by, (SELECT count(*) FROM n WHERE n.note_id = d.id) AS sources FROM d LEFT JOIN f USING (id)""")
def _(spark, sf):
    turns = _targets(spark, sf)
    notes = turns.where("id % 10 > 6").select((F.col("id") - F.col("id") % 10).alias("note_id"), F.col("id").alias("turn_id"))
    facts = reads.turn_facts(turns, fold.turn_flags(adapters.event_actions(spark, sf), turns), notes)
    return facts.withColumns({c: F.size(c).cast("long") for c in ("covered_by", "sources")})


# --- finders -----------------------------------------------------------------------------------------
# For the SQL to repeat the rule, a document counts as naming something when it holds a digit.
_NAMED_SQL = "regexp_matches(text, '[0-9]')"
CUT = 10**15


def _named(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("text").rlike("[0-9]")).select(F.col("id").alias("turn_id"))


@query("exact_duplicates", f"""WITH {sql.DOC_TURNS}, n AS (SELECT id, md5(array_to_string({sql.norms()}, ' ')) AS digest, len({sql.content()}) AS c, {_NAMED_SQL} AS named FROM turns),
 r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY id) AS nth, min(id) OVER (PARTITION BY digest) AS first FROM n)
 SELECT id, nth - 1 AS earlier, first, 'a copy; first said in turn ' || first AS reason FROM r WHERE nth > 1 AND (c >= 4 OR named)""")
def _(spark, sf):
    turns = runtime.spread_scan(adapters.document_turns(spark, sf))
    return finders.exact_duplicates(turns, _named(turns), cutoff=CUT).select("id", "earlier", "first", "reason")


@query("text_copies_sliced", f"""WITH {sql.DOC_TURNS}, n AS (SELECT id, md5(array_to_string({sql.norms()}, ' ')) AS digest FROM turns)
 SELECT id, row_number() OVER (PARTITION BY digest ORDER BY id) AS nth, min(id) OVER (PARTITION BY digest) AS first FROM n""")
def _(spark, sf):
    """The same scan with every group of copies treated as hot."""
    turns = runtime.spread_scan(adapters.document_turns(spark, sf))
    return finders.text_copies(turns, hot_rows=2).select("id", "nth", "first")


@query("noise_candidates", rf"""WITH {sql.DOC_TURNS}, n AS (SELECT id, length(text) AS chars, length(text) - length(replace(text, chr(10), '')) + CASE WHEN suffix(text, chr(10)) OR text = '' THEN 0 ELSE 1 END AS lines,
 length(regexp_replace(text, '[\p{{L}}\p{{N}}\s\p{{Z}}]', '', 'g')) AS symbols, len({sql.content()}) AS content, {_NAMED_SQL} AS named FROM turns),
 k AS (SELECT *, chars >= 400 AND (lines >= 15 OR symbols / chars >= 0.25) AS pasted FROM n)
 SELECT id, CASE WHEN pasted THEN 0.7 ELSE round(0.9 - 0.1 * content, 3) END AS score FROM k WHERE pasted OR (content <= 3 AND chars <= 120 AND NOT named)""")
def _(spark, sf):
    turns = runtime.spread_scan(adapters.document_turns(spark, sf))
    return finders.noise(turns, _named(turns), cutoff=CUT).select("id", "score")


@query("near_duplicate_candidates")
def _(spark, sf):
    from colloquy.functions.embed import hash_embed

    turns = runtime.spread_scan(adapters.document_turns(spark, sf))
    vecs = turns.select("id", hash_embed("text").alias("vec"))
    return finders.near_duplicates(turns, vecs, _named(turns), cutoff=CUT)


@query("supersession_candidates", f"""WITH {M}, k AS (SELECT DISTINCT turn_id AS id, entity FROM mentions),
 ks AS (SELECT id, list(entity) AS ks FROM k GROUP BY 1),
 w AS (SELECT t.id, ts, ks, list_distinct(list_filter(list_transform({sql.content()}, lambda x: {sql.stem_norm('x')}), lambda s: NOT list_contains(flatten(list_transform(ks, lambda e: string_split(e, ' '))), s))) AS ws,
  len(list_filter({sql.words('lower(text)')}, lambda x: x IN {sql.quoted('update updated now changed moved instead longer correction actually switched plan'.split())})) > 0 AS cue FROM turns t JOIN ks USING (id)),
 p AS (SELECT a.id, a.entity AS subject, b.id AS old, row_number() OVER (PARTITION BY a.id, a.entity ORDER BY wb.ts DESC, b.id DESC) AS r FROM k a JOIN k b ON a.entity = b.entity AND a.id <> b.id
  JOIN w wa ON wa.id = a.id JOIN w wb ON wb.id = b.id WHERE wb.ts <= wa.ts),
 j AS (SELECT p.id, p.old, subject, a.cue, list_filter(a.ks, lambda x: x <> subject) AS now, list_filter(b.ks, lambda x: x <> subject) AS before,
  CASE WHEN len(a.ws) + len(b.ws) = 0 THEN 0 ELSE len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) END AS overlap
  FROM p JOIN w a ON a.id = p.id JOIN w b ON b.id = p.old WHERE r <= 30),
 g AS (SELECT id, old, max(overlap) AS overlap, bool_or(cue) AS cue FROM j WHERE len(now) > 0 AND len(before) > 0 AND len(list_intersect(now, before)) = 0 AND overlap >= 0.3 GROUP BY 1, 2),
 f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, old DESC) AS r FROM g)
 SELECT id, round(least(1.0, max(overlap) + CASE WHEN bool_or(cue) THEN 0.2 ELSE 0 END), 3) AS score, count(*) AS earlier, min(old) AS oldest FROM f WHERE r <= 5 GROUP BY 1""")
def _(spark, sf):
    turns = runtime.spread_scan(adapters.conversation_turns(spark, sf))
    rows = finders.supersession(turns, extract_mentions(turns), cutoff=CUT)
    return rows.select("id", "score", F.size("turns").cast("long").alias("earlier"), F.array_min("turns").alias("oldest"))


@query("alias_candidates", f"""WITH {M}, {STATS}, {EDGES}, t AS (SELECT entity AS long, string_split(entity, ' ') AS t FROM stats WHERE contains(entity, ' ')),
 f AS (SELECT long, array_to_string(t[1:n], ' ') AS short, 'a prefix' AS how, 2*n AS o FROM t, UNNEST(range(1, len(t))) u(n) UNION ALL SELECT long, array_to_string(t[len(t)-n+1:], ' '), 'a suffix', 2*n+1 FROM t, UNNEST(range(1, len(t))) u(n)
  UNION ALL SELECT long, array_to_string(list_transform(t, lambda w: left(w, 1)), ''), 'an acronym', 1000000 FROM t),
 p AS (SELECT short, long, arg_min(how, o) AS how FROM f WHERE length(short) >= 2 AND short IN (SELECT entity FROM stats) GROUP BY 1, 2),
 ss AS (SELECT DISTINCT entity, session_id FROM mentions JOIN turns ON id = turn_id), sn AS (SELECT entity, count(*) AS n FROM ss GROUP BY 1),
 sh AS (SELECT short, long, count(*) AS shared FROM p JOIN ss a ON a.entity = short JOIN ss b ON b.entity = long AND b.session_id = a.session_id GROUP BY 1, 2),
 nr AS (SELECT entity, list(other) AS near FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY turns DESC, other) AS r FROM adj) WHERE r <= 20 GROUP BY 1),
 x AS (SELECT p.*, coalesce(shared, 0) AS shared, least(a.n, b.n) AS m, list_filter(coalesce(na.near, []), lambda k: k <> long) AS s1, list_filter(coalesce(nb.near, []), lambda k: k <> short) AS s2 FROM p
  JOIN sn a ON a.entity = short JOIN sn b ON b.entity = long LEFT JOIN sh USING (short, long) LEFT JOIN nr na ON na.entity = short LEFT JOIN nr nb ON nb.entity = long),
 y AS (SELECT *, len(list_intersect(s1, s2)) AS i, len(s1) + len(s2) - len(list_intersect(s1, s2)) AS un FROM x)
 SELECT short, long, round(0.5 * shared / m + 0.5 * (CASE WHEN un = 0 THEN 0 ELSE i / un END), 3) AS score FROM y""")
def _(spark, sf):
    turns = adapters.conversation_turns(spark, sf)
    rows = extract_mentions(runtime.spread_scan(turns)).persist()
    return finders.alias_candidates(graph.entity_stats(rows, turns), rows, turns, graph.edges(rows)).select("short", "long", "score")


@query("consolidation", f"""WITH {_segments_sql('user_id%5')}, ep AS (SELECT * FROM segments WHERE level = 'episode' AND turns >= 8 AND end_ts <= (SELECT max(ts) FROM turns) - 604800000),
 h AS (SELECT s.session_id, s.start_ts, s.end_ts, s.last_turn_id, count(*) AS n, bool_or(x.value > 450) AS any_covered FROM ep s JOIN turns t ON t.session_id = s.session_id
  AND t.ts BETWEEN s.start_ts AND s.end_ts JOIN events x ON x.event_id = t.id GROUP BY ALL)
 SELECT session_id, start_ts, end_ts, last_turn_id, n, round(least(n / 30, 1.0), 3) AS score FROM h WHERE n >= 8 AND NOT any_covered""")
def _(spark, sf):
    turns = adapters.event_turns(spark, sf)
    notes = adapters.table(spark, sf, "events").where("value > 450").select(F.col("event_id").alias("turn_id"))
    cutoff = turns.agg(F.max("ts")).first()[0] - 604_800_000
    found = finders.consolidation(timeline.segments(turns), turns.withColumn("kind", F.lit("turn")), None, notes, cutoff=cutoff)
    return found.select("session_id", "start_ts", "end_ts", "last_turn_id", "n", "score")


_BRIEFED = f"""{sql.TURNS}, b AS (SELECT *, CASE WHEN speaker = 'system' AND scope <> '' THEN 'brief' ELSE 'turn' END AS kind FROM turns)"""


def _briefed(spark, sf) -> DataFrame:
    brief = (F.col("speaker") == "system") & (F.col("scope") != "")
    return adapters.conversation_turns(spark, sf).withColumn("kind", F.when(brief, "brief").otherwise("turn"))


@query("current_brief", f"WITH {_BRIEFED} SELECT scope, arg_max(id, (ts, id)) AS id FROM b WHERE kind = 'brief' GROUP BY 1")
def _(spark, sf):
    return finders.current_briefs(_briefed(spark, sf)).select("scope", "id")


@query("brief_staleness", f"""WITH {_BRIEFED}, bt AS (SELECT scope, max(ts) AS bts FROM b WHERE kind = 'brief' GROUP BY 1),
 s AS (SELECT b.scope, count(*) AS turns, max(bts) AS bts, count(*) FILTER (WHERE ts > bts) AS newer FROM b LEFT JOIN bt USING (scope) WHERE kind = 'turn' GROUP BY 1)
 SELECT scope, CASE WHEN bts IS NULL THEN 1.0 ELSE round(least(newer / 200.0, 0.99), 3) END AS score FROM s WHERE bts IS NULL OR newer >= 50""")
def _(spark, sf):
    return finders.brief_staleness(_briefed(spark, sf)).select("scope", "score")


@query("brief_samples", f"""WITH {_BRIEFED}, r AS (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY ts DESC, id DESC) AS rank FROM b WHERE kind = 'turn')
 SELECT * FROM r WHERE rank <= 5""")
def _(spark, sf):
    return finders.brief_samples(_briefed(spark, sf)).select("scope", "id", "rank")
