"""Turn store: sessions, paging, growth, ingest, identity, the time hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import dates, hashing, text
from colloquy.operators import ingest, sessions, timeline
from colloquy.operators.ordered import Ordered
from colloquy.sources import adapters
from colloquy.suite import sql
from colloquy.suite.registry import query

T0 = adapters.ORIGIN_MS
DAY = 86_400_000
SINCE, UNTIL = T0 + DAY, T0 + 3 * DAY


@query("session_summaries", f"""WITH {sql.TURNS} SELECT session_id, count(*) AS turns, min(ts) AS first_ts,
 max(ts) AS last_ts, max(scope) AS scope FROM turns GROUP BY session_id""")
def _(spark, sf):
    return sessions.session_summaries(adapters.conversation_turns(spark, sf))


@query("sessions_between", f"""WITH {sql.TURNS} SELECT session_id, count(*) AS turns, min(ts) AS first_ts,
 max(ts) AS last_ts, max(scope) AS scope FROM turns WHERE scope = 'project:1' GROUP BY session_id
 HAVING max(ts) >= {SINCE} AND min(ts) <= {UNTIL} ORDER BY max(ts) DESC, session_id LIMIT 50""")
def _(spark, sf):
    rows = sessions.sessions_between(adapters.conversation_turns(spark, sf), SINCE, UNTIL, "project:1")
    return sessions.page(rows, sessions.newest_sessions_first(), 50)


@query("sessions_between_total", f"""WITH {sql.TURNS} SELECT count(*) AS total FROM (SELECT session_id FROM turns
 GROUP BY session_id HAVING max(ts) >= {SINCE} AND min(ts) <= {UNTIL})""")
def _(spark, sf):
    rows = sessions.sessions_between(adapters.conversation_turns(spark, sf), SINCE, UNTIL)
    return rows.agg(F.count(F.lit(1)).alias("total"))


@query("scope_summaries", f"""WITH {sql.TURNS} SELECT scope, count(*) AS turns, count(DISTINCT session_id) AS sessions
 FROM turns GROUP BY scope HAVING (SELECT max(scope) FROM turns) <> ''""")
def _(spark, sf):
    return sessions.scope_summaries(adapters.conversation_turns(spark, sf))


@query("growth", f"""WITH {sql.TURNS}, d AS (SELECT strftime(to_timestamp(ts//1000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day,
 count(*) AS turns, count(DISTINCT session_id) AS sessions FROM turns GROUP BY 1)
 SELECT *, sum(turns) OVER (ORDER BY day)::BIGINT AS cumulative_turns FROM d""")
def _(spark, sf):
    return sessions.growth(adapters.conversation_turns(spark, sf))


@query("growth_range", f"""WITH {sql.TURNS}, d AS (SELECT strftime(to_timestamp(ts//1000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day,
 count(*) AS turns, count(DISTINCT session_id) AS sessions FROM turns WHERE ts BETWEEN {SINCE} AND {UNTIL} GROUP BY 1)
 SELECT *, sum(turns) OVER (ORDER BY day)::BIGINT AS cumulative_turns FROM d""")
def _(spark, sf):
    return sessions.growth(adapters.conversation_turns(spark, sf), SINCE, UNTIL)


@query("latest_ts", f"WITH {sql.TURNS} SELECT max(ts) AS latest_ts FROM turns")
def _(spark, sf):
    return sessions.latest_ts(adapters.conversation_turns(spark, sf))


@query("session_rank", f"""WITH {sql.TURNS} SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) - 1
 AS position, count(*) OVER (PARTITION BY session_id) AS total FROM turns""")
def _(spark, sf):
    return sessions.session_positions(adapters.conversation_turns(spark, sf)).select("id", "position", "total")


@query("session_pages", f"""WITH {sql.TURNS}, r AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id
 ORDER BY ts, id) AS n FROM turns) SELECT session_id, id FROM r WHERE n BETWEEN 3 AND 5""")
def _(spark, sf):
    placed = sessions.session_positions(adapters.conversation_turns(spark, sf))
    return placed.where(F.col("position").between(2, 4)).select("session_id", "id")


@query("session_page", f"""WITH {sql.DOC_TURNS}, s AS (SELECT * FROM turns WHERE session_id = (SELECT min(session_id) FROM turns))
 SELECT id, session_id, ts, (SELECT count(*) FROM s) AS total, 5 AS "offset", 15 < (SELECT count(*) FROM s) AS truncated
 FROM s ORDER BY ts, id LIMIT 10 OFFSET 5""")
def _(spark, sf):
    turns = adapters.document_turns(spark, sf)
    first = turns.agg(F.min("session_id")).first()[0]
    return sessions.session_page(turns, first, 10, 5).select("id", "session_id", "ts", "total", "offset", "truncated")


@query("session_window", f"""WITH {sql.TURNS}, r AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, id)
 - 1 AS p, count(*) OVER (PARTITION BY session_id) AS total FROM turns),
 w AS (SELECT a.id AS hit_id, b.id, a.total, min(b.p) OVER (PARTITION BY a.id) AS "offset", count(*) OVER (PARTITION BY a.id) < a.total
 AS truncated FROM r a JOIN r b ON a.session_id = b.session_id AND b.p BETWEEN a.p - 5 AND a.p + 5) SELECT * FROM w""")
def _(spark, sf):
    turns = adapters.conversation_turns(spark, sf).drop("text")
    return sessions.window_around(turns, turns.select(F.col("id").alias("hit_id"))).select(
        "hit_id", "id", "total", "offset", "truncated"
    )


@query("session_neighbours", f"""WITH {sql.TURNS}, r AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id
 ORDER BY ts, id) AS p FROM turns) SELECT a.id AS hit_id, b.id, CASE WHEN b.p < a.p THEN 'before' ELSE 'after' END AS side,
 abs(b.p - a.p) AS dist FROM r a JOIN r b ON a.session_id = b.session_id AND b.p BETWEEN a.p - 2 AND a.p + 2 AND a.p <> b.p""")
def _(spark, sf):
    turns = adapters.conversation_turns(spark, sf).drop("text")
    near = sessions.neighbours_of(turns, turns.select(F.col("id").alias("hit_id")), 2, 2)
    return near.where("dist > 0").select("hit_id", "id", "side", F.col("dist").cast("long").alias("dist"))


@query("recent_view", f"WITH {sql.TURNS} SELECT id, ts FROM turns ORDER BY ts DESC, id DESC LIMIT 50")
def _(spark, sf):
    return sessions.recent(adapters.conversation_turns(spark, sf)).select("id", "ts")


@query("stride_sample", """WITH n AS (SELECT greatest(1, count(*)//100) AS stride FROM embeddings)
 SELECT vec_id FROM embeddings WHERE vec_id % (SELECT stride FROM n) = 0 ORDER BY vec_id LIMIT 100""")
def _(spark, sf):
    return sessions.stride_sample(adapters.table(spark, sf, "embeddings"), 100, "vec_id").select("vec_id")


@query("even_sample", """WITH r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p, count(*) OVER () AS n FROM benchmark),
 s AS (SELECT (i * (SELECT max(n) FROM r)) // 15 AS p FROM range(15) t(i)) SELECT item_id FROM r JOIN s USING (p)""")
def _(spark, sf):
    return sessions.even_sample(adapters.table(spark, sf, "benchmark"), ["item_id"], 15).select("item_id")


def _inputs(spark, sf):
    """Labeled documents as raw turns: unlabeled ones lack a speaker, copies lack everything of their own."""
    docs, labels = adapters.table(spark, sf, "documents"), adapters.table(spark, sf, "labels")
    speaker = F.when(F.col("quality") == 1, "user").when(F.col("quality") == 0, "assistant").otherwise(" ")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("seq"), F.lit("all").alias("session_id"), speaker.alias("speaker"), "text",
        F.lit(None).cast("long").alias("ts"), F.lit(None).cast("string").alias("uuid"),
        F.concat(F.lit(" "), F.col("source"), F.lit(" ")).alias("scope"),
    )


_INPUT_SQL = """i AS (SELECT doc_id AS seq, CASE quality WHEN 1 THEN 'user' WHEN 0 THEN 'assistant' END AS speaker, text, source AS scope
 FROM documents LEFT JOIN labels USING (doc_id)),
 v AS (SELECT *, sha256(encode('all') || '\\x00'::BLOB || encode(speaker) || '\\x00'::BLOB || encode(text) || '\\x00'::BLOB) AS h
 FROM i WHERE speaker IS NOT NULL AND regexp_matches(text, '\\S')),
 f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY seq) AS n FROM v)"""


@query("ingest_dedup", f"""WITH {_INPUT_SQL} SELECT row_number() OVER (ORDER BY seq) AS id, substr(h,1,8)||'-'||substr(h,9,4)||'-'||
 substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS uuid, speaker, scope, md5(text) AS digest FROM f WHERE n = 1""")
def _(spark, sf):
    done = ingest.ingest(_inputs(spark, sf), None, 0)
    return done.turns.select("id", "uuid", "speaker", "scope", F.md5("text").alias("digest"))


@query("ingest_report", f"""WITH {_INPUT_SQL} SELECT (SELECT count(*) FROM f WHERE n = 1) AS indexed,
 (SELECT count(*) FROM f WHERE n > 1) AS duplicates, (SELECT count(*) FROM i) - (SELECT count(*) FROM v) AS rejected""")
def _(spark, sf):
    return ingest.ingest(_inputs(spark, sf), None, 0).report


@query("ingest_again", f"""WITH {_INPUT_SQL}, s AS (SELECT DISTINCT h FROM f WHERE seq % 2 = 0)
 SELECT count(*) FILTER (WHERE n = 1 AND h NOT IN (SELECT h FROM s)) AS indexed,
 count(*) FILTER (WHERE NOT (n = 1 AND h NOT IN (SELECT h FROM s))) AS duplicates,
 (SELECT count(*) FROM i) - (SELECT count(*) FROM v) AS rejected FROM f""")
def _(spark, sf):
    """The whole table again, over a store that already holds every other row."""
    inputs = _inputs(spark, sf)
    stored = ingest.with_identity(inputs.where("seq % 2 = 0"), 0).where("reason IS NULL").select(
        F.col("seq").alias("id"), "uuid"
    ).dropDuplicates(["uuid"])
    return ingest.ingest(inputs, stored, 0).report


@query("derived_uuid", f"""WITH {sql.TURNS}, x AS (SELECT id, session_id, speaker, text, format('{{:016x}}', ts) AS z FROM turns),
 h AS (SELECT id, sha256(encode(session_id) || '\\x00'::BLOB || encode(speaker) || '\\x00'::BLOB || encode(text) || '\\x00'::BLOB ||
 unhex(substr(z,15,2)||substr(z,13,2)||substr(z,11,2)||substr(z,9,2)||substr(z,7,2)||substr(z,5,2)||substr(z,3,2)||substr(z,1,2))) AS h FROM x)
 SELECT id, substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS uuid FROM h""")
def _(spark, sf):
    c = F.col
    return adapters.conversation_turns(spark, sf).select(
        "id", hashing.derived_uuid(c("session_id"), c("speaker"), c("text"), c("ts")).alias("uuid")
    )


@query("note_uuid", f"""WITH {sql.TURNS}, s AS (SELECT session_id, list_sort(list(uuid)) AS u FROM turns GROUP BY 1),
 h AS (SELECT session_id, sha256(unhex(hex(encode('note')) || '00' || replace(hex(encode(array_to_string(u, '|'))), '7C', '00') || '00')) AS g FROM s)
 SELECT session_id, substr(g,1,8)||'-'||substr(g,9,4)||'-'||substr(g,13,4)||'-'||substr(g,17,4)||'-'||substr(g,21,12) AS uuid FROM h""")
def _(spark, sf):
    # One conversation's turns are the sources of one note.
    return adapters.conversation_turns(spark, sf).groupBy("session_id").agg(F.collect_list("uuid").alias("u")).select(
        "session_id", hashing.note_uuid(F.col("u")).alias("uuid")
    )


@query("scope_fill", """SELECT doc_id, coalesce(nullif(trim(CASE WHEN lang = 'en' THEN ' ' || source || ' ' ELSE '  ' END), ''), 'inbox') AS scope FROM documents""")
def _(spark, sf):
    raw = F.when(F.col("lang") == "en", F.concat(F.lit(" "), F.col("source"), F.lit(" "))).otherwise("  ")
    return adapters.table(spark, sf, "documents").select("doc_id", ingest.fill_scope(raw, "inbox").alias("scope"))


@query("forget_session", f"""WITH {sql.TURNS} SELECT session_id, count(*) AS turns, min(ts) AS first_ts, max(ts) AS last_ts,
 max(scope) AS scope FROM turns WHERE session_id <> 'c7' GROUP BY session_id""")
def _(spark, sf):
    kept, _ = ingest.forget_session(adapters.conversation_turns(spark, sf), "c7")
    return sessions.session_summaries(kept)


_VEC_SQL = """v AS (SELECT vec_id % 200 AS turn_id, vec_id AS seq, CASE WHEN label < 8 THEN 'm1' ELSE 'm2' END AS model FROM embeddings)"""


def _vectors(spark, sf):
    return adapters.table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 200).alias("turn_id"), F.when(F.col("label") < 8, "m1").otherwise("m2").alias("model"),
        F.col("vec_id").alias("seq"), F.col("embedding").alias("vec"),
    )


@query("upsert_vectors", f"WITH {_VEC_SQL} SELECT turn_id, model, max(seq) AS seq FROM v GROUP BY 1, 2")
def _(spark, sf):
    rows = _vectors(spark, sf)
    return ingest.upsert_vectors(rows.where("seq % 3 = 0"), rows.where("seq % 3 > 0")).select("turn_id", "model", "seq")


@query("vectors_after", f"WITH {_VEC_SQL} SELECT turn_id, seq FROM v WHERE model = 'm1' AND seq > 50")
def _(spark, sf):
    return ingest.vectors_after(_vectors(spark, sf), 50, "m1", 64).select("turn_id", "seq")


@query("vector_backlog", f"""WITH {_VEC_SQL} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN
 (SELECT turn_id FROM v WHERE model = 'm2')""")
def _(spark, sf):
    return ingest.without_vector(adapters.document_turns(spark, sf), _vectors(spark, sf), "m2").select("id")


@query("growth_month_index", f"""WITH {sql.TURNS}, m AS (SELECT id, to_timestamp(ts//1000) AT TIME ZONE 'UTC' AS said FROM turns)
 SELECT id, year(said)*12 + month(said) - 1 AS month FROM m""")
def _(spark, sf):
    return adapters.conversation_turns(spark, sf).select("id", dates.month_index(F.col("ts")).alias("month"))


def _segments_sql(session: str) -> str:
    return f"""{sql.events(session)},
 g AS (SELECT *, lag(ts) OVER w AS prev, row_number() OVER w AS rn FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)),
 r AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, id
  ROWS UNBOUNDED PRECEDING) AS run FROM g),
 p AS (SELECT *, (rn - min(rn) OVER (PARTITION BY session_id, run)) // 50 AS part FROM r),
 kc AS (SELECT session_id, run, part, entity, count(*) AS n FROM (SELECT session_id, run, part, UNNEST(keys) AS entity FROM p) GROUP BY ALL),
 k8 AS (SELECT session_id, run, part, list(entity ORDER BY n DESC, entity) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY
  session_id, run, part ORDER BY n DESC, entity) AS k FROM kc) WHERE k <= 8 GROUP BY ALL),
 w AS (SELECT session_id, run, part, min(ts) AS start_ts, max(ts) AS end_ts, arg_min(id, (ts, id)) AS first_turn_id,
  arg_max(id, (ts, id)) AS last_turn_id, count(*) AS turns FROM p GROUP BY ALL),
 wk AS (SELECT w.*, entities FROM w JOIN k8 USING (session_id, run, part)),
 wl AS (SELECT *, lag(entities) OVER (PARTITION BY session_id ORDER BY run, part) AS before FROM wk),
 we AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND len(list_intersect(before, entities)) / (len(before) + len(entities) -
  len(list_intersect(before, entities))) < 0.15 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY run, part
  ROWS UNBOUNDED PRECEDING) AS episode FROM wl),
 ec AS (SELECT session_id, episode, entity, sum(n) AS n FROM kc JOIN we USING (session_id, run, part) GROUP BY ALL),
 e8 AS (SELECT session_id, episode, list(entity ORDER BY n DESC, entity) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY
  session_id, episode ORDER BY n DESC, entity) AS k FROM ec) WHERE k <= 8 GROUP BY ALL),
 e AS (SELECT session_id, episode, min(start_ts) AS start_ts, max(end_ts) AS end_ts, arg_min(first_turn_id, (start_ts, first_turn_id))
  AS first_turn_id, arg_max(last_turn_id, (end_ts, last_turn_id)) AS last_turn_id, sum(turns)::BIGINT AS turns FROM we GROUP BY ALL),
 segments AS (SELECT 'window' AS level, session_id, start_ts, end_ts, first_turn_id, last_turn_id, turns, entities FROM wk
  UNION ALL SELECT 'episode', session_id, start_ts, end_ts, first_turn_id, last_turn_id, turns, entities FROM e JOIN e8 USING (session_id, episode))"""


def _register_segments(name: str, session_sql: str, session) -> None:
    @query(name, f"""WITH {_segments_sql(session_sql)} SELECT level, session_id, start_ts, end_ts, first_turn_id, last_turn_id,
 turns, array_to_string(entities, ',') AS entities FROM segments""")
    def _(spark, sf):
        rows = timeline.segments(adapters.event_turns(spark, sf, session()))
        return rows.withColumn("entities", F.array_join("entities", ","))


_register_segments("segments_few_sessions", "user_id%5", lambda: F.col("user_id") % 5)
_register_segments("segments_by_user", "user_id", lambda: F.col("user_id"))
_register_segments("segments_one_session", "0", lambda: F.lit(0))


@query("gap_runs", f"""WITH {_segments_sql('user_id')} SELECT session_id, count(*) AS runs, max(n) AS longest FROM (SELECT session_id, run,
 count(*) AS n FROM p GROUP BY ALL) GROUP BY 1""")
def _(spark, sf):
    runs = timeline.window_numbers(adapters.event_turns(spark, sf, F.col("user_id"))).groupBy("session_id", "run").count()
    return runs.groupBy("session_id").agg(F.count(F.lit(1)).alias("runs"), F.max("count").alias("longest"))


@query("window_numbers_sliced", f"""WITH {_segments_sql('0')} SELECT id, run::BIGINT AS run, part FROM p""")
def _(spark, sf):
    """One session holds every row, so the scan is cut into slices and the state carried over."""
    turns = adapters.event_turns(spark, sf, F.lit(0)).select("id", "session_id", "ts")
    return timeline.window_numbers(turns, hot_rows=1000).select("id", "run", "part")


@query("hierarchy", f"""WITH {_segments_sql('user_id%5')}, hs AS (SELECT session_id, count(*) AS turns, min(ts) AS first_ts, max(ts) AS last_ts
 FROM turns GROUP BY 1), hg AS (SELECT session_id, count(*) FILTER (WHERE level = 'window') AS windows, count(*) FILTER (WHERE level = 'episode')
 AS episodes, min(last_turn_id) FILTER (WHERE level = 'window') AS first_window_end FROM segments GROUP BY 1)
 SELECT session_id, turns, first_ts, last_ts, windows, episodes, first_window_end, (SELECT count(*) FROM hs) AS total_sessions
 FROM hs JOIN hg USING (session_id) ORDER BY last_ts DESC, session_id LIMIT 50""")
def _(spark, sf):
    turns = adapters.event_turns(spark, sf)
    tree = sessions.hierarchy(turns.withColumn("scope", F.lit("")), timeline.segments(turns))
    return tree.select(
        "session_id", "turns", "first_ts", "last_ts", F.size("windows").cast("long").alias("windows"),
        F.size("episodes").cast("long").alias("episodes"), F.array_min(F.col("windows.last_turn_id")).alias("first_window_end"),
        "total_sessions",
    )


@query("text_tokens", f"""SELECT doc_id, len({sql.words()}) AS n_words, md5(array_to_string({sql.words()}, ' ')) AS words,
 md5(array_to_string({sql.norms()}, ' ')) AS normalised, md5(array_to_string({sql.stems()}, ' ')) AS stems,
 md5(array_to_string({sql.content()}, ' ')) AS content, (length(text) + 3) // 4 AS tokens FROM documents""")
def _(spark, sf):
    t = F.col("text")
    return adapters.table(spark, sf, "documents").select(
        "doc_id", F.size(text.words(t)).cast("long").alias("n_words"), F.md5(F.array_join(text.words(t), " ")).alias("words"),
        F.md5(text.normalised_text(t)).alias("normalised"), F.md5(F.array_join(text.stems(t), " ")).alias("stems"),
        F.md5(F.array_join(text.content_words(t), " ")).alias("content"), text.token_estimate(t).alias("tokens"),
    )


@query("clip_text", "SELECT doc_id, md5(CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END) AS clipped FROM documents")
def _(spark, sf):
    return adapters.table(spark, sf, "documents").select("doc_id", F.md5(text.clip(F.col("text"), 300)).alias("clipped"))


@query("question_tokens", f"""SELECT item_id, array_to_string({sql.tokens('text')}, ' ') AS tokens FROM benchmark""")
def _(spark, sf):
    return adapters.table(spark, sf, "benchmark").select(
        "item_id", F.array_join(text.question_tokens(F.col("text")), " ").alias("tokens")
    )


@query("ngram_keys", f"""WITH q AS (SELECT 'b'||item_id AS query_id, trim(regexp_replace(text,
 '\\s+', ' ', 'g')) AS query FROM benchmark), k AS (SELECT DISTINCT query_id, key FROM (SELECT query_id,
 UNNEST(list_concat({sql.grams(4)}, list_concat({sql.grams(3)}, list_concat({sql.grams(2)}, {sql.grams(1)})))) AS key FROM q) WHERE length(key) >= 2)
 SELECT * FROM k""")
def _(spark, sf):
    asked = adapters.benchmark_queries(spark, sf)
    return asked.select("query_id", F.explode(text.candidate_keys(F.col("query"))).alias("key"))


@query("cue_words", """SELECT id, regexp_matches(lower(t), '(^|[^\\p{L}\\p{N}])(?:click|error)($|[^\\p{L}\\p{N}])') AS hit FROM
 (SELECT event_id AS id, event_type || ' ' || props AS t FROM events)""")
def _(spark, sf):
    return adapters.table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        text.any_phrase(F.lower(F.concat_ws(" ", "event_type", "props")), ["click", "error"]).alias("hit"),
    )


@query("prompt_text", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)),
 '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '^\s+', ''), '\s+$', '')) AS prompt FROM documents""")
def _(spark, sf):
    return adapters.table(spark, sf, "documents").select("doc_id", F.md5(text.prompt_text(F.col("text"))).alias("prompt"))


@query("ordered_rank_sliced", """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS n,
 sum(user_id) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run_sum FROM events""")
def _(spark, sf):
    rows = adapters.table(spark, sf, "events").select("event_id", "event_type", "value", "user_id")
    return Ordered.of(rows, ["event_type"], ["value", "event_id"], hot_rows=1000).rank("n").running_sum(
        "run_sum", F.col("user_id")
    ).done().select("event_id", "n", "run_sum")
