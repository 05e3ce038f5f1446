"""Ranking metrics, abstention, comparisons, and operational health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import runtime
from colloquy.curation.log import oracle_supersession
from colloquy.operators import evaluation, health
from colloquy.operators.ordered import Ordered
from colloquy.sources import adapters
from colloquy.suite.registry import query

# Sources are the questions; their documents ranked by length (a) and by number (b); labels are the grades.
RANKED = """a AS (SELECT source AS query_id, doc_id AS uuid, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
 b AS (SELECT source AS query_id, doc_id AS uuid, row_number() OVER (PARTITION BY source ORDER BY n_chars // 50 DESC, doc_id DESC) AS rank FROM documents),
 l AS (SELECT source AS query_id, doc_id AS uuid, 1 + quality AS grade FROM labels JOIN documents USING (doc_id)),
 qs AS (SELECT source AS query_id, min(lang) AS kind FROM documents GROUP BY 1)"""


def _score_sql(side: str, k: int = 10) -> str:
    return f"""id_{side} AS (SELECT query_id, least(count(*), {k}) AS reachable, sum(CASE WHEN i <= {k} THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS idcg
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, uuid) AS i FROM l) GROUP BY 1),
 f_{side} AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM {side} JOIN l USING (query_id, uuid) WHERE rank <= {k} GROUP BY 1),
 s_{side} AS (SELECT query_id, kind, coalesce(hits / reachable, 0) AS recall, coalesce(1.0 / first, 0) AS rr, coalesce(dcg / nullif(idcg, 0), 0) AS ndcg
 FROM qs LEFT JOIN id_{side} USING (query_id) LEFT JOIN f_{side} USING (query_id))"""


def _frames(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = adapters.table(spark, sf, "documents").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("uuid"), "n_chars", "lang"
    )
    a = Ordered.of(docs, ["query_id"], ["-n_chars", "uuid"]).rank("rank").done().select("query_id", "uuid", "rank")
    coarse = docs.withColumn("size", F.floor(F.col("n_chars") / 50))
    b = Ordered.of(coarse, ["query_id"], ["-size", "-uuid"]).rank("rank").done().select("query_id", "uuid", "rank")
    labels = adapters.table(spark, sf, "labels").select(F.col("doc_id").alias("uuid"), (F.col("quality") + 1).alias("grade"))
    queries = docs.groupBy("query_id").agg(F.min("lang").alias("kind"))
    return a, b, docs.select("query_id", "uuid").join(labels, "uuid"), queries


@query("ranking_scores", f"""WITH {RANKED}, {_score_sql('a')} SELECT query_id, round(recall, 6) AS recall, round(rr, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM s_a""")
def _(spark, sf):
    a, _, labels, queries = _frames(spark, sf)
    rows = evaluation.query_scores(a, labels, queries, 10)
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


@query("ranking_summary_by_kind", f"""WITH {RANKED}, {_score_sql('a')} SELECT coalesce(kind, 'all') AS kind, count(*) AS queries, round(avg(recall), 6) AS recall_at_k,
 round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_at_k FROM s_a GROUP BY GROUPING SETS ((kind), ())""")
def _(spark, sf):
    a, _, labels, queries = _frames(spark, sf)
    rows = evaluation.summarise(evaluation.query_scores(a, labels, queries, 10), "kind")
    return rows.select("kind", "queries", *[F.round(c, 6).alias(c) for c in ("recall_at_k", "mrr", "ndcg_at_k")])


@query("ranker_agreement", f"""WITH {RANKED}, x AS (SELECT * FROM a WHERE rank <= 10), y AS (SELECT * FROM b WHERE rank <= 10),
 z AS (SELECT query_id, count(*) AS n, corr(x.rank, y.rank) AS rho FROM x JOIN y USING (query_id, uuid) GROUP BY 1),
 na AS (SELECT query_id, count(*) AS n FROM x GROUP BY 1), nb AS (SELECT query_id, count(*) AS n FROM y GROUP BY 1)
 SELECT na.query_id, round(coalesce(z.n, 0) / greatest(na.n, nb.n), 6) AS overlap, CASE WHEN z.n >= 2 THEN round(rho, 6) END AS spearman
 FROM na JOIN nb USING (query_id) LEFT JOIN z USING (query_id)""")
def _(spark, sf):
    a, b, _, _ = _frames(spark, sf)
    return evaluation.agreement(a, b, 10).select("query_id", F.round("overlap", 6).alias("overlap"), F.round("spearman", 6).alias("spearman"))


@query("ranker_comparison", f"""WITH {RANKED}, {_score_sql('a')}, {_score_sql('b')} SELECT (SELECT count(*) FROM qs) AS queries,
 (SELECT round(avg(recall), 6) FROM s_a) AS left_recall_at_k, (SELECT round(avg(ndcg), 6) FROM s_a) AS left_ndcg_at_k,
 (SELECT round(avg(recall), 6) FROM s_b) AS right_recall_at_k, (SELECT round(avg(ndcg), 6) FROM s_b) AS right_ndcg_at_k""")
def _(spark, sf):
    a, b, labels, queries = _frames(spark, sf)
    row = evaluation.compare(queries, labels, a, b, 10)
    cols = [f"{s}_{m}" for s in ("left", "right") for m in ("recall_at_k", "ndcg_at_k")]
    return row.select("queries", *[F.round(c, 6).alias(c) for c in cols])


@query("evidence_diff", f"""WITH {RANKED}, x AS (SELECT * FROM a WHERE rank <= 20), y AS (SELECT * FROM b WHERE rank <= 20)
 SELECT query_id, uuid, x.rank AS rank_a, y.rank AS rank_b, CASE WHEN y.rank IS NULL THEN 'only a' WHEN x.rank IS NULL THEN 'only b' WHEN x.rank = y.rank THEN 'shared' ELSE 'moved' END AS state
 FROM x FULL JOIN y USING (query_id, uuid)""")
def _(spark, sf):
    a, b, _, _ = _frames(spark, sf)
    x, y = (r.where("rank <= 20").withColumn("score", 1 / F.col("rank")) for r in (a, b))
    return evaluation.evidence_diff(x, y).select("query_id", "uuid", "rank_a", "rank_b", "state")


@query("abstention_auc", """WITH o AS (SELECT quality = 1 AS yes, round(n_chars / 1000.0, 1) AS best, doc_id % 11 = 0 AS gone, toxic = 1 AS abst FROM labels JOIN documents USING (doc_id)),
 p AS (SELECT coalesce(CASE WHEN NOT gone THEN best END, 0) AS s, yes, NOT gone AND NOT abst AS ans FROM o)
 SELECT (SELECT count(*) FROM p WHERE NOT yes) AS queries, round((SELECT avg(ans::INT) FROM p WHERE NOT yes), 6) AS answered, round((SELECT avg((NOT ans)::INT) FROM p WHERE yes), 6) AS withheld,
 (SELECT round(avg(CASE WHEN a.s > u.s THEN 1 WHEN a.s = u.s THEN 0.5 ELSE 0 END), 6) FROM p a, p u WHERE a.yes AND NOT u.yes) AS auc""")
def _(spark, sf):
    docs, labels = adapters.table(spark, sf, "documents"), adapters.table(spark, sf, "labels")
    rows = labels.join(docs, "doc_id").select(
        (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 1).alias("abstained"),
        F.when(F.col("doc_id") % 11 != 0, F.round(F.col("n_chars") / 1000, 1)).alias("best"),
    )
    return evaluation.abstention(rows).select("queries", *[F.round(c, 6).alias(c) for c in ("answered", "withheld", "auc")])


@query("grading_references", f"""WITH {RANKED}, m AS (SELECT query_id, max(grade) AS g FROM l GROUP BY 1) SELECT l.query_id, uuid, grade FROM l JOIN m USING (query_id) WHERE g < 2 OR grade >= 2""")
def _(spark, sf):
    return evaluation.references(_frames(spark, sf)[2])


@query("oracle_supersession", """WITH l AS (SELECT source AS query_id, doc_id AS id, 1 + quality AS grade FROM labels JOIN documents USING (doc_id)), n AS (SELECT query_id, max(id) AS nxt FROM l WHERE grade = 2 GROUP BY 1)
 SELECT query_id, max(nxt) AS by, count(*) AS replaced, min(id) AS oldest FROM l JOIN n USING (query_id) WHERE grade = 1 GROUP BY 1""")
def _(spark, sf):
    labels = _frames(spark, sf)[2].withColumns({"seq": F.xxhash64("query_id"), "uuid": F.concat(F.lit("d"), "uuid")})
    rows = oracle_supersession(labels, adapters.document_turns(spark, sf))
    return rows.select("query_id", "by", F.size("turn_ids").cast("long").alias("replaced"), F.array_min("turn_ids").alias("oldest"))


@query("tokens_per_answer", """WITH a AS (SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
 SELECT round(sum((length(text) + 3) // 4) / (SELECT count(*) FROM benchmark), 6) AS tokens_per_answer FROM a""")
def _(spark, sf):
    good = adapters.table(spark, sf, "documents").join(adapters.table(spark, sf, "labels").where("quality = 1"), "doc_id")
    row = evaluation.tokens_per_answer(good, adapters.table(spark, sf, "benchmark"))
    return row.select(F.round("tokens_per_answer", 6).alias("tokens_per_answer"))


@query("verdict_summary", """WITH r AS (SELECT CASE lang WHEN 'en' THEN 'current' WHEN 'fr' THEN 'history' WHEN 'de' THEN 'as_of' ELSE 'abstain' END AS ask, quality, toxic, doc_id, n_chars,
 CASE WHEN doc_id % 13 = 0 THEN 'error' WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'abstained' ELSE 'wrong' END AS verdict FROM labels JOIN documents USING (doc_id)),
 x AS (SELECT *, CASE WHEN ask = 'abstain' THEN verdict = 'abstained' ELSE verdict = 'correct' END AS ok FROM r)
 SELECT coalesce(ask, 'all') AS ask, count(*) AS questions, count(*) FILTER (WHERE ok) AS "right", count(*) FILTER (WHERE verdict = 'wrong') AS wrong,
 count(*) FILTER (WHERE verdict = 'abstained') AS abstained, count(*) FILTER (WHERE verdict = 'error') AS errors,
 round(coalesce(count(*) FILTER (WHERE ok) / nullif(count(*) - count(*) FILTER (WHERE verdict = 'error'), 0), 0), 6) AS accuracy, round(avg(n_chars), 4) AS prompt_tokens_mean
 FROM x GROUP BY GROUPING SETS ((ask), ())""")
def _(spark, sf):
    rows = adapters.table(spark, sf, "labels").join(adapters.table(spark, sf, "documents"), "doc_id")
    ask = F.when(F.col("lang") == "en", "current").when(F.col("lang") == "fr", "history").when(F.col("lang") == "de", "as_of").otherwise("abstain")
    verdict = F.when(F.col("doc_id") % 13 == 0, "error").when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, "abstained").otherwise("wrong")
    results = rows.select(
        ask.alias("ask"), verdict.alias("verdict"), evaluation.is_right(F.when(ask == "abstain", 0).otherwise(1), verdict).alias("right"),
        F.lit(False).alias("cut_off"), F.lit(1).alias("tool_calls"), F.col("n_chars").alias("prompt_tokens"),
    )
    return evaluation.verdict_summary(results).select(
        "ask", "questions", "right", "wrong", "abstained", "errors", F.round("accuracy", 6).alias("accuracy"), F.round("prompt_tokens_mean", 4).alias("prompt_tokens_mean")
    )


def _log(spark, sf) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "recall").when(F.col("event_type") == "error", "error").otherwise("ingest")
    return adapters.table(spark, sf, "events").select(
        runtime.ms_of("ts").alias("ts"), kind.alias("kind"), F.col("value").alias("duration_ms"), F.col("user_id").alias("turns")
    )


_LOG = """g AS (SELECT epoch_us(ts)//1000 AS ts, CASE WHEN event_type IN ('view', 'click') THEN 'recall' WHEN event_type = 'error' THEN 'error' ELSE 'ingest' END AS kind,
 value AS duration_ms, user_id AS turns FROM events)"""


@query("percentiles_nearest_rank", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT event_type, max(value) FILTER (WHERE i = ceil(n * 50 / 100.0)) AS p50, max(value) FILTER (WHERE i = ceil(n * 95 / 100.0)) AS p95 FROM r GROUP BY 1""")
def _(spark, sf):
    return health.nearest_rank(adapters.table(spark, sf, "events"), ["event_type"], "value", {"p50": 50, "p95": 95})


@query("minute_series", f"""WITH {_LOG}, e AS (SELECT max(ts) // 60000 * 60000 AS last FROM g), s AS (SELECT last - i * 60000 AS minute FROM e, range(60) t(i)),
 m AS (SELECT ts // 60000 * 60000 AS minute, * EXCLUDE (ts) FROM g), r AS (SELECT minute, duration_ms, row_number() OVER (PARTITION BY minute ORDER BY duration_ms) AS i, count(*) OVER (PARTITION BY minute) AS n FROM m WHERE kind = 'recall'),
 p AS (SELECT minute, max(duration_ms) FILTER (WHERE i = ceil(n * 0.5)) AS p50_ms, max(duration_ms) FILTER (WHERE i = ceil(n * 95 / 100.0)) AS p95_ms FROM r GROUP BY 1)
 SELECT s.minute, count(m.kind) FILTER (WHERE m.kind = 'recall') AS recalls, coalesce(sum(m.turns) FILTER (WHERE m.kind = 'ingest'), 0)::BIGINT AS ingested, count(m.kind) FILTER (WHERE m.kind = 'error') AS errors,
 max(p50_ms) AS p50_ms, max(p95_ms) AS p95_ms FROM s LEFT JOIN m USING (minute) LEFT JOIN p USING (minute) GROUP BY 1""")
def _(spark, sf):
    log = _log(spark, sf)
    return health.minute_series(log, log.agg(F.max("ts").alias("t")).scalar())


@query("health_headline", f"""WITH {_LOG}, r AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) AS i, count(*) OVER () AS n FROM g WHERE kind = 'recall')
 SELECT count(*) FILTER (WHERE kind = 'recall') AS recalls, count(*) FILTER (WHERE kind = 'error') AS errors, max(duration_ms) FILTER (WHERE kind = 'recall') AS max_ms,
 count(*) FILTER (WHERE kind = 'ingest') AS ingest_calls, sum(turns) FILTER (WHERE kind = 'ingest')::BIGINT AS ingest_turns,
 (SELECT duration_ms FROM r WHERE i = ceil(n * 0.5)) AS p50_ms, (SELECT duration_ms FROM r WHERE i = ceil(n * 95 / 100.0)) AS p95_ms FROM g""")
def _(spark, sf):
    return health.headline(_log(spark, sf))


@query("history_pivot", """SELECT source AS recorded_at, lang AS "commit", max(n_chars) FILTER (WHERE doc_id % 2 = 0) AS "p0 · hash", max(n_chars) FILTER (WHERE doc_id % 2 = 1) AS "p1 · hash"
 FROM documents GROUP BY 1, 2""")
def _(spark, sf):
    """Recordings stood in for by sources and languages, two profiles each."""
    docs = adapters.table(spark, sf, "documents").groupBy(
        F.col("source").alias("recorded_at"), F.col("lang").alias("commit"), F.concat(F.lit("p"), F.col("doc_id") % 2).alias("profile")
    ).agg(F.max("n_chars").alias("ndcg_at_k"))
    return evaluation.history_pivot(docs.withColumn("embedder", F.lit("hash")), "ndcg_at_k", ["p0 · hash", "p1 · hash"])
