"""Given tables written out as files of each kind and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import runtime
from colloquy.sources import adapters, files
from colloquy.suite.registry import query

_TALK = """SELECT conv_id, turn, role, text, 'u'||conv_id||'-'||turn AS uuid, 'c'||conv_id AS session_id,
 1736154000000 + conv_id*3600000 + turn*(60000 + (conv_id % 5)*600000) AS ts FROM conversations"""


@query("file_turns", f"SELECT uuid, session_id, role AS speaker, text, ts FROM ({_TALK})")
def _(spark, sf):
    folder = runtime.work_folder(spark, "turns")
    files.write_jsonl(adapters.conversation_turns(spark, sf).select("session_id", "speaker", "text", "ts", "uuid", "scope"), folder)
    return files.read_turns(spark, folder).select("uuid", "session_id", "speaker", "text", "ts")


@query("file_turns_lenient", f"""WITH t AS (SELECT *, (conv_id + turn) % 6 AS m FROM ({_TALK})) SELECT CASE m WHEN 1 THEN 'not JSON' WHEN 2 THEN '(root): expected an object'
 WHEN 3 THEN 'a field has the wrong type' WHEN 4 THEN 'speaker: must not be blank' ELSE 'u' || conv_id || '-' || turn || ': ' || text END AS said, count(*) AS n FROM t GROUP BY 1""")
def _(spark, sf):
    """Of every six lines four are spoilt, each in its own way."""
    folder, way = runtime.work_folder(spark, "lenient"), (F.col("conv_id") + F.col("turn")) % 6
    talk = adapters.table(spark, sf, "conversations").select("*", way.alias("way"))
    speaker = F.when(F.col("way") == 4, " ").otherwise(F.col("role"))
    line = F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("session_id"), speaker.alias("speaker"), "text", F.concat(F.lit("u"), "conv_id", F.lit("-"), "turn").alias("uuid")))
    spoilt = F.when(F.col("way") == 1, F.concat(F.lit("{"), line)).when(F.col("way") == 2, F.concat(F.lit("["), line, F.lit("]"))).when(
        F.col("way") == 3, F.regexp_replace(line, r"\}$", ',"ts":"noon"}')
    )
    talk.select(F.coalesce(spoilt, line).alias("value")).write.text(folder)
    good, bad = files.read_turns_lenient(spark, folder)
    said = good.select(F.concat("uuid", F.lit(": "), "text").alias("said")).union(bad.select("reason"))
    return said.groupBy("said").agg(F.count(F.lit(1)).alias("n"))


@query("file_transcripts", """SELECT 'd'||doc_id AS uuid, CASE doc_id % 4 WHEN 0 THEN 'user' ELSE 'assistant' END AS speaker,
 CASE doc_id % 4 WHEN 2 THEN text || chr(10) || chr(10) || lang ELSE text END AS text, 1735689600000 + (doc_id % 86400) * 1000 AS ts FROM documents WHERE doc_id % 4 <> 3""")
def _(spark, sf):
    """Words said by a user, by an assistant in one block or in two around a tool call, and summaries that count for nothing."""
    folder, k = runtime.work_folder(spark, "transcripts"), F.col("doc_id") % 4
    block = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("text"))
    parts = F.to_json(F.array(block("text", F.col("text")), block("tool_use", F.lit("call")), block("text", F.col("lang"))))
    content = F.when(k == 2, parts).otherwise(F.regexp_extract(F.to_json(F.struct("text")), r'^\{"text":(.*)\}$', 1))
    at = F.date_format(F.timestamp_seconds(F.lit(1_735_689_600) + F.col("doc_id") % 86_400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(k == 0, "user").when(k == 3, "summary").otherwise("assistant")
    line = F.concat(F.lit('{"type":"'), kind, F.lit('","uuid":"d'), "doc_id", F.lit('","timestamp":"'), at, F.lit('","message":{"content":'), content, F.lit("}}"))
    adapters.table(spark, sf, "documents").select(line.alias("value")).write.text(folder)
    return files.read_transcripts(spark, folder).select("uuid", "speaker", "text", "ts")


@query("file_questions", """WITH m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t FROM conversations)
 SELECT 'c'||conv_id||'#'||t AS uuid, 'c'||conv_id AS session_id, role AS speaker, text, t * 60000 AS ts, conv_id % 3 = 0 AND t = 0 AS marked FROM m""")
def _(spark, sf):
    """Every conversation as the haystack of one question; its first message answers every third."""
    folder = runtime.work_folder(spark, "questions")
    first = (F.col("conv_id") % 3 == 0) & (F.col("place") == 0)
    talk = adapters.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    message = talk.select("conv_id", F.posexplode("said").alias("place", "m")).select("conv_id", "place", F.struct(F.col("m.role").alias("role"), F.col("m.text").alias("content"), first.alias("has_answer")).alias("m"))
    session = message.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda x: x["m"]).alias("messages"))
    name = F.concat(F.lit("c"), "conv_id")
    session.select(
        F.concat(F.lit("q"), "conv_id").alias("question_id"), F.lit("who").alias("question_type"), F.lit("Who said it?").alias("question"),
        F.array(name).alias("haystack_session_ids"), F.array("messages").alias("haystack_sessions"), F.array(name).alias("answer_session_ids"),
    ).write.json(folder)
    corpus = files.read_qa(spark, folder, per_line=True)
    marked = corpus.queries.select(F.explode("relevant").alias("r")).where("r.grade = 2").select("r.uuid", F.lit(True).alias("marked"))
    return corpus.turns.join(marked, "uuid", "left").select("uuid", "session_id", "speaker", "text", "ts", F.coalesce("marked", F.lit(False)).alias("marked"))


@query("file_corpus", """SELECT 'b'||item_id AS id, text AS query, CASE WHEN item_id % 4 = 0 THEN 'abstain' WHEN item_id % 2 = 0 THEN 'history' ELSE 'current' END AS ask,
 (SELECT count(*) FROM conversations) AS turns FROM benchmark""")
def _(spark, sf):
    """A folder of turns, questions with and without an ask, and probes."""
    folder, item = runtime.work_folder(spark, "corpus"), F.col("item_id")
    adapters.conversation_turns(spark, sf).select("session_id", "speaker", "text", "ts", "uuid", "scope").write.json(f"{folder}/turns.jsonl")
    rows = adapters.table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("b"), item).alias("id"), F.col("text").alias("query"), F.when(item % 4 == 0, "abstain").when(item % 2 == 0, "history").alias("ask"))
    rows.where("item_id % 4 <> 0").drop("item_id").write.json(f"{folder}/queries.jsonl")
    rows.where("item_id % 4 = 0").drop("item_id").write.json(f"{folder}/probes.jsonl")
    corpus = files.read_corpus(spark, folder)
    n = corpus.turns.agg(F.count(F.lit(1)).alias("turns"))
    return corpus.queries.unionByName(corpus.probes).select("id", "query", "ask").crossJoin(F.broadcast(n))  # `n` is one row


@query("file_ranked", """SELECT 'o'||l_orderkey AS id, 's'||l_suppkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS rank FROM lineitem""")
def _(spark, sf):
    folder = runtime.work_folder(spark, "ranked")
    lines = adapters.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("o"), "l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("l"))
    files.write_jsonl(lines.select("id", F.transform("l", lambda x: F.concat(F.lit("s"), x["l_suppkey"])).alias("ranked")), folder)
    return files.read_ranked(spark, folder).select("id", F.posexplode("ranked").alias("p", "item")).select("id", "item", (F.col("p") + 1).cast("long").alias("rank"))


@query("file_eval_history", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS recorded_at, 'c'||o_orderkey AS commit, o_custkey AS queries FROM orders WHERE o_orderkey % 5 NOT IN (1, 2, 3)""")
def _(spark, sf):
    """Recordings between comments, lines that are no JSON and recordings that lack a field."""
    folder, k = runtime.work_folder(spark, "history"), F.col("o_orderkey") % 5
    orders = adapters.table(spark, sf, "orders")
    whole = [F.date_format("o_orderdate", "yyyy-MM-dd").alias("recorded_at"), F.concat(F.lit("c"), "o_orderkey").alias("commit"), F.lit("full").alias("profile"), F.lit("hash").alias("embedder"), F.col("o_custkey").alias("queries")]
    line = F.when(k == 1, F.concat(F.lit("# "), F.to_json(F.struct(*whole)))).when(k == 2, "no recording").when(k == 3, F.to_json(F.struct(*whole[1:]))).otherwise(F.to_json(F.struct(*whole)))
    orders.select(line.alias("value")).write.text(folder)
    return files.read_eval_history(spark, folder).select("recorded_at", "commit", F.col("queries").cast("long").alias("queries"))
