import json

import pytest
from pyspark.sql import functions as F

from colloquy import schema as sc
from colloquy.operators import evaluation, ingest, sessions, timeline
from colloquy.operators.ordered import Ordered, numbered
from colloquy.curation import reads
from colloquy.functions.mentions import extract_mentions
from colloquy.operators import graph
from colloquy.sources import adapters, files
from colloquy.streaming import live

SF = "/root/testdata/sf0.001"


def test_lenient_lines(spark, tmp_path):
    good = {"session_id": "s", "speaker": "user", "text": "hi", "ts": 5}
    lines = [json.dumps(good), "", "{nope", json.dumps({**good, "text": "  "}), "[1]", json.dumps({**good, "ts": "soon"}), json.dumps(good)]
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(lines) + "\n")
    turns, rejected = files.read_turns_lenient(spark, str(path))
    assert [(r.line, r.ts) for r in turns.orderBy("line").collect()] == [(1, 5), (7, 5)]
    got = {r.line: r.reason for r in rejected.collect()}
    assert got[3] == "not JSON" and got[4] == "text: must not be blank" and set(got) == {3, 4, 5, 6}
    with pytest.raises(Exception):
        files.read_turns(spark, str(path)).collect()


def test_transcripts(spark, tmp_path):
    rows = [
        {"type": "user", "uuid": "a", "timestamp": "2025-01-06T09:02:30.500Z", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "one"}, {"type": "tool_use", "text": "x"}, {"type": "text", "text": "two"}]}},
        {"type": "summary", "message": {"content": "no"}},
        {"type": "assistant", "message": {"content": [{"type": "tool_use"}]}},
    ]
    (tmp_path / "chat-1.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken {\n")
    got = files.read_transcripts(spark, str(tmp_path), "heron").orderBy("speaker").collect()
    assert [(r.session_id, r.speaker, r.text, r.uuid, r.scope) for r in got] == [
        ("chat-1", "assistant", "one\n\ntwo", None, "heron"), ("chat-1", "user", "hello", "a", "heron")
    ]
    assert got[1].ts == 1736154150500 and got[0].ts is None


def test_nested_questions(spark, tmp_path):
    talk = [{"role": "user", "content": "I moved to Osaka."}, {"role": "assistant", "content": " "}, {"role": "user", "content": "In May.", "has_answer": True}]
    other = [{"role": "user", "content": "Weather?"}]
    items = [
        {"question_id": "q1", "question_type": "where", "question": "Where?", "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["2023/05/20 (Sat) 02:21", None],
         "haystack_sessions": [talk, other], "answer_session_ids": ["s1"]},
        {"question_id": 7, "question": "What?", "haystack_session_ids": ["s1"], "haystack_sessions": [[{"role": "user", "content": "dup"}]], "answer_session_ids": ["s2"]},
        {"question_id": "q3_abs", "question": "Never?", "haystack_sessions": [other]},
        {"question_id": "q4", "question": "Lost?", "haystack_session_ids": [], "haystack_sessions": []},
        {"no": "question"},
    ]
    path = tmp_path / "qa.json"
    path.write_text(json.dumps(items))
    corpus = files.read_qa(spark, str(path))
    turns = {r.uuid: r for r in corpus.turns.collect()}
    assert set(turns) == {"s1#0", "s1#2", "s2#0", "q3_abs-s000#0"} and turns["s1#2"].ts - turns["s1#0"].ts == 120_000
    queries = {r.id: r for r in corpus.queries.collect()}
    assert [(x.uuid, x.grade) for x in queries["q1"].relevant] == [("s1#2", 2)] and queries["q1"].latest_session_id == "s1"
    assert [(x.uuid, x.grade) for x in queries["7"].relevant] == [("s2#0", 1)]
    assert [r.id for r in corpus.probes.collect()] == ["q3_abs"]
    report = corpus.report.first()
    assert (report.questions, report.abstain, report.labeled_by_turn, report.labeled_by_session, report.unlabeled) == (4, 1, 1, 1, 1)
    assert (report.turns, report.sessions, report.undated_sessions) == (4, 3, 2)


def test_questions_of_many_files_are_numbered_where_they_are_read(spark, tmp_path):
    """no task reads all questions; places run on from file to file."""
    rows = spark.range(0, 400, 1, 8).select(F.col("id").alias("at"))
    placed = numbered(rows, "n").withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.at, r.n) for r in placed) == [(i, i) for i in range(400)] and len({r.task for r in placed}) == 8
    for i in range(40):
        (tmp_path / f"{i:02}.json").write_text("".join(json.dumps({"question": f"{i}?", "haystack_sessions": [[{"role": "user", "content": str(i)}]]}) + "\n" for _ in range(3)))
    corpus = files.read_qa(spark, str(tmp_path), per_line=True)
    assert {r.session_id for r in corpus.turns.collect()} == {f"q{n:05}-s000" for n in range(120)}


def test_corpus_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([("s", "user", "hi", 1, "u1", None)], sc.TURN_INPUT)
    queries = spark.createDataFrame([("q", "date", "when?", "s", [("u1", 2)], None)], sc.LABELED_QUERY)
    files.write_jsonl(turns, f"{tmp_path}/turns.jsonl")
    files.write_jsonl(queries, f"{tmp_path}/queries.jsonl")
    corpus = files.read_corpus(spark, str(tmp_path))
    assert corpus.turns.first().uuid == "u1" and corpus.queries.first().ask == "current" and corpus.probes is None
    (tmp_path / "h.jsonl").write_text('# note\n{"recorded_at":"t","commit":"c","profile":"small","embedder":"hash","k":5}\nnot json\n')
    assert files.read_eval_history(spark, f"{tmp_path}/h.jsonl").first().k == 5


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "x", 3)], "query_id string, uuid string, rank int")
    labels = spark.createDataFrame([("q", "a", 2), ("q", "c", 1)], "query_id string, uuid string, grade int")
    queries = spark.createDataFrame([("q", "k"), ("none", "k")], "query_id string, kind string")
    got = {r.query_id: r for r in evaluation.query_scores(ranked, labels, queries, 5).collect()}
    assert got["q"].recall == 0.5 and got["q"].reciprocal_rank == 0.5
    assert abs(got["q"].ndcg - (3 / 1.584962500721156) / (3 + 1 / 1.584962500721156)) < 1e-9
    assert (got["none"].recall, got["none"].ndcg) == (0.0, 0.0)
    out = spark.createDataFrame([(True, 0.9, False), (True, 0.5, False), (False, 0.5, False), (False, None, True)], "answerable boolean, best double, abstained boolean")
    row = evaluation.abstention(out).first()
    assert (row.queries, row.answered, row.withheld, row.auc) == (2, 0.5, 0.0, 0.875)


def test_sliced_scans_equal_plain_ones(spark):
    rows = adapters.table(spark, SF, "events").select("event_id", "event_type", "value")
    plain = Ordered.of(rows, ["event_type"], ["value", "event_id"]).rank("n").lag("prev", "value").running_max("top", F.col("event_id")).done()
    cut = Ordered.of(rows, ["event_type"], ["value", "event_id"], hot_rows=10, slices=7)
    assert cut.sliced
    assert reads.same(plain, cut.rank("n").lag("prev", "value").running_max("top", F.col("event_id")).done())


def test_segments_do_not_depend_on_slicing(spark):
    turns = adapters.event_turns(spark, SF, F.lit(0))
    assert reads.same(timeline.segments(turns), timeline.segments(turns, hot_rows=50, slices=5))


def test_stream_equals_batch(spark, tmp_path):
    base = adapters.conversation_turns(spark, SF).select("session_id", "speaker", "text", "ts", "uuid", "scope")
    doubled = base.unionByName(base.limit(10))
    doubled.repartition(3).write.json(f"{tmp_path}/in")
    store = live.ingest_files(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/state", 0, 1)
    again = live.ingest_files(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/state", 0, 1)
    turns = again.turns()
    assert turns.count() == base.count()
    mentions = extract_mentions(turns)
    stats = graph.entity_stats(mentions, turns)
    assert reads.same(store.stats().select(*sorted(stats.columns)), stats.select(*sorted(stats.columns)))
    edges = graph.edges(mentions)
    assert reads.same(store.edges().select("a", "b", "turns"), edges.select("a", "b", "turns"))
    segments = timeline.segments(timeline.turn_keys(turns, mentions))
    cols = ["level", "session_id", "start_ts", "end_ts", "turns", "entities"]
    assert reads.same(store.segments().select(*cols), segments.select(*cols))
    live.drain_backlog(store, f"{tmp_path}/drain")
    assert store.vectors("hash-384").count() == turns.count()


def test_ingest_is_idempotent(spark):
    rows = [("s", "user", "hi", 1, None, None), ("s", "user", "hi", 1, None, "x"), (" ", "user", "hi", 1, None, None), ("s", "user", "yo", None, None, None)]
    inputs = spark.createDataFrame(rows, sc.TURN_INPUT).withColumn("seq", F.monotonically_increasing_id())
    first = ingest.ingest(inputs, None, 9)
    assert first.report.first().asDict() == {"indexed": 2, "duplicates": 1, "rejected": 1}
    stored = first.turns
    assert {(r.text, r.ts, r.scope) for r in stored.collect()} == {("hi", 1, ""), ("yo", 9, "")}
    assert ingest.ingest(inputs, stored, 9).report.first().asDict() == {"indexed": 0, "duplicates": 3, "rejected": 1}
    page = sessions.session_page(stored.withColumn("kind", F.lit("turn")), "s")
    assert "session s: turns 1–2 of 2" in sessions.format_session(page).first().rendered
