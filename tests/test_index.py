"""Tables clustered by key, the lexical and entity views read from them, and dense views that fail."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy import runtime
from colloquy import schema as sc
from colloquy.curation.reads import same
from colloquy.functions.porter import terms
from colloquy.operators import clustered, graph, lexical
from colloquy.plans import recall as rc
from colloquy.plans.memory import Memory
from colloquy.sources import adapters

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entries(spark):
    rows = adapters.document_turns(spark, SF).select("id", "session_id", "ts", "scope", "text")
    return lexical.with_postings(rows.repartition(4), "porter").persist()


@pytest.fixture(scope="module")
def index(entries, tmp_path_factory):
    return lexical.write_index(entries, str(tmp_path_factory.mktemp("index")), bucket_postings=500)


def plain_bm25(texts, phrases, k):
    """Scores of one question over (id, text) rows; a phrase is a run of terms."""
    docs = {i: terms(t or "") for i, t in texts}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    total = Counter()
    for phrase in phrases:
        run = terms(phrase)
        if run:
            tf = {i: sum(d[j : j + len(run)] == run for j in range(len(d) - len(run) + 1)) for i, d in docs.items()}
            tf = {i: c for i, c in tf.items() if c}
            idf = math.log((n - len(tf) + 0.5) / (len(tf) + 0.5))
            for i, c in tf.items():
                total[i] += (idf if idf > 0 else 1e-6) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
    return sorted(((round(s, 9), i) for i, s in total.items()), reverse=True)[:k]


def test_lexical_top_against_a_plain_scorer(spark, entries, index):
    texts = [(r.id, r.text) for r in entries.select("id", "text").collect()]
    words = texts[7][1].split()
    asked = {"one": [words[0], words[5]], "run": [" ".join(words[2:4]), words[9]], "none": ["zzzz qqqq"], "odd": ["", "!?", words[1], words[1] + " " + words[1]]}
    rows = spark.createDataFrame(list(asked.items()), "query_id string, phrases array<string>")
    for bound in (None, 100):
        got = {}
        for r in lexical.lexical_top(index, rows, limit=20, bound=bound).collect():
            got.setdefault(r.query_id, []).append((r.score, r.id))
        for q, phrases in asked.items():
            assert sorted(got.get(q, []), reverse=True) == plain_bm25(texts, phrases, 20), q


def test_reach_and_hidden_turns(spark, entries, index):
    word = entries.select("text").first().text.split()[0]
    rows = spark.createDataFrame([("q", [word], 100)], "query_id string, phrases array<string>, q_until long")
    every = lexical.lexical_top(index, rows.drop("q_until"), limit=500).collect()
    marks = spark.createDataFrame([(every[0].id, True)], "id long, hidden boolean")
    seen = lexical.lexical_top(index, rows, limit=500, reach=(F.col("id") <= F.col("q_until")) & ~F.col("hidden"), options=["q_until"], marks=marks).collect()
    assert {r.id for r in seen} == {r.id for r in every if r.id <= 100} - {every[0].id}
    assert {r.id: r.score for r in seen}.items() <= {r.id: r.score for r in every}.items()


def test_scan_is_pruned_by_the_batch(spark, index, capsys):
    assert index.buckets > 20 and index.rows.inputFiles() and index.n == 200
    word = index.terms.orderBy("term").first().term
    rows = spark.createDataFrame([("q", [word])], "query_id string, phrases array<string>")
    top = lexical.lexical_top(index, rows, bound=10)
    top.explain()
    plan = capsys.readouterr().out
    assert "dynamicpruning" in plan and "explode(postings" not in plan
    wanted = spark.createDataFrame([(word, 1)], "term string, pn int")
    read = clustered.lookup(index.rows, wanted, "term", index.buckets, 1).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) == 1


def test_index_read_back_and_empty(spark, entries, index, tmp_path):
    again = lexical.write_index(entries.limit(0), str(tmp_path / "none"))
    assert (again.n, again.avgdl, again.rows.count()) == (0, 0.0, 0)
    rows = spark.createDataFrame([("q", ["word"])], "query_id string, phrases array<string>")
    assert lexical.lexical_top(again, rows, bound=5).count() == 0
    where = str(tmp_path / "again")
    lexical.write_index(entries, where, bucket_postings=2_000)
    back = lexical.read_index(spark, where)
    assert (back.n, back.avgdl) == (index.n, index.avgdl) and same(back.rows.drop("bucket"), index.rows.drop("bucket"))
    assert same(back.terms.drop("bucket"), entries.select(F.explode("postings.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")))


def test_coverage_counts_tokens(spark):
    said = "The tides tested Oda's dredger; src/locks/gate.rs is maintained by Oda_GATE."
    row = spark.createDataFrame([(1, said, [{"kind": "path"}]), (2, said, []), (3, None, None)], "id long, text string, m array<struct<kind: string>>")
    got = {r.id: r for r in lexical.with_words(row).collect()}
    tokens = F.array(*map(F.lit, ["tide", "tides", "owner", "own", "src/locks/gate.rs", "gate", "harbour"]))
    seen = lexical.with_words(row).select("id", lexical.coverage(lexical.asked_stems(tokens), F.col("said")).alias("all"), lexical.coverage(lexical.asked_stems(tokens), F.coalesce("plain", "said")).alias("plain"))
    counts = {r.id: (r["all"], r["plain"]) for r in seen.collect()}
    # tide and tides, owner and own through "maintained" or not, the path, gate inside a symbol
    family = 2 if got[1].said.family else 0
    assert counts[1] == (4 + family, 2 + family) and counts[2] == (4 + family, 4 + family)
    assert got[2].plain is None and got[3].words == []


def test_keys_are_turned_back_into_what_was_said(spark, tmp_path):
    said = [(1, ["oda", "skagen"]), (2, ["o lien", "skagen"]), (3, ["oda lien"]), (4, ["crane"]), (5, ["oda", "oda"])]
    rows = spark.createDataFrame([(i, "s", 10 * i, "", [{"key": k} for k in ks]) for i, ks in said], "id long, session_id string, ts long, scope string, m array<struct<key: string>>")
    index = graph.write_keys(rows, str(tmp_path / "keys"), bucket_rows=2)
    aliases = spark.createDataFrame([("oda", "oda lien"), ("o lien", "oda"), ("boat", "crane")], "alias string, canonical string")
    blocked = spark.createDataFrame([("skagen",)], "entity string")
    mentions = rows.select(F.col("id").alias("turn_id"), F.explode("m.key").alias("entity"))
    keys = spark.createDataFrame([("oda lien", 1), ("oda", 2), ("skagen", 3), ("crane", 4), ("absent", 5)], "entity string, en int")
    for a, b in ((None, None), (aliases, None), (None, blocked), (aliases, blocked)):
        none = spark.createDataFrame([], "alias string, canonical string"), spark.createDataFrame([], "entity string")
        want = graph.apply_entity_rules(mentions, a if a is not None else none[0], b if b is not None else none[1]).join(keys, "entity").select("en", F.col("turn_id").alias("id")).distinct()
        got = graph.turns_of_keys(index, keys, a, b).select("en", "id")
        assert same(got, want) and got.count() == got.distinct().count()


def test_a_failing_embedder_leaves_the_dense_view_empty(spark):
    def failing(texts):
        if any("steers" in t for t in texts):
            raise ValueError("no model")
        return np.ones((len(texts), 4), np.float32) / 2

    said = ["Oddvar Lien holds the pilot boat at Skagen.", "The harbour at Skagen dredges mud.", "Evelien Smit holds the crane."]
    rows = [(i, f"u{i}", "log", "mate", t, 1_000 * i, 1_000 * i, "turn", "") for i, t in enumerate(said, 1)]
    memory = Memory.build(spark.createDataFrame(rows, sc.TURN), embed_fn=failing)
    asked = spark.createDataFrame([("bad", "Who steers the pilot boat at Skagen?")], "query_id string, query string")
    answer = rc.recall(memory, asked)
    assert answer.evidence.where("rank = 1").first().uuid == "u1"
    assert {r.view for r in answer.views.select("view").distinct().collect()} == {"lexical", "entity"}
    assert "dense" not in {r.view for r in answer.plan.collect()}
    memory.close()


def test_prefixes_reach_the_embedder(spark):
    rows = [(1, "u", "log", "mate", "mud", 1, 1, "turn", "")]
    memory = Memory.build(spark.createDataFrame(rows, sc.TURN), embed_fn=lambda ts: np.asarray([[len(t), t.startswith("passage: ")] for t in ts], np.float32), document_prefix="passage: ", query_prefix="query: ")
    assert memory.entries.first().vec == [12.0, 1.0]
    read = rc.profile(spark.createDataFrame([("q", "mud")], "query_id string, query string"), memory).first()
    assert read.vec == [10.0, 0.0]
    memory.close()


def test_index_of_a_known_size_reads_entries_once(spark, tmp_path):
    texts = [(i, " ".join(f"w{i * j % 97}" for j in range(1, 40))) for i in range(300)] + [(300, None), (301, "")]
    turns = runtime.spread_scan(spark.createDataFrame(texts, "id long, text string"), 64)
    entries = lexical.with_postings(turns, "porter")
    below = lexical.postings(entries)._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[-1]
    assert "_porter_positions" not in below
    told = lexical.write_index(entries, str(tmp_path / "told"), bucket_postings=500, size=lexical.text_size(turns))
    plain = lexical.write_index(entries.persist(), str(tmp_path / "plain"), bucket_postings=500)
    assert (told.n, told.avgdl) == (plain.n, plain.avgdl) == (302, 11700 / 302)
    assert same(told.rows.drop("bucket"), plain.rows.drop("bucket")) and same(told.terms.drop("bucket"), plain.terms.drop("bucket"))


def test_runs_on_their_way_to_buckets_are_small(spark):
    n = 20_000
    words = pa.table({"bucket": pa.array([i % 7 for i in range(n)], pa.int32()), "term": [f"term{i * i % 501}" for i in range(n)], "id": list(range(n))})
    rows = clustered._packed(words, "term", 3)
    back = pa.concat_tables([pa.ipc.open_stream(run.as_buffer()).read_all() for run in rows.column(2)])
    key = [("id", "ascending")]
    assert back.sort_by(key).equals(words.sort_by(key)) and rows.column(0).to_pylist() == list(range(7))
    assert rows.nbytes < words.nbytes / 4
