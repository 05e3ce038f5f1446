"""Whole recalls over an invented harbour: who holds a post when, what is missing, what is hidden."""

import duckdb
import pytest
from pyspark.sql import functions as F

from colloquy import schema as sc
from colloquy.operators import graph, lexical
from colloquy.plans import recall as rc
from colloquy.plans.memory import Memory

SF = "/root/testdata/sf0.001"
DAY = sc.DAY_MS
#: 2031-01-01.
YEAR = 22_280 * DAY


def harbour(spark, said, **build):
    """`said`: (uuid, day of the year, text[, session[, scope]])."""
    rows = []
    for i, (uuid, day, words, *rest) in enumerate(said, 1):
        session, scope = (*rest, "log", "")[:1][0], (rest[1] if len(rest) > 1 else "")
        rows.append((i, uuid, session, "mate", words, YEAR + day * DAY, YEAR + day * DAY, "turn", scope))
    return Memory.build(spark.createDataFrame(rows, sc.TURN), **build)


def replaced(spark, *pairs, hidden=()):
    rows = [(old, False, new) for old, new in pairs] + [(i, True, None) for i in hidden]
    return spark.createDataFrame(rows, "id long, hidden boolean, superseded_by long")


def asked(spark, memory, questions, **options):
    rows = spark.createDataFrame(list(questions.items()), "query_id string, query string")
    result = rc.recall(memory, rows.withColumns({k: F.lit(v) for k, v in options.items()}), context="context" in options)
    ranked = {q: [] for q in questions}
    for r in result.evidence.orderBy("query_id", "rank").collect():
        ranked[r.query_id].append(r)
    return result, ranked


PILOTS = [
    ("p-odd", 10, "Oddvar Lien steers the harbour pilot boat at Skagen."),
    ("p-mud", 12, "The harbour at Skagen dredges mud on Mondays."),
    ("p-eve", 90, "Evelien Smit steers the harbour pilot boat at Skagen."),
    ("p-net", 91, "Skagen wants new nets for the harbour."),
    ("p-tor", 200, "Torben Juhl steers the harbour pilot boat at Skagen."),
]
WHO = "the harbour pilot boat at Skagen"


@pytest.fixture(scope="module")
def pilots(spark):
    memory = harbour(spark, PILOTS, flags=replaced(spark, (1, 3), (3, 5)))
    yield memory
    memory.close()


def test_now_and_then(spark, pilots):
    result, got = asked(spark, pilots, {
        "now": f"Who steers {WHO}?", "was": f"Who steered {WHO} before?", "may": f"Who steered {WHO} in May 2031?", "feb": f"Who steered {WHO} in February 2031?",
    })
    first = {q: rows[0].uuid for q, rows in got.items()}
    assert first == {"now": "p-tor", "was": "p-eve", "may": "p-eve", "feb": "p-odd"}
    assert not {"p-odd", "p-eve"} & {r.uuid for r in got["now"]}
    eve = got["was"][0]
    assert eve.superseded_by == 5 and eve.valid_until == YEAR + 200 * DAY
    profile = {r.query_id: r for r in result.profile.collect()}
    assert profile["was"].history and not profile["now"].history and profile["may"].period[1] - profile["may"].period[0] == 31 * DAY


def test_without_curation_time_alone_decides(spark):
    memory = harbour(spark, PILOTS)
    _, got = asked(spark, memory, {"may": f"Who steered {WHO} in May 2031?", "feb": f"Who steered {WHO} in February 2031?"})
    assert (got["may"][0].uuid, got["feb"][0].uuid) == ("p-eve", "p-odd")
    memory.close()


def test_a_name_nobody_said_is_declined(spark):
    memory = harbour(spark, [*PILOTS, ("p-kat", 300, "Katla ferries leave for Anholt at six.")])
    result, got = asked(spark, memory, {"known": f"Who steers {WHO}?", "gone": "Who steers the harbour pilot boat at Grenaa?"}, context=1)
    verdicts = {r.query_id: r for r in result.abstained.collect()}
    assert set(verdicts) == {"gone"} and verdicts["gone"].missing == ["grenaa"]
    assert got["gone"] and {r.role for r in got["gone"]} == {"supporting"}
    shown = {r.query_id: r.rendered for r in rc.render(result.evidence, result.context, verdicts=result.abstained).collect()}
    assert shown["gone"].startswith("[abstained]") and "grenaa" in shown["gone"].split("\n")[0]
    assert "#5 mate, 2031-07-20, session log, primary > Torben Juhl" in shown["known"]
    memory.close()


def test_scope_bounds_what_is_nominated(spark):
    noise = [(f"n-{i}", i, f"Skagen harbour pilot boat note {i}.", "far", "out") for i in range(150)]
    memory = harbour(spark, [("near", 5, "The harbour pilot boat at Skagen needs Ruth.", "own", "in"), *noise])
    _, got = asked(spark, memory, {"q": f"Who needs {WHO}?"}, scope="in")
    assert [r.uuid for r in got["q"]] == ["near"]
    _, got = asked(spark, memory, {"q": f"Who needs {WHO}?"}, until=YEAR + 2 * DAY, exclude_session="own")
    assert got["q"] and {r.uuid for r in got["q"]} <= {"n-0", "n-1", "n-2"}
    memory.close()


def test_notes_stand_for_their_sources_and_hidden_turns_stay_away(spark):
    notes = spark.createDataFrame([(6, 3), (6, 5)], "note_id long, turn_id long")
    memory = harbour(spark, [*PILOTS, ("p-sum", 310, "Harbour pilot boat at Skagen: Evelien Smit, then Torben Juhl.")], flags=replaced(spark, hidden=[1]), note_sources=notes)
    _, got = asked(spark, memory, {"q": f"Who steers {WHO}?"})
    uuids = {r.uuid: r for r in got["q"]}
    assert "p-odd" not in uuids and sorted(uuids["p-sum"].covers) == [3, 5] and not {"p-eve", "p-tor"} & set(uuids)
    _, got = asked(spark, memory, {"q": f"Who steers {WHO}?"}, include_hidden=True)
    assert any(r.uuid == "p-odd" and r.hidden for r in got["q"])
    memory.close()


def test_names_of_and_missing_names(spark):
    names = F.array(*map(F.lit, ["ruth lien", "skagen", "oddvar 77", "tide_gauge", "port varna"]))
    row = spark.range(1).select(
        rc.names_of(F.array(*map(F.lit, ["skagen", "harbour skagen", "may", "12%", "2031-05", "ruth lien", "a_b"])), F.array(F.lit("12%"))).alias("names"),
        rc.missing_names(names, rc.name_words(names), F.transform(F.split(F.lit("then lien saw 77 at varna"), " "), lambda w: F.xxhash64(w)), F.lit("then lien saw 77 at varna; tide_gauge")).alias("missing"),
    ).first()
    assert row.names == ["harbour skagen", "ruth lien", "a_b"]
    assert row.missing == ["skagen", "oddvar 77"]


def test_turns_on_a_cycle_count_half_and_hand_nothing_over(spark):
    free = harbour(spark, PILOTS)
    _, before = asked(spark, free, {"q": f"Who steers {WHO}?"})
    free.close()
    bound = harbour(spark, PILOTS, flags=replaced(spark, (1, 3), (3, 1)))
    _, after = asked(spark, bound, {"q": f"Who steers {WHO}?"})
    bound.close()
    half = {r.uuid: r.score for r in after["q"]}
    assert after["q"][0].uuid == "p-tor"
    for r in before["q"]:
        if r.uuid in ("p-odd", "p-eve") and r.uuid in half:
            assert half[r.uuid] < r.score


def test_a_batch_too_large_to_broadcast_gives_the_same_answers(spark, monkeypatch):
    from colloquy import runtime
    from colloquy.operators import shared
    from colloquy.suite import QUERIES

    names = ("entity_view", "recall_turns_fused")
    plain = {n: QUERIES[n](spark, SF).collect() for n in names}
    grids = []
    met = shared.top_shared
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "top_shared", lambda *a, **kw: grids.append(1) or met(*a, **kw, turn_block=400, question_block=400))
    for name in names:
        assert sorted(QUERIES[name](spark, SF).collect()) == sorted(plain[name]) and plain[name]
    assert len(grids) == 3


def test_questions_meet_turns_in_blocks_and_ties_go_to_the_greater_id(spark):
    from colloquy.operators import shared
    from colloquy.operators.ordered import top_n

    said = spark.range(300).selectExpr("id", "explode(array('a', concat('b', id % 7), concat('c', id % 3))) AS word").selectExpr("id", "word", "1.0 AS w")
    asked = spark.range(40).selectExpr("id AS qn", "explode(array(concat('b', id % 9), concat('c', id % 4), 'a')) AS word")
    plain = said.join(asked, "word").groupBy("qn", "id").agg(F.sum("w").cast("double").alias("score"))
    order = [F.col("score").desc(), F.col("id").desc()]
    want = {tuple(r) for r in top_n(plain, ["qn"], order, 5).select("qn", "id", "score").collect()}
    met = shared.top_shared(said, asked, 5, turns=300, questions=40, turn_block=100, question_block=20)
    assert {tuple(r) for r in top_n(met, ["qn"], order, 5).select("qn", "id", "score").collect()} == want
    assert met.count() < plain.count()


def test_turns_share_names_with_passages_where_they_lie(spark, tmp_path):
    said = [(1, 0, "user", "Tide and/or wind, Skagen's tide."), (1, 1, "user", "Nothing here"), (2, 0, "user", None), (2, 1, "user", "wind")]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "Skagen tide and/or ice"), (8, "the wind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    from colloquy import suite

    con = duckdb.connect()
    for t in ("conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = suite.QUERIES["names_mentioned"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(suite.ORACLES["names_mentioned"]).fetchall()) == [(1000, 7, 1), (1000, 8, 1), (2001, 8, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "item_id" not in moved[0]


def test_questions_are_read_without_an_index(spark, monkeypatch):
    questions = spark.createDataFrame([("a", "where does oddvar lien steer now?"), ("b", "Anna's boats' port, the Port of Skagen's")], "query_id string, query string")
    lines = lambda memory: sorted((r.query_id, r.temporal, r.tokens, r.entities, r.names) for r in rc.profile(questions, memory).collect())
    whole = lines(harbour(spark, PILOTS, analyzer="light", embed_fn=None))
    for builder in (lexical, "write_index"), (lexical, "with_postings"), (lexical, "with_words"), (graph, "write_keys"):
        monkeypatch.setattr(*builder, lambda *_: pytest.fail("builds an index"))
    assert lines(harbour(spark, PILOTS, analyzer="light", embed_fn=None, searched=False)) == whole
    assert "oddvar lien" in whole[0][3]
    from colloquy import suite

    suite.QUERIES["recall_turns_profile"](spark, SF)


def test_candidates_carry_no_options_of_their_question(spark, monkeypatch):
    from colloquy import runtime

    cut, kept = runtime.checkpoint, []
    monkeypatch.setattr(runtime, "checkpoint", lambda df: kept.append(df.columns) or cut(df))
    questions = spark.createDataFrame([("a", "where does oddvar lien steer now?")], "query_id string, query string")
    answer = rc.recall(harbour(spark, PILOTS, analyzer="light", embed_fn=None), questions)
    assert answer.fused.count() > 0
    candidates = [columns for columns in kept if "view" in columns]
    assert len(candidates) == 2 and not any(c.startswith("q_") for columns in candidates for c in columns)
