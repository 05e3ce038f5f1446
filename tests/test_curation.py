"""Finders, folds and the action log on a small invented shipyard."""

import pytest
from pyspark.sql import functions as F

from colloquy import schema as sc
from colloquy.curation import finders, fold, reads
from colloquy.curation import log as actions
from colloquy.functions.mentions import extract_mentions
from colloquy.operators import graph

HOUR, DAY = 3_600_000, sc.DAY_MS
LATE = 400 * DAY

LINES = [
    ("dock", "Today Odile Brandt signed the hull papers of the Marigold in Trieste."),
    ("dock", "The Marigold refit costs $40k and the refit papers are filed."),
    ("mess", "mm fine"),
    ("mess", "The Marigold refit now costs $55k and the refit papers are filed."),
    ("mess", "Today Odile Brandt signed the hull papers of the Marigold in Trieste!"),
    ("quay", "Then we met Odile near the Marigold in Trieste."),
]


def yard(spark, lines, gap=10 * DAY):
    rows = [(i, f"y-{i}", session, "crew", said, i * gap, i * gap, "turn", "") for i, (session, said) in enumerate(lines, 1)]
    return spark.createDataFrame(rows, sc.TURN)


def entry(index, op, **payload):
    full = {f.name: payload.get(f.name) for f in sc.ACTION_PAYLOAD.fields}
    return {"index": index, "run_id": payload.get("run", "first"), "actor": "keeper", "ts": 1000 + index, "op": op, "payload": full, "reason": "kept tidy", "undone_at": None, "undone_by": None}


def entries(spark, *rows):
    fields = [f for f in sc.ACTION_LOG.fields if f.name != "id"]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("index", T.LongType()), *fields])
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)


@pytest.fixture(scope="module")
def turns(spark):
    return yard(spark, LINES).persist()


@pytest.fixture(scope="module")
def found(turns):
    return extract_mentions(turns).persist()


def test_a_repeated_statement_points_at_the_first(turns, found):
    doubled = finders.exact_duplicates(turns, found, cutoff=LATE)
    assert [(r.id, r.first, r.earlier) for r in doubled.collect()] == [(5, 1, 1)]
    assert [r.turn_id for r in finders.copies_of(doubled, turns).collect()] == [1]
    young = finders.exact_duplicates(turns, found, cutoff=50 * DAY - HOUR)
    assert young.isEmpty()


def test_pages_stop_at_the_budget(turns, found):
    doubled, order = finders.exact_duplicates(turns, found, cutoff=LATE), finders.eligible_after(turns, None, 0, LATE)
    for budget, want in ((4, (0, 4, True)), (6, (1, 6, False)), (50, (1, 6, False))):
        page = finders.scan_page(doubled, order, 0, budget=budget)
        assert (page.candidates.count(), page.scanned_through, page.more) == want


def test_small_talk_is_noise(turns, found):
    assert [(r.id, r.suggested) for r in finders.noise(turns, found, cutoff=LATE).collect()] == [(3, "hide")]


@pytest.mark.parametrize("split", [{}, {"hot_rows": 1}])
def test_a_changed_figure_supersedes(turns, found, split):
    rows = finders.supersession(turns, found, cutoff=LATE, **split).collect()
    assert [(r.id, r.turns) for r in rows] == [(4, [2])]
    assert "$40k → $55k" in rows[0].reason and 0 < rows[0].score <= 1


def test_supersession_looks_back_thirty_turns(spark):
    many = yard(spark, [("log", f"Every month the Marigold pays ${i + 1}k for its mooring at the pier.") for i in range(35)], HOUR)
    got = {r.id: r.turns for r in finders.supersession(many, extract_mentions(many), cutoff=LATE).collect()}
    assert got[35] == [30, 31, 32, 33, 34] and got[3] == [1, 2]


def test_a_first_name_is_proposed_for_the_whole(turns, found):
    stats = graph.entity_stats(found, turns)
    pairs = finders.alias_candidates(stats, found, turns, graph.edges(found))
    assert any((r.short, r.long) == ("odile", "odile brandt") for r in pairs.collect())
    page, more = finders.ranked_page(pairs, finders.alias_order(), 10_000)
    assert page.count() == pairs.count() and not more


def test_log_rows_fold_into_the_state_and_back(spark, turns, found):
    empty = spark.createDataFrame([], sc.ACTION_LOG)
    note = (7, "n-7", "mess", "curator", "Odile signed for the Marigold.", 60 * DAY, 60 * DAY, "note", "")
    store = turns.unionByName(spark.createDataFrame([note], sc.TURN))
    rows = entries(
        spark,
        entry(0, "hide", turns=["y-3"]), entry(1, "supersede", turns=["y-2"], by="y-4"), entry(2, "alias", alias="odile", canonical="odile brandt"),
        entry(3, "block", entity="trieste"), entry(4, "note", note="n-7", sources=["y-1", "y-5"]), entry(5, "run_end", summary="over", cursor=6),
        entry(6, "hide", turns=["y-6"], run="second"),
    )
    log = actions.append_log(empty, rows)
    assert [r.id for r in log.orderBy("id").collect()] == [1, 2, 3, 4, 5, 6, 7]
    assert [r.id for r in actions.append_log(log, rows.where("index = 3")).where("id > 7").collect()] == [8]
    flags = fold.turn_flags(log, store)
    assert {r.id: (r.hidden, r.superseded_by) for r in flags.collect()} == {3: (True, None), 2: (False, 4), 6: (True, None)}
    assert [r.entity for r in fold.blocklist(log).collect()] == ["trieste"] and fold.cursor(log).first().cursor == 6
    assert sorted(r.turn_id for r in fold.note_sources(log, store).collect()) == [1, 5]
    facts = {r.id: r for r in reads.turn_facts(store, flags, fold.note_sources(log, store)).collect()}
    assert facts[1].covered_by == [7] and facts[7].sources == [1, 5] and facts[2].superseded_by == 4
    ruled = graph.apply_entity_rules(found, fold.aliases(log).select("alias", "canonical"), fold.blocklist(log).select("entity"))
    left = {r.entity for r in ruled.select("entity").distinct().collect()}
    assert "trieste" not in left and "odile" not in left

    one, same = actions.undo(log, store, actor="keeper", now=5, action_id=1)
    assert {r.id for r in fold.turn_flags(one, same).collect()} == {2, 6} and same.count() == 7
    run, fewer = actions.undo(one, same, actor="keeper", now=6, run_id="first")
    assert {r.id for r in fold.turn_flags(run, fewer).collect()} == {6} and fold.aliases(run).isEmpty()
    assert reads.same(fewer, turns) and run.where("undone_at = 5").count() == 1
    for wrong in ({"action_id": 1}, {"action_id": 44}, {"run_id": "third"}):
        with pytest.raises(actions.UnknownAction):
            actions.undo(run, fewer, actor="keeper", now=7, **wrong)


def test_snapshot_of_vectors_and_notes_goes_by_uuid(spark):
    rows = [(i, f"w-{i}", "mess", "cook", "x", i, i, "turn", "") for i in (1, 2, 3)]
    moved = [(i + 10, *r[1:]) for i, r in zip((1, 2, 3), rows)]
    none = lambda spec: spark.createDataFrame([], spec)
    empty = [none("turn_id long, start int, end int, entity string, kind string, surface string"), none("entity string, kind string, turns long, first_ts long, last_ts long"), none("a string, b string, turns long"),
             none("session_id string, level string, start_ts long, end_ts long, first_turn_id long, last_turn_id long, turns long, entities array<string>")]
    shots = []
    for said, shift in ((rows, 0), (moved, 10)):
        vectors = spark.createDataFrame([(1 + shift, "hash", [0.5, 0.5]), (3 + shift, "hash", [1.0, 0.0])], "id long, model string, vec array<double>")
        notes = spark.createDataFrame([(3 + shift, 1 + shift), (3 + shift, 2 + shift)], "note_id long, turn_id long")
        shots.append(reads.snapshot(spark.createDataFrame(said, sc.TURN), *empty, vectors=vectors, note_sources=notes))
    assert {tuple(r) for r in shots[0]["note_sources"].collect()} == {("w-3", "w-1"), ("w-3", "w-2")} and shots[0]["vectors"].count() == 2
    assert all(reads.same(shots[0][t], shots[1][t]) for t in ("turns", "vectors", "note_sources"))


def test_runs_are_summed_up(spark):
    log = actions.append_log(spark.createDataFrame([], sc.ACTION_LOG), entries(spark, entry(0, "hide", turns=["a"]), entry(1, "hide", turns=["b"]), entry(2, "run_end", summary="two hidden", cursor=2)))
    run = reads.runs(log).first()
    assert (run.actions, run.undone, run.summary, run.finished) == (3, 0, "two hidden", True)
    shut, _ = actions.undo(log, spark.createDataFrame([], sc.TURN), actor="keeper", now=9, action_id=2)
    assert reads.runs(shut).first().undone == 1 and log.where(F.col("undone_at").isNotNull()).isEmpty()


def test_supersession_across_spans_matches_every_pair_of_positions(spark, monkeypatch):
    """Turns in many small spans, some at the same instant: as when all positions were joined one by one."""
    many = yard(spark, [("log", f"Every month the Marigold pays ${i + 1}k for its mooring at the pier.") for i in range(90)], HOUR)
    many = many.withColumn("ts", F.col("ts") - F.col("id") % 3 * HOUR)
    found = extract_mentions(many)
    seen = []
    place = finders.runtime.place
    monkeypatch.setattr(finders.runtime, "place", lambda df, *keys: seen.append(df) or place(df, *keys))
    monkeypatch.setattr(finders, "SPAN", 7)
    got = {r.id: r.turns for r in finders.supersession(many, found, cutoff=LATE).collect()}
    at = {r.id: r.ts for r in many.collect()}
    order = sorted(at, key=lambda i: (at[i], i))
    want = {}
    for i in order:
        earlier = [j for j in reversed(order) if j != i and at[j] <= at[i]][:30]
        if earlier:
            want[i] = sorted(sorted(earlier, reverse=True)[:5], key=lambda j: (at[j], j))
    assert got == want
    # what a turn says travels once per span it reaches, not once per earlier turn
    assert seen and seen[0].count() < 90 * 2 * (30 // 7 + 3)
