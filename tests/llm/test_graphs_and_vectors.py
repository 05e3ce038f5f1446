"""Random-projection forest, conversation trie and hard negatives beside plain versions."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import anglemining, convtrie, rpforest, suite

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def _sql(name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con.execute(suite.ORACLES[name])


def _same(spark, name, table):
    want = _sql(name, table)
    columns, rows = [c[0] for c in want.description], want.fetchall()
    got = suite.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str) and rows


# --- the trie ------------------------------------------------------------------------------------------
def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    paths, members, depth = {}, defaultdict(list), {(): 0}
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        paths[c] = own.get(base, [])[:h] + own[c][h:]
        key = ()
        members[key].append(c)
        for turn in paths[c]:
            depth[key, turn] = depth[key] + 1
            key = (key, turn)
            members[key].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            kids[key[0]] += 1
    for key in sorted(members, key=lambda k: -depth[k]):
        leaves[key] += kids[key] == 0
        if key:
            saved[key] += (len(members[key]) - 1) * len(key[1][1].encode())
            leaves[key[0]] += leaves[key]
            saved[key[0]] += saved[key]
    out = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in m if len(paths[c]) == depth[key])
        out.append((m[0], depth[key], members[key[0]][0] if key else None, len(m), kids[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def _trie(spark, rows, **how):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS owner", "2 AS n").repartition(3)
    return sorted(map(tuple, convtrie.trie(frame, **how).select(*COLUMNS).collect()), key=str)


def test_trie_query_against_sql(spark):
    _same(spark, "op12_conversation_trie", "conversations")


@pytest.mark.parametrize("how", [{}, {"component": 20, "span": 3, "popular": 4}], ids=["gathered", "split in rounds"])
def test_trie_of_odd_conversations(spark, how):
    rows = [(None, 1, "user", "no id"), (1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "b"), (2, 1, "user", ""), (-3, 1, "user", "below zero"), (-3, 2, "tool", "ü" * 70_000)]
    for c in range(5, 60):  # a common first turn, copies, every one a turn longer than another, turnless ones
        rows += [(c, t, "user" if t % 2 else "assistant", f"{'same' if t < 4 or c % 3 else c} {t}") for t in range(1 + c % 7)]
        if c % 10 == 5:
            rows += [(c, t, "user", f"long {t}") for t in range(10, 10 + 3 * c)]
    assert _trie(spark, rows, **how) == plain_trie(rows)


def test_trie_of_one_long_conversation_and_of_none(spark):
    rows = [(10, t, "user", f"turn {t}") for t in range(700)] + [(20 + 5 * c, t, "user", f"turn {t}") for c in range(40) for t in range(17 * c)]
    assert _trie(spark, rows, component=300, span=16, popular=7) == plain_trie(rows)
    assert convtrie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert convtrie.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_splits_halve_components(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    convs, turns = convtrie.rebuilt(rows)
    keys = convtrie.prefixes(convs, turns)
    nodes = convtrie.nodes_of(keys)
    weight = nodes.where("d = 0").first().s
    rounds = convtrie.splits_of(convtrie.pieces_of(nodes, convtrie.paths_of(keys, nodes)), 4)
    assert 1 < len(rounds) <= math.log2(weight)
    for number, splits in enumerate(rounds):
        assert sum(s.weight for s in splits.values()) <= weight and all(4 < s.weight <= weight / 2**number and 2 * s.below >= s.weight for s in splits.values())


# --- the forest ----------------------------------------------------------------------------------------
def _nearest(rows, asked, k):
    """(query id, its vector) -> best (-score, id); rows and queries are distinct (id, vector)."""
    rows, asked = {(i, tuple(v)) for i, v in rows}, {(i, tuple(v)) for i, v in asked}
    return {(q, v): sorted((-float(np.dot(v, w)), i) for i, w in rows if (i, w) != (q, v) and len(w) == len(v))[:k] for q, v in asked}


def test_forest_query_has_its_recall(spark):
    rows = [(r.vec_id, np.asarray(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = suite.op11_rp_forest(spark, SF).collect()
    want = _nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert len(got) == 20 * len(want)
    hits = {(q, i) for (q, _), best in want.items() for _, i in best} & {(r.query_id, r.vec_id) for r in got}
    assert len(hits) >= 0.9 * len(got)


def test_forest_of_many_leaves(spark):
    """Leaves of 40 rows, cells of 16: recall, exact scores and order, a third of the rows equal, norms that differ."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(30, 12))
    points = middle[rng.integers(0, 30, 2400)] + 0.4 * rng.normal(size=(2400, 12))
    points[800:1600] = points[0]
    points *= np.where(np.arange(2400) % 3 == 0, 1.0, 0.6)[:, None]
    points[800:1600] = points[0]
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(5)
    got = rpforest.search(vectors, F.col("vec_id") % 20 == 0, 20, leaf=40, cell=16).collect()
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    want, scores = {}, points @ points.T
    found = 0
    for q in range(0, 2400, 20):
        others = np.delete(np.arange(2400), q)
        want[q] = np.sort(scores[q, others])[::-1][:20]
        mine = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and len({r.vec_id for r in mine}) == 20 and q not in {r.vec_id for r in mine}
        assert all(abs(r.score - scores[q, r.vec_id]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        found += sum(r.score >= want[q][-1] - 1e-12 for r in mine)
    assert found >= 0.9 * 20 * len(want)
    # of equal vectors the smallest ids
    equal = sorted(r.vec_id for r in by[800] if abs(r.score - scores[0, 0]) < 1e-12)
    assert equal == [0, *range(801, 1600)][: len(equal)]


def test_forest_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(1, 90)]
    rows += [(None, [0.5] * 6), (100, None), (101, [0.0] * 6), (120, [0.0] * 6), (102, [1.0] * 5 + [None]), (103, [float("nan")] * 6), (140, [float("inf")] * 6), (160, []), (180, [2.0, 1.0]), (104, [1.0, 3.0])]
    rows += [(rows[6][0], rows[6][1]), (105, rows[6][1]), (rows[7][0], rows[8][1]), rows[19], rows[19], (30, rows[19][1]), (200, [1.5, 1.0, 0.2, 0.1, 0.0, 0.3])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS leaf").repartition(4)
    got = defaultdict(list)
    for r in rpforest.search(vectors, F.col("vec_id") % 20 == 0, 20).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    fit = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    want = _nearest(fit, [r for r in fit if r[0] % 20 == 0], 20)
    assert set(got) == {q for q, _ in want} and len(want) == len(got)
    for (q, _), best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert np.allclose([m[2] for m in mine], [-s for s, _ in best], atol=1e-12)
        assert sorted((round(m[2], 9), m[1]) for m in mine if m[2] > mine[-1][2] + 1e-9) == sorted((round(-s, 9), i) for s, i in best if -s > mine[-1][2] + 1e-9)
    assert rpforest.search(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_queue_gives_leaves_by_cost():
    rng = np.random.default_rng(9)
    points = rng.normal(size=(3000, 8))
    forest = rpforest.Forest.fit(points, float(np.linalg.norm(points, axis=1).max()), 3000, leaf=60)
    assert forest.levels == 6 and len(np.unique(forest.members(points)[:, 0])) == 64
    places = forest.places(points[:5])
    costs = forest.costs(places)
    for place, cost in zip(places, costs, strict=True):
        out = forest.visits(place, 90)
        assert len(set(out)) == 90 and np.all(np.diff(cost[out]) >= -1e-12) and np.isclose(cost[out[-1]], np.sort(cost)[89])


# --- hard negatives ------------------------------------------------------------------------------------
def plain_negatives(rows, anchors, positives=5, negatives=3):
    fit = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in fit if anchors(i)}):
        _, label, own = min((i, lab, v) for i, lab, v in fit if i == a)
        scored = sorted((-sum(x * y for x, y in zip(own, v)), i, lab) for i, lab, v in fit if i != a and len(v) == len(own))
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            within = [(-s, i) for s, i, lab in scored if lab != label and 50 * -ps <= 100 * -s <= 95 * -ps][:negatives]
            out += [(a, p, r + 1, i, -ps, s) for r, (s, i) in enumerate(within)]
    return sorted(out)


def test_negatives_query_against_sql(spark):
    _same(spark, "op13_hard_negatives", "embeddings")


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 3)), (rng.normal(size=8) + 0.5).round(1).tolist()) for i in range(1, 400)]
    rows += [(None, 1, [0.5] * 8), (401, None, [0.5] * 8), (402, 1, None), (403, 1, [1.0] * 7 + [None]), (404, 1, [float("nan")] * 8), (405, 1, [float("-inf")] * 8), (450, 2, [0.0] * 8)]
    rows += [(500, 1, [1.0, 2.0]), (501, 1, [1.0, 2.0]), (502, 2, [0.9, 1.5]), (550, 1, []), (551, 1, []), (552, 2, []), (600, 1, [-1.0] * 8), (650, 1, [3e4] * 8), (50, 0, [0.1] * 8)]
    rows += [(700 + i, i % 3, rows[49][2]) for i in range(9)] + [rows[60], rows[61]]
    schema = "vec_id long, label int, embedding array<double>"
    frame = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS rank", "2 AS anchor", "3 AS norm", "4 AS score").repartition(4)
    want = plain_negatives(rows, lambda i: i % 50 == 0)
    assert want and sorted(map(tuple, anglemining.mine(frame, F.col("vec_id") % 50 == 0).collect())) == want
    assert sorted(map(tuple, anglemining.mine(frame, F.col("vec_id") % 50 == 0, block=3).collect())) == want
    assert anglemining.mine(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def _side(labels, vectors, references):
    norms = np.linalg.norm(vectors, axis=1)
    angles = np.arccos(np.clip(vectors @ references.T / norms[:, None], -1, 1)).astype(np.float32)
    return anglemining.Side(np.arange(len(vectors)), labels, vectors.astype(np.int64), norms, angles)


def test_bounds_hold_and_prune():
    """Every score lies inside its bounds; in clustered vectors most pairs need no score at all."""
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(12, 16))
    label = rng.integers(0, 12, 4000)
    vectors = np.floor(256 * (middle[label] + 0.05 * rng.normal(size=(4000, 16))))
    references = vectors[:16] / np.linalg.norm(vectors[:16], axis=1, keepdims=True)
    rows, anchors = _side(label, vectors, references), _side(label[:64], vectors[:64], references)
    low, high = anglemining.bounds(anchors, rows)
    score = anchors.vectors @ rows.vectors.T
    assert (low <= score).all() and (score <= high).all()
    best = np.sort(score, axis=1)[:, -6]
    assert (high >= best[:, None]).mean() < 0.25


def test_best_keeps_ties_by_id():
    best = anglemining.Best(2, 3)
    best.add(np.array([0, 1]), np.array([9, 4, 7, 1]), np.array([[5, 5, 5, 5], [1, 2, np.iinfo(np.int64).min, 2]]))
    best.add(np.array([0]), np.array([2, 0]), np.array([[5, 4]]))
    assert best.id[0].tolist() == [1, 2, 4] and best.id[1].tolist() == [1, 4, 9] and best.score[1].tolist() == [2, 2, 1]


def test_lists_of_one_row_share_their_score():
    ids = pa.array([[3, 8], [1], [2, 5, 6]], pa.list_(pa.int64()))
    got = rpforest.nearest(np.array([[1.0, 0.0]]), np.array([40]), np.array([[0.5, 1.0], [0.9, 0.0], [0.5, 2.0]]), ids, 4)
    assert [x.tolist() for x in got] == [[40] * 4, [1, 2, 3, 5], [0.9, 0.5, 0.5, 0.5], [False] * 4]
