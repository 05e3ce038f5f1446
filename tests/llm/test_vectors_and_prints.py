import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import fingerprints, suite, topk

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_topk_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(suite.TOPK_SQL).fetchall()
    assert sorted(map(tuple, suite.op4_topk(spark, SF).collect())) == sorted(want)


def test_topk_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(1, 400)]
    rows += [(500, None), (501, [1.0] * 7 + [None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, [1.0, 2.0]), (550, [1.0, 2.0]), (None, [0.5] * 8), (600, []), (650, [])]
    rows += [(1000 + i, rows[40][1]) for i in range(9)] + [(50, rows[49][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank").repartition(3)
    got = sorted(map(tuple, topk.search(vectors, F.col("vec_id") % 50 == 0, 5, block=3).dropDuplicates().collect()))
    fit = [(k, [math.floor(256 * x) for x in v]) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for k, v in fit:
        if k % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in fit if j != k and len(w) == len(v))
            want |= {(k, r + 1, j, -s) for r, (s, j) in enumerate(scored[:5])}
    assert {g for g in got if g[0] != 50} == {w for w in want if w[0] != 50}
    assert topk.search(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_leave_only_what_can_win():
    rng = np.random.default_rng(5)
    items = np.floor(256 * rng.normal(size=(2000, 6)))
    items[:, 0] *= 20
    queries = np.floor(256 * rng.normal(size=(20, 6)))
    queries[:, 0] *= 20
    left = topk.aggregate(queries, items, 5, np.full(20, -np.inf))
    for q, open_ in zip(queries, left, strict=True):
        best = np.sort(items @ q)[-5]
        assert set(np.flatnonzero(items @ q >= best)) <= set(open_.tolist())
    assert np.mean([len(x) for x in left]) < 1000


def _edited(docs):
    """(key, text) rows with distinct keys: key -> (text, edited)."""
    ordered = sorted(docs, key=lambda d: -(1 << 63) if d[0] is None else d[0], reverse=True)
    out = {}
    for i, (k, t) in enumerate(ordered):
        n = len(t or "")
        following = ordered[(i + 1) % len(ordered)][1] or ""
        out[k] = (t or "", (t or "")[: n - n // 2] + following[: n // 2])
    return out


def test_fingerprint_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = _edited(docs)
    rows = suite.op9_fingerprints(spark, SMALL).collect()
    assert len(rows) == len(docs)
    prints = {}
    for r in rows:
        text, edited = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        alike = np.mean([r.fingerprint[i : i + 8] == r.edited_fingerprint[i : i + 8] for i in range(0, 512, 8)])
        assert r.near_edited == alike
    order = sorted(rows, key=lambda r: -r.doc_id)
    for a, b in zip(order, order[1:] + order[:1]):
        assert a.near_next == np.mean([a.fingerprint[i : i + 8] == b.fingerprint[i : i + 8] for i in range(0, 512, 8)])


def test_collision_rate_is_generalised_jaccard(spark):
    """Two weighted sets drawn many times: the share of equal samples against sum of least over sum of greatest."""
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    rows = [(1, int(i), math.log(x) if x else None, math.log(y) if y else None) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x or y]
    weights = spark.createDataFrame(rows, "k long, i long, a double, b double").withColumn("_t", F.xxhash64("i"))
    n = 2000
    r = fingerprints.sampled(weights.drop("i"), ["k"], {"fa": "a", "fb": "b"}, n).first()
    same = np.mean([r.fa[i : i + 8] == r.fb[i : i + 8] for i in range(0, 8 * n, 8)])
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(same - want) < 4 * math.sqrt(want * (1 - want) / n)


def test_production_samples_against_brute_force(spark):
    """near_edited and near_next beside generalised Jaccard on documents: each within 4.5 standard errors of 64 draws, all together within 1.2."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts = _edited(docs)
    order = sorted(texts, reverse=True)

    def terms(text):
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
        return Counter(zip(words, [*words[1:], None]))

    def jaccard(a, b):
        return (a & b).total() / (a | b).total() if a or b else 1.0

    rows = {r.doc_id: r for r in suite.op9_fingerprints(spark, SMALL).collect()}
    off, expected = [], []
    for k, following in zip(order, order[1:] + order[:1]):
        own, r = terms(texts[k][0]), rows[k]
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 8 * 64
        for got, want in ((r.near_edited, jaccard(own, terms(texts[k][1]))), (r.near_next, jaccard(own, terms(texts[following][0])))):
            error = math.sqrt(want * (1 - want) / 64)
            assert abs(got - want) <= 4.5 * error + 1 / 64
            off.append((got - want) ** 2)
            expected.append(error**2)
    assert sum(expected) > 0 and math.sqrt(sum(off) / sum(expected)) < 1.2


def test_fingerprints_of_odd_rows(spark, odd_docs):
    rows = fingerprints.fingerprints(odd_docs).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert by[3].fingerprint == by[4].fingerprint == "0" * 512 and by[3].near_next == 0.0 and by[4].near_next == 1.0
    assert by[1].fingerprint == by[2].fingerprint and by[2].near_next == 1.0 and by[None].n_chars == 5
    assert fingerprints.fingerprints(odd_docs.limit(0)).count() == 0
    one = fingerprints.fingerprints(odd_docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_fingerprints_run_no_python(spark, capsys):
    fingerprints.fingerprints(spark.read.parquet(f"{SMALL}/documents.parquet")).explain()
    assert not any(word in capsys.readouterr().out for word in ("Python", "Pandas", "Arrow"))


def test_samples_are_least_draws_of_copies(spark):
    """op9: two samples a hash, no logarithm per term and sample; a copy's draw is the same in every text."""
    counts = spark.createDataFrame([(1, 3, 2, 5), (1, 4, 0, 1)], "k long, _t long, a int, b int")
    found = fingerprints.drawn(counts, ["k"], ["a", "b"])
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "ln(" not in plan and "log(" not in plan
    r = found.first()
    hashed = {(t, c, i): spark.sql(f"SELECT xxhash64(xxhash64({t}L, {c}) ^ ({i}L << 48))").first()[0] % (1 << 64) for t, n in ((3, 5), (4, 1)) for c in range(1, n + 1) for i in range(2)}
    for i in range(2):
        for shift, at in ((32, 2 * i), (0, 2 * i + 1)):
            draw = lambda t, n: [hashed[t, c, i] >> shift & 0xFFFFFFFF for c in range(1, n + 1)]  # noqa: E731, B023
            assert r.a[8 * at : 8 * at + 8] == f"{min(draw(3, 2)):08x}" and r.b[8 * at : 8 * at + 8] == f"{min(draw(3, 5) + draw(4, 1)):08x}"
