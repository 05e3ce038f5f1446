import numpy as np
from pyspark.sql import functions as F

from colloquy.curation.reads import same
from colloquy.operators import pairs, vectors
from colloquy.sources import adapters

SF = "/root/testdata/sf0.001"


def items(spark):
    return adapters.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def test_blocks_of_questions_give_the_same_neighbours(spark):
    rows = items(spark).withColumns({"session_id": F.concat(F.lit("s"), F.col("id") % 3), "ts": F.col("id"), "scope": F.lit("")})
    asked = rows.select(
        F.concat(F.lit("q"), "id").alias("query_id"), "vec", F.when(F.col("id") % 2 == 0, "s1").alias("session"),
        F.lit(None).cast("string").alias("exclude_session"), F.when(F.col("id") % 5 == 0, F.lit(40)).cast("long").alias("until"),
    )
    one = vectors.knn(rows, asked, 5)
    many = vectors.knn(rows, asked, 5, block=3)
    assert same(one, many) and one.count() > 0
    mine = one.where("query_id = 'q0'").join(rows.select("id", "session_id"), "id").collect()
    assert all(r.session_id == "s1" and r.id <= 40 for r in mine)


def test_near_duplicates_equal_brute_force_with_copies(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 16))
    data = []
    for i in range(180):
        v = centres[i % 6] + rng.normal(scale=0.05 if i % 4 else 0.3, size=16)
        if i % 3 == 0:
            v = centres[0]
        data.append((i + 1, [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)]))
    df = spark.createDataFrame(data, "id long, vec array<float>")
    m = np.array([d[1] for d in data], dtype=np.float64)
    cos = np.round(m @ m.T, 6)
    want = set()
    for i in range(len(data)):
        found = sorted(((cos[i, j], j + 1) for j in range(i) if cos[i, j] >= 0.95), key=lambda x: (-x[0], -x[1]))[:4]
        want |= {(i + 1, other, rank + 1) for rank, (_, other) in enumerate(found)}
    for options in ({}, {"pivots": 3, "block": 20}):
        got = {(r.id, r.earlier, r["rank"]) for r in vectors.near_duplicates(df, 0.95, **options).collect()}
        assert got == want


def test_blocked_pairs_equal_plain_ones(spark):
    rows = adapters.table(spark, SF, "lineitem").select(F.col("l_suppkey").alias("turn_id"), F.col("l_partkey").alias("entity"))
    sets = pairs.key_sets(rows)
    assert same(pairs.pair_counts(sets, 1_000_000), pairs.pair_counts(sets, 7))


def test_near_duplicates_keep_the_nearest_when_far_more_pass_the_bound(spark):
    rng = np.random.default_rng(11)
    data = []
    for i in range(400):
        v = rng.normal(size=8) + 1.0
        if i % 5 == 0 and data:
            v = np.asarray(data[rng.integers(len(data))][1])
        data.append((int(i * 3 % 401), [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)]))
    df = spark.createDataFrame(data, "id long, vec array<float>")
    data.sort()
    m = np.array([d[1] for d in data], dtype=np.float64)
    cos = np.round(m @ m.T, 6)
    want = set()
    for i in range(len(data)):
        found = sorted(((cos[i, j], data[j][0]) for j in range(i) if cos[i, j] >= 0.2), key=lambda x: (-x[0], -x[1]))[:4]
        want |= {(data[i][0], other, rank + 1) for rank, (_, other) in enumerate(found)}
    assert {(r.id, r.earlier, r["rank"]) for r in vectors.near_duplicates(df, 0.2, pivots=2, block=64).collect()} == want


def test_pairs_counted_by_parts_equal_plain_ones_and_no_pair_is_shuffled(spark):
    rows = adapters.table(spark, SF, "lineitem").select(F.col("l_suppkey").alias("turn_id"), F.col("l_partkey").alias("entity"))
    for some in (rows, rows.withColumn("entity", F.concat(F.lit("é"), F.col("entity").cast("string")))):
        sets = pairs.key_sets(some)
        plain = pairs.pair_counts(sets)
        for options in ({}, {"parts": 3, "held": 500}):
            assert same(pairs.pair_counts_by_parts(sets, **options), plain)
    empty = pairs.key_sets(rows.where("false"))
    assert pairs.pair_counts_by_parts(empty).count() == 0
