import hashlib
import random

import numpy as np
import pytest
from plain import jaccard_components, runs, suffix_spans

from colloquy.llm import ngramjoin, suffixdedup, suite
from colloquy.llm.components import components

SF = "/root/testdata/sf0.001"


def _spans_agree(rows, docs):
    want = {}
    for (k, b), mask in zip(docs, suffix_spans(docs), strict=True):
        kept = bytes(x for x, f in zip(b, mask, strict=True) if not f)
        want.setdefault(k, []).append((len(b), sum(mask), runs(mask), hashlib.sha256(kept).hexdigest()))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return sum(x[1] for v in want.values() for x in v)


def _text_rows(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.collect()]


def test_suffix_query(spark):
    docs = _text_rows(spark.read.parquet(f"{SF}/documents.parquet"))
    assert _spans_agree(suite.op1_suffix_dedup(spark, SF).collect(), docs) > 10_000


@pytest.mark.parametrize("pieces", [1, 64])
def test_suffix_of_odd_rows(spark, odd_docs, monkeypatch, pieces):
    monkeypatch.setattr(suffixdedup, "PIECES", pieces)
    rng = random.Random(4)
    line = "this line of sixty bytes stands in every other document, see."
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 90))) + line * (i % 2) + "".join(rng.choice("ab é") for _ in range(40)), "x") for i in range(60)]
    rows += [(100, "a" * 400, "y"), (101, "a" * 300, "y"), (102, "é" * 200, "y"), (103, "ab" * 100, "z"), (104, "ba" * 90, "z")]
    docs = odd_docs.select("doc_id", "text", "source", "length").unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string"), allowMissingColumns=True)
    _spans_agree(suffixdedup.dedup(docs, digests=True).collect(), _text_rows(docs))
    for r in suffixdedup.dedup(docs, carry=("source", "length")).collect():
        assert len(r.kept) == r.n_bytes - r.n_removed and sum(s.end - s.begin for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
        assert r.kept_text == r.kept.decode("utf-8", "ignore")
    assert suffixdedup.dedup(docs.limit(0)).count() == 0


def test_longest_previous_factor():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 400):
        document, lcp = rng.integers(0, 9, n), rng.integers(0, 12, n)
        lcp[:1] = 0
        got = suffixdedup.longest_previous(document, lcp, 3)
        for i in range(n):
            best = 0
            for step in (-1, 1):
                reach, j = 99, i
                while 0 <= j + step < n:
                    reach = min(reach, int(lcp[j] if step < 0 else lcp[j + 1]))
                    j += step
                    if document[j] < document[i]:
                        best = max(best, reach)
                        break
            assert got[i] == (best if best >= 3 else 0)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(90, 95), (95, 90), (95, 95), (99, 99)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_join_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in suite.op7_ngram_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == jaccard_components(docs)
    assert sum(k != c for k, (_, c) in got.items()) > 30


def test_join_with_families_in_blocks(spark, monkeypatch):
    """A chain of edits, a crowd of near copies, copies and short texts, with families cut very small."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 5)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows, text = [], list(base)
    for i in range(40):
        rows.append((1000 - i, " ".join(text)))
        text[rng.randrange(120)] = f"new{i}"
    for i in range(40):
        some = [f"v{j}" for j in range(80)]
        for _ in range(rng.choice([1, 2, 3])):
            some[rng.randrange(80)] = f"x{rng.randrange(3000)}"
        rows.append((2000 + i, " ".join(some)))
    rows += [(3000 + i, "same few words here") for i in range(30)] + [(4000, "A B"), (4001, "a  b"), (4002, ""), (4003, None), (4004, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = spark.createDataFrame(docs.orderBy("doc_id").toPandas()[["doc_id", "text"]].astype(object).where(lambda d: d.notna(), None).values.tolist(), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(docs).collect()}
    assert got == jaccard_components(rows)


def test_join_of_odd_rows(spark, odd_docs):
    rows = ngramjoin.join(odd_docs.coalesce(1)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)
    assert got == sorted([(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 2, 6), (7, 2, 7), (None, 1, None)], key=repr)
    assert ngramjoin.join(odd_docs.limit(0)).count() == 0


def test_sets_walk_the_tree_side_by_side():
    rng = np.random.default_rng(8)
    base = np.sort(rng.choice(2000, 120, replace=False)).astype(np.uint64)
    lists = [np.unique(np.where(rng.random(120) < rng.choice([0.02, 0.1]), rng.integers(0, 2000, 120).astype(np.uint64), base)) for _ in range(70)]
    lists += [base[:40], base[:100], base[60:], np.empty(0, np.uint64), np.asarray([5000], np.uint64)]
    sizes = np.asarray([max(len(x), 1) for x in lists])
    held = np.arange(0, len(lists), 2)
    tree = ngramjoin.PrefixTree([lists[i] for i in held], sizes[held], 80)
    place, other = tree.similar(lists, sizes)
    got = {(int(i), int(held[j])) for i, j in zip(place, other, strict=True)}
    common = lambda i, j: len(np.intersect1d(lists[i], lists[j]))
    want = {(i, int(j)) for i in range(len(lists)) for j in held if 100 * (c := common(i, j)) >= 80 * (sizes[i] + sizes[j] - c)}
    assert got == want and len(got) > 500
