import math
from collections import Counter

import numpy as np
import pyarrow as pa
from plain import held, words

from colloquy.llm import langid, lm, quality, suite

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def _plain_phrases(parser, sample, text):
    """Greedy longest matches found by substring search."""
    pool = ["".join(chr(c + 40) for c in parser.symbols(s).tolist()) for s in sample]
    stream = "".join(chr(c + 40) for c in parser.symbols(text).tolist())
    n = 0
    for b in range(0, len(stream), langid.BLOCK):
        block, i = stream[b : b + langid.BLOCK], 0
        while i < len(block):
            k = 0
            while i + k < len(block) and any(block[i : i + k + 1] in p for p in pool):
                k += 1
            n, i = n + 1, i + max(1, k)
    return n


def test_cross_parsing_against_substring_search():
    sample = {"aa": ["the cat sat on the mat", "a dog ran"], "bb": ["le chat était là", "un chien"], "cc": ["x"]}
    parser = langid.Parser(sample)
    texts = ["the dog sat", "un chat, le chien!", "", "12 34", "zzz the", "été " * 600, "x" * 2100, "你好 the"]
    total, sizes = parser.phrases(texts)
    for i, text in enumerate(texts):
        if sizes[i]:
            assert total[:, i].tolist() == [_plain_phrases(parser, sample[k], text) for k in parser.languages]
    names, score, _ = parser.predict(texts)
    assert names[:4] == ["aa", "bb", "und", "und"] and score[2] == 0 and all(0 <= s <= 1 for s in score)


def test_suffix_automaton_accepts_exactly_the_substrings():
    text = "abracadabra"
    after, _ = langid.automaton([ord(c) for c in text])
    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def walk(s):
        state = 0
        for c in s:
            state = after[state].get(ord(c), -1)
            if state < 0:
                return False
        return True

    assert all(map(walk, subs)) and not any(walk(s) for s in ("abc", "aa", "brab", "raa") if s not in subs)


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = suite.op2_language_id(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(docs))
    assert all(r.held_out == held(r.doc_id, 4) for r in rows)
    right = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert np.mean(right) > 0.97


def test_language_of_odd_rows(spark, odd_docs):
    learnt = langid.sample(odd_docs)
    assert set(learnt) == {"en", "de"}
    rows = langid.identify(odd_docs, learnt).collect()
    by = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == 9 and by[3] == by[4] == "und" and by[1] == by[2] == "en"
    assert langid.identify(odd_docs.limit(0), learnt).count() == 0
    nothing = langid.identify(odd_docs, langid.sample(odd_docs.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_quality_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = suite.op3_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in test]) > 0.96


def test_quality_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (None, 1), (5, None), (6, 0), (77, 1)], "doc_id long, quality int")
    for known in (labels, labels.where("quality = 1"), labels.limit(0)):
        rows = quality.score(odd_docs, quality.learn(odd_docs, known), carry=("lang", "length")).collect()
        assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(odd_docs.limit(0), quality.learn(odd_docs.limit(0), labels)).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[2000:]) > 0.5) == y[2000:]) > 0.9


def test_features_count_the_whole_text():
    batch = pa.RecordBatch.from_pydict({"text": ["AB!! " * 5000 + "12", None, ""]})
    rows = quality.features(batch)
    upper, digit = (1 + quality.CLASSES.index(c) for c in ("upper", "digit"))
    assert rows[0, upper] == 10_000 / 25_002 and rows[0, digit] == 2 / 25_002 and not rows[1:].any()


def _tokens(text):
    return [*words(text), None]


def test_lm_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    train = [k for k in docs if not held(k, 7)]
    one = Counter(w for k in train for w in _tokens(docs[k]))
    n, v = sum(one.values()), len(one)
    rows = suite.op8_lm_scores(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        t = _tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 7), len(t), sum(one[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    test = [r for r in rows if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_lm_scores_are_the_mixture(spark):
    """Scores against a plain model with the same weights, and probabilities of a context that sum to one."""
    texts = {i: t for i, t in enumerate(["a b a c", "A b d", "", None, "b b b\tb", "c a b d a", "e"])}
    docs = spark.createDataFrame([*texts.items(), (None, "a b")], "doc_id long, text string").selectExpr("*", "1 AS ones", "2 AS score")
    out = {r.doc_id: r for r in lm.scores(docs, langid.held_out("doc_id", 7)).collect()}
    train = [k for k in texts if not held(k, 7)]
    one, two, ctx = Counter(), Counter(), Counter()
    for k in train:
        t = _tokens(texts[k])
        one.update(t)
        two.update(zip([0, *t[:-1]], t))
        ctx.update([0, *t[:-1]])
    n, v = sum(one.values()), len(one)
    cells = Counter()
    for k in train:
        t = _tokens(texts[k])
        for h, w in zip([0, *t[:-1]], t):
            p2, p1 = ((two[h, w] - 1) / (ctx[h] - 1) if ctx[h] > 1 else 0), (one[w] - 1) / (n - 1)
            q = lambda p, fine: 0 if p <= 0 else 1 + int(min(max(-math.log2(p) * fine, 0), lm.STEPS - 2))
            cell = (int(lm.bucket_of(np.array([ctx[h] - 1.0]))[0]) * lm.STEPS + q(p2, 4)) * lm.STEPS + q(p1, 2)
            cells[cell, "n"] += 1
            cells[cell, "p2"] += p2
            cells[cell, "p1"] += p1
    weights = lm.mixture([(c, cells[c, "n"], cells[c, "p2"], cells[c, "p1"]) for c in {c for c, _ in cells}], v)

    def p(h, w):
        a, b, c = weights[int(lm.bucket_of(np.array([float(ctx[h])]))[0])]
        return a * (two[h, w] / ctx[h] if ctx[h] else 0) + b * one[w] / n + c / (v + 1)

    for k, text in [*texts.items(), (None, "a b")]:
        t = _tokens(text)
        assert math.isclose(out[k].score, sum(math.log10(p(h, w)) for h, w in zip([0, *t[:-1]], t)), rel_tol=1e-9)
    for h in (0, "a", "b"):
        assert math.isclose(sum(p(h, w) for w in one) + p(h, "never seen"), 1.0, rel_tol=1e-9)
    assert lm.scores(docs.limit(0), langid.held_out("doc_id", 7)).count() == 0
