"""Each stage of the pipeline on its own input, against the plain versions."""

from collections import Counter

import corpus_pipeline as cp
from plain import jaccard_components, suffix_spans
from tokenizers import Tokenizer

from colloquy.llm.tables import stored

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_in_turn(spark, vocabulary):
    assert [name for name, _ in cp.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = []
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name.replace(" ", "-"))
        assert docs.columns == list(cp.COLUMNS)
        after = {r.doc_id: r for r in docs.collect()}
        kept.append(len(after))
        assert set(after) <= set(before) and docs.count() == len(after)
        if name in ("language ID", "quality classifier", "n-gram Jaccard join"):
            assert all(after[k] == before[k] for k in after)
        gone = set(before) - set(after)
        if name == "language ID":
            assert all(not any(map(str.isalpha, before[k].text or "")) for k in gone)
        if name == "quality classifier":
            judged = [k for k in before if k in labels]
            assert sum((k in after) == bool(labels[k]) for k in judged) >= 0.95 * len(judged)
        if name == "n-gram Jaccard join":
            groups = jaccard_components([(k, r.text) for k, r in before.items()])
            assert set(after) == {k for k, (_, root) in groups.items() if k == root} and gone
        if name == "suffix-array dedup":
            rows = [(k, (r.text or "").encode()) for k, r in before.items()]
            for (k, b), mask in zip(rows, suffix_spans(rows), strict=True):
                text = bytes(x for x, f in zip(b, mask, strict=True) if not f).decode("utf-8", "ignore")
                assert (after[k].text, after[k].n_chars, after[k].lang, after[k].source) == (text, len(text), before[k].lang, before[k].source)
    packed = cp.STAGES[-1][1](spark, docs, SF).collect()
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {k: [*library.encode(r.text, add_special_tokens=False).ids, 0] for k, r in after.items()}
    got = {}
    for r in sorted(packed, key=lambda r: r.piece):
        got[r.doc_id] = got.get(r.doc_id, []) + r.ids
    assert got == want
    filled = Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(map(len, want.values())) // 2048) + 2


def test_odd_rows_go_through(spark, odd_docs, tmp_path):
    odd_docs.select("doc_id").selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = stored(odd_docs, "odd")
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
    assert {r.doc_id for r in docs.collect()} <= {None, 1, 2, 5, 6, 7}
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count() > 0
    empty = stored(odd_docs.limit(0), "none")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_language_stage_drops_foreign_texts_and_keeps_short_ones(spark):
    foreign = [
        "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita e quanto a dir qual era e cosa dura esta selva selvaggia e aspra e forte",
        "litwo ojczyzno moja ty jestes jak zdrowie ile cie trzeba cenic ten tylko sie dowie kto cie stracil dzis pieknosc twa w calej ozdobie widze i opisuje bo tesknie po tobie",
        "mieleni minun tekevi aivoni ajattelevi lahteani laulamahan saa ani sanelemahan sukuvirtta suoltamahan lajivirtta laulamahan sanat suussani sulavat puhe et putoelevat",
        "alle mensen worden vrij en gelijk in waardigheid en rechten geboren zij zijn begiftigd met verstand en geweten en behoren zich jegens elkander in een geest van broederschap te gedragen",
        "butun insanlar hur haysiyet ve haklar bakimindan esit dogarlar akil ve vicdana sahiptirler ve birbirlerine karsi kardeslik zihniyeti ile hareket etmelidirler",
        "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью",
    ]
    short = ["Hello.", "Yes", "The weather is nice today.", "Guten Morgen", "Bonjour tout le monde"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    plain = [r.text for r in docs.where("crc32(cast(string(doc_id) as binary)) % 4 = 2 AND text IS NOT NULL").orderBy("doc_id").limit(60).collect()]
    starts = [s for t in plain for n in (10, 25, 60) if len(s := t[:n]) == n and all(c.isalpha() or c in " .," for c in s)]
    texts = foreign + short + starts
    planted = spark.createDataFrame([(10_000_000 + i, t, None, "a", len(t)) for i, t in enumerate(texts)], docs.schema)
    kept = {r.doc_id - 10_000_000 for r in cp.language(spark, docs.union(planted), SF).collect() if r.doc_id >= 10_000_000}
    assert not kept & set(range(len(foreign)))
    assert set(range(len(foreign), len(foreign) + len(short))) <= kept
    assert len(starts) > 30 and len(kept) - len(short) == len(starts)
