import hashlib
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colloquy.llm import packing, pieces, suite, wavelet
from colloquy.llm.tables import Remembered
from colloquy.llm.vocab import WordEncoder

SF = "/root/testdata/sf0.001"
TEXT = st.text(alphabet=st.sampled_from("aB'sé  \n\t.ÉßſİΣ你😀\x85\xa0▁<s>-,"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_agenda_agrees_with_the_library(text):
    model = pieces.model(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    got = np.frombuffer(model.encode([text])[0], "<u4").tolist()
    assert got == model.library.encode(text, add_bos=True, add_eos=True)
    assert model.differing == 0


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_words_apart_give_the_ids_of_the_whole(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = WordEncoder(__import__("public_tokenizers").path(name)) if name not in ENCODERS else ENCODERS[name]
        ENCODERS[name] = encoder
        assert encoder.encode([text]) == encoder.ids([text])


ENCODERS: dict = {}
CUT = ["'", "'s", "'re", "'ll", "'d", "'S", "a", "Bc", "l", "e", "12", ".", ",", "é", "×", "“", "’s", "€", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\0", "²", "日本", "<|endoftext|>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(CUT), max_size=9).map("".join), max_size=4))
def test_texts_cut_at_once_give_the_ids_of_each(texts):
    """op10: contractions, white space and signs where texts meet, and texts with other characters between them."""
    name = "byte_bpe_50k.json"
    encoder = ENCODERS.setdefault(name, None) or WordEncoder(public_tokenizers.path(name))
    ENCODERS[name] = encoder
    assert encoder.encode(texts) == encoder.ids(texts)


def test_words_with_marks_behind_them_are_encoded_as_pieces():
    encoder = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["an oak, an oak.", "an oak; an oak\nan oak's 'oak"]
    assert encoder.encode(texts) == encoder.ids(texts)
    assert not encoder.words and {b"an", b" oak", b",", b" an", b"'s", b" '", b"oak"} <= set(encoder.pieces)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdelnorst", min_size=2, max_size=40))
def test_agenda_as_list_and_as_heap(run):
    model = pieces.model(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    whole = pieces.SHORT
    found = []
    for pieces.SHORT in (0, 100):
        found.append(model.agenda(list(run)))
    pieces.SHORT = whole
    assert found[0] == found[1]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pieces_query(spark, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = []
    for d in docs:
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        want.append((d.doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert _rows(suite.op5_pieces(spark, SF)) == sorted(want, key=repr)


def test_pieces_of_odd_rows(spark, odd_docs, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.encode(odd_docs, path)
    rows = got.collect()
    assert Counter(r.doc_id for r in rows)[2] == 2 and len(rows) == 9
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True) and r.decoded == library.decode(r.ids)
    assert {r.decoded for r in pieces.decode(got, path).collect()} == {r.decoded for r in rows}
    assert pieces.encode(odd_docs.limit(0), path).count() == 0


def test_wavelet_matrix_against_a_list():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (7, 5), (1500, 3), (5000, 50257)):
        values = rng.integers(0, top, n).astype(np.uint32)
        matrix = wavelet.WaveletMatrix.open(n, **wavelet.WaveletMatrix.build(values).row())
        assert matrix.decode().tolist() == values.tolist()
        for i in rng.integers(0, n, 30).tolist() if n else []:
            assert matrix.access(i) == values[i]
            v = int(values[i])
            places = np.flatnonzero(values == v)
            assert matrix.count(v) == len(places) and matrix.rank(v, i) == int((places < i).sum())
            assert [matrix.select(v, k) for k in range(len(places))][:40] == places.tolist()[:40]
            assert matrix.select(v, len(places)) == -1
        assert matrix.count(70_000) == 0


def _encoded(docs, vocabulary, name):
    library = Tokenizer.from_file(vocabulary(name))
    return [(d.doc_id, np.asarray([*library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")) for d in docs]


def test_wavelet_query(spark, vocabulary):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    want, start = [], 0
    for key, ids in _encoded(docs, vocabulary, "byte_bpe_50k.json"):
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert _rows(suite.op10_wavelet(spark, SF)) == sorted(want, key=repr)


def test_wavelet_of_odd_rows(spark, odd_docs, vocabulary, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 40)
    path = wavelet.written(odd_docs, vocabulary("byte_bpe_50k.json"))
    rows = wavelet.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert all(r.ids == [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0] for r in rows)
    flat = [t for r in rows for t in r.ids]
    for token in (0, flat[0], 11):
        assert sorted(r.position for r in wavelet.occurrences(spark, path, token).collect()) == [i for i, t in enumerate(flat) if t == token]
        assert sum(r.n for r in wavelet.count(spark, path, token).collect()) == flat.count(token)
    empty = wavelet.written(odd_docs.limit(0), vocabulary("byte_bpe_50k.json"))
    assert wavelet.read(spark, empty).count() == 0


def _check_packing(rows, capacity, want):
    """want: document -> list of id arrays (repeated rows: the same array again)."""
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == Counter((k, p, s, len(part), zlib.crc32(part.tobytes())) for k, ids in want for p, s in enumerate(range(0, len(ids), capacity)) for part in [ids[s : s + capacity]])
    return len(filled)


def test_packing_query(spark, vocabulary):
    want = _encoded(spark.read.parquet(f"{SF}/documents.parquet").collect(), vocabulary, "word_bpe_49k.json")
    n = _check_packing(suite.op6_packing(spark, SF).collect(), 2048, want)
    assert n <= np.ceil(sum(len(i) for _, i in want) / 2048) + 2


def test_packing_of_odd_rows(spark, odd_docs, vocabulary):
    docs = odd_docs.collect()
    packed = packing.pack(odd_docs, vocabulary("word_bpe_49k.json"), capacity=64, rounds=50)
    rows = packed.collect()
    _check_packing(rows, 64, _encoded(docs, vocabulary, "word_bpe_49k.json"))
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert packing.pack(odd_docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_solver_holds_the_histogram_and_stays_near_the_bound():
    rng = np.random.default_rng(5)
    for n in (0, 1, 40, 5000):
        histogram = Counter(np.minimum(512, np.maximum(1, rng.lognormal(4.5, 1, n).astype(int))).tolist())
        plan = packing.solve(dict(histogram), 512, 200)
        held = Counter()
        for content, times in plan.items():
            assert sum(content) <= 512 and times > 0
            for size in content:
                held[size] += times
        assert held == histogram
        assert sum(plan.values()) <= 1.02 * sum(k * v for k, v in histogram.items()) / 512 + 2


def test_words_are_put_together_as_the_library_encodes_them():
    """op6, op10: cores in joined strings, words around a line feed from their parts, and lookups that do not walk through all that is remembered."""
    texts = ["Éa b.\nThe end", "a\n\nb c.\n d", "ÀÖØß ÿ,.;\nX\nYz!! q", "1a b2 don't I'LL\nno", "ª º µ × a÷b\nc", "", " a", "x \ny", "日本 a\nb", "<|endoftext|> a", "a\nb.\nc,,\nd e"] * 2
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e, few = WordEncoder(public_tokenizers.path(name)), WordEncoder(public_tokenizers.path(name), 4, 4)
        library = Tokenizer.from_file(public_tokenizers.path(name))
        library.encode_special_tokens = True
        want = [array("I", x.ids).tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
        assert [few.encode([t])[0] for t in texts] == want  # forgets all the time
        assert e.encode(texts) == want and e.core_ids(["ab"]) == e.ids(["ab"]) and e.bare is not None
    assert WordEncoder.lines("a.\nb\nc!") == [" a", ".", "\n", "b", "", "\n", "c", "!"] and WordEncoder.lines("a\n1") == []

    class Counted(Remembered):
        def __iter__(self):
            raise AssertionError("walks through all that is remembered")

    known = Counted(100)
    known.update({"a": b"1"})
    assert known.missing({"a", "b"}) == {"b"}


def test_packing_in_small_runs_of_text(spark, vocabulary):
    """pipeline: behind other stages texts are taken and words remembered in smaller numbers; the pieces stay the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    few = packing.pieces(docs, path, remember=(50, 50), text_bytes=2_000)
    assert sorted(map(str, few.collect())) == sorted(map(str, packing.pieces(docs, path).collect()))
    assert packing.TEXT_BYTES_BEHIND < packing.TEXT_BYTES and sum(packing.BEHIND_OTHERS) * 2 < 700_000
