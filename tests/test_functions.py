"""Column rules and readers, each on sentences made for the rule."""

import hashlib
import struct
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import dates, embed, hashing, mentions, text
from colloquy.functions.mentions import find_mentions
from colloquy.functions.period import read_period
from colloquy.functions.porter import porter, terms

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def midnight(*ymd):
    return (datetime(*ymd, tzinfo=timezone.utc) - EPOCH) // timedelta(milliseconds=1)


def by_kind(sentence):
    out = {}
    for key, kind, *_ in find_mentions(sentence):
        out.setdefault(kind, []).append(key)
    return out


@pytest.mark.parametrize(
    "sentence, kind, found",
    [
        ("yesterday Lotte Aalto saw Bram near Turku", "name", ["lotte aalto", "bram", "turku"]),
        ("the crew of the Port of Varna stayed", "name", ["port of varna"]),
        ("we met on 3 May 2031 at noon", "date", ["2031-05-03"]),
        ("we met on May 3rd, 2031 at noon", "date", ["2031-05-03"]),
        ("due 2031-05-03 or Oct 9", "date", ["2031-05-03", "10-09"]),
        ("it used 17% of $9k within 40ms", "quantity", ["17%", "$9k", "40ms"]),
        ("open `lib/tide/gauge.py:7` and pyproject.toml", "path", ["lib/tide/gauge.py", "pyproject.toml"]),
        ("export TIDE_TOKEN before the run", "env", ["tide_token"]),
        ("then tide::gauge::read calls reset_level", "symbol", ["tide::gauge::read", "reset_level"]),
    ],
)
def test_each_kind_of_mention(sentence, kind, found):
    assert by_kind(sentence).get(kind) == found


@pytest.mark.parametrize("sentence", ["either/or", "it rained 3/4 of the time", "i.e. nothing", "see https://tide.example/x/y.py"])
def test_prose_is_not_technical(sentence):
    assert not {"path", "symbol", "env"} & set(by_kind(sentence))


@given(st.lists(st.sampled_from(["Żaneta Łoś", "—", "über", "GAUGE_URL", "été", "$4k", "Øresund", "lib/a.rs", "😀"]), max_size=8))
def test_spans_cut_the_bytes_of_the_surface(parts):
    sentence = " ".join(parts)
    for _, _, surface, start, end in find_mentions(sentence):
        assert sentence.encode()[start:end].decode() == surface


def word_by_word(sentence):
    """Every mention, from the letters of all words of one text."""
    spans = mentions.word_spans(sentence)
    found = [(sentence[s:e].lower(), kind, s, e) for kind, s, e in mentions.technical(sentence)]
    held = lambda s, e: any(s < y and x < e for _, _, x, y in found)
    letters = "".join("|" if held(s, e) else mentions._letter(sentence[s:e], o) for s, e, o in spans)
    for hit in mentions._RUNS.finditer(letters):
        run = spans[hit.start() : hit.end()]
        surface = sentence[run[0][0] : run[-1][1]]
        key = {"date": lambda: mentions._date_key([sentence[s:e] for s, e, _ in run]), "quantity": lambda: mentions._quantity_key(surface), "name": lambda: mentions.name_key(surface)}[hit.lastgroup]()
        if key:
            found.append((key, hit.lastgroup, run[0][0], run[-1][1]))
    size = lambda n: len(sentence[:n].encode())
    return [(k, kind, sentence[s:e], size(s), size(e)) for k, kind, s, e in sorted(found, key=lambda m: m[2])]


ODD = """may May March 3 3rd 12th 2024 2024-05-06 van von der the and of Anna Lars NATO X1 Anna's O’Neil’s 'Tis ... . - -- ' ! ? v1.2 V2.0 $5 €9 5% 12ms foo/bar.py
A_B=1 x::y f() (f()) http://a.b/c ./x ǅa İstanbul ß 日本 ١٢ ² Sept sept May. Anna. Dr. Dr.- e.g. U.S. 😀 A😀b / .5 -5 +3 0005 Monday vii v V""".split()
GAPS = [" ", " ", " ", "", ". ", "\n", "  ", ", ", "\t", "\x85", "! "]


@given(st.lists(st.lists(st.tuples(st.sampled_from(ODD), st.sampled_from(GAPS)), max_size=9), max_size=4))
def test_texts_read_as_one_hold_the_mentions_of_each(said):
    texts = ["".join(w + g for w, g in parts) for parts in said]
    found = mentions._mention_lists(pa.array(texts, pa.string())).to_pylist()
    assert [[tuple(m.values()) for m in row] for row in found] == [word_by_word(t) for t in texts]


def test_words_of_no_mention_are_not_looked_at(monkeypatch):
    seen = []
    letter = mentions._letter
    monkeypatch.setattr(mentions, "_letter", lambda word, opens: seen.append(word) or letter(word, opens))
    found = find_mentions("the boat of the port was may be late " * 500 + "as Lotte of Turku said on 3 may and sailed")
    assert [key for key, *_ in found] == ["lotte of turku", "05-03"]
    assert seen == ["Lotte", "of", "Turku", "on", "3", "may"]


#: A Thursday afternoon.
ASKED = midnight(2030, 8, 15) + 15 * 3_600_000


@pytest.mark.parametrize(
    "asked, start, end",
    [
        ("what sailed in June 2029?", (2029, 6, 1), (2029, 7, 1)),
        ("what sailed in nov 2029", (2029, 11, 1), (2029, 12, 1)),
        ("the tide table of 2029-11", (2029, 11, 1), (2029, 12, 1)),
        ("the tide on 2028-02-29", (2028, 2, 29), (2028, 3, 1)),
        ("who steered on 9th June 2029", (2029, 6, 9), (2029, 6, 10)),
        ("who steered on June 9, 2029", (2029, 6, 9), (2029, 6, 10)),
        ("the fleet as of 2027", (2027, 1, 1), (2028, 1, 1)),
        ("who steered yesterday", (2030, 8, 14), (2030, 8, 15)),
        ("who steered last week", (2030, 8, 5), (2030, 8, 12)),
        ("who steered 9 months ago", (2029, 11, 1), (2029, 12, 1)),
        ("who steered four days ago", (2030, 8, 11), (2030, 8, 12)),
        ("who steered a year ago", (2029, 1, 1), (2030, 1, 1)),
        ("yesterday they spoke of June 2029", (2029, 6, 1), (2029, 7, 1)),
    ],
)
def test_periods_named(asked, start, end):
    assert read_period(asked, ASKED) == (midnight(*start), midnight(*end))


@pytest.mark.parametrize("asked", ["does the ferry run in June", "pier 2029", "2029-02-30", "the last ferry", "ages ago", "0 days ago"])
def test_no_period_named(asked):
    assert read_period(asked, ASKED) is None


@given(st.integers(-(10**17), 10**17))
def test_a_far_clock_neither_fails_nor_loses_a_day(now):
    """Days and weeks are plain arithmetic on any clock, months stay within 28 to 31 days."""
    day = now // 86_400_000 * 86_400_000
    assert read_period("yesterday", now) == (day - 86_400_000, day)
    start, end = read_period("last week", now)
    assert end - start == 7 * 86_400_000 and (start // 86_400_000 + 3) % 7 == 0 and 0 <= day - end < 7 * 86_400_000
    start, end = read_period("last month", now)
    assert 28 <= (end - start) // 86_400_000 <= 31 and start < end <= day


def test_a_clock_in_microseconds():
    assert read_period("last year", 1_700_000_000_000_000) is not None
    assert read_period("when was that", (1 << 63) - 1) is None


def test_porter_on_inflections():
    """Inflections of one verb fall together, and the analyser folds, splits and stems."""
    for family in (["sail", "sails", "sailed", "sailing"], ["carry", "carries", "carried"], ["plan", "planned", "planning"]):
        assert len({porter(w) for w in family}) == 1
    assert [porter(w) for w in ("conditional", "rational", "hopeful", "goodness", "feed")] == ["condit", "ration", "hope", "good", "feed"]
    assert terms("Øre's gauges_7 été") == terms("øre S GAUGES_7 ete") and terms("x-y.z") == ["x", "y", "z"]


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_text_columns(spark):
    said = F.lit("Bram's ferry left at 9, and Lotte paid $12 for Bram's seat.")
    row = one(
        spark, words=text.words(said), content=text.content_words(said), key=text.name_key(F.lit("  Lotte’s   AALTO's ")),
        grams=text.candidate_keys(F.lit("the Port of Varna ferry")), clip=text.clip(F.lit("gangway"), 4), short=text.clip(F.lit("gang"), 4),
        prompt=text.prompt_text(F.lit("up  \r\n\n\n\ndown \n")), tokens=text.token_estimate(F.lit("nine char")), scope=text.path_scope(F.lit("/srv/tide/")),
        asks=text.is_question(F.lit("Who steered?")), tells=text.is_question(F.lit("Bram steered.")),
    )
    assert row.words == ["Bram's", "ferry", "left", "at", "9", "and", "Lotte", "paid", "$12", "for", "Bram's", "seat"]
    assert "ferry" in row.content and "and" not in row.content and "at" not in row.content
    assert row.key == "lotte aalto" and "port of varna" in row.grams and "varna ferry" in row.grams
    assert (row.clip, row.short, row.prompt, row.tokens, row.scope) == ("gang…", "gang", "up\n\ndown", 3, "tide")
    assert row.asks and not row.tells


def test_clock_columns(spark):
    row = one(spark, at=dates.rfc3339_ms(F.lit("2031-05-03T06:07:08.250Z")), loose=dates.loose_date_ms(F.lit("2031/05/03 (Sat) 06:07")))
    assert row.at == midnight(2031, 5, 3) + ((6 * 60 + 7) * 60 + 8) * 1000 + 250
    assert row.loose == midnight(2031, 5, 3) + (6 * 60 + 7) * 60_000


@pytest.mark.parametrize("ts", [None, 0, 1_935_000_000_123])
def test_identity_is_a_digest_of_its_parts(spark, ts):
    got = one(spark, u=hashing.derived_uuid(F.lit("pier"), F.lit("bram"), F.lit("cast off"), F.lit(ts).cast("long"))).u
    tail = b"" if ts is None else struct.pack("<q", ts)
    assert got.replace("-", "") == hashlib.sha256(b"pier\0bram\0cast off\0" + tail).hexdigest()[:32]
    assert [len(p) for p in got.split("-")] == [8, 4, 4, 4, 12]


@pytest.mark.parametrize(
    "asked, past",
    [("Who steered the ferry before?", True), ("Who used to steer the ferry?", True), ("Who steers the ferry?", False), ("Was it fixed before Monday's trip?", False)],
)
def test_questions_about_the_past(spark, asked, past):
    assert one(spark, got=text.asks_history(F.lower(F.lit(asked)))).got is past


def test_questions_about_the_present(spark):
    asked = ["who steers it as of today", "where is it right now", "it was nowhere", "an unknown buoy"]
    rows = spark.createDataFrame([(a,) for a in asked], "a string").select("a", text.asks_now(F.col("a")).alias("now")).collect()
    assert {r.a: r.now for r in rows} == dict(zip(asked, [True, True, False, False], strict=True))


def test_hash_vectors_read_whole_texts(spark):
    """The same vector by either path, of unit length, and what stands past 8,000 characters counts."""
    opening = "tide and gauge " * 700
    rows = spark.createDataFrame([(0, opening), (1, opening + "anchor harbour lantern " * 400), (2, "Anchor"), (3, "")], "id long, text string")
    by_embed = {r.id: np.asarray(r.vec) for r in embed.embed(rows, text="text").collect()}
    by_column = {r.id: np.asarray(r.v) for r in rows.select("id", embed.hash_embed("text").alias("v")).collect()}
    for i, vec in by_embed.items():
        assert np.allclose(vec, by_column[i]) and (i == 3 or abs(float(vec @ vec) - 1) < 1e-5)
    assert float(by_embed[0] @ by_embed[1]) < 0.95 and not by_embed[3].any()
    cut = {r.id: np.asarray(r.vec) for r in embed.embed(rows, text="text", chars=8_000).collect()}
    assert np.allclose(cut[0], cut[1])


def test_fnv_follows_its_definition():
    value = 0xCBF29CE484222325
    for byte in "Øre".encode():
        value = (value ^ byte) * 0x100000001B3 % (1 << 64)
    assert embed.fnv1a("Øre".encode()) == value


def test_long_batches_are_read_in_short_runs(spark, monkeypatch):
    """However many rows a batch has, few texts are Python objects at once; results are those of the whole batch."""
    from colloquy.functions import slices

    texts = pa.array([f"Odile Brandt met crew {i} of the Marigold on 2024-05-01." if i % 7 else None for i in range(500)])
    monkeypatch.setattr(slices, "SLICE_BYTES", 1_000)
    seen = []

    def work(part):
        seen.append(len(part))
        return mentions._mention_lists(part)

    assert slices.in_slices(work, texts).equals(mentions._mention_lists(texts)) and max(seen) < 30 and sum(seen) == 500
    assert slices.in_slices(work, texts.slice(0, 0)).type == mentions._mention_lists(texts).type


def test_long_texts_are_embedded_a_few_at_a_time_and_partitions_follow_the_rows(spark):
    import numpy as np

    from colloquy import runtime
    from colloquy.functions.embed import embed

    rows = spark.range(12, numPartitions=1).selectExpr("id", "repeat('word ', 60000) AS text")
    sizes = embed(rows, lambda texts: np.full((len(texts), 1), float(len(texts)), np.float32)).collect()
    assert len(sizes) == 12 and all(1 <= r.vec[0] <= 4 for r in sizes)
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    n = table.count()
    assert runtime.spread_scan(table, 2).rdd.getNumPartitions() == -(-n // 2) and runtime.spread_scan(table, 2).count() == n


def test_bytes_of_many_texts_are_hashed_at_once(monkeypatch):
    """the k-th bytes of all texts of a batch together, the same numbers as byte by byte; repeated words weigh by their count."""
    import pyarrow as pa

    from colloquy.functions import embed

    texts = [None, "", "a", "é日本" * 7, *("x" * i for i in range(40)), "q" * 900]
    calls = []
    monkeypatch.setattr(embed, "fnv1a", lambda data, h=embed.FNV_BASIS, f=embed.fnv1a: calls.append(len(data)) or f(data, h))
    for a in (pa.array(texts), pa.array(texts).slice(2, 30), pa.array([], pa.string()), pa.array([None, None], pa.string())):
        calls.clear()
        got = embed.fnv1a_all(a).tolist()
        assert len(calls) <= embed.FEW
        assert got == [embed.fnv1a((t or "").encode()) for t in a.to_pylist()]
    assert (embed.hash_vector("red red blue") != embed.hash_vector("red blue")).any()


def test_workers_remember_a_bounded_number_of_words():
    from colloquy.functions import embed, mentions, porter

    embed.hash_vector(" ".join(f"word{i}" for i in range(2000)))
    assert embed._word_features.cache_info().currsize >= 2000 and embed._piece_slot.cache_info().currsize < 2000
    assert max(f.cache_parameters()["maxsize"] for f in (embed._word_features, embed._piece_slot, mentions._letter, porter.porter)) <= 100_000
    slots, weights = embed._word_features("word7")
    assert slots.nbytes + weights.nbytes <= 6 * len(slots)
