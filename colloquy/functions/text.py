"""Token, stem and phrase rules as column expressions; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lx


def words(text: Column) -> Column:
    """Words of a text with trailing punctuation trimmed; array of strings as written."""
    return F.regexp_extract_all(text, F.lit(lx.TRIMMED_WORD), F.lit(0))


def _bare(w: Column) -> Column:
    """A lower-case word without its possessive."""
    return (
        F.when(w.endswith("'s") | w.endswith("’s"), _strip(w, "'s")).when(w.endswith("'"), _strip(w, "'")).otherwise(w)
    )


def normalise(word: Column) -> Column:
    return _bare(F.lower(word))


def _strip(word: Column, suffix: str) -> Column:
    return F.left(word, F.length(word) - F.lit(len(suffix)))


def stem_normalised(w: Column) -> Column:
    """Light suffix stripping of a word already normalised. First rule whose base qualifies wins."""
    rules = [("ies", 3, "y"), ("sses", 4, ""), ("ing", 4, ""), ("ed", 4, ""), ("s", 3, "")]
    out = F.when(F.octet_length(w) <= 3, w)
    for suffix, keep, tail in rules:
        base = _strip(w, suffix)
        fits = w.endswith(suffix) & (F.octet_length(base) >= keep) & ~base.endswith("s")
        out = out.when(fits, F.concat(base, F.lit(tail)) if tail else base)
    return out.otherwise(w)


def stem(word: Column) -> Column:
    return stem_normalised(normalise(word))


def is_stopword(word: Column) -> Column:
    return word.isin(lx.STOPWORDS)


def normalised_words(text: Column) -> Column:
    return F.transform(words(F.lower(text)), _bare)


def normalised_text(text: Column) -> Column:
    """Lower-case words without punctuation, for exact-duplicate matching."""
    return F.array_join(normalised_words(text), " ")


def content_words(text: Column) -> Column:
    return F.filter(normalised_words(text), lambda w: w.rlike(r"\p{L}") & ~is_stopword(w))


def stems(text: Column) -> Column:
    return F.transform(normalised_words(text), stem_normalised)


def question_tokens(text: Column) -> Column:
    """Distinct content words of a question, two characters or more, in order of first use."""
    return F.array_distinct(
        F.filter(normalised_words(text), lambda w: (F.length(w) >= 2) & ~is_stopword(w))
    )


def index_terms(text: Column) -> Column:
    """Terms of the inverted index under the light stemmer, stopwords kept out of nothing."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), stem_normalised)


def name_key(surface: Column) -> Column:
    """Identity of a name: lower-case, possessives off each token, inner blanks collapsed."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(surface), r"\s+", " ")), " ")
    bare = F.transform(tokens, lambda w: F.regexp_replace(w, lx.KEY_POSSESSIVE, ""))
    return F.array_join(F.filter(bare, lambda w: w != ""), " ")


def candidate_keys(text: Column, longest: int = lx.MAX_KEY_WORDS) -> Column:
    """Word n-grams of a question, longest first, as keys to look up among known entities."""
    tagged = F.transform(
        words(text), lambda w: F.struct(F.regexp_replace(F.lower(w), lx.KEY_POSSESSIVE, "").alias("key"), is_stopword(normalise(w)).alias("stop"))
    )
    return F.transform(F.array(tagged), lambda ws: _grams(ws, longest))[0]


def _grams(ws: Column, longest: int) -> Column:
    """The keys of runs of words; a word has no blank, so that a run's key (`name_key`) is that of its words."""
    sizes = F.filter(F.sequence(F.lit(longest), F.lit(1), F.lit(-1)), lambda n: n <= F.size(ws))
    spans = F.flatten(
        F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.slice(ws, i, n)))
    )
    useful = F.filter(spans, lambda s: F.exists(s, lambda w: ~w["stop"]))
    keys = F.transform(useful, lambda s: F.array_join(F.filter(s["key"], lambda k: k != ""), " "))
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= 2))


def contains_phrase(haystack: Column, phrase: str) -> Column:
    """Whole-word containment of a phrase, no letter or digit touching either end."""
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase)
    return haystack.rlike(rf"(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])")


def any_phrase(haystack: Column, phrases: list[str]) -> Column:
    alternatives = "|".join(phrases)
    return haystack.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{alternatives})(?![\p{{L}}\p{{N}}])")


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def asks_now(lower: Column) -> Column:
    return any_phrase(lower, lx.TEMPORAL_CUES)


def asks_history(lower: Column) -> Column:
    """Asks what held before the present value, not what happens before an event."""
    bare = F.regexp_replace(lower, r"[^\p{L}\p{N}]+$", "")
    return (
        any_phrase(lower, lx.HISTORY_CUES)
        | bare.rlike(r"(?<![\p{L}\p{N}])before$")
        | any_phrase(lower, [f"before {what}" for what in lx.BEFORE_WHAT])
    )


def is_question(text: Column) -> Column:
    opener = "|".join(lx.QUESTION_WORDS)
    return F.rtrim(text).endswith("?") | F.lower(text).rlike(rf"^(?:{opener}) ")


def clip(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def prompt_text(text: Column) -> Column:
    """What a prompt can use: unix line ends, no trailing blanks, at most one empty line in a row."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    bare = F.regexp_replace(unix, r"(?m)[ \t]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))


def clip_marked(text: Column, limit: Column, turn_id: Column, read_call: str = "read_session") -> Column:
    """Clip by code point and say what was kept and how to read the rest."""
    marker = F.format_string(
        f"\n… [clipped: %d of %d characters — {read_call} {{around_turn: %d}}]",
        limit.cast("int"), F.length(text), turn_id.cast("long"),
    )
    return F.when(F.length(text) > limit, F.concat(F.left(text, limit), marker)).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4)).cast("long")


def path_scope(cwd: Column) -> Column:
    """The scope a working directory stands for: its last path segment."""
    last = F.element_at(F.split(F.regexp_replace(F.trim(cwd), r"/+$", ""), "/"), -1)
    return F.when(last != "", last)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard of two arrays read as sets; `empty` when both are."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(shared / union)
