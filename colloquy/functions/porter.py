"""The index analyser: unicode words without diacritics, Porter-stemmed (Porter, 1980)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.slices import WORDS_REMEMBERED, in_slices

_TOKEN = re.compile(r"[^\W_]+")
# Consonants become `c` and vowels `v`, so that the measure of a stem is a count of `vc`.
_RUNS = re.compile(r"c+|v+")

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive",
    "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _shape(stem: str) -> str:
    out = []
    for i, c in enumerate(stem):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return "".join(r[0] for r in _RUNS.findall(_shape(stem))).count("vc")


def _short_end(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(maxsize=WORDS_REMEMBERED)
def porter(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (cut := _longest(w, ("ed", "ing"))) and "v" in _shape(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (cut := _longest(w, table)) and _measure(w[: -len(cut)]) > 0:
            w = w[: -len(cut)] + table[cut]
    if cut := _longest(w, (*_STEP4, "ion")):
        stem = w[: -len(cut)]
        if _measure(stem) > 1 and (cut != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or (m == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def terms(text: str) -> list[str]:
    low = text.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return [porter(t) for t in _TOKEN.findall(low)]


@F.arrow_udf(T.ArrayType(T.StringType()))
def porter_terms(texts: pa.Array) -> pa.Array:
    return in_slices(lambda part: pa.array([terms(t or "") for t in part.to_pylist()], pa.list_(pa.string())), texts)
