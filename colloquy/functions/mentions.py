"""Entity mentions by shape.

Every word gets one letter that says what it could be part of (a month, a day, a year, a quantity, the start
of a name, ...). A single pattern over the string of letters then finds dates, quantities and names, in that
order of preference. Paths, symbols and env vars are read from blank-separated tokens first, and words they
cover end whatever run they interrupt.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import lexicon as lx
from colloquy.functions.slices import WORDS_REMEMBERED, in_slices
from colloquy.schema import MENTION, struct

_STOP = frozenset(lx.STOPWORDS)
_CONNECT = frozenset(lx.CONNECTORS)
_WORD = re.compile(r"(?:[^\W_]|['\-.$%#/+’])+")
_TAIL = re.compile(r"[.'\-/#]+$")
_SENTENCE_GAP = re.compile(r"[!?\n]")

# --- technical tokens -------------------------------------------------------------------------
_OPENERS, _CLOSERS = "([{\"'`<*", ",;.!?]}\"'`>*:"
_ENV = re.compile(r"([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)(?==|$)")
_IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
_SYMBOL = re.compile(
    rf"(?P<qualified>{_IDENT}(?:::{_IDENT})+)(?:\(\))?$"
    rf"|(?P<called>{_IDENT}(?:\.{_IDENT})*)\(\)$"
    r"|(?P<snake>(?=[^_]*_)(?=[^a-z]*[a-z])[A-Za-z][A-Za-z0-9_]*[A-Za-z0-9])$"
)
_LINE_SUFFIX = re.compile(r"(?::\d+){1,2}$")
_SEGMENT = r"(?:[^\W]|[\-.@~])+"
_PATH = re.compile(rf"/*{_SEGMENT}(?:/{_SEGMENT})*/*$")
_ROOTED = re.compile(r"/|\.{1,2}/|~/")
_FILE = re.compile(rf"[^/]+\.(?:{'|'.join(lx.EXTENSIONS)})$", re.I | re.A)


def _path_name(token: str) -> str | None:
    if "://" in token:
        return None
    name = _LINE_SUFFIX.sub("", token)
    if not _PATH.match(name) or not any(c.isalpha() for c in name):
        return None
    last = name.strip("/").rsplit("/", 1)[-1]
    is_file = bool(_FILE.match(last))
    if "/" not in name:
        product = last.endswith(".js") and last[0].isupper()
        return name if is_file and not product and len(last.split(".")[0].encode()) >= 2 else None
    return name if is_file or name.count("/") >= 2 or _ROOTED.match(name) else None


def _technical_name(token: str) -> tuple[str, str] | None:
    if hit := _ENV.match(token):
        return "env", hit[1]
    if name := _path_name(token):
        return "path", name
    if hit := _SYMBOL.match(token):
        return "symbol", hit["qualified"] or hit["called"] or hit["snake"]
    return None


def technical(text: str) -> Iterator[tuple[str, int, int]]:
    """`(kind, start, end)` in characters of every path, symbol and env var."""
    for first, last in _marked(text):
        start = last - len(text[first:last].lstrip(_OPENERS))
        token = text[start:last]
        while True:
            bare = token.rstrip(_CLOSERS)
            if bare.endswith(")") and bare.count(")") > bare.count("("):
                bare = bare[:-1]
            if bare == token:
                break
            token = bare
        if token and (found := _technical_name(token)):
            yield found[0], start, start + len(found[1])


#: Only a token with one of these signs inside can be a path, a symbol or an env var.
_SIGN = re.compile(r"[_/.:(][^\s,;.!?\]}\"'`>*:]|\(\)")
_REST = re.compile(r"\S*")


def _marked(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the blank-separated tokens that hold such a sign."""
    end = 0
    while hit := _SIGN.search(text, end):
        start = hit.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = _REST.match(text, hit.end()).end()
        yield start, end


# --- words ------------------------------------------------------------------------------------
def word_spans(text: str) -> list[tuple[int, int, bool]]:
    """`(start, end, opens a sentence)` of every word, in characters."""
    out, opens, at = [], True, 0
    for hit in _WORD.finditer(text):
        start, end = hit.span()
        if not opens and not (start - at == 1 and text[at] == " "):
            opens = bool(_SENTENCE_GAP.search(text, at, start))
        at = end
        if text[end - 1] in ".'-/#":
            bare = end - len(_TAIL.search(hit[0])[0])
            if bare > start:
                out.append((start, bare, opens))
                opens = "." in text[bare:end]
        else:
            out.append((start, end, opens))
            opens = False
    return out


_DAY = re.compile(r"\+?0*([12]\d|3[01]|[1-9])(?:st|nd|rd|th)?$", re.A)
_YEAR = re.compile(r"\+?0*(19\d\d|2[01]\d\d|2200)$", re.A)
_ISO = re.compile(r"\+?0*(19\d\d|2[01]\d\d|2200)-\+?0*(1[0-2]|[1-9])-\+?0*([12]\d|3[01]|[1-9])$", re.A)
_UNIT_QUANTITY = re.compile(r"[-+]?\d.*(?:%|[kmx]|ms|gb|mb)$", re.A)
_CAPITALISED = re.compile(r"(?:[^\W_]|['’\-.])+$")
_ACRONYM = re.compile(r"(?=.*[A-Z])[A-Z0-9]{2,}$", re.A)
_KEY_TAIL = re.compile(lx.KEY_POSSESSIVE)

MONTH, DAY, YEAR, ISO, QUANT, START, CAP, LINK, AFTER_LINK = (1 << i for i in range(9))
_BASE = 0x4E00


def _quantity_key(word: str) -> str | None:
    w = word.lower().replace(",", "")
    if w[:1] in "$€£" and re.search(r"[0-9]", w):
        return w
    if re.match(r"v[0-9]", w) and "." in w:
        return w
    return w if _UNIT_QUANTITY.match(w) else None


@lru_cache(maxsize=WORDS_REMEMBERED)
def _letter(word: str, opens: bool) -> str:
    bits, low, first = 0, word.lower(), word[0]
    if first.isdigit() or first in "+$€£-vV":
        bits |= DAY if _DAY.match(word) else 0
        bits |= YEAR if _YEAR.match(word) else 0
        bits |= ISO if _ISO.match(word) else 0
        bits |= QUANT if _quantity_key(word) else 0
    if low in lx.MONTH_NUMBER:
        bits |= MONTH
    if low in _CONNECT:
        bits |= LINK
    if first.isupper() and _CAPITALISED.match(word):
        if not opens:
            bits |= AFTER_LINK | (CAP if low not in _STOP else 0)
        if re.sub(r"(?:’s)*(?:'s)*$", "", low) not in _STOP:
            inner = any(c.isupper() or "0" <= c <= "9" for c in word[1:])
            if not opens or inner or not (bits & MONTH or low in lx.WEEKDAYS):
                bits |= START
    if _ACRONYM.match(word):
        bits |= START
    return chr(_BASE + bits)


def _having(bit: int) -> str:
    return "[" + "".join(chr(_BASE + b) for b in range(512) if b & bit) + "]"


_RUNS = re.compile(
    "(?P<date>{iso}|{m}{d}{y}?|{d}{m}{y}?)|(?P<quantity>{q})|(?P<name>{s}(?:{c}|{k}{a})*)".format(
        iso=_having(ISO), m=_having(MONTH), d=_having(DAY), y=_having(YEAR), q=_having(QUANT), s=_having(START),
        c=_having(CAP), k=_having(LINK), a=_having(AFTER_LINK),
    )
)


def _date_key(words: list[str]) -> str:
    if len(words) == 1:
        y, m, d = (int(g) for g in _ISO.match(words[0]).groups())
        return f"{y:04}-{m:02}-{d:02}"
    month_first = words[0].lower() in lx.MONTH_NUMBER
    m = lx.MONTH_NUMBER[words[0 if month_first else 1].lower()]
    d = int(_DAY.match(words[1 if month_first else 0])[1])
    year = f"{int(_YEAR.match(words[2])[1]):04}-" if len(words) == 3 else ""
    return f"{year}{m:02}-{d:02}"


def name_key(surface: str) -> str:
    low = surface.lower()
    if "'" not in low and "’" not in low:
        return " ".join(low.split())
    return " ".join(k for k in (_KEY_TAIL.sub("", w) for w in low.split()) if k)


# --- runs of texts ----------------------------------------------------------------------------
#: What a character can be: part of a word, a sign cut off at a word's end, a gap that ends a sentence, the first letter of a word that has to be looked at
#: (wherever it stands, beside a day, between two such words).
_IN_WORD, _CUT, _GAP, _LOOK, _COUNTS, _BESIDE, _NEW = (1 << i for i in range(7))
_FIRSTS = {w[0] for w in (*lx.MONTH_NUMBER, *_CONNECT)}
_CLASSES = np.full(0x110000, _NEW, np.uint8)


def _class(c: str) -> int:
    look = c.isupper() or c.isdigit() or c in "+$€£-vV"
    return (
        _IN_WORD * bool(_WORD.match(c)) | _CUT * (c in ".'-/#") | _GAP * (c in "!?\n") | _LOOK * look
        | _COUNTS * (c.isdigit() or c == "+") | _BESIDE * (c in _FIRSTS and not look or c == "v")
    )


def _classes(codes: np.ndarray) -> np.ndarray:
    found = _CLASSES[codes]
    if (new := found == _NEW).any():
        for c in np.unique(codes[new]).tolist():
            _CLASSES[c] = _class(chr(c))
        found = _CLASSES[codes]
    return found


def _words_of(codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`word_spans` of a long text as three columns."""
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = kinds & _IN_WORD
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, bool)
    cut = kinds & _CUT != 0
    bare, left = ends.copy(), np.flatnonzero(cut[ends - 1])
    tails = left
    while len(left):
        bare[left] -= 1
        left = left[bare[left] > starts[left]]
        left = left[cut[bare[left] - 1]]
    gaps = np.searchsorted(np.flatnonzero(kinds & _GAP), starts)
    opens = np.concatenate([[True], gaps[1:] > gaps[:-1]])
    dots = np.flatnonzero(codes == ord("."))
    real = bare > starts
    dotted = tails[real[tails] & (np.searchsorted(dots, ends[tails]) > np.searchsorted(dots, bare[tails])) & (tails + 1 < len(starts))]
    opens[dotted + 1] = True
    for i in np.flatnonzero(~real[:-1]).tolist():  # signs alone leave open what was
        opens[i + 1] |= opens[i]
    return starts[real], bare[real], opens[real]


def _near(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flags of the word before and of the word behind."""
    none = np.zeros(1, bool)
    return np.concatenate([none, flags[:-1]]), np.concatenate([flags[1:], none])


def find_all(texts: list[str]) -> tuple[list[str], list[str], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Keys, kinds, surfaces and spans in UTF-8 bytes of all mentions in reading order, and how many each text has.

    The texts are read as one, a line each. Words that can be no part of a mention, most of all, are told by their first letters and never become strings.
    """
    line = "\n".join(texts)
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _classes(codes)
    heads = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    starts, ends, opens = _words_of(codes, kinds)
    firsts = kinds[starts]
    look, counts = firsts & _LOOK != 0, firsts & _COUNTS != 0
    found = [(line[s:e].lower(), kind, s, e) for kind, s, e in technical(line)]
    taken = np.zeros(len(starts), bool)
    for _, _, s, e in found:
        taken[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e)] = True
    before, behind = _near(look)
    day_before, day_behind = _near(counts)
    look |= (firsts & _BESIDE != 0) & (before & behind | day_before | day_behind)
    some = np.flatnonzero(look & ~taken)
    # one letter a word, and one that fits nothing between two texts
    place = np.arange(len(starts)) + np.searchsorted(heads, starts, "right") - 1
    letters = np.full(len(starts) + len(texts), _BASE, "<u4")
    read = [_letter(line[s:e], o) for s, e, o in zip(starts[some].tolist(), ends[some].tolist(), opens[some].tolist())]
    letters[place[some]] = np.frombuffer("".join(read).encode("utf-32-le"), "<u4")
    word_at = np.zeros(len(letters), np.int64)
    word_at[place] = np.arange(len(starts))
    for hit in _RUNS.finditer(letters.tobytes().decode("utf-32-le")):
        first, last = int(word_at[hit.start()]), int(word_at[hit.end() - 1])
        start, end, kind = int(starts[first]), int(ends[last]), hit.lastgroup
        surface = line[start:end]
        if kind == "name":
            key = name_key(surface)
        elif kind == "date":
            key = _date_key([line[s:e] for s, e in zip(starts[first : last + 1].tolist(), ends[first : last + 1].tolist())])
        else:
            key = _quantity_key(surface)
        if key:
            found.append((key, kind, start, end))
    found.sort(key=lambda m: m[2])
    begins, closes = np.array([m[2] for m in found], np.int64), np.array([m[3] for m in found], np.int64)
    owner = np.searchsorted(heads, begins, "right") - 1
    surfaces = [line[m[2] : m[3]] for m in found]
    if len(line) and not line.isascii():
        sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(sizes)])
        begins, closes, heads = at[begins], at[closes], at[np.minimum(heads, len(line))]
    shift = heads[owner] if len(found) else np.zeros(0, np.int64)
    return [m[0] for m in found], [m[1] for m in found], surfaces, begins - shift, closes - shift, np.bincount(owner, minlength=len(texts))


def find_mentions(text: str) -> list[tuple[str, str, str, int, int]]:
    """`(key, kind, surface, start, end)` with spans in UTF-8 bytes, in reading order."""
    keys, kinds, surfaces, starts, ends, _ = find_all([text])
    return list(zip(keys, kinds, surfaces, starts.tolist(), ends.tolist()))


MENTION_ARRAY = T.ArrayType(MENTION)


def _mention_lists(texts: pa.Array) -> pa.Array:
    *columns, numbers = find_all([t or "" for t in texts.to_pylist()])
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
    items = pa.StructArray.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "kind", "surface", "start", "end"]
    )
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(numbers)]).astype(np.int32)), items)


@F.arrow_udf(MENTION_ARRAY)
def mentions_of(texts: pa.Array) -> pa.Array:
    return in_slices(_mention_lists, texts)


@F.pandas_udf(T.BooleanType())
def has_technical(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: next(technical(t or ""), None) is not None)


@F.pandas_udf(T.StringType())
def without_technical(texts: pd.Series) -> pd.Series:
    """The text with every word that lies inside a path, symbol or env var blanked out."""

    def blank(text: str) -> str:
        spans = [(s, e) for _, s, e in technical(text)]
        if not spans:
            return text
        chars = list(text)
        for start, end, _ in word_spans(text):
            if any(s <= start and end <= e for s, e in spans):
                chars[start:end] = " " * (end - start)
        return "".join(chars)

    return texts.map(lambda t: blank(t or ""))


_PIECES = pa.list_(pa.struct([("text", pa.string()), ("key", pa.string()), ("kind", pa.string())]))


@F.arrow_udf(T.ArrayType(struct(text=T.StringType(), key=T.StringType(), kind=T.StringType())))
def split_mentions(texts: pa.Array, mentions: pa.Array) -> pa.Array:
    """A text cut into plain and mentioned pieces; of overlapping mentions the first, longest wins."""

    def split(text: str, found) -> list[dict]:
        raw, at, out = (text or "").encode(), 0, []
        piece = lambda s, e, m=None: {
            "text": raw[s:e].decode(errors="replace"), "key": m and m["key"], "kind": m and m["kind"],
        }
        for m in sorted(found if found is not None else [], key=lambda m: (m["start"], -m["end"])):
            start, end = min(len(raw), m["start"]), min(len(raw), m["end"])
            if start < at or end <= start:
                continue
            if start > at:
                out.append(piece(at, start))
            out.append(piece(start, end, m))
            at = end
        if at < len(raw) or not out:
            out.append(piece(at, len(raw)))
        return out

    listed = lambda t, m: pa.array([split(*x) for x in zip(t.to_pylist(), m.to_pylist())], _PIECES)
    return in_slices(listed, texts, mentions)


def extract_mentions(turns: DataFrame) -> DataFrame:
    """The mentions table of a turns table. One pass over the texts; nothing is shuffled."""
    hit = F.explode(mentions_of("text")).alias("m")
    return turns.select(F.col("id").alias("turn_id"), hit).select(
        "turn_id", F.col("m.key").alias("entity"), "m.kind", "m.surface", "m.start", "m.end"
    )
