"""Language identification by cross-parsing entropy.

A bounded sample of labelled texts per language becomes a suffix automaton. A text is parsed greedily against each automaton:
the longest match from where the last one ended is a phrase. The language that needs the fewest phrases per symbol wins.
The automaton and its restart make one table of states and symbols with the phrase ends marked, so that many
blocks of text are walked side by side. Symbols are the sample's letters in lower case and one space for any run of
other characters; each block of `BLOCK` symbols is parsed on its own, and whole texts are parsed.

Texts that are null or hold no letter are `und` with score 0. Ties go to the smaller language name. Without any labelled
text every document is `und`. A null key is neither learnt from nor held out. Rows with equal keys stay apart; columns
other than key, text and language are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.tables import held, slices, texts_of

#: Characters of whole labelled texts learnt per language; texts of over a quarter of it come last.
SAMPLE_CHARS = 32_000
#: Languages learnt at most, the most frequent first.
LANGUAGES = 256
#: Symbols of a block, and letters told apart.
BLOCK, LETTERS = 1024, 61
SPACE, OTHER, END = LETTERS, LETTERS + 1, LETTERS + 2
WIDTH = LETTERS + 3
UNKNOWN = "und"
#: Standard deviations from the middle from which a rate is none of a language's own, windows that tell of a length, and symbols of the longest.
SPREAD, WINDOWS, PASSAGE = 8, 16, 64


def held_out(key: str, parts: int, part: int = 2) -> Column:
    """Whether crc32 of the key as text falls in the part kept for tests."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(docs: DataFrame, chars: int = SAMPLE_CHARS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """At most about `chars` characters of whole texts per language, spread by hash. Keys are ranked; only texts chosen travel."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_k"), F.col(lang).alias("_l"), F.length(text).alias("_n"), F.xxhash64(F.col(key).cast("string")).alias("_h")
    )
    counts = rows.groupBy("_l").count().orderBy(F.desc("count"), "_l").limit(LANGUAGES).select("_l")
    order = [(F.col("_n") > chars // 4).asc(), F.col("_h"), F.col("_k"), F.col("_n")]
    most = 400
    salted = rows.join(F.broadcast(counts), "_l").withColumn("_s", F.pmod("_h", F.lit(64)))
    near = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_l", "_s").orderBy(*order))).where(F.col("_r") <= most)
    top = near.withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy(*order))).where(F.col("_r") <= most)
    so_far = Window.partitionBy("_l").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    chosen = top.withColumn("_b", F.coalesce(F.sum("_n").over(so_far), F.lit(0))).where(F.col("_b") < chars).select("_k", "_l")
    texts = docs.select(F.col(key).alias("_k"), F.col(lang).alias("_l"), F.col(text).alias("_t")).join(F.broadcast(chosen.distinct()), ["_k", "_l"])
    found: dict[str, list[str]] = {}
    for r in texts.where(F.col("_t").isNotNull()).orderBy("_l", "_k", "_t").collect():
        found.setdefault(r["_l"], []).append(r["_t"])
    return found


def automaton(symbols: list[int]) -> tuple[list[dict[int, int]], int]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    after: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return after, len(after)


class Parser:
    """The automata of all languages in one table: where each state goes on a symbol and how many phrases end there."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        counts = Counter(ch for t in texts.values() for x in t for ch in x.lower() if ch.isalpha() and ord(ch) < 0x10000)
        letters = [ch for ch, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]]
        self.classes = np.full(0x10000, SPACE, np.uint8)
        alphabetic = np.fromiter((chr(i).isalpha() or 0xD800 <= i < 0xE000 for i in range(0x10000)), bool, 0x10000)
        self.classes[alphabetic] = OTHER
        self.classes[[ord(ch) for ch in letters]] = np.arange(len(letters), dtype=np.uint8)
        rows, roots = [], []
        for language in self.languages:
            # an end between texts keeps matches inside one; it is no symbol of a parsed text
            symbols = [c for t in texts[language] for c in [*self.symbols(t).tolist(), END]]
            after, n = automaton(symbols)
            base = sum(map(len, rows))
            roots.append(base)
            to = np.full((n, WIDTH), -1, np.int64)
            for state, out in enumerate(after):
                for c, target in out.items():
                    to[state, c] = target
            to[:, END] = -1
            root = np.where(to[0] >= 0, to[0], 0)
            alone = (to[0] < 0).astype(np.int64)  # a symbol that the root lacks is a phrase of its own
            alone[END] = 0
            ends = np.where(to >= 0, 0, alone[None, :] + (np.arange(n) > 0)[:, None])
            to = np.where(to >= 0, to, root[None, :]) + base
            rows.append(((to * WIDTH) << 2 | ends).astype(np.int32 if (base + n) * WIDTH < 1 << 28 else np.int64))
        self.table = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int32)
        self.roots = np.asarray(roots, np.int64) * WIDTH

    def symbols(self, text: str) -> np.ndarray:
        """Classes of a text, runs of spaces as one."""
        units = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), "<u2")
        classes = self.classes[units]
        space = classes == SPACE
        return np.delete(classes, np.flatnonzero(space[1:] & space[:-1]) + 1)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and its number of symbols; 0 where it has no letter."""
        streams = [self.symbols(t) for t in texts]
        sizes = np.asarray([len(s) for s in streams], np.int64)
        owner = np.repeat(np.arange(len(texts)), -(-sizes // BLOCK))
        blocks = [s[i : i + BLOCK] for s in streams for i in range(0, len(s), BLOCK)]
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        if blocks and self.languages:
            lengths = np.asarray([len(b) for b in blocks])
            order = np.argsort(-lengths, kind="stable")
            grid = np.full((int(lengths.max()) + 1, len(blocks)), END, np.uint8)
            for column, i in enumerate(order.tolist()):
                grid[: lengths[i], column] = blocks[i]
            state = np.repeat(self.roots[:, None], len(blocks), axis=1).astype(self.table.dtype)
            ended = np.zeros_like(state)
            active = np.searchsorted(-lengths[order], -np.arange(-1, len(grid) - 1), "right")  # a block and its end
            for step in range(len(grid)):
                n = int(active[step])
                went = self.table.take(state[:, :n] + grid[step, :n])
                ended[:, :n] += went & 3
                state[:, :n] = went >> 2
            for row, found in zip(total, ended, strict=True):
                row += np.bincount(owner[order], found, len(texts)).astype(np.int64)
        lettered = np.asarray([bool((s != SPACE).any()) and any(map(str.isalpha, t)) for s, t in zip(streams, texts, strict=True)], bool)
        return total, np.where(lettered, sizes, 0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and phrases per symbol of each text."""
        return self.judge(texts)[:3]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, phrases per symbol and symbols of each text."""
        total, sizes = self.phrases(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts)), sizes
        rates = total / np.maximum(sizes, 1)
        best = rates.argmin(axis=0)
        first = rates.min(axis=0)
        second = np.partition(rates, 1, axis=0)[1] if len(rates) > 1 else np.full(len(texts), np.inf)
        score = np.where(np.isinf(second), 1.0, second / np.maximum(first + second, 1e-300)) if len(rates) > 1 else np.ones(len(texts))
        known = sizes > 0
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, score, 0.0), np.where(known, first, 1.0), sizes


def _parser(texts: tuple[tuple[str, tuple[str, ...]], ...]) -> Parser:
    return Parser({language: list(x) for language, x in texts})


Bounds = dict[str, list[tuple[int, float]]]


def bounds(learnt: dict[str, list[str]]) -> Bounds:
    """Per language (symbols, phrase rate) in rising order of symbols: the most a text of so many symbols or more has.

    Each half of a language's texts is cut into windows of 8 to `PASSAGE` characters and parsed by the other half; the bound is the median
    rate of a length and `SPREAD` standard deviations (1.4826 times the median distance from it, one phrase at least), so that a few odd or
    wrongly labelled texts do not move it. Longer texts keep the bound of `PASSAGE`, as they differ from one another by more than windows of
    few texts tell. Half a sample makes more phrases than the whole, so the bound errs towards keeping. Lengths with less than `WINDOWS`
    windows have no bound of their own, and texts shorter than any bound are never foreign.
    """
    found: Bounds = {}
    for language, texts in learnt.items():
        whole = sorted(set(texts))
        whole = whole if len(whole) > 1 else [half for t in whole for half in (t[: len(t) // 2], t[len(t) // 2 :])]
        sides = [(Parser({language: whole[1 - i :: 2]}), whole[i::2]) for i in (0, 1)]
        found[language], least, size = [], 1.0, 8
        while size <= PASSAGE:
            rates = []
            for parser, other in sides:
                _, _, rate, n = parser.judge([t[i : i + size] for t in other for i in range(0, len(t) - size + 1, size)])
                rates.extend(rate[n > 0].tolist())
            if len(rates) >= WINDOWS:
                middle = float(np.median(rates))
                spread = max(1.4826 * float(np.median(np.abs(np.asarray(rates) - middle))), 1 / size)
                least = min(least, middle + SPREAD * spread)
                found[language].append((size, least))
            size *= 2
    return found


def is_foreign(limits: Bounds, language: str, rate: float, symbols: int) -> bool:
    """Whether a text parses like none of the languages learnt: above the bound of the one it is nearest to."""
    reached = [bound for size, bound in limits.get(language, ()) if size <= symbols]
    return bool(reached) and rate > reached[-1]


def identify(docs: DataFrame, learnt: dict[str, list[str]], key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), limits: Bounds | None = None) -> DataFrame:
    """Per document lang_pred, score and `phrase_rate` (phrases per symbol in the best language; 1 for `und`); with `limits` also `is_foreign`."""
    columns = list(dict.fromkeys([key, text, *carry]))
    kept = docs.select(*columns)
    out = [c for c in columns if c != text or text in carry]
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in out)
    frozen = tuple((k, tuple(v)) for k, v in sorted(learnt.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held(_parser, frozen)
        for batch in slices(batches, text):
            lang, score, rate, symbols = parser.judge(texts_of(batch, text))
            own = [batch.column(columns.index(c)) for c in out]
            made, names = [pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], ["lang_pred", "score", "phrase_rate"]
            if limits is not None:
                made.append(pa.array([is_foreign(limits, *x) for x in zip(lang, rate.tolist(), symbols.tolist(), strict=True)], pa.bool_()))
                names.append("is_foreign")
            yield pa.RecordBatch.from_arrays([*own, *made], names=[*out, *names])

    tail = ", is_foreign boolean" if limits is not None else ""
    return kept.mapInArrow(run, f"{kinds}, lang_pred string, score double, phrase_rate double{tail}")
