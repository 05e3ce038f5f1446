"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is cut where no piece of the vocabulary can reach across: before each run of the space mark. Each such
word goes through an agenda of adjacent symbol pairs, best score first and leftmost among equals, until no pair is a
piece; symbols outside the vocabulary fall back to bytes. Words are remembered between Arrow batches, and each new
word is checked against the library in its batch; should the two differ, the library's ids are taken and counted.

Null and empty texts get the begin and end ids alone. Any length is encoded whole. Rows with equal keys stay apart;
columns other than the key and the text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from colloquy.llm.tables import Remembered, held, slices, texts_of

SPACE = "▁"
NO_PIECE = float("-inf")
#: Words, and runs of joinable symbols, remembered in a Python worker.
REMEMBERED = 600_000
#: Symbols up to which the agenda is a plain list; beyond, a heap.
SHORT = 16


class PieceModel:
    """The vocabulary of a model file and the agenda over it."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.scores[piece], self.ids[piece] = lib.get_score(i), i
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece holds a space mark after other characters: words cannot be encoded one by one")
        self.joins = {pair for p in self.scores for pair in zip(p, p[1:])}
        self.words: dict[str, bytes] = Remembered(REMEMBERED)
        self.runs: dict[str, bytes] = Remembered(REMEMBERED)
        self.differing = 0

    def agenda(self, symbols: list[str]) -> list[str]:
        """Merge the best pair until none is a piece: the greatest score first, the leftmost among equals."""
        scores, n = self.scores, len(symbols)
        if n <= SHORT:
            score = scores.get
            waiting = [score(a + b, NO_PIECE) for a, b in zip(symbols, symbols[1:])]
            while waiting and (best := max(waiting)) > NO_PIECE:
                i = waiting.index(best)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del waiting[i]
                if i < len(waiting):
                    waiting[i] = score(symbols[i] + symbols[i + 1], NO_PIECE)
                if i:
                    waiting[i - 1] = score(symbols[i - 1] + symbols[i], NO_PIECE)
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                waiting.append((-scores[pair], i, pair))
        heapq.heapify(waiting)
        while waiting:
            _, i, pair = heapq.heappop(waiting)
            j = after[i]
            if j >= n or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (right := pair + symbols[k]) in scores:
                    heapq.heappush(waiting, (-scores[right], i, right))
            if (h := before[i]) >= 0 and (left := symbols[h] + pair) in scores:
                heapq.heappush(waiting, (-scores[left], h, left))
        return [s for s in symbols if s]

    def encode_run(self, run: str) -> bytes:
        """Ids of symbols that pieces can join."""
        out = []
        for symbol in self.agenda(list(run)):
            if symbol in self.ids:
                out.append(self.ids[symbol])
            elif self.bytes:
                out.extend(self.bytes[b] for b in symbol.encode())
            else:
                out.append(self.library.unk_id())
        return np.asarray(out, "<u4").tobytes()

    def encode_word(self, word: str) -> bytes:
        """Ids of the space mark and `word`, cut first where no piece joins two neighbours."""
        chars, out, start, runs = SPACE + word, [], 0, self.runs
        ends = [i + 1 for i, pair in enumerate(zip(chars, chars[1:])) if pair not in self.joins]
        for end in [*ends, len(chars)]:
            run = chars[start:end]
            if (ids := runs.get(run)) is None:
                runs[run] = ids = runs.older.get(run) or self.encode_run(run)
            out.append(ids)
            start = end
        return b"".join(out)

    def learn(self, words: set[str]) -> None:
        """Encode words not seen before, in one batch with the library's answer beside ours."""
        new = self.words.missing(words)
        self.runs.missing(set())
        plain = [w for w in new if w and not w.startswith(SPACE)]
        for word in new:
            self.words[word] = self.encode_word(word)
        for word, theirs in zip(plain, self.library.encode(plain, num_threads=1), strict=True):
            if (checked := array("I", theirs).tobytes()) != self.words[word]:
                self.words[word] = checked
                self.differing += 1

    @staticmethod
    def split(text: str) -> list[str]:
        """The words of a text, each without its leading space mark."""
        if SPACE in text or "  " in text or text.startswith(" "):
            return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return text.split(" ") if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        words = [self.split(t) for t in texts]
        self.learn(set().union(*words))
        begin, end = (np.asarray([i], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id()))
        known = self.words.__getitem__
        return [begin + b"".join(map(known, w)) + end for w in words]

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def model(path: str) -> PieceModel:
    return held(PieceModel, path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per document its token ids and the text they decode to; with `digests`, lengths and SHA-256 of both instead."""
    kept = docs.select(key, text)
    kind = kept.schema[key].dataType.simpleString()
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in slices(batches, text, 4 << 20):
            packed = pieces.encode(texts_of(batch, text))
            ids = [np.frombuffer(p, "<u4").tolist() for p in packed]
            decoded = pieces.library.decode(ids)
            if digests:
                made = [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ]
            else:
                made = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)]
            names = [key, *(c.split()[0] for c in columns.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), *made], names=names)

    return kept.mapInArrow(run, f"`{key}` {kind}, {columns}")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Text of each row's ids; null ids: empty."""
    kept = tokens.select(key, ids)
    kind = kept.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = model(path).library
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(library.decode(lists) if lists else [], pa.string())], names=[key, "decoded"])

    return kept.mapInArrow(run, f"`{key}` {kind}, decoded string")
