"""Token ids by the tokenizers library, a word at a time, so that a repeated word is encoded once.

Both published pipelines split a text before they merge: one drops white space, the other keeps a single space with the
word behind it. Between two non-space characters a single space is therefore always a border, and encoding the words
apart gives the ids of the whole text. Texts with other runs of white space are given to the library whole.

For the byte-level pipeline that keeps its spaces, texts of common characters are cut as its rule cuts them, in columns of characters: the cuts of
many texts are one Arrow array, its distinct ones are encoded, and the ids of the texts are gathered by number. Other texts go word by word.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from colloquy.llm.tables import Remembered, held

#: Words, and cores of words, remembered in a Python worker.
REMEMBERED, CORES = 1_200_000, 900_000
#: A word of letters with marks behind it, in scripts whose case folding is one letter to one letter.
MARKS = ".,:;!?|)*$%&#"
CORE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Cores given to the library in one string, and how many of the first ones are encoded both ways before that is relied on.
JOINED, TRIED = 2_000, 200


#: What a character is to the rule that cuts texts; OTHER is any that it is not asked about here.
SPACE, BLANK, LETTER, DIGIT, SIGN, END, OTHER = range(7)
_KINDS = np.full(0x2101, OTHER, np.uint8)
for _c in [*range(33, 127), *map(ord, "¡¢£¤¥¦§¨©«¬®¯°±´¶·¸»¿×÷€"), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
    _KINDS[_c] = LETTER if chr(_c).isalpha() else DIGIT if chr(_c).isdigit() else SIGN
for _c in [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)]:
    _KINDS[_c] = LETTER
_KINDS[[32, 0]] = SPACE, END
_KINDS[[9, 10, 13]] = BLANK


def kinds_of(line: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a line, and what each is."""
    codes = np.frombuffer(line.encode("utf-32-le"), "<u4")
    return codes, _KINDS[np.minimum(codes, len(_KINDS) - 1)]


def cuts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the rule begins a piece, in a line of texts with an END behind each: contractions, letters, digits and signs with a space before them, white space."""
    runs = np.maximum(kinds, BLANK)
    first = np.concatenate([[True], runs[1:] != runs[:-1]]) | (kinds == END)
    # of white space before a piece the last character stands alone, or is a part of the piece if it is a space
    behind = np.flatnonzero(first[1:] & (runs[:-1] == BLANK) & (runs[1:] != BLANK) & (runs[1:] != END)) + 1
    first[behind - 1] = True
    first[behind[kinds[behind - 1] == SPACE]] = False
    quotes = np.flatnonzero(codes == ord("'"))
    quotes = quotes[first[quotes]]
    quotes = quotes[kinds[quotes + 1] == LETTER]
    a, b = codes[quotes + 1], codes[quotes + 2]  # a letter is never the last
    one = np.isin(a, [*map(ord, "stmd")])
    two = (b == ord("e")) & np.isin(a, [*map(ord, "rv")]) | (a == ord("l")) & (b == ord("l"))
    first[quotes[one | two] + 1] = False
    first[quotes[one] + 2] = True
    first[quotes[two] + 3] = True
    return np.flatnonzero(first)


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    def __init__(self, path: str, words: int = REMEMBERED, cores: int = CORES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        rules = json.dumps(json.load(open(path))["pre_tokenizer"])
        self.drops_space = '"Removed"' in rules and '"invert": true' in rules
        self.keeps_space = json.loads(rules).get("type") == "ByteLevel" and json.loads(rules).get("use_regex", True) and not json.loads(rules).get("add_prefix_space", True)
        self.words: dict[str, bytes] = Remembered(words)
        self.cores: dict[str, bytes] = Remembered(cores)
        self.pieces: dict[bytes, bytes] = Remembered(cores)
        self.bare = None
        if '"ByteLevel"' in rules and (self.drops_space or self.keeps_space):
            self.bare = Tokenizer(self.library.model)  # the same merges without the rules that split and fold a text: cores are split and folded
            self.letters, self.tried = byte_letters(), False
            self.bare.pre_tokenizer = pre_tokenizers.Split(self.letters[10], "isolated")
            border = self.bare.encode(self.letters[10]).ids
            self.border, self.bare = border[0] if border else None, self.bare if len(border) == 1 else None

    def ids(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def core_ids(self, cores: list[str]) -> list[bytes]:
        """Ids of runs of letters (behind one space at most) and other pieces: many in a string, with line feeds between them, which none holds."""
        if cores and self.bare and not self.tried:
            some, self.tried = cores[:TRIED], True
            if self._joined(some) != self.ids(some):
                self.bare = None
        if not self.bare:
            return self.ids(cores)
        return [x for i in range(0, len(cores), JOINED) for x in self._joined(cores[i : i + JOINED])]

    def _joined(self, cores: list[str]) -> list[bytes]:
        found = self.bare.encode_batch_fast(["\n".join(cores).encode().decode("latin-1").translate(self.letters)], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        ends, raw = 4 * np.flatnonzero(ids == self.border), ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)])]

    def learn(self, words: set[str]) -> None:
        """Encode new words; a word with marks behind it, and words with a line feed between them, are put together from their parts."""
        new = self.words.missing(words)
        lead = "" if self.drops_space else " "
        whole, short, long = [], [], []
        for word in new:
            core = word.rstrip(MARKS)
            if core.isalpha() and core.isascii() or CORE.fullmatch(core):
                short.append((word, lead + (core.lower() if self.drops_space else core), word[len(core) :]))
            elif self.keeps_space and (not word or word != word.strip()):
                continue  # next to other white space: left to the whole text
            elif self.keeps_space and "\n" in word and (parts := self.lines(word)):
                long.append((word, parts))
            else:
                whole.append(word)
        self.words.update(zip(whole, self.ids([lead + w for w in whole]), strict=True))
        asked = {c for _, c, _ in short}.union((m for _, _, m in short), *(p for _, p in long))
        unknown = self.cores.missing(asked)  # asked once, as asking may forget what was not asked
        cores, marks = [c for c in unknown if c[-1:].isalpha()], [c for c in unknown if not c[-1:].isalpha()]
        self.cores.update(zip(cores, self.core_ids(cores), strict=True))
        self.cores.update(zip(marks, self.ids(marks), strict=True))
        cores = self.cores
        self.words.update((w, cores[a] + cores[b]) for w, a, b in short)
        self.words.update((w, b"".join(map(cores.__getitem__, p))) for w, p in long)

    @staticmethod
    def lines(word: str) -> list[str]:
        """Core, marks, line feed, core, marks, and so on; nothing if a line is not a core with marks. Only the first has a space before it."""
        parts: list[str] = []
        for line in word.split("\n"):
            core = line.rstrip(MARKS)
            if not CORE.fullmatch(core):
                return []
            parts += ["\n", core, line[len(core) :]] if parts else [" " + core, line[len(core) :]]
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.drops_space:
            split = [t.replace("\n", " ").split(" ") for t in texts]
            self.learn(set().union(*split))
            known = self.words.__getitem__
            return [b"".join(map(known, w)) for w in split]
        if not self.keeps_space:
            return self.ids(texts)
        return self.in_pieces(texts) if texts and self.bare else self.in_words(texts)

    def in_pieces(self, texts: list[str]) -> list[bytes]:
        """Texts cut by the rule at once; those with a character that it is not asked about go word by word."""
        line = "\0".join(texts) + "\0"
        codes, kinds = kinds_of(line)
        if (kinds == OTHER).any() or np.count_nonzero(kinds == END) > len(texts):
            heads = np.cumsum([0, *(len(t) + 1 for t in texts)])
            odd = set((np.searchsorted(heads, np.flatnonzero(kinds == OTHER), "right") - 1).tolist())
            odd.update(i for i, t in enumerate(texts) if "\0" in t)
            rest = [t for i, t in enumerate(texts) if i not in odd]
            apart, whole = iter(self.in_words([texts[i] for i in sorted(odd)])), iter(self.in_pieces(rest) if rest else [])
            return [next(apart if i in odd else whole) for i in range(len(texts))]
        at = cuts(codes, kinds)
        ends, data = np.flatnonzero(kinds[at] == END), line.encode()
        if len(data) > len(line):
            sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF)
            at = (np.cumsum(sizes) - sizes)[at]
        offsets = np.append(at, len(data)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn_pieces(set(distinct))
        parts = list(map(self.pieces.__getitem__, distinct))
        which, ids = coded.indices.to_numpy(), np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        each = sizes[which]
        upto = np.cumsum(each)
        place = np.repeat((np.cumsum(sizes) - sizes)[which] - upto + each, each)
        place += np.arange(len(place))
        raw, stops = ids[place].tobytes(), (4 * upto[ends]).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def learn_pieces(self, pieces: set[bytes]) -> None:
        """Encode new pieces; those without a line feed in joined strings."""
        new = self.pieces.missing(pieces)
        lines = [p for p in new if b"\n" in p]
        plain = list(new.difference(lines, [b"\0"]))
        self.pieces.update(zip(plain, self.core_ids([p.decode() for p in plain]), strict=True))
        self.pieces.update(zip(lines, self.ids([p.decode() for p in lines]), strict=True))
        self.pieces[b"\0"] = b""

    def in_words(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        self.learn(set().union(*(w[1:] for w in split)))
        heads = self.ids([w[0] for w in split])
        known, out = self.words.__getitem__, []
        for text, head, words in zip(texts, heads, split, strict=True):
            try:
                if words[0] != words[0].rstrip() or not words[0] and len(words) > 1:
                    raise KeyError
                out.append(head + b"".join(map(known, words[1:])))
            except KeyError:
                out.extend(self.ids([text]))
        return out


def encoder(path: str, words: int = REMEMBERED, cores: int = CORES) -> WordEncoder:
    return held(WordEncoder, path, words, cores)
