"""The built-in embedder: signed feature hashing of words, light stems and character trigrams."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import mentions
from colloquy.functions.slices import WORDS_REMEMBERED, in_slices
from colloquy.schema import HASH_DIM

HASH_MODEL = "hash-384"
EMBED_BATCH = 64
# Fixed values of the 64-bit FNV-1a hash and of the feature weights.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
WORD_WEIGHT, STEM_WEIGHT, TRIGRAM_WEIGHT = 1.0, 0.5, 0.25
_MASK = (1 << 64) - 1
#: Longest texts of a batch whose last bytes are hashed one by one.
FEW = 8


def fnv1a(data: bytes, h: int = FNV_BASIS) -> int:
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & _MASK
    return h


def _slot(feature: str) -> tuple[int, float]:
    h = fnv1a(feature.encode())
    return h % HASH_DIM, -1.0 if h >> 63 else 1.0


#: Only pieces of words come again in other words.
_piece_slot = lru_cache(maxsize=WORDS_REMEMBERED)(_slot)


def light_stem(word: str) -> str:
    w = word.lower()
    for tail in ("'s", "’s", "'"):
        if w.endswith(tail):
            w = w[: -len(tail)]
            break
    size = len(w.encode())
    if size > 3:
        for suffix, keep, tail in (("ies", 3, "y"), ("sses", 4, ""), ("ing", 4, ""), ("ed", 4, ""), ("s", 3, "")):
            base = w[: -len(suffix)]
            if w.endswith(suffix) and len(base.encode()) >= keep and not base.endswith("s"):
                return base + tail
    return w


@lru_cache(maxsize=WORDS_REMEMBERED)
def _word_features(low: str) -> tuple[np.ndarray, np.ndarray]:
    padded = f" {low} "
    slots = [(_slot(f"w:{low}"), WORD_WEIGHT), (_slot(f"s:{light_stem(low)}"), STEM_WEIGHT)]
    slots += [(_piece_slot(f"t:{padded[i : i + 3]}"), TRIGRAM_WEIGHT) for i in range(len(padded) - 2)]
    return (
        np.array([slot for (slot, _), _ in slots], dtype=np.int16),
        np.array([sign * w for (_, sign), w in slots], dtype=np.float32),
    )


def hash_vector(text: str) -> np.ndarray:
    words = Counter([text[s:e].lower() for s, e, _ in mentions.word_spans(text)])
    if not words:
        return np.zeros(HASH_DIM, dtype=np.float32)
    parts = [_word_features(w) for w in words]
    # weights are quarters, so that the sums are exact in any order
    times = np.repeat(list(words.values()), [len(p[0]) for p in parts])
    sums = np.bincount(
        np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) * times, minlength=HASH_DIM
    ).astype(np.float32)
    norm = np.sqrt((sums * sums).sum(dtype=np.float32))
    return sums / norm if norm > 0 else sums


def fnv1a_all(texts: pa.Array) -> np.ndarray:
    """FNV-1a of every text's UTF-8 bytes (null: empty): the k-th bytes of all texts at once, as long as more than a few have one."""
    column = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    order = np.argsort(starts[:-1] - starts[1:], kind="stable")  # longest first
    at, sizes = starts[:-1][order], np.diff(starts)[order]
    h, prime = np.full(len(at), FNV_BASIS, np.uint64), np.uint64(FNV_PRIME)
    rounds = int(sizes[FEW]) if len(sizes) > FEW else 0
    left = len(at) - np.searchsorted(sizes[::-1], np.arange(rounds), "right")  # how many are longer than k
    for k, n in enumerate(left.tolist()):
        h[:n] = (h[:n] ^ raw[at[:n] + k]) * prime
    for i in range(min(FEW, len(at))):
        if sizes[i] > rounds:
            h[i] = fnv1a(raw[at[i] + rounds : at[i] + sizes[i]].tobytes(), int(h[i]))
    out = np.empty_like(h)
    out[order] = h
    return out


@F.arrow_udf(T.LongType())
def fnv1a_64(texts: pa.Array) -> pa.Array:
    """FNV-1a of the UTF-8 bytes, as the signed LONG with the same bits."""
    return pa.array(fnv1a_all(texts).view(np.int64))


def _hash_vectors(texts: pa.Array) -> pa.Array:
    flat = [hash_vector(t or "") for t in texts.to_pylist()]
    ends = np.arange(len(flat) + 1, dtype=np.int32) * HASH_DIM
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.float32)))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def hash_embed(texts: pa.Array) -> pa.Array:
    return in_slices(_hash_vectors, texts)


EmbedFn = Callable[[list[str]], "np.ndarray"]


def hash_embed_fn(texts: list[str]) -> np.ndarray:
    return np.stack([hash_vector(t) for t in texts]) if texts else np.zeros((0, HASH_DIM), np.float32)


def embed(
    df: DataFrame, embed_fn: EmbedFn = hash_embed_fn, *, text: str = "text", prefix: str = "", vec: str = "vec",
    batch: int = EMBED_BATCH, chars: int | None = None, lenient: bool = False,
) -> DataFrame:
    """Append unit vectors. `embed_fn` maps a list of texts to a matrix and is called in small batches.

    Whole texts are embedded; `chars` cuts them for a model of the caller's that takes no more. When lenient, a batch that `embed_fn` fails on
    has null vectors instead of failing the job.
    """

    def tried(texts: list[str]) -> np.ndarray | None:
        try:
            return np.asarray(embed_fn(texts), dtype=np.float32)
        except Exception:
            if not lenient:
                raise
            return None

    def embedded(column: pa.Array) -> pa.Array:
        texts = [prefix + ((t or "")[:chars] if chars else (t or "")) for t in column.to_pylist()]
        parts = [texts[i : i + batch] for i in range(0, len(texts), batch)]
        out = [(part, tried(part)) for part in parts]
        found = [m for _, m in out if m is not None]
        flat = np.concatenate(found) if found else np.zeros((0, 1), np.float32)
        failed = np.concatenate([np.full(len(part), m is None) for part, m in out]) if out else np.zeros(0, bool)
        ends = np.append(0, np.cumsum(~failed)).astype(np.int32) * flat.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.reshape(-1), pa.float32()), mask=pa.array(failed))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(column: pa.Array) -> pa.Array:
        return in_slices(embedded, column)

    return df.withColumn(vec, vectors(F.col(text)))
