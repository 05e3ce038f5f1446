"""Content-derived identities."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def little_endian(value: Column) -> Column:
    """A LONG as eight little-endian bytes."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)]))


def uuid_of(payload: Column) -> Column:
    """The first half of a SHA-256, written 8-4-4-4-12."""
    digest = F.sha2(payload, 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def _bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")




def derived_uuid(session_id: Column, speaker: Column, text: Column, ts: Column) -> Column:
    """Identity of a turn that came without one: who said what where, and when if that is known."""
    zero = F.unhex(F.lit("00"))
    stamp = F.coalesce(little_endian(ts), F.unhex(F.lit("")))
    return uuid_of(F.concat(_bytes(session_id), zero, _bytes(speaker), zero, _bytes(text), zero, stamp))


def note_uuid(source_uuids: Column, namespace: str = "note") -> Column:
    """Identity of a note: its sources, in any order."""
    zero = F.unhex(F.lit("00"))
    joined = F.aggregate(
        F.array_sort(source_uuids), F.concat(_bytes(F.lit(namespace)), zero),
        lambda acc, u: F.concat(acc, _bytes(u), zero),
    )
    return uuid_of(joined)


def brief_uuid(scope: Column, previous: Column, text: Column, namespace: str = "brief") -> Column:
    zero = F.unhex(F.lit("00"))
    parts = [F.lit(namespace), scope, F.coalesce(previous, F.lit("")), text]
    return uuid_of(F.concat(*[piece for p in parts for piece in (_bytes(p), zero)]))


@F.pandas_udf(T.StringType())
def vector_digest(vectors: pd.Series) -> pd.Series:
    """Short digest of a vector rounded to 1e-4, so float noise below that does not show."""

    def digest(v):
        if v is None:
            return None
        scaled = np.asarray(v, dtype=np.float32) * np.float32(10_000.0)
        rounded = np.copysign(np.floor(np.abs(scaled) + np.float32(0.5)), scaled)
        return hashlib.sha256(rounded.astype("<i4").tobytes()).hexdigest()[:16]

    return vectors.map(digest)
