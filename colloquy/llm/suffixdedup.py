"""Removal of byte strings that an earlier document holds, by longest-previous-factor arrays over sharded suffixes.

Every window of `length` bytes is sent where all its equals are. A window's anchor is its least hash of a shorter string, so equal
windows have equal anchors and neighbouring windows mostly share one: a maximal run of windows with one anchor is a piece.

1. A chunk of texts tells each bucket of anchors its distinct pieces (as hashes) with the least document of each. The bucket answers: the
   anchor is in one document alone; the same piece is in an earlier document; or other pieces of that anchor must be compared.
2. Only pieces to compare travel as text. A bucket sorts their suffixes, takes the common prefix of neighbours, and from each the nearest suffix
   of a smaller document on either side: the longer of the two common prefixes is its longest previous factor. A window whose
   factor reaches `length` has an earlier match.
3. Back in its chunk a text loses all bytes that such windows cover.

Anchors with more than `PIECES` pieces in a chunk are hot: their windows go out one by one, by their own hash, each once per
chunk with its least document, so no anchor fills a bucket. Matches never cross documents. Null texts are empty; equal keys are
one document's worth of order and remove nothing from each other; a null key counts as the largest. Texts shorter than `length` keep all.
An empty table gives an empty result; columns not named in `carry` are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.llm import grams
from colloquy.llm.grams import U, packed5, unpacked5
from colloquy.llm.ngramjoin import PLACES

LENGTH = 50
#: Distinct pieces of one anchor in a chunk, above which its windows go out one by one.
PIECES = 64
LAST_KEY = (1 << 63) - 1
LOW40 = U((1 << 40) - 1)
ALONE, COPY, COMPARE, HOT = range(4)


def _windows(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Least hash of a shorter string in the window at each byte, and whether a whole window begins there."""
    gram = max(8, length // 16 * 8)
    n = len(raw) - length + 1
    eight = np.ndarray((len(raw) - 7,), "<u8", raw.data if raw.flags.c_contiguous else np.ascontiguousarray(raw).data, strides=(1,))
    count = len(raw) - gram + 1
    value = np.zeros(count, np.uint64)
    for j in range(0, gram, 8):
        value ^= eight[j : j + count] * PLACES[j // 8]
        value ^= value >> U(29)
    value *= U(0xBF58476D1CE4E5B9)
    value ^= value >> U(32)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    if span > width:
        value = np.minimum(value[: n], value[span - width : span - width + n])
    inside = np.zeros(n + 1, np.int8)
    sizes = np.diff(starts)
    long = np.flatnonzero(sizes >= length)
    inside[starts[long]] += 1
    np.add.at(inside, starts[long + 1] - length + 1, -1)
    return value[:n], np.cumsum(inside[:n]).astype(bool)


class Pieces:
    """The runs of windows of a chunk, and its distinct pieces in the order in which buckets are asked."""

    def __init__(self, batch: pa.RecordBatch, length: int):
        self.raw, self.starts = grams.text_of(batch)
        keys = batch.column(batch.schema.get_field_index("_key")).to_pylist()
        self.keys = np.asarray([LAST_KEY if k is None else k for k in keys], np.int64)
        empty = np.empty(0, np.int64)
        self.first, self.last, self.owner, self.anchor, content = empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        if len(self.raw) >= length:
            least, inside = _windows(self.raw, self.starts, length)
            begins = inside.copy()
            begins[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
            heads = self.starts[:-1][np.diff(self.starts) >= length]
            begins[heads] = True
            self.first = np.flatnonzero(begins)
            self.owner = np.searchsorted(self.starts, self.first, "right") - 1
            ends = np.append(self.first[1:], len(self.raw)) - 1
            self.last = np.minimum(ends, self.starts[self.owner + 1] - length)
            self.anchor = grams.mixed(least[self.first]) >> U(16)
            content = grams.spans_hash(grams.BYTE_VALUES[self.raw], self.first, self.last + length) & LOW40
        order = np.lexsort((self.keys[self.owner], content, self.anchor))
        anchor, content, key = self.anchor[order], content[order], self.keys[self.owner][order]
        new_anchor = np.ones(len(order), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new = new_anchor.copy()
        new[1:] |= content[1:] != content[:-1]
        group = np.cumsum(new_anchor) - 1
        hot = (np.bincount(group[new], minlength=group[-1] + 1 if len(group) else 0) > PIECES)[group] if len(group) else new
        new &= ~hot | new_anchor  # of a hot anchor one entry
        at = np.flatnonzero(new)
        self.item = np.empty(len(order), np.int64)
        self.item[order] = np.cumsum(new) - 1
        self.item_anchor, self.item_key, self.item_hot, self.item_run = anchor[at], key[at], hot[at], order[at]
        self.item_content = np.where(self.item_hot, U(0), content[at])

    def cut(self, buckets: int) -> np.ndarray:
        return grams.cuts(self.item_anchor, buckets)


ASK = pa.schema([("_bucket", pa.int32()), ("_chunk", pa.int32()), ("anchors", pa.binary()), ("contents", pa.binary()), ("keys", pa.binary()), ("hot", pa.binary())])
ASK_DDL = "_bucket int, _chunk int, anchors binary, contents binary, keys binary, hot binary"
TOLD = pa.schema([("_chunk", pa.int32()), ("_bucket", pa.int32()), ("status", pa.binary())])
TOLD_DDL = "_chunk int, _bucket int, status binary"
SENT = pa.schema([("_bucket", pa.int32()), ("_chunk", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary()), ("status", pa.binary())])
SENT_DDL = "_bucket int, _chunk int, ids binary, keys binary, sizes binary, texts binary, status binary"
FOUND = pa.schema([("_chunk", pa.int32()), ("_bucket", pa.int32()), ("ids", pa.binary()), ("matched", pa.binary()), ("status", pa.binary())])
FOUND_DDL = "_chunk int, _bucket int, ids binary, matched binary, status binary"


def _planes8(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes8(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _chunk_of(batch: pa.RecordBatch) -> int:
    return batch.column(batch.schema.get_field_index("_chunk"))[0].as_py()


def _ask(table: pa.Table, length: int, buckets: int) -> pa.Table:
    batch = grams.whole(table)
    p = Pieces(batch, length)
    cut = p.cut(buckets)
    return pa.Table.from_pylist([
        {"_bucket": b, "_chunk": _chunk_of(batch), "anchors": packed5(p.item_anchor[a:z]), "contents": packed5(p.item_content[a:z]), "keys": _planes8(p.item_key[a:z]), "hot": p.item_hot[a:z].tobytes()}
        for b, (a, z) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False)) if z > a
    ], schema=ASK)


def _tell(table: pa.Table) -> pa.Table:
    """For each piece of a bucket: alone, in an earlier document, to be compared, or hot."""
    rows = table.to_pylist()
    sizes = [len(r["hot"]) for r in rows]
    anchor, content = (np.concatenate([unpacked5(r[c]) for r in rows]) for c in ("anchors", "contents"))
    key = np.concatenate([_unplanes8(r["keys"]) for r in rows])
    hot = np.frombuffer(b"".join(r["hot"] for r in rows), bool)
    order = np.lexsort((key, content, anchor))
    a, c, k, h = anchor[order], content[order], key[order], hot[order]
    new_anchor = np.ones(len(a), bool)
    new_anchor[1:] = a[1:] != a[:-1]
    new = new_anchor.copy()
    new[1:] |= c[1:] != c[:-1]
    heads = np.flatnonzero(new_anchor)
    group = np.cumsum(new_anchor) - 1
    several = (np.add.reduceat(new, heads) > 1) & (np.minimum.reduceat(k, heads) != np.maximum.reduceat(k, heads))
    any_hot = np.logical_or.reduceat(h, heads)
    earliest = k[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    status = np.where(any_hot[group], HOT, np.where(k > earliest, COPY, np.where(several[group], COMPARE, ALONE))).astype(np.uint8)
    back = np.empty_like(status)
    back[order] = status
    return pa.Table.from_pylist([
        {"_chunk": r["_chunk"], "_bucket": r["_bucket"], "status": part.tobytes()} for r, part in zip(rows, np.split(back, np.cumsum(sizes)[:-1]), strict=True)
    ], schema=TOLD)


def _bytes_at(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bytes:
    where = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return raw[where].tobytes()


def _hot_windows(p: Pieces, status: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of a hot anchor: its place, its hash, its document's key."""
    runs = np.flatnonzero(status[p.item] == HOT)
    size = p.last[runs] - p.first[runs] + 1
    place = np.repeat(p.first[runs] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    hashed = grams.spans_hash(grams.BYTE_VALUES[p.raw], place, place + length)
    return place, hashed, p.keys[np.repeat(p.owner[runs], size)]


def _distinct(hashed: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of equal hashes by key, in order of hash, and for each entry which of them it equals."""
    order = np.lexsort((key, hashed))
    new = np.ones(len(order), bool)
    new[1:] = hashed[order][1:] != hashed[order][:-1]
    item = np.empty(len(order), np.int64)
    item[order] = np.cumsum(new) - 1
    return order[np.flatnonzero(new)], item


def _statuses(table: pa.Table) -> np.ndarray:
    rows = sorted((r for r in table.select(["_bucket", "status"]).to_pylist() if r["status"] is not None), key=lambda r: r["_bucket"])
    return np.frombuffer(b"".join(r["status"] for r in rows), np.uint8)


def _send(texts: pa.Table, told: pa.Table, length: int, buckets: int) -> pa.Table:
    if not texts.num_rows:
        return SENT.empty_table()
    batch = grams.whole(texts)
    p, status, chunk = Pieces(batch, length), _statuses(told), _chunk_of(batch)
    rows = [{"_bucket": -1 - chunk % buckets, "_chunk": chunk, "status": status.tobytes()}]

    def put(bucket: np.ndarray, ids: np.ndarray, keys: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(at)).tolist():
            some = order[at[b] : at[b + 1]]
            rows.append({"_bucket": b, "_chunk": chunk, "ids": grams.planes(ids[some]), "keys": _planes8(keys[some]), "sizes": grams.planes(size[some]), "texts": _bytes_at(p.raw, begin[some], size[some])})

    items = np.flatnonzero(status == COMPARE)
    run = p.item_run[items]
    shift = U(49 - buckets.bit_length())
    put((p.item_anchor[items] >> shift).astype(np.int64), items, p.item_key[items], p.first[run], p.last[run] - p.first[run] + length)
    place, hashed, key = _hot_windows(p, status, length)
    first, _ = _distinct(hashed, key)
    put((hashed[first] >> U(64 - buckets.bit_length() + 1)).astype(np.int64), len(status) + np.arange(len(first)), key[first], place[first], np.full(len(first), length))
    return pa.Table.from_pylist(rows, schema=SENT)


def common_prefixes(columns: list[np.ndarray]) -> np.ndarray:
    """Bytes that each row of sorted suffixes (as big-endian words, first word first) shares with the one before; 0 for the first."""
    n = len(columns[0])
    lcp, equal = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for word in columns:
        differ = word[1:] ^ word[:-1]
        same = np.zeros(max(n - 1, 0), np.int64)
        for byte in range(8):
            same += differ >> U(56 - 8 * byte) == 0
        lcp[1:] += np.where(equal, same, 0)
        equal &= differ == 0
    return lcp


def longest_previous(document: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Longest prefix that each suffix, in suffix order, shares with a suffix of a smaller document; shorter than `least`: 0.

    On each side the nearest suffix of a smaller document is sought by jumping: a neighbour that is not smaller has all up to its own
    nearest smaller one behind it.
    """

    def one_side(document: np.ndarray, shared: np.ndarray) -> np.ndarray:
        n = len(document)
        near, reach = np.arange(n) - 1, shared.copy()
        on = np.arange(1, n)
        while len(on := on[(near[on] >= 0) & (reach[on] >= least) & (document[near[on]] >= document[on])]):
            step = near[on]
            reach[on], near[on] = np.minimum(reach[on], reach[step]), near[step]
        found = (near >= 0) & (reach >= least)
        found[found] = document[near[found]] < document[found]
        return np.where(found, reach, 0)

    if not len(document):
        return np.empty(0, np.int64)
    right = np.append(lcp[1:], 0)[::-1].copy()
    right[0] = 0
    return np.maximum(one_side(document, lcp), one_side(document[::-1].copy(), right)[::-1])


def _match(table: pa.Table, length: int) -> pa.Table:
    """Of the pieces that met: the windows that an earlier document holds."""
    rows = table.to_pylist()
    if rows[0]["_bucket"] < 0:
        return pa.Table.from_pylist([{k: r[k] for k in ("_chunk", "_bucket", "status")} for r in rows], schema=FOUND)
    size = np.concatenate([grams.unplanes(r["sizes"]) for r in rows]).astype(np.int64)
    key = np.concatenate([_unplanes8(r["keys"]) for r in rows])
    raw = np.frombuffer(b"".join(r["texts"] for r in rows) + b"\0" * 8, np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = size - length + 1
    piece = np.repeat(np.arange(len(size)), count)
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    eight = np.ndarray((len(raw) - 7,), ">u8", raw.data, strides=(1,))
    columns = [eight[place + j].astype(np.uint64) for j in range(0, length, 8)]
    if length % 8:
        columns[-1] &= U(((1 << 8 * (length % 8)) - 1) << (64 - 8 * (length % 8)))
    order = np.lexsort(columns[::-1])
    lcp = np.minimum(common_prefixes([c[order] for c in columns]), length)
    factor = np.empty(len(order), np.int64)
    factor[order] = longest_previous(key[piece][order], lcp, length)
    matched = factor >= length
    ends = np.cumsum([len(r["sizes"]) // 4 for r in rows])
    out, piece_from, window_ends = [], 0, np.concatenate([[0], np.cumsum(count)])
    for r, to in zip(rows, ends.tolist(), strict=True):
        some = matched[window_ends[piece_from] : window_ends[to]]
        if some.any():
            ids, n = grams.unplanes(r["ids"]), count[piece_from:to]
            hit = np.logical_or.reduceat(some, np.concatenate([[0], np.cumsum(n)[:-1]]))
            out.append({"_chunk": r["_chunk"], "_bucket": r["_bucket"], "ids": grams.planes(ids[hit]), "matched": np.packbits(some[np.repeat(hit, n)]).tobytes()})
        piece_from = to
    return pa.Table.from_pylist(out, schema=FOUND)


def removed(p: Pieces, found: pa.Table, length: int) -> np.ndarray:
    """Which bytes of a chunk go."""
    status = _statuses(found)
    change = np.zeros(len(p.raw) + 1, np.int32)

    def drop(begin: np.ndarray, end: np.ndarray) -> None:
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)

    run_status, own = status[p.item], p.keys[p.owner]
    whole = np.flatnonzero((run_status != HOT) & ((run_status == COPY) | (own > p.item_key[p.item])))
    drop(p.first[whole], p.last[whole] + length)
    answers = [r for r in found.select(["ids", "matched"]).to_pylist() if r["ids"] is not None]
    place, hashed, key = _hot_windows(p, status, length)
    first, item = _distinct(hashed, key)
    later = np.flatnonzero(key > key[first][item]) if len(item) else item
    drop(place[later], place[later] + length)
    if answers:
        ids = np.concatenate([grams.unplanes(r["ids"]) for r in answers]).astype(np.int64)
        size = np.ones(len(ids), np.int64)
        some = ids < len(status)
        run = p.item_run[ids[some]]
        size[some] = p.last[run] - p.first[run] + 1
        bits, at = [], 0
        for r in answers:
            n = int(size[at : at + len(r["ids"]) // 4].sum())
            bits.append(np.unpackbits(np.frombuffer(r["matched"], np.uint8), count=n).astype(bool))
            at += len(r["ids"]) // 4
        matched, offset = np.concatenate(bits), np.concatenate([[0], np.cumsum(size)[:-1]])
        known = np.full(len(status), -1)
        known[ids[some]] = offset[some]
        runs = np.flatnonzero((known[p.item] >= 0) & (own == p.item_key[p.item]) & (run_status == COMPARE))
        n = p.last[runs] - p.first[runs] + 1
        inner = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        hit = matched[np.repeat(known[p.item[runs]], n) + inner]
        window = (np.repeat(p.first[runs], n) + inner)[hit]
        drop(window, window + length)
        marked = np.zeros(len(first), bool)
        marked[ids[~some] - len(status)] = True
        window = place[np.flatnonzero(marked[item])] if len(item) else place
        drop(window, window + length)
    return np.cumsum(change[:-1]) > 0


def _finisher(length: int, key: str, carry: list[str], digests: bool, schema: pa.Schema):
    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        batch = grams.whole(texts)
        p = Pieces(batch, length)
        gone = removed(p, found, length)
        keep = p.raw[np.flatnonzero(~gone)].tobytes()
        total = np.concatenate([[0], np.cumsum(gone)])
        columns = {"n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept": [], "kept_text": [], "kept_sha256": []}
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[p.starts[:-1][np.diff(p.starts) > 0]] = gone[p.starts[:-1][np.diff(p.starts) > 0]]
        spans = np.concatenate([[0], np.cumsum(begins)])
        for a, z in zip(p.starts.tolist(), p.starts[1:].tolist(), strict=False):
            kept = keep[a - total[a] : z - total[z]]
            columns["n_bytes"].append(z - a)
            columns["n_removed"].append(int(total[z] - total[a]))
            columns["n_spans"].append(int(spans[z] - spans[a]))
            if digests:
                columns["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            else:
                part = np.diff(np.concatenate([[0], gone[a:z].astype(np.int8), [0]]))
                columns["spans"].append([{"begin": b, "end": e} for b, e in zip(np.flatnonzero(part == 1).tolist(), np.flatnonzero(part == -1).tolist(), strict=True)])
                columns["kept"].append(kept)
                columns["kept_text"].append(kept.decode("utf-8", "ignore"))
        own = [batch.column(batch.schema.get_field_index(c)) for c in ("_key", *carry)]
        made = [pa.array(columns[f.name], f.type) for f in list(schema)[len(own) :]]
        return pa.Table.from_arrays([*own, *made], schema=schema)

    return finish


def dedup(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), digests: bool = False) -> DataFrame:
    """Per document n_bytes, n_removed, n_spans, the removed spans, the bytes kept and the text they hold (characters cut
    in two are left out); with `digests` the SHA-256 of the bytes kept instead."""
    names = {c: f"_carry{i}" for i, c in enumerate(carry)}
    rows = grams.chunked(docs.select(key, text, *(F.col(c).alias(n) for c, n in names.items())), key, text, *names.values())
    buckets = grams.buckets_for(docs)
    by_chunk = rows.groupBy("_chunk")
    asked = by_chunk.applyInArrow(lambda t: _ask(t, length, buckets), ASK_DDL)
    told = asked.groupBy("_bucket").applyInArrow(_tell, TOLD_DDL)
    sent = by_chunk.cogroup(told.groupBy("_chunk")).applyInArrow(lambda t, r: _send(t, r, length, buckets), SENT_DDL)
    found = sent.groupBy("_bucket").applyInArrow(lambda t: _match(t, length), FOUND_DDL)
    fields = [T.StructField(key, T.LongType()), *(T.StructField(c, rows.schema[n].dataType) for c, n in names.items())]
    fields += [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    span = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields += [T.StructField("kept_sha256", T.StringType())] if digests else [T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())]
    finish = _finisher(length, key, list(names.values()), digests, to_arrow_schema(T.StructType(fields)))
    return by_chunk.cogroup(found.groupBy("_chunk")).applyInArrow(finish, T.StructType(fields))

