"""Jaccard join of documents by their word n-grams: prefix tree over sets in one global order, rarest first.

1. Every text's distinct n-grams go to their buckets, a row per chunk of texts; buckets count in how many texts each occurs and send
   back those that two or more share. With them a text's shared n-grams are known in global order (frequency, then
   hash); an n-gram of one text alone can match nothing and stands before them.
2. Texts of one set are one. Of two sets that are similar enough, the first n - ceil(0.8 n) + 1 n-grams of each have one in common;
   those prefixes group the sets into families.
3. In a family the sets form a prefix tree. Each set walks it edge by edge, sharing the overlap of common paths, and leaves a subtree
   whose remaining lengths cannot reach the overlap needed. A large family is cut into blocks; the member with the
   largest share of common n-grams joins each block, and only what is then still apart from the rest meets the other blocks.

A document without words, or null, has no set and is linked with nothing; a text of fewer than n words has one n-gram. Rows
with equal keys are one node, and each keeps its own count; a null key counts as the largest and comes back as null.
Columns other than key and text are not read; an empty table gives an empty result. `docs` must read the same rows in the
same order when read again, as a table of files does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import grams
from colloquy.llm.components import components
from colloquy.llm.grams import U, packed5, unpacked5
from colloquy.llm.tables import slices, stored, text_offsets

NULL_KEY = (1 << 63) - 1
#: Members of a family that one task compares with each other.
BLOCK = 600
#: Members that walk a prefix tree side by side.
PROBES = 64
PLACES = grams.powers(0xD1342543DE82EF95, 64)[1:]
TOKEN = U((1 << 40) - 1)


def sets(batch: pa.RecordBatch, n: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, and where each text's begin."""
    found, at = grams.words(*text_offsets(batch.column(batch.schema.get_field_index(text))))
    counts = np.diff(at)
    total = np.maximum(counts - n + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), total)
    first = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(total)[:-1]]), total) + np.arange(len(owner))
    padded = np.append(found, np.zeros(n, np.uint64))
    value = np.repeat(np.minimum(counts, n).astype(np.uint64), total)
    short = np.repeat(counts, total)
    for j in range(n):
        value += np.where(j < short, padded[first + j], U(0)) * PLACES[j]
    value = grams.mixed(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    keep = np.flatnonzero(new)
    return value[keep], np.searchsorted(owner[keep], np.arange(len(counts) + 1))


SENT = pa.schema([("_bucket", pa.int32()), ("_chunk", pa.int64()), ("counts", pa.binary()), ("tokens", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("marks", pa.binary())])
SENT_DDL = "_bucket int, _chunk long, counts binary, tokens binary, keys binary, sizes binary, marks binary"
BACK = pa.schema([("_chunk", pa.int64()), ("_bucket", pa.int32()), ("counts", pa.binary()), ("tokens", pa.binary()), ("often", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("marks", pa.binary())])
BACK_DDL = "_chunk long, _bucket int, counts binary, tokens binary, often binary, keys binary, sizes binary, marks binary"
LISTS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("mark_a", pa.int64()), ("mark_b", pa.int64()), ("single", pa.int64()), ("tokens", pa.binary())])
LISTS_DDL = "key long, n long, mark_a long, mark_b long, single long, tokens binary"


def _sender(n: int, buckets: int, key: str, text: str):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, text, grams.CHUNK_BYTES)):
            keys = np.asarray([NULL_KEY if k is None else k for k in batch.column(batch.schema.get_field_index(key)).to_pylist()], "<i8")
            value, at = sets(batch, n, text)
            chunk, sizes = part << 32 | number, np.diff(at)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            marks = np.zeros((2, len(sizes)), np.uint64)
            filled = sizes > 0
            for row, salt in zip(marks, (U(0), U(0x5851F42D4C957F2D)), strict=True):
                row[filled] = np.add.reduceat(grams.mixed(value ^ salt), at[:-1][filled]) + sizes[filled].astype(np.uint64)
            bucket = (value >> U(65 - buckets.bit_length())).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            tokens, owner = (value[order] >> U(16)) & TOKEN, owner[order]
            head = {"_bucket": -1 - (part * 7919 + number) % buckets, "keys": keys.tobytes(), "sizes": grams.planes(sizes), "marks": marks.tobytes()}
            rows = [head | {"_chunk": chunk}]
            for b in np.flatnonzero(np.diff(cut)).tolist():
                a, z = cut[b], cut[b + 1]
                rows.append({"_bucket": b, "_chunk": chunk, "counts": grams.planes(np.bincount(owner[a:z], minlength=len(sizes))), "tokens": packed5(tokens[a:z])})
            yield pa.RecordBatch.from_pylist(rows, schema=SENT)

    return send


def _count(table: pa.Table) -> pa.Table:
    """Of a bucket's n-grams those of two or more texts, back to the chunks they came from, each with its frequency."""
    rows = table.to_pylist()
    if rows[0]["_bucket"] < 0:
        return pa.Table.from_pylist([{k: r[k] for k in ("_chunk", "_bucket", "keys", "sizes", "marks")} for r in rows], schema=BACK)
    lists = [unpacked5(r["tokens"]) for r in rows]
    _, back, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    answers = []
    for r, tokens, n in zip(rows, lists, np.split(often[back], np.cumsum([len(x) for x in lists])[:-1]), strict=True):
        if len(shared := np.flatnonzero(n > 1)):
            counts = grams.unplanes(r["counts"])
            owner = np.repeat(np.arange(len(counts)), counts)
            answers.append({"_chunk": r["_chunk"], "_bucket": r["_bucket"], "counts": grams.planes(np.bincount(owner[shared], minlength=len(counts))), "tokens": packed5(tokens[shared]), "often": grams.planes(n[shared])})
    return pa.Table.from_pylist(answers, schema=BACK)


def _gatherer(buckets: int):
    def gather(table: pa.Table) -> pa.Table:
        """A row per text: its key, size, marks of its set, n-grams of its own and the shared ones in global order."""
        rows = table.to_pylist()
        head = next(r for r in rows if r["_bucket"] < 0)
        keys, sizes, marks = np.frombuffer(head["keys"], "<i8"), grams.unplanes(head["sizes"]).astype(np.int64), np.frombuffer(head["marks"], np.int64).reshape(2, -1)
        owners, values = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for r in rows:
            if r["_bucket"] >= 0:
                owners.append(np.repeat(np.arange(len(keys)), grams.unplanes(r["counts"])))
                often = np.minimum(grams.unplanes(r["often"]), 0xFFFF).astype(np.uint64)
                values.append(often << U(48) | unpacked5(r["tokens"], r["_bucket"], buckets))
        owner, value = np.concatenate(owners), np.concatenate(values)
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        at = np.searchsorted(owner, np.arange(len(keys) + 1))
        raw = value.tobytes()
        tokens = [raw[8 * a : 8 * b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
        return pa.Table.from_arrays([pa.array(keys), pa.array(sizes), pa.array(marks[0]), pa.array(marks[1]), pa.array(sizes - np.diff(at)), pa.array(tokens, pa.binary())], schema=LISTS)

    return gather


def least_overlap(x: np.ndarray | int, y: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least common n-grams of two sets for 100 * common >= percent * union."""
    return -(-percent * (x + y) // (100 + percent))


class PrefixTree:
    """Ordered sets as a tree of edges; an edge is a run of n-grams without a branch."""

    def __init__(self, lists: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.percent, self.sizes = percent, sizes
        self.order = sorted(range(len(lists)), key=lambda i: lists[i].astype(">u8").tobytes())
        ranked = [lists[i] for i in self.order]
        common = [0] * len(ranked)
        for i in range(1, len(ranked)):
            a, b = ranked[i - 1], ranked[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            common[i] = int(differ[0]) if len(differ) else n
        edges: list[list] = []  # [leaf whose list holds the run, from, to, parent, level]
        self.leaf_edge = [0] * len(ranked)
        path: list[int] = []
        for i, depth in enumerate(common):
            while path and edges[path[-1]][2] > depth:
                e = path[-1]
                if edges[e][1] >= depth:
                    path.pop()
                    continue
                below = len(edges)  # the branch is inside: its lower part becomes an edge of its own
                edges.append([edges[e][0], depth, edges[e][2], e, 0])
                edges[e][2] = depth
                for other in range(below):
                    if edges[other][3] == e:
                        edges[other][3] = below
                for k in range(i):
                    if self.leaf_edge[k] == e:
                        self.leaf_edge[k] = below
            parent = path[-1] if path else -1
            if len(ranked[i]) > depth or parent < 0:
                edges.append([i, depth, len(ranked[i]), parent, 0])
                path.append(len(edges) - 1)
            self.leaf_edge[i] = path[-1]
        for e in sorted(range(len(edges)), key=lambda e: edges[e][1]):
            edges[e][4] = edges[edges[e][3]][4] + 1 if edges[e][3] >= 0 else 0
        self.parent = np.asarray([e[3] for e in edges])
        level = np.asarray([e[4] for e in edges])
        self.levels = [np.flatnonzero(level == k) for k in range(int(level.max()) + 1)]
        runs = [ranked[e[0]][e[1] : e[2]] for e in edges]
        self.tokens, dense = np.unique(np.concatenate(runs), return_inverse=True)
        self.length = np.asarray([len(r) for r in runs])
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.dense = dense.astype(np.int32)
        self.last = np.asarray([r[-1] if len(r) else 0 for r in runs], np.uint64)
        # of the sets below an edge: the smallest size, and the most n-grams after the edge
        self.least = np.full(len(edges), np.iinfo(np.int64).max)
        self.below = np.zeros(len(edges), np.int64)
        depth = np.asarray([e[2] for e in edges])
        for i, e in enumerate(self.leaf_edge):
            while e >= 0:
                self.least[e] = min(self.least[e], sizes[self.order[i]])
                self.below[e] = max(self.below[e], len(ranked[i]) - depth[e])
                e = self.parent[e]
        self.leaf_edge = np.asarray(self.leaf_edge)
        self.leaf_of = np.asarray(self.order)

    def similar(self, own: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some ordered sets and those of the tree the pairs that are similar enough: places in `own`, in order, and row numbers.

        The sets walk the tree side by side: an edge's n-grams are looked up once for all of them, and an edge is left when none can reach the overlap needed below it.
        """
        has = np.zeros((len(self.tokens), len(own)), np.uint8)
        for i, x in enumerate(own):
            at = np.minimum(np.searchsorted(self.tokens, x), max(len(self.tokens) - 1, 0))
            has[at[self.tokens[at] == x] if len(self.tokens) else at[:0], i] = 1
        lengths = np.asarray([len(x) for x in own])
        after = np.stack([len(x) - np.searchsorted(x, self.last, "right") for x in own], axis=1)
        after = np.minimum(np.where(self.length[:, None] > 0, after, lengths), self.below[:, None])
        needed = least_overlap(sizes[None, :], self.least[:, None], self.percent)
        overlap = np.full((len(self.parent), len(own)), -1, np.int64)
        for level, edges in enumerate(self.levels):
            if level:
                edges = edges[(overlap[self.parent[edges]] >= 0).any(axis=1)]
            if not len(edges):
                break
            count = overlap[self.parent[edges]] if level else np.zeros((len(edges), len(own)), np.int64)
            some = np.flatnonzero(self.length[edges])
            if len(some):
                n = self.length[edges[some]]
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                where = np.repeat(self.start[edges[some]] - first, n) + np.arange(n.sum())
                met = np.add.reduceat(has[self.dense[where]], first, axis=0, dtype=np.int32)
                count[some] = np.where(count[some] >= 0, count[some] + met, -1)
            overlap[edges] = np.where((count >= 0) & (count + after[edges] >= needed[edges]), count, -1)
        found = overlap[self.leaf_edge].T
        place, leaf = np.nonzero((found >= 0) & (found >= least_overlap(sizes[:, None], self.sizes[self.leaf_of][None, :], self.percent)))
        return place, self.leaf_of[leaf]


def _linker(percent: int):
    def link(table: pa.Table) -> pa.Table:
        """Within each family of a group: every member and the least member it is linked with, where that is another."""
        table = table.sort_by([("family", "ascending"), ("key", "ascending")])
        family, key, size = (table.column(c).to_numpy() for c in ("family", "key", "n"))
        lists = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
        apart = table.column("root").to_numpy() if "root" in table.column_names else np.arange(len(key))
        probe = table.column("probe").to_numpy() if "probe" in table.column_names else np.ones(len(key), bool)
        cut = np.concatenate([[0], np.flatnonzero(family[1:] != family[:-1]) + 1, [len(family)]])
        nodes, least = [], []
        for a, z in zip(cut.tolist(), cut[1:].tolist(), strict=False):
            if z - a < 2:
                continue
            asked = np.flatnonzero(probe[a:z])
            # Those that only ask stand in a block of their own too.
            held = np.arange(z - a) if len(asked) == z - a else np.flatnonzero(~probe[a:z])
            if not len(held):
                continue
            tree, root = PrefixTree([lists[a + i] for i in held.tolist()], size[a:z][held], percent), np.arange(z - a)
            for x in range(0, len(asked), PROBES):
                if not root.any() and z - a > 2:
                    break  # all are one already
                mine = asked[x : x + PROBES]
                place, other = tree.similar([lists[a + i] for i in mine.tolist()], size[a:z][mine])
                i, j = mine[place], held[other]
                some = (apart[a + i] != apart[a + j]) | (key[a + i] == key[a + j])
                i, j = i[some], j[some]
                for p in np.unique(i).tolist():
                    tied = np.unique(root[np.append(j[i == p], p)])
                    if len(tied) > 1:
                        root[np.isin(root, tied)] = tied[0]
            for i in np.flatnonzero(root != np.arange(z - a)).tolist():
                nodes.append(int(key[a + i]))
                least.append(int(key[a + root[i]]))
        return pa.table({"a": pa.array(nodes, pa.int64()), "b": pa.array(least, pa.int64())})

    return link


def _prefix_families(lists: DataFrame, percent: int) -> DataFrame:
    """(node, root): members of families of sets whose prefixes have an n-gram in common."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Joins what a batch can; of every n-gram one row with the least member leaves the task."""
        for batch in batches:
            keys, n, single = (batch.column(i).to_numpy() for i in range(3))
            take = np.maximum(n - -(-percent * n // 100) + 1 - single, 0)
            lists = [np.frombuffer(t, np.uint64)[:k] for t, k in zip(batch.column(3).to_pylist(), take.tolist(), strict=True)]
            if not lists:
                continue
            tokens = np.concatenate(lists)
            owner = np.repeat(np.arange(len(keys)), [len(x) for x in lists])
            order = np.lexsort((keys[owner], tokens))
            tokens, owner = tokens[order], owner[order]
            new = np.ones(len(tokens), bool)
            new[1:] = tokens[1:] != tokens[:-1]
            first = owner[np.maximum.accumulate(np.where(new, np.arange(len(tokens)), 0))] if len(tokens) else owner
            pairs = np.unique(np.column_stack([keys[owner], keys[first]])[~new], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[new].view(np.int64)), pa.array(keys[owner[new]]), pa.nulls(int(new.sum()), pa.int64())], names=["token", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["token", "a", "b"])

    rows = stored(lists.select("key", "n", "single", "tokens").mapInArrow(local, "token long, a long, b long"), "prefixes")
    # a token has a row per batch at most
    met = rows.where("token IS NOT NULL").groupBy("token").agg(F.min("a").alias("b"), F.collect_set("a").alias("all")).where(F.size("all") > 1)
    edges = met.select(F.explode("all").alias("a"), "b").where("a != b").union(rows.where("token IS NULL").select("a", "b")).distinct()
    return components(edges, "a", "b")


def _links(lists: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that tie together all sets linked by similarity."""
    families = stored(_prefix_families(lists, percent), "families")
    parts = grams.partitions(lists)
    sized = families.groupBy("root").agg(F.count("*").alias("members"))
    members = lists.join(families.withColumnRenamed("node", "key"), "key").withColumnRenamed("root", "family")
    members = members.join(sized.withColumnRenamed("root", "family"), "family").select("family", "members", "key", "n", "single", "tokens")
    small = members.where(F.col("members") <= BLOCK).withColumn("group", F.pmod(F.xxhash64("family"), F.lit(8 * parts)))
    linker = _linker(percent)
    found = small.select("family", "key", "n", "tokens", "group").groupBy("group").applyInArrow(linker, "a long, b long")
    large = sized.where(F.col("members") > BLOCK)
    if large.isEmpty():
        return stored(found, "links")
    big = stored(members.where(F.col("members") > BLOCK).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "large")
    share = F.struct((F.col("single") / F.col("n")).alias("own"), F.col("key").alias("key"))
    lead = big.groupBy("family").agg(F.min(share)["key"].alias("lead")).select(F.col("family").alias("_f"), "lead")
    leaders = big.join(lead, (F.col("family") == F.col("_f")) & (F.col("key") == F.col("lead"))).dropDuplicates(["family"]).drop("_f", "lead")
    spread = leaders.withColumn("block", F.explode(F.expr("filter(sequence(0, blocks - 1), b -> b != block)")))
    columns = ["family", "block", "key", "n", "tokens"]
    first = big.select(*columns).union(spread.select(*columns)).groupBy("family", "block").applyInArrow(linker, "a long, b long")
    found = stored(found.union(first), "links")
    # what is still apart from its family's largest part meets every block
    tied = components(found, "a", "b")
    labelled = big.join(tied.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    parted = labelled.groupBy("family", "root").count().groupBy("family").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    labelled = stored(labelled.join(parted.drop("parts"), "family"), "labelled")
    if labelled.isEmpty():
        return found
    outside = labelled.where("root != main")
    some = outside.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("sets")).withColumnRenamed("family", "_f")
    columns = ["family", "block", "set", "key", "n", "tokens", "root", "probe"]
    asked = outside.join(some, F.col("family") == F.col("_f")).withColumn("set", F.pmod(F.xxhash64("key", F.lit(3)), F.col("sets")).cast("int"))
    asked = asked.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("probe", F.lit(True))
    held = labelled.join(some, F.col("family") == F.col("_f")).withColumn("set", F.explode(F.expr("sequence(0, sets - 1)"))).withColumn("probe", F.lit(False))
    second = asked.select(*columns).union(held.select(*columns)).groupBy("family", "block", "set").applyInArrow(linker, "a long, b long")
    return stored(found.union(second), "links")


def join(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document n_shingles and component_id, the least key reachable by links of 100 * common >= percent * union."""
    buckets = grams.buckets_for(docs)
    rows = docs.select(F.col(key).cast("long").alias(key), text)
    sent = rows.mapInArrow(_sender(n, buckets, key, text), SENT_DDL)
    back = sent.groupBy("_bucket").applyInArrow(_count, BACK_DDL)
    lists = stored(back.groupBy("_chunk").applyInArrow(_gatherer(buckets), LISTS_DDL), "sets")
    narrow = lists.select("key", "n", "mark_a", "mark_b")
    same = stored(narrow.where("n > 0").groupBy("mark_a", "mark_b").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "same")
    several = same.where("copies > 1")
    copies = narrow.where("n > 0").join(several, ["mark_a", "mark_b"]).where("key != rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    others = copies.select(F.col("a").alias("key")).distinct()
    repeated = not narrow.groupBy("key").count().where("count > 1").isEmpty()
    firsts = lists.where("n > 0") if repeated else lists.where("n > 0").join(others, "key", "left_anti")
    links = _links(firsts.where(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 > F.col("single")), percent)
    tied = components(links.union(copies) if repeated else links, "a", "b")
    roots = stored(tied, "roots")
    own = narrow.join(same.select("mark_a", "mark_b", "rep"), ["mark_a", "mark_b"], "left").withColumn("rep", F.coalesce(F.when(F.col("n") > 0, F.col("rep")), F.col("key")))
    out = own.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    shown = lambda c: F.when(c == NULL_KEY, F.lit(None)).otherwise(c)
    return out.select(shown(F.col("key")).alias(key), F.col("n").alias("n_shingles"), shown(F.coalesce("root", "rep")).alias("component_id"))
