"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

A prefix is known by its depth and the exclusive or of one 128-bit code per (place, turn); a node by its smallest member and its depth. A conversation
owns the nodes whose smallest member it is: a run at the end of its own path, so a path is a short list of runs (depth, owner). A node weighs its members; the
weight below a node is a sum over its members' lengths, known before any rollup.

Rollup: the centroid of a component is its deepest node with half of the component's weight below it; the nodes with that much weight are just the
path from the centroid to the top. Each round sums every component's totals below its centroid, adds them along the centroid-to-top path, and
splits there: what lies below each child is a component of its own, the rest another, none with more than half the weight. While a component weighs
more than `COMPONENT`, rounds run as scans of the stored nodes with the splits so far (at most weight / `COMPONENT` a round) sent to the tasks; then each
component is gathered in one task, which goes on by the same rounds.

Rows with a null conv_id take no part; null role or text is empty. Turns go by `turn`, null first, then by a hash of role and text; rows that repeat are turns of
their own. A conversation may have no turn left once rebuilt: it is a member of the root alone. Extra columns are ignored; an empty table gives an
empty result. Conversations may be of any length: order is kept by slices, nodes move in blocks of `SPAN`, ids of equal conversations in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.tables import stored
from colloquy.operators.ordered import Ordered

#: Weight of a component that one task holds; nodes of a conversation in one row; ids of equal conversations in one piece.
COMPONENT, SPAN, PIECE = 1 << 18, 4_096, 4_096
#: A prefix with more members than this, and than a 100,000th of all rows, meets its rows by broadcast: at most 100,000 prefixes.
POPULAR, MOST_POPULAR = 10_000, 100_000

EMPTY = hashlib.sha256().hexdigest()


# --- the trie ------------------------------------------------------------------------------------------
def kept_turns(conv: Column) -> Column:
    """How many turns of the base conversation a rebuilt one begins with, at most."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: c, len) and (turns: c, len, d from 1, x, y, bytes): the first turns of conversation c - c % 5, then the later ones of c.

    `x` and `y` are 128 bits of hash over place, role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit(1), text, role).alias("y"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    turns = stored(narrow, "turns")
    ranked = Ordered.of(turns, ["c"], ["turn", "x", "y"]).rank("p").done().select("c", "p", "x", "y", "bytes")
    counts = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    h = kept_turns(F.col("c"))
    plan = counts.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % 5).alias("base"))
    plan = plan.join(counts.select(F.col("c").alias("base"), F.col("n").alias("nb")), "base", "left")
    plan = plan.withColumn("m", F.least("h", F.coalesce("nb", F.lit(0))))
    plan = stored(plan.select("c", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "conversations")
    cols = ["c", "len", "d", "x", "y", "bytes"]
    heads = ranked.where("p <= 8 AND c % 5 = 0").withColumnsRenamed({"c": "base", "p": "d"}).join(plan, "base").where("d <= h").select(*cols)
    tails = ranked.join(plan, "c").where("p > h").withColumn("d", F.col("p") - F.col("h") + F.col("m")).select(*cols)
    placed = heads.union(tails).withColumns({"x": F.xxhash64("d", "x", "y"), "y": F.xxhash64("y", "d", "x")})
    return plan.select("c", "len"), placed


def prefixes(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each conversation and depth, the root at depth 0: c, len, d, bytes, the key `a`, `b` of the prefix, that of its parent `pa`, `pb`."""
    keyed = Ordered.of(stored(turns, "rebuilt"), ["c"], ["d"]).running_xor("a", F.col("x")).running_xor("b", F.col("y")).done()
    zero = F.lit(0).cast("long")
    below = keyed.select("c", "len", "d", "bytes", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"))
    root = conversations.select("c", "len", *[zero.alias(n) for n in ("d", "bytes", "a", "b", "pa", "pb")])
    return stored(below.union(root), "prefixes")


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per node: its key, owner, members, weight at and below it, bytes of its last text, children."""
    nodes = rows.groupBy("d", "a", "b").agg(
        F.min("c").alias("owner"), F.count(F.lit(1)).alias("n"), F.sum(F.col("len") - F.col("d") + 1).alias("s"), F.max("bytes").alias("bytes"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb"),
    )
    kids = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("kids"))
    return stored(nodes.drop("pa", "pb").join(kids, ["d", "a", "b"], "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long"))), "nodes")


def paths_of(rows: DataFrame, nodes: DataFrame, popular: int = POPULAR) -> DataFrame:
    """c and `runs`, the owners along its path as (start, owner) sorted by depth, owners growing."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    limit = max(popular, total // MOST_POPULAR)
    known = nodes.where(F.col("n") > limit).select("d", "a", "b", F.col("owner").alias("o"))
    told = rows.select("c", "d", "a", "b").join(F.broadcast(known), ["d", "a", "b"], "left")
    rest = told.where("o IS NULL").drop("o").join(nodes.where(F.col("n") <= limit).select("d", "a", "b", F.col("owner").alias("o")), ["d", "a", "b"])
    owned = told.where("o IS NOT NULL").select("c", "d", "o").union(rest.select("c", "d", "o"))
    starts = owned.repartition("c").groupBy("c", "o").agg(F.min("d").alias("start"))
    return stored(starts.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("start", "o"))).alias("runs")), "paths")


def pieces_of(nodes: DataFrame, paths: DataFrame, span: int = SPAN) -> DataFrame:
    """Nodes in rows of at most `span` that lie one below the other: c (their owner), first (depth), runs, and arrays s, n, kids, bytes."""
    facts = F.array_sort(F.collect_list(F.struct("d", "s", "n", "kids", "bytes")))
    rows = nodes.groupBy(F.col("owner").alias("c"), F.floor(F.col("d") / span).alias("_b")).agg(facts.alias("f")).join(paths, "c")
    runs = [F.col("runs.start").alias("starts"), F.col("runs.o").alias("owners")]
    return stored(rows.select("c", F.col("f")[0]["d"].alias("first"), *runs, "f.s", "f.n", "f.kids", "f.bytes"), "pieces")


# --- centroids -----------------------------------------------------------------------------------------
@dataclass
class Split:
    """One component's split: the weight at its top, its centroid, the weight and the totals (leaves, saved) below that."""

    weight: int
    owner: int = 0
    depth: int = 0
    below: int = 0
    totals: tuple[int, int] = (0, 0)


class Trie:
    """Nodes of some rows, with the weight and the totals of each as far as the splits so far have brought them."""

    def __init__(self, conv, first, starts, owners, s, n, kids, size):
        """Row-wise: owner, first depth and lists; see `pieces_of`."""
        lengths = s.value_lengths().to_numpy(zero_copy_only=False)
        flat = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        runs = starts.value_lengths().to_numpy(zero_copy_only=False)
        self.conv, self.row = conv, np.repeat(np.arange(len(conv)), lengths)
        self.depth = np.repeat(first, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.run_key, self.run_owner = (np.repeat(np.arange(len(conv)), runs) << 40) + flat(starts), flat(owners)
        self.s, self.n, self.kids = flat(s), flat(n), flat(kids)
        self.own = np.stack([(self.kids == 0).astype(np.int64), (self.n - 1) * flat(size)])
        self.total = np.zeros_like(self.own)
        self.top = np.zeros(len(self.row), np.int64)
        self.done = np.zeros(len(self.row), bool)

    def owner_at(self, rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """Who owns the node at a depth of a row's path."""
        return self.run_owner[np.searchsorted(self.run_key, (rows << 40) + depths, "right") - 1]

    def components(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner and depth of the tops of the components that nodes `at` lie in, and each node's place among them."""
        depth = self.top[at]
        owner = self.owner_at(self.row[at], depth)
        order = np.lexsort((owner, depth))
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(owner[order]) != 0) | (np.diff(depth[order]) != 0)
        which = np.empty(len(at), np.int64)
        which[order] = np.cumsum(new) - 1
        return owner[order][new], depth[order][new], which

    def centroid_path(self, at: np.ndarray, which: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes with half of their component's weight, the depth of the deepest by component (-1: none here), and which it is."""
        path = 2 * self.s[at] >= weight[which]
        deepest = np.full(len(weight), -1)
        np.maximum.at(deepest, which[path], self.depth[at[path]])
        ends = path & (self.depth[at] == deepest[which])
        centre = np.zeros(len(weight), np.int64)
        centre[which[ends]] = at[ends]
        return path, deepest, centre

    def below(self, at: np.ndarray, owner: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Which nodes lie at or below the node (owner, depth) given for each."""
        found = self.depth[at] >= depth
        found[found] = self.owner_at(self.row[at[found]], depth[found]) == owner[found]
        return found

    def split(self, at: np.ndarray, which: np.ndarray, path: np.ndarray, inside: np.ndarray, depth: np.ndarray, weight: np.ndarray, totals: np.ndarray) -> None:
        """Add what lies below the centroids along their paths and cut there; centroids given by component."""
        above = path & ~inside
        centre = inside & (self.depth[at] == depth[which])
        self.s[at[above]] -= weight[which[above]]
        gains = above | centre
        self.total[:, at[gains]] += totals[:, which[gains]]
        self.done[at[centre]] = True
        lower = inside & ~centre
        self.top[at[lower]] = depth[which[lower]] + 1

    def follow(self, rounds: list[dict[tuple[int, int], Split]]) -> None:
        """Repeat rounds of splits that were found over all rows."""
        for splits in rounds:
            at = np.flatnonzero(~self.done)
            owner, depth, which = self.components(at)
            found = [splits.get(key) for key in zip(owner.tolist(), depth.tolist(), strict=True)]
            there = np.asarray([f is not None for f in found], bool)
            at, which = at[there[which]], which[there[which]]
            get = lambda f: np.asarray([f(x) if x else 0 for x in found], np.int64)
            who, deep, weight = get(lambda x: x.owner), get(lambda x: x.depth), get(lambda x: x.weight)
            totals = np.stack([get(lambda x: x.totals[0]), get(lambda x: x.totals[1])])
            inside = self.below(at, who[which], deep[which])
            self.split(at, which, 2 * self.s[at] >= weight[which], inside, deep, get(lambda x: x.below), totals)

    def solve(self) -> None:
        """All rounds to the end, every component being here as a whole."""
        while len(at := np.flatnonzero(~self.done)):
            _, depth, which = self.components(at)
            weight = np.zeros(len(depth), np.int64)
            tops = self.depth[at] == self.top[at]
            weight[which[tops]] = self.s[at[tops]]
            path, deepest, centre = self.centroid_path(at, which, weight)
            inside = self.below(at, self.conv[self.row[centre]][which], deepest[which])
            totals = np.zeros((2, len(depth)), np.int64)
            for t in (0, 1):
                np.add.at(totals[t], which[inside], self.own[t, at[inside]])
            self.split(at, which, path, inside, deepest, self.s[centre], totals)


def _lists(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def _trie(batch: pa.RecordBatch) -> Trie:
    conv, first, *lists = _lists(batch, "c", "first", "starts", "owners", "s", "n", "kids", "bytes")
    return Trie(conv.to_numpy(), first.to_numpy(), *lists)


def splits_of(pieces: DataFrame, component: int = COMPONENT) -> list[dict[tuple[int, int], Split]]:
    """Rounds of splits until no component weighs more than `component`; keys are the components' tops (owner, depth).

    Each round holds at most weight / `component` splits, there are at most log2(weight / `component`) rounds.
    """
    rounds: list[dict[tuple[int, int], Split]] = []

    def over(find, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                trie = _trie(b)
                trie.follow(rounds)
                found = find(trie)
                if found and len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=[c.split()[0] for c in schema.split(", ")])

        return pieces.mapInArrow(run, schema)

    def tops(trie: Trie):
        at = np.flatnonzero(~trie.done & (trie.depth == trie.top) & (trie.s > component))
        return trie.conv[trie.row[at]], trie.depth[at], trie.s[at]

    while heavy := over(tops, "o long, d long, s long").collect():
        splits = {(r["o"], r["d"]): Split(r["s"]) for r in heavy}

        def within(trie: Trie, splits=splits):
            at = np.flatnonzero(~trie.done)
            owner, depth, which = trie.components(at)
            found = [splits.get(k) for k in zip(owner.tolist(), depth.tolist(), strict=True)]
            there = np.asarray([f is not None for f in found], bool)[which] if found else np.zeros(0, bool)
            return at[there], which[there], owner, depth, found

        def centroids(trie: Trie):
            at, which, owner, depth, found = within(trie)
            weight = np.asarray([f.weight if f else 0 for f in found], np.int64)
            _, deepest, centre = trie.centroid_path(at, which, weight)
            there = np.flatnonzero(deepest >= 0)
            centre = centre[there]
            return owner[there], depth[there], deepest[there], trie.conv[trie.row[centre]], trie.s[centre]

        deepest = over(centroids, "o long, d long, cd long, co long, cs long").groupBy("o", "d").agg(F.max(F.struct("cd", "co", "cs")).alias("m"))
        for r in deepest.collect():
            split = splits[r["o"], r["d"]]
            split.depth, split.owner, split.below = r["m"]

        def totals(trie: Trie):
            at, which, owner, depth, found = within(trie)
            who = np.asarray([f.owner if f else 0 for f in found], np.int64)
            deep = np.asarray([f.depth if f else 0 for f in found], np.int64)
            inside = trie.below(at, who[which], deep[which])
            sums = np.zeros((2, len(found)), np.int64)
            for t in (0, 1):
                np.add.at(sums[t], which[inside], trie.own[t, at[inside]])
            there = np.unique(which[inside])
            return owner[there], depth[there], sums[0][there], sums[1][there]

        for r in over(totals, "o long, d long, leaves long, saved long").groupBy("o", "d").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).collect():
            splits[r["o"], r["d"]].totals = (r["l"], r["s"])
        rounds.append(splits)
    return rounds


_SEGMENT = "o long, td long, c long, first long, starts array<bigint>, owners array<bigint>, parent array<bigint>, s array<bigint>, n array<bigint>, kids array<bigint>, leaves array<bigint>, saved array<bigint>, bytes array<bigint>, fixed boolean"


def _segments(trie: Trie, sizes: np.ndarray) -> pa.RecordBatch:
    """The nodes of each row cut where the component changes; runs from the component's top on."""
    new = np.ones(len(trie.row), bool)
    new[1:] = (np.diff(trie.row) != 0) | (np.diff(trie.top) != 0) | trie.done[1:] | trie.done[:-1]
    at = np.flatnonzero(new)
    row, end = trie.row[at], np.append(at[1:], len(new))
    fixed = trie.done[at]
    top = np.where(fixed, trie.depth[at], trie.top[at])
    begin = np.searchsorted(trie.run_key, (row << 40) + top, "right") - 1
    stop = np.searchsorted(trie.run_key, (row << 40) + trie.depth[end - 1], "right")
    counts = stop - begin
    pick = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.maximum(trie.run_key[pick] & ((1 << 40) - 1), np.repeat(top, counts))
    run_ends = np.append(0, np.cumsum(counts)).astype(np.int32)
    lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
    ends = np.append(at, len(new)).astype(np.int32)
    parent = np.where(trie.depth > 0, trie.owner_at(trie.row, np.maximum(trie.depth - 1, 0)), -1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(trie.run_owner[begin]), pa.array(top), pa.array(trie.conv[row]), pa.array(trie.depth[at]), lists(starts, run_ends), lists(trie.run_owner[pick], run_ends),
            lists(parent, ends), lists(trie.s, ends), lists(trie.n, ends), lists(trie.kids, ends), lists(trie.total[0], ends), lists(trie.total[1], ends), lists(sizes, ends), pa.array(fixed),
        ],
        names=[f.split()[0] for f in _SEGMENT.split(", ")],
    )


def _rolled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whole components: their nodes with all totals."""
    trie = _trie(batch)
    top, fixed = (c.to_numpy(zero_copy_only=False) for c in _lists(batch, "td", "fixed"))
    parent, leaves, saved = (c.flatten().to_numpy(zero_copy_only=False) for c in _lists(batch, "parent", "leaves", "saved"))
    trie.top, trie.done, trie.total = top[trie.row], fixed[trie.row].astype(bool), np.stack([leaves, saved])
    trie.solve()
    return pa.RecordBatch.from_arrays(
        [pa.array(trie.conv[trie.row]), pa.array(trie.depth), pa.array(parent, mask=trie.depth == 0), *(pa.array(x) for x in (trie.n, trie.kids, trie.total[0], trie.total[1]))],
        names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"],
    )


def _whole(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches sorted by component, dealt anew so that none is cut; about `least` nodes at a time."""
    waiting: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        waiting.append(b)
        if sum(len(x.column(x.schema.get_field_index("s")).flatten()) for x in waiting) < least:
            continue
        both = joined()
        o, d = (c.to_numpy() for c in _lists(both, "o", "td"))
        cut = int(np.flatnonzero((o != o[-1]) | (d != d[-1]))[-1]) + 1 if ((o != o[-1]) | (d != d[-1])).any() else 0
        if cut:
            yield both.slice(0, cut)
        waiting = [both.slice(cut)]
    if waiting:
        yield joined()


def rollup(pieces: DataFrame, component: int = COMPONENT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens of every node."""
    rounds = splits_of(pieces, component)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trie = _trie(b)
            trie.follow(rounds)
            yield _segments(trie, b.column(b.schema.get_field_index("bytes")).flatten().to_numpy(zero_copy_only=False))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole(batches):
            yield _rolled(b)

    dealt = pieces.mapInArrow(cut, _SEGMENT).repartition("o", "td").sortWithinPartitions("o", "td")
    return dealt.mapInArrow(solve, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")


# --- conversations that end at a node --------------------------------------------------------------------
def endings(conversations: DataFrame, paths: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes where a conversation ends: SHA-256 of their ids in order, joined by commas."""
    last = paths.select("c", F.element_at("runs", -1)["o"].alias("o")).join(conversations, "c")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    parts = last.groupBy("o", "len", F.expr(f"c div {piece}").alias("part")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for b in batches:
            for o, d, ids in zip(*(c.to_pylist() for c in _lists(b, "o", "len", "ids")), strict=True):
                if (o, d) != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (o, d), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield _table(out)
                out = []
        if now:
            yield _table([(*now, state.hexdigest())])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        o, d, sha = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()), pa.array(d, pa.int64()), pa.array(sha)], names=["conv_id", "depth", "ends_sha256"])

    return parts.repartition("o", "len").sortWithinPartitions("o", "len", "part").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, component: int = COMPONENT, span: int = SPAN, popular: int = POPULAR) -> DataFrame:
    """One row per node; see the query's columns. `conversations` holds conv_id, turn, role, text."""
    convs, turns = rebuilt(conversations)
    rows = prefixes(convs, turns)
    nodes = nodes_of(rows)
    paths = paths_of(rows, nodes, popular)
    rolled = rollup(pieces_of(nodes, paths, span), component)
    ends = endings(convs, paths)
    return rolled.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
