"""The prefix trie of conversations by union-find over sorted neighbours.

Conversations become sequences of turn names. Distinct sequences are sorted; neighbours
share a prefix of a certain depth, and these edges, deepest first, join the sequences
into components. Every merge creates a branching node of the trie at its edge's depth (or
extends the one that is there already). A range of the sorted order gives a forest:
nodes that hold neither its first nor its last sequence are finished; the others are
contracted to the two paths that end in those sequences, with what hangs off each node of
a path summed up in one element. Contracted forests of neighbouring ranges are merged in
the same way, a bounded number at a time, until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: Bytes of a turn's name.
NAME = 16
#: Ids that are joined to one piece of text before a node's digest is taken.
PIECE = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Sequences of a forest, and forests that are merged at a time.
FOREST_ROWS = 20_000
FAN_IN = 64
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ref long"
FOREST = "first binary, first_lens array<int>, last binary, last_lens array<int>, edges array<int>, depths array<int>, ns array<long>, lows array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"
LINK = "child int, child_ref long, low long"
RANGE = f"kind int, part int, {NODE}, {FOREST}, {LINK}"
IS_NODE, IS_FOREST, IS_LINK = 0, 1, 2


@dataclass
class Elements:
    """Sequences, or sums of finished subtrees, in sorted order, and the common depths of neighbours.

    ``saved`` lies below an element's node. ``lens`` has the code points of the turns of real
    sequences; ``name`` their names, which only the first and the last one need.
    """

    depth: list[int] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    kids: list[int] = field(default_factory=list)
    leaves: list[int] = field(default_factory=list)
    saved: list[int] = field(default_factory=list)
    ends: list[str | None] = field(default_factory=list)
    lens: list[list[int] | None] = field(default_factory=list)
    edges: list[int] = field(default_factory=list)
    first: bytes = b""
    last: bytes = b""

    def add(self, depth: int, n: int, low: int, kids: int, leaves: int, saved: int, ends: str | None, lens: list[int] | None) -> None:
        for column, value in zip((self.depth, self.n, self.low, self.kids, self.leaves, self.saved, self.ends, self.lens), (depth, n, low, kids, leaves, saved, ends, lens)):
            column.append(value)

    def add_sequence(self, name: bytes, low: int, n: int, ends: str, lens: list[int]) -> None:
        if self.depth:
            self.edges.append(common_depth(self.last, name))
        else:
            self.first = name
        self.last = name
        self.add(len(name) // NAME, n, low, 0, 0, 0, ends, lens)


def common_depth(a: bytes, b: bytes) -> int:
    """Number of leading turns that two sequences share."""
    most = min(len(a), len(b)) // NAME
    if a[: most * NAME] == b[: most * NAME]:
        return most
    x, y = np.frombuffer(a, np.uint8, most * NAME), np.frombuffer(b, np.uint8, most * NAME)
    return int(np.argmax(x != y)) // NAME


class Forest:
    """Nodes over a range of elements: structure by union-find, sums from the deepest node up."""

    def __init__(self, e: Elements, whole: bool):
        """``whole``: the range is everything, so it has a root and no open nodes."""
        self.e, m = e, len(e.depth)
        self.depth, self.parent = list(e.depth), [-1] * m
        same = list(range(m))  # nodes that turned out to be one
        above = list(range(m))  # elements to components
        node = list(range(m))  # of a component's root

        def find(up: list[int], x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for i in np.argsort(-np.array(e.edges, np.int64), kind="stable").tolist():
            d, a, b = e.edges[i], find(above, i), find(above, i + 1)
            x, y = node[a], node[b]
            if self.depth[x] == d:
                top = x
                if self.depth[y] == d:
                    same[y] = x
                else:
                    self.parent[y] = x
            elif self.depth[y] == d:
                top = y
                self.parent[x] = y
            else:
                top = len(self.depth)
                self.depth.append(d)
                self.parent.append(-1)
                same.append(top)
                self.parent[x] = self.parent[y] = top
            above[b] = a
            node[a] = top
        top = node[find(above, 0)]
        if whole and self.depth[top] > 0:
            self.depth.append(0)
            self.parent.append(-1)
            same.append(len(same))
            self.parent[top] = top = len(same) - 1
        self.top = top
        self.of = [find(same, i) for i in range(m)]
        self.nodes = sorted({find(same, x) for x in range(len(same))}, key=lambda x: -self.depth[x])
        self.parent = [find(same, p) if p >= 0 else -1 for p in self.parent]
        self.sum_up()
        self.left = [] if whole else self.path(0)
        self.right = [] if whole else self.path(m - 1)
        self.open = set(self.left) | set(self.right)

    def sum_up(self) -> None:
        size, e = len(self.depth), self.e
        self.n, self.kids, self.leaves, self.saved = [0] * size, [0] * size, [0] * size, [0] * size
        self.low: list[int | None] = [None] * size
        self.ends: list[str | None] = [None] * size
        self.lens: list[list[int] | None] = [None] * size
        self.cum: list[np.ndarray | None] = [None] * size
        for i, x in enumerate(self.of):
            self.take(x, e.n[i], e.low[i], e.kids[i], e.leaves[i], e.saved[i])
            self.ends[x] = e.ends[i] or self.ends[x]
            self.cum[x] = self.cum[x] if e.lens[i] is None else np.concatenate([[0], np.cumsum(e.lens[i], dtype=np.int64)])
        for x in self.nodes:  # children come before their parents
            if (p := self.parent[x]) >= 0:
                self.cum[p] = self.cum[x] if self.cum[p] is None else self.cum[p]
                self.take(p, *self.hanging(x))

    def take(self, x: int, n: int, low: int, kids: int, leaves: int, saved: int) -> None:
        self.n[x] += n
        self.kids[x] += kids
        self.leaves[x] += leaves
        self.saved[x] += saved
        self.low[x] = low if self.low[x] is None else min(self.low[x], low)

    def hanging(self, x: int) -> tuple[int, int, int, int, int]:
        """What a node with the turns above it adds to its parent: n, low, kids, leaves, saved."""
        turns = int(self.cum[x][self.depth[x]] - self.cum[x][self.depth[self.parent[x]]])
        return self.n[x], self.low[x], 1, self.leaves[x] if self.kids[x] else 1, self.saved[x] + (self.n[x] - 1) * turns

    def path(self, element: int) -> list[int]:
        """Nodes that hold an element, the deepest first."""
        out, x = [], self.of[element]
        while x >= 0:
            out.append(x)
            x = self.parent[x]
        return out

    def contracted(self) -> tuple[Elements, dict[int, int]]:
        """The two open paths as elements, and the places of open nodes' sums among them."""
        e, m = self.e, len(self.of)
        ends_of = {0, m - 1}
        sums: dict[int, list] = {x: [0, None, 0, 0, 0, None] for x in self.open}

        def add(x: int, n: int, low: int, kids: int, leaves: int, saved: int) -> None:
            s = sums[x]
            s[0], s[1] = s[0] + n, low if s[1] is None else min(s[1], low)
            s[2], s[3], s[4] = s[2] + kids, s[3] + leaves, s[4] + saved

        for i, x in enumerate(self.of):
            if x in sums and i not in ends_of:
                add(x, e.n[i], e.low[i], e.kids[i], e.leaves[i], e.saved[i])
                sums[x][5] = e.ends[i] or sums[x][5]
        for x in self.nodes:
            if x not in self.open and self.parent[x] in self.open:
                add(self.parent[x], *self.hanging(x))
        out, place = Elements(first=e.first, last=e.last), {}
        real = lambda i: out.add(e.depth[i], e.n[i], e.low[i], 0, 0, 0, e.ends[i], e.lens[i])
        top_first = [x for x in self.right if x not in set(self.left)][::-1]
        real(0)
        at = [self.depth[x] for x in self.left]
        pending = None  # the least depth between the last element and the next one
        for x, d in [*zip(self.left, at), *((x, self.depth[x]) for x in top_first)]:
            pending = d if pending is None else min(pending, d)
            n, low, kids, leaves, saved, ends = sums[x]
            if n:
                out.edges.append(pending)
                place[x] = len(out.depth)
                out.add(d, n, low, kids, leaves, saved, ends, None)
                pending = d
        if m > 1:
            # the last sequence's own node may be the last one seen: then they share its depth
            out.edges.append(pending)
            real(m - 1)
        return out, place

    def rows(self, place: dict[int, int]) -> Iterator[tuple]:
        """Finished nodes, with the turns between a node and its parent as nodes of their own.

        A node whose parent is still open refers to the parent's place in the contracted forest.
        """
        for x in self.nodes:
            if x in self.open:
                continue
            p, d, n, low, saved = self.parent[x], self.depth[x], self.n[x], self.low[x], self.saved[x]
            if p < 0:
                yield low, d, None, n, self.kids[x], self.leaves[x] if self.kids[x] else 1, saved, self.ends[x] or NO_ENDS, None
                continue
            leaves, kids, ends = self.leaves[x] if self.kids[x] else 1, self.kids[x], self.ends[x] or NO_ENDS
            top = self.depth[p] + 1
            for depth in range(d, top - 1, -1):
                saved += (n - 1) * int(self.cum[x][depth] - self.cum[x][depth - 1])
                ref = place[p] if depth == top and p in self.open else None
                above = None if ref is not None else self.low[p] if depth == top else low
                yield low, depth, above, n, kids, leaves, saved, ends, ref
                kids, ends = 1, NO_ENDS


def batch(kind: int, part: int, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """Rows of one kind in the common layout of ``RANGE``."""
    types = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
        "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
    }
    columns, fields = [], [x.strip().split(" ") for x in RANGE.split(",")]
    for name, kind_name in fields:
        if name in ("kind", "part"):
            columns.append(pa.array([kind if name == "kind" else part] * len(rows), pa.int32()))
        elif name in names:
            i = names.index(name)
            columns.append(pa.array([r[i] for r in rows], types[kind_name]))
        else:
            columns.append(pa.nulls(len(rows), types[kind_name]))
    return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


def columns_of(schema: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in schema.split(",")]


def give(forest: Forest, part: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """A range's finished nodes and, unless it is everything, its contracted forest."""
    e, place = (Elements(), {}) if whole else forest.contracted()
    held = []
    for row in forest.rows(place):
        held.append(row)
        if len(held) == 10_000:
            yield batch(IS_NODE, part, columns_of(NODE), held)
            held = []
    yield batch(IS_NODE, part, columns_of(NODE), held)
    if not whole:
        row = (e.first, e.lens[0], e.last, e.lens[-1], e.edges, e.depth, e.n, e.low, e.kids, e.leaves, e.saved, e.ends)
        yield batch(IS_FOREST, part, columns_of(FOREST), [row])


def range_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a partition of sorted distinct sequences."""
    e = Elements()
    for b in batches:
        for r in b.to_pylist():
            e.add_sequence(r["seq"], r["low"], r["n"], r["ends"], r["lens"])
    if e.depth:
        yield from give(Forest(e, False), TaskContext.get().partitionId(), False)


def merged_forest(rows: list[dict], whole: bool, group: int) -> Iterator[pa.RecordBatch]:
    """Contracted forests of neighbouring ranges as one; links say what became of their open nodes."""
    e, starts = Elements(first=rows[0]["first"], last=rows[-1]["last"]), []
    for k, r in enumerate(rows):
        if k:
            e.edges.append(common_depth(rows[k - 1]["last"], r["first"]))
        starts.append(len(e.depth))
        e.edges += r["edges"]
        last = len(r["depths"]) - 1
        for i, values in enumerate(zip(r["depths"], r["ns"], r["lows"], r["kids"], r["leaves"], r["saved"], r["ends"])):
            e.add(*values, r["first_lens"] if i == 0 else r["last_lens"] if i == last else None)
    forest = Forest(e, whole)
    _, place = (None, {}) if whole else forest.contracted()
    links = []
    for r, at in zip(rows, starts):
        for i in range(1, len(r["depths"]) - 1):
            x = forest.of[at + i]
            done = x not in forest.open
            links.append((r["part"], i, forest.low[x] if done else None, None if done else place[x]))
    yield batch(IS_LINK, group, ["child", "child_ref", "low", "ref"], links)
    yield from give(forest, group, whole)


def merge_ranges(forests: DataFrame, fan_in: int, whole: bool) -> DataFrame:
    """Merges ``fan_in`` neighbouring forests at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if rows and r["grp"] != now:
                    yield from merged_forest(rows, whole, now)
                    rows = []
                now = r["grp"]
                rows.append(r)
        if rows:
            yield from merged_forest(rows, whole, now)

    dealt = forests.select(F.floor(F.col("part") / fan_in).cast("int").alias("grp"), "part", *columns_of(FOREST))
    return dealt.repartition("grp").sortWithinPartitions("grp", "part").mapInArrow(run, RANGE)


def id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, conv_id, lens) to pieces of up to ``PIECE`` ids of one sequence, joined by commas."""
    names = ["seq", "low", "n", "ids", "lens"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())]
    seq, lens, ids, out = None, [], [], []

    def piece() -> tuple:
        return seq, ids[0], len(ids), ",".join(map(str, ids)), lens

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    for b in batches:
        for r in b.to_pylist():
            if ids and (r["seq"] != seq or len(ids) == PIECE):
                out.append(piece())
                ids = []
            seq, lens = r["seq"], r["lens"]
            ids.append(r["conv_id"])
        if out:
            yield flush()
            out = []
    if ids:
        out.append(piece())
        yield flush()


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one row per sequence; the digest takes them one by one."""
    names = ["seq", "low", "n", "ends", "lens"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())]
    now, sha, out = None, None, []
    for b in batches:
        for r in b.to_pylist():
            if now is None or r["seq"] != now[0]:
                if now is not None:
                    out.append((*now[:3], sha.hexdigest(), now[3]))
                now, sha = [r["seq"], r["low"], 0, r["lens"]], hashlib.sha256()
            elif now[2]:
                sha.update(b",")
            sha.update(r["ids"].encode())
            now[2] += r["n"]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)
            out = []
    if now is not None:
        last = (*now[:3], sha.hexdigest(), now[3])
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(last, kinds)], names)


def own_sequences(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows (conv_id, names, lens): a conversation's turns in order, as names and code points."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    t = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            role.alias("role"),
            F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("name"),
            F.char_length(text).alias("len"),
        ).alias("t"),
    )
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return t.select("conv_id", F.col("t.name").alias("names"), F.col("t.len").alias("lens"))


def rebuilt(own: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Rows (conv_id, seq, lens): the head of conversation c - c % ``every``, then c's own turns after as many.

    A head has crc32 of the id modulo ``heads`` turns.
    """
    longest = heads - 1
    head = own.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("names", 1, longest).alias("head_names"), F.slice("lens", 1, longest).alias("head_lens")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(head, "base", "left")

    def with_head(column: str) -> Column:
        rest = F.slice(column, F.col("h") + 1, F.greatest(F.size(column) - F.col("h"), F.lit(0)))
        return F.when(F.col(f"head_{column}").isNull(), rest).otherwise(F.concat(F.slice(f"head_{column}", F.lit(1), F.col("h")), rest))

    return joined.select("conv_id", F.unhex(F.array_join(with_head("names"), "")).alias("seq"), with_head("lens").alias("lens"))


def trie_nodes(sequences: DataFrame, forest_rows: int = FOREST_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per trie node over rows (conv_id, seq, lens): see ``prefix_trie``."""
    spark = sequences.sparkSession
    s = store(sequences, "sequences")
    parts = max(1, -(-s.count() // forest_rows))
    pieces = s.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(id_pieces, "seq binary, low long, n long, ids string, lens array<int>")
    distinct = pieces.repartition("seq").sortWithinPartitions("seq", "low").mapInArrow(digests, "seq binary, low long, n long, ends string, lens array<int>")
    distinct = store(distinct, "distinct")
    sorted_ranges = distinct.repartitionByRange(parts, "seq").sortWithinPartitions("seq")
    levels = [store(sorted_ranges.mapInArrow(range_forest, RANGE), "forests")]
    left = levels[0].where(F.col("kind") == IS_FOREST).agg(F.max("part")).first()[0]
    while left is not None:
        whole = left < fan_in
        levels.append(store(merge_ranges(levels[-1].where(F.col("kind") == IS_FOREST), fan_in, whole), "forests"))
        left = None if whole else left // fan_in
    out = None
    known = None  # what the open nodes of the level below turned out to be: (child, child_ref, low)
    for level in reversed(levels):
        nodes = level.where(F.col("kind") == IS_NODE).select("part", *columns_of(NODE))
        if known is not None:
            nodes = nodes.join(known, (F.col("part") == F.col("child")) & (F.col("ref") == F.col("child_ref")), "left")
            nodes = nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "low"))
        nodes = nodes.select(*columns_of(NODE)[:-1])
        out = nodes if out is None else out.unionByName(nodes)
        links = level.where(F.col("kind") == IS_LINK).select("part", "ref", F.col("child").alias("c"), F.col("child_ref").alias("r"), F.col("low").alias("found"))
        if known is not None:
            links = links.join(known, (F.col("part") == F.col("child")) & (F.col("ref") == F.col("child_ref")), "left").withColumn("found", F.coalesce("found", "low"))
        known = links.select(F.col("c").alias("child"), F.col("r").alias("child_ref"), F.col("found").alias("low"))
    return out if out is not None else spark.createDataFrame([], ", ".join(NODE.split(", ")[:-1]))


def prefix_trie(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    every: int = 100,
    heads: int = 6,
    forest_rows: int = FOREST_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 (of the ids that end there). Turns are ordered by number,
    null first; ties by role, then by the turn's name (md5 of role and text), so repeated rows are
    turns of their own. Null roles and texts are empty. Rows without a conversation id are
    left out. Turns are equal if their 128-bit names are. An empty table has no nodes; other
    columns are ignored.

    Texts don't travel: a turn is 16 bytes and a length, and a conversation, however many
    turns it has, one row of these. Copies of a sequence are joined to one before the sort, a
    node that many conversations end in gets its digest from sorted pieces of ids, and a
    prefix that many share only joins ranges, so no group meets in one task. Contracted
    forests have at most two elements per branching depth of two sequences.
    """
    return trie_nodes(rebuilt(own_sequences(turns, conv_col, turn_col, role_col, text_col), every, heads), forest_rows, fan_in)
