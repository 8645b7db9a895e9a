"""Product quantisation codes of vectors, assigned over a lexicographic trie of parts.

Components become integers, vectors are cut into parts, and every block of vectors keeps,
for each part position, the trie of its distinct parts in lexicographic order. A walk
over a trie, depth first, adds up the squared distances to all codebook entries dimension
by dimension, and parts with a common prefix share what was added up along it. The
leaves take the nearest entry, and add their part, times its number of copies, to that
entry's sum. Only sums leave the tasks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: Vectors of a block.
BLOCK_ROWS = 8192
#: Leaves that a walk takes at a time.
STEP = 4096
LIMB = 32


def finite(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, ok), F.lit(False))


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers, or Python's where those don't do."""
    if np.abs(x).max(initial=0.0) < 2.0**52 / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(Fraction(v) * scale) for v in x.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


def narrow(*arrays: np.ndarray) -> bool:
    """Do squared distances between these rows fit in 64 bits?"""
    d = max(1, arrays[0].shape[1])
    most = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    return d * 4 * most * most < 1 << 62


class PartTrie:
    """The distinct parts of one position in lexicographic order, and how much of its predecessor's prefix each shares."""

    def __init__(self, parts: np.ndarray):
        n, d = parts.shape
        order = np.lexsort(parts.T[::-1]) if d and parts.dtype != object else np.array(sorted(range(n), key=lambda i: tuple(parts[i])), np.int64)
        rows = parts[order]
        differ = rows[1:] != rows[:-1]
        new = np.ones(n, bool)
        new[1:] = differ.any(axis=1)
        self.leaves = rows[new]
        self.shared = np.zeros(len(self.leaves), np.int32)
        self.shared[1:] = np.argmax(differ[new[1:]], axis=1)
        self.leaf_of = np.empty(n, np.int32)
        self.leaf_of[order] = np.cumsum(new) - 1
        self.copies = np.bincount(self.leaf_of, minlength=len(self.leaves))

    def distances(self, entries: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Squared distances of the leaves to all entries, in the order of a depth-first walk.

        ``path`` is the walk's stack: what has been added up at each depth above the last leaf.
        A leaf starts from the depth where it leaves the path before it.
        """
        kind = np.int64 if narrow(self.leaves, entries) else object
        leaves, entries = self.leaves.astype(kind), entries.astype(kind)
        n, d = leaves.shape
        path = np.zeros((d + 1, len(entries)), kind)
        for at in range(0, n, STEP):
            rows, shared = leaves[at : at + STEP], self.shared[at : at + STEP]
            added, node = path[:1], np.zeros(len(rows), np.int64)
            for depth in range(d):
                leaves_path = shared <= depth
                if at == 0:
                    leaves_path[0] = True
                new = np.nonzero(leaves_path)[0]
                step = rows[new, depth][:, None] - entries[:, depth][None, :]
                below = added[node[new]] + step * step
                on_path = not leaves_path[0]
                added = np.concatenate([path[depth + 1][None], below]) if on_path else below
                node = np.cumsum(leaves_path) - (0 if on_path else 1)
                path[depth + 1] = added[node[-1]]
            yield slice(at, at + len(rows)), added[node]

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each leaf: the nearest entry, the first among equals, and its squared distance."""
        best = np.zeros(len(self.leaves), np.int64)
        error = np.zeros(len(self.leaves), np.int64 if narrow(self.leaves, entries) else object)
        for rows, dist in self.distances(entries):
            best[rows] = np.argmin(dist, axis=1)
            error[rows] = dist[np.arange(len(dist)), best[rows]]
        return best, error

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry: how many parts chose it, and their sum (Python integers)."""
        best, _ = self.nearest(entries)
        count = np.bincount(best, weights=self.copies, minlength=len(entries)).astype(np.int64)
        total = np.zeros((len(entries), self.leaves.shape[1]), object)
        kind = np.int64 if narrow(self.leaves) and len(self.leaf_of) < 1 << 30 else object
        for e in np.unique(best).tolist():
            own = best == e
            total[e] = (self.leaves[own].astype(kind) * self.copies[own][:, None]).sum(axis=0)
        return count, total


def as_entries(codebook: list[list[int]]) -> np.ndarray:
    """Entries as rows; Python integers where 64 bits don't do."""
    big = any(abs(x) >= 1 << 62 for entry in codebook for x in entry)
    return np.array(codebook, object if big else np.int64).reshape(len(codebook), -1)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as a sum of limb << (32 * index); all but the last limb are not negative."""
    index = 0
    while not -(1 << 62) <= value < 1 << 62:
        yield index, value & ((1 << LIMB) - 1)
        value >>= LIMB
        index += 1
    yield index, value


def build_tries(rows: DataFrame, dim: int, parts: int, scale: int, label_type: str) -> DataFrame:
    """Rows (vec_id, label, v) to one row per block: its ids, labels and tries."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        flat = t.column("v").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)
        q = quantised(x, scale)
        width = dim // parts
        tries = pickle.dumps([PartTrie(q[:, p * width : (p + 1) * width]) for p in range(parts)])
        one = lambda name: pa.array([t.column(name).to_pylist()], pa.list_(t.schema.field(name).type))
        return pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([tries], pa.binary())], ["ids", "labels", "tries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"ids array<bigint>, labels array<{label_type}>, tries binary")


def next_codebooks(tries: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """One round: every part goes to its nearest entry, every entry to the floored mean of its parts."""
    sums = "part int, entry int, place int, limb int, value long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [as_entries(b) for b in books]
        count = [np.zeros(len(e), np.int64) for e in entries]
        total = [np.zeros(e.shape, object) for e in entries]
        for batch in batches:
            for packed in batch.column("tries").to_pylist():
                for p, trie in enumerate(pickle.loads(packed)):
                    c, t = trie.sums(entries[p])
                    count[p], total[p] = count[p] + c, total[p] + t
        out = []
        for p, (c, t) in enumerate(zip(count, total)):
            for e in np.nonzero(c)[0].tolist():
                out.append((p, e, -1, 0, int(c[e])))
                out += [(p, e, i, limb, v) for i, s in enumerate(t[e].tolist()) for limb, v in limbs(int(s))]
        kinds = [pa.int32()] * 4 + [pa.int64()]
        names = ["part", "entry", "place", "limb", "value"]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    # parts x entries x (width + 1) sums whatever the number of vectors
    got = tries.select("tries").mapInArrow(run, sums).groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect()
    value: dict[tuple[int, int, int], int] = {}
    for r in got:
        key = (r["part"], r["entry"], r["place"])
        value[key] = value.get(key, 0) + (r["value"] << (LIMB * r["limb"]))
    out = [[list(entry) for entry in book] for book in books]
    for (p, e, place), v in value.items():
        if place >= 0:
            out[p][e][place] = v // value[p, e, -1]
    return out


def assign(tries: DataFrame, books: list[list[list[int]]], label_type: str) -> DataFrame:
    """Rows (vec_id, label, code, error) from the leaves' nearest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [as_entries(b) for b in books]
        for batch in batches:
            ids, labels = batch.column("ids"), batch.column("labels")
            for i, packed in enumerate(batch.column("tries").to_pylist()):
                codes, error = [], 0
                for p, trie in enumerate(pickle.loads(packed)):
                    best, dist = trie.nearest(entries[p])
                    codes.append(best[trie.leaf_of])
                    error = error + dist[trie.leaf_of].astype(object)
                code = np.stack(codes, axis=1).astype(np.int32)
                n = len(code)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, 1).flatten(),
                        labels.slice(i, 1).flatten(),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * code.shape[1], pa.int32()), pa.array(code.ravel())),
                        pa.array([int(x) if x < 1 << 63 else None for x in error.tolist()], pa.int64()),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return tries.mapInArrow(run, f"vec_id bigint, label {label_type}, code array<int>, error bigint")


def compress_vectors(
    df: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, list[list[list[int]]]]:
    """Rows (vec_id, label, code, error, label_error) and the codebooks, by part, entry and place.

    Vectors that are null or hold null or non-finite components are dropped. Components
    become floor(scale * x), exactly however large. The codebooks start as the parts of the
    ``entries`` smallest ids (fewer, if there are fewer vectors; ties by vector, null ids
    last); ties go to the lower entry, means are floored, entries without parts stay. A
    vector whose length is not that of the smallest id's, or not a multiple of ``parts``,
    keeps its row with a null code and error. ``error`` adds up the squared distances over
    the parts, ``label_error`` the errors of equal labels (nulls are equal); sums beyond 64
    bits are null. Repeated rows each get a row. An empty table gives no rows and empty
    codebooks; other columns are ignored.

    Vectors are read once into blocks of tries, which are written and walked once a round;
    no row is shuffled until the labels' errors are joined on. Copies of a part are one leaf
    of a block. Per round, sums of bounded number reach the driver.
    """
    label_type = df.schema[label_col].dataType.simpleString()
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(finite(F.col(vector_col)))
    first = v.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    dim = len(first[0]["v"]) if first else 0
    fits = (F.size("v") == dim) if dim and dim % parts == 0 else F.lit(False)
    start = quantised(np.array([r["v"] for r in first if len(r["v"]) == dim], float), scale) if dim and dim % parts == 0 else np.zeros((0, 0), np.int64)
    width = dim // parts
    books = [[[int(x) for x in row[p * width : (p + 1) * width]] for row in start] for p in range(parts)]
    odd = v.where(~fits).select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    if len(start):
        tries = store(build_tries(v.where(fits), dim, parts, scale, label_type), "tries")
        for _ in range(rounds):
            books = next_codebooks(tries, books)
        odd = assign(tries, books, label_type).unionByName(odd)
    coded = store(odd, "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    return out, books
