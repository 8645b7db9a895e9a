"""Near-duplicate embeddings by cover trees and dual traversal.

On the unit sphere a cosine of c is a distance of sqrt(2 - 2c). Each block of vectors gets
a cover tree: nested balls whose radii halve from level to level. Two trees are
walked at once: a pair of balls goes when their centres are further apart than both
radii and the threshold, else its children are paired. What is left are exact pairs.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, spanning, store
from .vectors import matrix, usable, vectors

#: Slack of distances between doubles on the unit sphere.
SLACK = 1e-6
LEAF_RADIUS = 0.05
#: Balls of this radius at most are paired where larger ones hold hardly more than one point.
FINE_RADIUS = 0.5
#: Pairs of balls with at most so many pairs of points are compared point by point.
DIRECT = 1 << 16
#: Bytes of packed trees that all tasks get at a time.
ROUND_BYTES = 32 << 20


class Node:
    """A ball: its centre's row, the rows within, their largest distance, and child balls of half the radius."""

    __slots__ = ("center", "rows", "radius", "children")

    def __init__(self, center: int, rows: np.ndarray, radius: float):
        self.center, self.rows, self.radius, self.children = center, rows, radius, []

    def below(self) -> list[Node]:
        """The next level; where its balls hardly group the points, the first finer balls instead."""
        if len(self.children) * 8 <= len(self.rows):
            return self.children or [self]
        out, todo = [], list(self.children)
        while todo:
            n = todo.pop()
            if n.children and n.radius > FINE_RADIUS:
                todo += n.children
            else:
                out.append(n)
        return out


def cover_tree(u: np.ndarray, rows: np.ndarray | None = None, center: int = 0, level: float = 2.0, dist: np.ndarray | None = None) -> Node:
    """Cover tree over rows of unit vectors; the centre is in the first child again (nested)."""
    rows = np.arange(len(u)) if rows is None else rows
    dist = apart(u[rows], u[center]) if dist is None else dist
    node = Node(center, rows, float(dist.max(initial=0.0)))
    if len(rows) == 1 or node.radius <= LEAF_RADIUS:
        return node
    half = level / 2
    while half >= node.radius:
        half /= 2
    left, now = rows, center
    part = u[left]
    while len(left):
        d = apart(part, u[now])
        inside = d <= half
        node.children.append(cover_tree(u, left[inside], now, half, d[inside]))
        left, part = left[~inside], part[~inside]
        if len(left):
            now = int(left[0])
    return node


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Powers of two, which are exact, bring the largest component near one first: no norm overflows or vanishes."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -exponent)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def apart(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ q)))


def close_pairs(a: Node, ua: np.ndarray, b: Node, ub: np.ndarray, least: float, eps: float):
    """Yields arrays (rows of a, rows of b) with cosine >= ``least``; for a tree with itself every pair both ways.

    Centres are compared in single precision with slack, points in double precision.
    """
    fa, fb = ua.astype(np.float32), ub.astype(np.float32)
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if len(x.rows) * len(y.rows) <= DIRECT or not x.children and not y.children:
            step = max(1, (1 << 22) // len(y.rows))
            for at in range(0, len(x.rows), step):
                i, j = np.nonzero(ua[x.rows[at : at + step]] @ ub[y.rows].T >= least)
                if len(i):
                    yield x.rows[at + i], y.rows[j]
            continue
        xs, ys = x.below(), y.below()
        cx, cy = np.array([n.center for n in xs]), np.array([n.center for n in ys])
        rx, ry = np.array([n.radius for n in xs]), np.array([n.radius for n in ys])
        one_x, one_y = np.array([len(n.rows) == 1 for n in xs]), np.array([len(n.rows) == 1 for n in ys])
        fy = np.ascontiguousarray(fb[cy].T)
        widest = float(ry.max())
        step = max(1, (1 << 22) // len(ys))
        for at in range(0, len(xs), step):
            cos = fa[cx[at : at + step]] @ fy
            # centres further apart than both radii and the threshold: first by each row's widest bound, then each pair's
            bound = 1.0 - (rx[at : at + step] + widest + eps + SLACK) ** 2 / 2 - 1e-4
            i, j = np.nonzero(cos >= bound.astype(np.float32)[:, None])
            near = cos[i, j] >= 1.0 - (rx[at + i] + ry[j] + eps + SLACK) ** 2 / 2 - 1e-4
            i, j = at + i[near], j[near]
            points = one_x[i] & one_y[j]
            p, q = cx[i[points]], cy[j[points]]
            linked = np.einsum("ij,ij->i", ua[p], ub[q]) >= least
            if linked.any():
                yield p[linked], q[linked]
            todo += [(xs[m], ys[n]) for m, n in zip(i[~points], j[~points])]


class Side:
    """A block's points, how many rows each was found to link to, and edges that span what was found."""

    def __init__(self, key: tuple, packed: bytes):
        self.key = key
        self.points, self.n, self.u, self.tree = pickle.loads(packed)
        self.links = np.zeros(len(self.points), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(self, other: Side, least: float, eps: float) -> None:
        same = other is self
        edges = []
        for i, j in close_pairs(self.tree, self.u, other.tree, other.u, least, eps):
            if same:
                i, j = i[i != j], j[i != j]
            self.links += np.bincount(i, weights=other.n[j], minlength=len(self.n)).astype(np.int64)
            if not same:
                other.links += np.bincount(j, weights=self.n[i], minlength=len(other.n)).astype(np.int64)
            edges += spanning(i, j + (0 if same else len(self.n)))
        if edges:
            every = self.points if same else np.concatenate([self.points, other.points])
            kept = np.array(spanning(*np.array(edges, np.int64).T), np.int64)
            self.edges.append((every[kept[:, 0]], every[kept[:, 1]]))

    def found(self):
        """Rows (point, other, n): counts, then edges."""
        at = np.nonzero(self.links)[0]
        yield pd.DataFrame({"point": pd.array(self.points[at], "Int64"), "other": pd.array([None] * len(at), "Int64"), "n": pd.array(self.links[at], "Int64")})
        for x, y in self.edges:
            yield pd.DataFrame({"point": pd.array(x, "Int64"), "other": pd.array(y, "Int64"), "n": pd.array([None] * len(x), "Int64")})


def near_duplicates(
    df: DataFrame, threshold: float = 0.95, block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows link when the cosine of their vectors, in doubles, is at least ``threshold``. Null
    vectors, zero vectors and vectors with null or non-finite components link with nothing,
    nor do vectors of different lengths; they are kept, as components of their own. Rows
    with a null id link with nothing and have a null component. Equal vectors are one point
    with a count, so copies are never paired among each other. Rows that repeat an id count
    as links of the others, and get the same result. An empty table gives no rows; other
    columns are ignored.

    Points are dealt to blocks of ``block_rows`` by hash; each block's tree is built once and
    written. Every pair of blocks is one unit of work. Units run in rounds: of each round's blocks
    (``ROUND_BYTES`` at most, but one block at least) all tasks get the trees by broadcast, and
    compare them with the blocks that they read. So no tree is shuffled, and disk doesn't grow with the
    pairs of blocks. A task gives, per point, the number of rows it links to, and edges
    that span what it found, never the pairs themselves.
    """
    v = vectors(df, id_col, vector_col)
    rows = store(v.groupBy("dim", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("point")), "points")
    blocks = max(1, -(-rows.count() // block_rows))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point")
        u = unit_rows(matrix(pdf["v"]))
        packed = pickle.dumps((pdf["point"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), u, cover_tree(u)))
        return pd.DataFrame({"block": [key[0]], "dim": [key[1]], "tree": [packed]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int"))
    # few blocks a file: a task of a round reads files
    dealt = dealt.repartition(min(2 * blocks, 4000), "block")
    trees = store(dealt.groupBy("block", "dim").applyInPandas(build, "block int, dim int, tree binary"), "trees", 8)
    size = trees.agg(F.sum(F.octet_length("tree")).alias("n")).first()["n"] or 0
    rounds = min(blocks, max(1, -(-size // ROUND_BYTES)))
    eps = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))

    def compare(batches):
        mine, met = None, {}  # the tree that is compared, and those of this round
        for pdf in batches:
            for block, dim, block2, tree, other in zip(pdf["block"], pdf["dim"], pdf["block2"], pdf["tree"], pdf["other"]):
                if mine is None or mine.key != (block, dim):
                    if mine is not None:
                        yield from mine.found()
                    mine = Side((block, dim), tree)
                if block == block2:
                    mine.meet(mine, threshold, eps)
                else:
                    if (block2, dim) not in met:
                        met[block2, dim] = Side((block2, dim), other)
                    mine.meet(met[block2, dim], threshold, eps)
        for side in [mine, *met.values()] if mine is not None else []:
            yield from side.found()

    # a block meets the half of the others that follow it in a circle, so every block has as many units
    ahead = F.pmod(F.col("block2") - F.col("block"), F.lit(blocks))
    once = (ahead * 2 < blocks) | ((ahead * 2 == blocks) & (F.col("block") < F.col("block2")))
    found = None
    for k in range(rounds):
        now = trees.where(F.pmod(F.col("block"), F.lit(rounds)) == k).select(F.col("block").alias("block2"), F.col("dim").alias("dim2"), F.col("tree").alias("other"))
        units = trees.join(F.broadcast(now), (F.col("dim") == F.col("dim2")) & once).select("block", "dim", "block2", "tree", "other")
        one = store(units.mapInPandas(compare, "point long, other long, n long"), "links", 8)
        found = one if found is None else found.unionByName(one)
    part = components(found.where("other is not null").select(F.col("point").alias("a"), F.col("other").alias("b")))
    counts = found.where("n is not null").groupBy("point").agg(F.sum("n").alias("linked"))
    judged = (
        rows.join(counts, "point", "left")
        .join(part.withColumnRenamed("node", "point"), "point", "left")
        .select("v", "point", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "point").alias("component_id"))
    )
    every = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    known = v.select("vec_id", "v").join(judged.select("v", "n_links", "component_id"), "v").select("vec_id", "n_links", "component_id")
    rest = every.where(F.col("vec_id").isNull() | ~usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

