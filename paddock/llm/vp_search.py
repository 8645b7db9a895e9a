"""Nearest neighbours by vantage-point trees, one per shard.

A node keeps a vantage point and the distance interval of each half of its points. A
half is skipped when the triangle inequality puts it ``factor`` times further than the
nearest neighbours found so far: with factor one only halves that can't hold a neighbour
are skipped and the search is exact; smaller factors skip more.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .vectors import matrix, vectors

LEAF = 128


class VPTree:
    """Vantage-point tree over the rows of ``x`` with ids; halves are split by rank, so copies can't unbalance it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.ids, self.x, self.leaf = ids, x, leaf
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(ids))

    def _build(self, begin: int, end: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if end - begin <= self.leaf:
            self.nodes[at] = (begin, end)
            return at
        rows = self.order[begin:end]
        # the point furthest from the first one: vantage points at the rim part the others best
        far = int(np.argmax(distances(self.x[rows], self.x[rows[0]])))
        rows[[0, far]] = rows[[far, 0]]
        d = distances(self.x[rows[1:]], self.x[rows[0]])
        by = np.argsort(d, kind="stable")
        rows[1:], d = rows[1:][by], d[by]
        half = (end - begin) // 2
        near = self._build(begin + 1, begin + 1 + half)
        away = self._build(begin + 1 + half, end)
        self.nodes[at] = (begin, (d[0], d[half - 1], near), (d[half], d[-1], away))
        return at

    def search(self, q: np.ndarray, skip: int, k: int, factor: float) -> list[tuple[float, int]]:
        """(distance, id) of the ``k`` nearest found, ties to the smaller id; ``skip`` is left out."""
        best: list[tuple[float, int]] = []  # a heap of (-distance, -id): the worst first

        def offer(dist: np.ndarray, rows: np.ndarray) -> None:
            limit = -best[0][0] if len(best) == k else np.inf
            for i in np.nonzero(dist <= limit)[0]:
                entry = (-float(dist[i]), -int(self.ids[rows[i]]))
                if -entry[1] == skip:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)

        def visit(at: int) -> None:
            node = self.nodes[at]
            if len(node) == 2:
                rows = self.order[node[0] : node[1]]
                offer(distances(self.x[rows], q), rows)
                return
            rows = self.order[node[0] : node[0] + 1]
            d = distances(self.x[rows], q)
            offer(d, rows)
            halves = sorted((max(low - d[0], d[0] - high, 0.0), child) for low, high, child in node[1:])
            for bound, child in halves:
                if len(best) < k or bound * (1 + 1e-9) - 1e-12 <= -best[0][0] * factor:
                    visit(child)

        visit(self.root)
        return sorted((-d, -i) for d, i in best)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    diff = x - q
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int = 10,
    factor: float = 1.0,
    shard_rows: int = 16384,
    block_rows: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each query's ``k`` nearest rows of ``df`` other than itself: query_id, rank, vec_id, score.

    ``queries`` has the same columns as ``df``. Nearest first, ties to the smaller id; score is the
    Euclidean distance in doubles. Null vectors, zero vectors, vectors with null or
    non-finite components and rows without an id take no part on either side; vectors of
    another length than the query's are no candidates. Of rows with the same id and vector
    one counts; of rows with the same id and other vectors the smallest vector counts. Fewer
    rows than ``k`` give all of them; an empty table gives none. Other columns are ignored.

    Rows are dealt to shards by id hash, ``shard_rows`` on average, so neither copies nor
    clusters meet in one task; each shard's tree is built once and written. Queries go
    in blocks to every shard, each pair of shard and block is one task's unit, and the
    shards' answers are merged, k rows each.
    """
    v = one_per_id(vectors(df, id_col, vector_col))
    q = one_per_id(vectors(queries, id_col, vector_col))
    shards = max(1, -(-v.count() // shard_rows))
    blocks = max(1, -(-q.count() // block_rows))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        tree = VPTree(pdf["vec_id"].to_numpy(np.int64), matrix(pdf["v"]))
        return pd.DataFrame({"shard": [key[0]], "dim": [key[1]], "tree": [pickle.dumps(tree)]})

    trees = v.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    trees = store(trees.groupBy("shard", "dim").applyInPandas(build, "shard int, dim int, tree binary"), "trees")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"dim": [key[1]], "ids": [pdf["vec_id"].tolist()], "x": [matrix(pdf["v"]).tobytes()]})

    packed = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    packed = packed.groupBy("block", "dim").applyInPandas(pack, "dim int, ids array<long>, x binary")
    packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def answer(batches):
        for pdf in batches:
            out = []
            for tree, ids, x in zip(pdf["tree"], pdf["ids"], pdf["x"]):
                t = pickle.loads(tree)
                for i, row in zip(ids, np.frombuffer(x).reshape(len(ids), -1)):
                    out += [(int(i), found, d) for d, found in t.search(row, int(i), k, factor)]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    pairs = trees.join(packed, ["shard", "dim"]).select("tree", "ids", "x")
    pairs = pairs.repartition(max(2, min(2 * shards * blocks, 2000))) if shards * blocks > 1 else pairs
    found = pairs.mapInPandas(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def one_per_id(v: DataFrame) -> DataFrame:
    return v.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
