"""Helpers shared by the training-data operators: shared tables, components, documents."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word of the contracts: a run of characters other than blank and tab .. carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


#: Spark's setting to drop shuffle files as soon as the query that made them has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a batch that Python tasks get; packed rows are large.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def store(df: DataFrame, name: str, batch_rows: int = 1000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files behind it go once it is written, so phases don't add up on disk. Python
    tasks get ``batch_rows`` rows at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    settings = {DROP_SHUFFLES: "true", BATCH_ROWS: str(batch_rows)}
    was = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(schema).parquet(path)


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


#: A key with more than one in so many rows is heavy; fewer keys than this can be.
HEAVY = 1000


def heavy_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The values of ``key`` that more than one in ``HEAVY`` of the table's ``rows`` have: always fewer than ``HEAVY``."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HEAVY > rows).select(key)


def look_up(df: DataFrame, heavy: DataFrame, key: str, table: DataFrame, name: str) -> DataFrame:
    """``df`` with column ``name`` of ``table``, which has one row for every value of ``key``.

    Rows of the ``heavy`` keys take it from a broadcast of fewer than ``HEAVY`` rows, where they stand;
    the others are shuffled by key, none of which holds more than one in ``HEAVY`` rows.
    """
    table = table.select(key, name)
    top = F.broadcast(table.join(F.broadcast(heavy), key))
    met = df.join(top, key, "left")
    rest = met.where(F.col(name).isNull()).drop(name).join(table, key)
    return met.where(F.col(name).isNotNull()).unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows (node, component), the smallest node.

    Minimum labels spread over the edges and, by pointer jumping, along the labels
    themselves, so the number of rounds grows with the logarithm of the diameter. Each
    step of a round is written to the shared folder. Nodes without an edge have no row. Minima are
    pre-aggregated before the shuffle. Hubs and the labels of large components are looked up
    in a broadcast of bounded size (``look_up``), so neither their edges nor their nodes meet in one task.
    """
    both = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = store(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels"
    )
    nodes = labels.count()
    if not nodes:
        return labels
    hubs = store(heavy_keys(both, "b", both.count()), "hubs")
    for _ in range(max_rounds):
        near = look_up(both, hubs, "b", labels.withColumnRenamed("node", "b"), "component")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        hooked = store(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("c1")), "hooked")
        jump = hooked.select(F.col("node").alias("c1"), F.col("c1").alias("c2"))
        large = heavy_keys(hooked, "c1", nodes)
        new = store(look_up(hooked, large, "c1", jump, "c2").select("node", "was", F.least("c1", "c2").alias("component")), "labels")
        changed = not new.where("was <> component").isEmpty()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of ``a``-``b`` that join parts not joined yet."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out
