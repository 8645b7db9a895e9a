"""Versioned snapshot tables (Z4, K5): whole versions in folders of their own, published last.

A version's rows are written first, then a one-row marker. Readers only see versions with
a marker, so a writer that dies leaves nothing half visible, and a retry under the same
name replaces what it left. A published version is never written again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_path, path_exists, shuffles_dropped


def publish(df: DataFrame, root: str, version: str, *partition_by: str) -> bool:
    """Writes ``df`` as ``version``; False if it is there already (nothing is written then)."""
    spark = df.sparkSession
    marker = f"{root}/published/version={version}"
    if path_exists(spark, f"{marker}/_SUCCESS"):
        return False
    with shuffles_dropped(spark):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/rows/version={version}")
    spark.range(1).select(F.current_timestamp().alias("published_at")).write.mode("overwrite").parquet(marker)
    return True


def _table_name(path: str) -> str:
    return f"paddock_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def publish_bucketed(df: DataFrame, root: str, version: str, key: str, buckets: int, dealt: bool = False) -> None:
    """Writes ``df`` as a version whose files are buckets of ``key``, sorted by it: readers group by it without a shuffle.

    One task writes one bucket (``dealt``: ``df`` is partitioned so already). The number of
    buckets is part of the version's name.
    """
    name = f"{version}-b{buckets}"
    path = f"{root}/rows/version={name}"
    rows = df if dealt else df.repartition(buckets, key)
    with shuffles_dropped(df.sparkSession):
        rows.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_table_name(path))
    marker = f"{root}/published/version={name}"
    df.sparkSession.range(1).select(F.current_timestamp().alias("published_at")).write.mode("overwrite").parquet(marker)


def read_bucketed(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The last version of a bucketed table; a catalog that doesn't know it yet learns its layout."""
    version = versions(spark, root)[-1]
    path = f"{root}/rows/version={version}"
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        layout = f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {version.rpartition('-b')[2]} BUCKETS"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {layout} LOCATION '{path}'")
    return spark.table(name)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions, oldest name first (one marker each)."""
    fs, p = hadoop_path(spark, f"{root}/published")
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    marks = [n.removeprefix("version=") for n in names if n.startswith("version=")]
    return sorted(v for v in marks if path_exists(spark, f"{root}/published/version={v}/_SUCCESS"))


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """A published version's rows, the last one's by default."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no published version {version or ''} under {root}")
    return spark.read.parquet(f"{root}/rows/version={version or known[-1]}")


def read_all(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all published versions, with their ``version``."""
    rows = spark.read.parquet(*[f"{root}/rows/version={v}" for v in versions(spark, root)])
    return rows.withColumn("version", F.regexp_extract(F.input_file_name(), "/version=([^/]+)/", 1))
