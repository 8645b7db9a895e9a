"""Spark session helpers.

The library never owns cluster configuration: on a cluster the session comes from
the platform and these helpers only fill in settings that are still unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on for correct results or for a sane plan. They are
# applied only when the running session has no value of its own.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # broadcast only sides that are proven small at runtime (AQE re-plans on real sizes)
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "paddock") -> SparkSession:
    """A local session for tests and benchmarks (UI off, loopback only)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Fill in library defaults on an existing session without overriding anything."""
    for key, value in _DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


#: The largest method that the JVM compiles, in bytes; Spark lets generated ones grow to 65535, which are then interpreted.
COMPILED_BYTES = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def compile_wide_plans(spark: SparkSession) -> None:
    """Stages that compute so many columns that one method of them all is never compiled get
    several smaller ones instead (unless the session says how large methods may be)."""
    for key, value in COMPILED_BYTES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is respected as is. Only
    when it is unset (local tests) a private scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="paddock-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting to drop shuffle files as soon as the query that made them has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While tables are written: the shuffle files behind one go once it is there, so steps don't add up on disk."""
    was = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, was)


def stored(df: DataFrame) -> DataFrame:
    """Rows written into the shared checkpoint folder and read back: cuts the lineage as ``cut_lineage`` does, in
    compressed columns instead of whole rows. Partitions and their order are not kept."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/paddock-stored/{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def hadoop_path(spark: SparkSession, path: str):
    """The file system of ``path`` and the path itself, as Hadoop objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return bool(fs.exists(p))


#: Input bytes (compressed columns) for which a wide shuffle has one partition.
PARTITION_BYTES = 8 * 1024 * 1024


def partitions_for(spark: SparkSession, *paths: str) -> int:
    """Partitions of a shuffle of these inputs: the session's number, more where its tasks would have to spill."""
    size = 0
    for path in paths:
        fs, p = hadoop_path(spark, path)
        size += fs.getContentSummary(p).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
