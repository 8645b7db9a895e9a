"""Ingested domain tables (K1), written once per input and shared by every query.

The reference ingests raw feeds into processed Parquet tables (results, entries,
past performances, ...) and runs every modelling and evaluation step on those.
Here the ingest builds the ``runners`` table -- the result-chart and entry-card
columns of every runner -- from the driver tables, and writes it to the shared folder named
by ``spark.checkpoint.dir``. A runner's past performances are up to 10 runs that this table
has already, so they are looked up when they are read (``past_performances``) instead of
being written 10 rows a runner. The card, the race features and the few columns of them that
scoring reads are written there too, each once a query first asks for it. A fingerprint
of the layout's version and the input files (path, size, modification time) names the copy,
so changed inputs are re-ingested and unchanged ones are read back. A table is written to
a folder of its own and published last: a rebuild that fails, or runs beside another one,
changes nothing that is being read. Reading the written table also cuts the lineage: a
lost executor recomputes from these files, not from the raw scans.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, snapshots
from ..session import ensure_checkpoint_dir, hadoop_path, stored
from ..sources import fixtures

#: To be raised when what the ingest writes changes: tables of other versions are not read.
LAYOUT_VERSION = "4"
INGEST_INPUTS = ("lineitem", "orders", "customer", "part")
_LOCK = threading.Lock()
_FEATURES_LOCK = threading.Lock()
_CARD_LOCK = threading.Lock()
_READY: set[str] = set()


def fingerprint(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = INGEST_INPUTS) -> str:
    h = hashlib.sha256(LAYOUT_VERSION.encode())
    for n in names:
        fs, p = hadoop_path(spark, fixtures.table_path(sf_dir, n))
        h.update(str(p).encode())
        files = fs.listFiles(p, True)  # with those in partition folders
        found = []
        while files.hasNext():
            st = files.next()
            found.append(f"{st.getPath()}|{st.getLen()}|{st.getModificationTime()}")
        h.update("\n".join(sorted(found)).encode())
    return h.hexdigest()[:20]


def _version() -> str:
    """Names sort by time; two writers at once publish two whole copies."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _publish(df: DataFrame, root: str, *partition_by: str) -> None:
    snapshots.publish(df, root, _version(), *partition_by)


def build_runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest plan (lazy). A part that is listed n times gives n * n rows a runner, n of them
    ``counted`` in career totals."""
    base = fixtures.runner_base(spark, sf_dir).withColumn("race_year", F.year("race_date"))
    base = base.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return base.withColumn("counted", F.col("copies") == 1).drop("copies")


PP_MAX_INDEX = 10


def _root(spark: SparkSession, sf_dir: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/paddock-warehouse/{fingerprint(spark, sf_dir)}"


def ingest(spark: SparkSession, sf_dir: str, force: bool = False) -> str:
    """Build (or rebuild with ``force``) the ingested table; returns its folder."""
    with _LOCK:
        root = _root(spark, sf_dir)
        if force or not snapshots.versions(spark, f"{root}/runners"):
            _publish(build_runners(spark, sf_dir), f"{root}/runners", "race_year")
        _READY.add(root)
    return root


def table(spark: SparkSession, sf_dir: str, name: str, with_year: bool = False) -> DataFrame:
    """An ingested table for ``sf_dir`` (the ingest runs on first use).

    ``with_year``: keeps ``race_year``, by which the table is laid out.
    """
    # the fingerprint is taken again each time: changed inputs have another folder
    root = _root(spark, sf_dir)
    if root not in _READY:
        ingest(spark, sf_dir)
    df = snapshots.read_version(spark, f"{root}/{name}")
    return df if with_year else df.drop("race_year")


def latest_day(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runners of the latest race day and the past performances of its horses.

    The year and the day are scalar subqueries: they are found first, and prune the scan of the
    day at run time. The horses' earlier runs come from all years, by a semi-join before any shuffle by horse;
    the horses are written first, so that the join knows how few they are and need not shuffle all runs.
    """
    runners_ = table(spark, sf_dir, "runners", with_year=True)
    year = runners_.agg(F.max("race_year")).scalar()
    in_year = F.col("race_year") == year
    day = runners_.where(in_year).agg(F.max("race_date")).scalar()
    today = runners_.where(in_year & (F.col("race_date") == day)).drop("race_year")
    horses = stored(today.select("horse_name").distinct())
    # runs without a date are nobody's history
    runs = fixtures.runs_for_history(runners_.where(F.col("race_year") <= year)).join(horses, "horse_name", "left_semi")
    return today, history.past_performances_asof(runs, PP_MAX_INDEX)


def card(spark: SparkSession, sf_dir: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Runners with their history rollups, written by ``build`` on first use in buckets of races:
    the race windows of the features, and whatever else groups by race, read it without a shuffle."""
    path = f"{_root(spark, sf_dir)}/card"
    with _CARD_LOCK:
        if force or not snapshots.versions(spark, path):
            snapshots.publish_bucketed(build(), path, _version(), "race_id", fixtures.history_partitions(spark, sf_dir))
    return snapshots.read_bucketed(spark, path, "race_id")


def scoring(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """What scoring reads of the features, written by ``build`` on first use in buckets of races (``build`` deals it so)."""
    path = f"{_root(spark, sf_dir)}/scoring-{name}"
    with _CARD_LOCK:
        if force or not snapshots.versions(spark, path):
            snapshots.publish_bucketed(build(), path, _version(), "race_id", fixtures.history_partitions(spark, sf_dir), dealt=True)
    return snapshots.read_bucketed(spark, path, "race_id")


def features(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The card with its race features, written by ``build`` on first use: every evaluation reads this copy."""
    path = f"{_root(spark, sf_dir)}/features-{name}"
    with _FEATURES_LOCK:
        if force or not snapshots.versions(spark, path):
            _publish(build(), path)
    return snapshots.read_version(spark, path)


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "runners")


def past_performances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4/W8 of every runner, from one shuffle of the written runners by horse."""
    runs = fixtures.runs_for_history(runners(spark, sf_dir))
    return history.past_performances_asof(runs, PP_MAX_INDEX, fixtures.history_partitions(spark, sf_dir))
