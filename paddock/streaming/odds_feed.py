"""The odds feed as a stream of JSON payloads.

A line of a feed file is an envelope: the race, when its odds were fetched, and the
payload as it came. Fetches that come again within the watermark are dropped, and so are
those that come after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import payload_odds

ENVELOPE = "race_key bigint, fetched_at timestamp, payload string"


def envelopes(lines: DataFrame) -> DataFrame:
    """Rows (race_key, fetched_at, payload) of text lines; lines that are none have no row."""
    e = lines.select(F.from_json("value", ENVELOPE).alias("e")).select("e.*")
    return e.where(F.col("race_key").isNotNull() & F.col("fetched_at").isNotNull())


def read_feed(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if max_files else spark.readStream
    return envelopes(reader.text(path))


def odds_of(payloads: DataFrame) -> DataFrame:
    """Rows (race_key, fetched_at, post_position, live_odds): without state, entries coupled by position."""
    return payloads.select("race_key", "fetched_at", F.explode(payload_odds("payload")).alias("o")).select("race_key", "fetched_at", "o.*")


def stream_odds(payloads: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Z1 on a stream of payloads: every fetch of a race once.

    A fetch older than ``late`` is dropped from the trigger on that follows the one in which
    the watermark passed it.
    """
    return odds_of(payloads.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["race_key", "fetched_at"]))


def as_ticks(odds: DataFrame) -> DataFrame:
    """Feed rows as odds events of the card log; a race's fetches are numbered by their time."""
    return odds.select(
        "race_key",
        "post_position",
        F.col("fetched_at").cast("timestamp_ntz").alias("ts"),
        F.unix_millis("fetched_at").alias("seq"),
        F.lit("odds").alias("kind"),
        "live_odds",
    )
