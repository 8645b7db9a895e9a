"""Scoring of changed races as their odds arrive (Z6), and what the triggers wrote.

Every trigger writes into folders of its own, named by its batch id, so that a batch that
runs again after a failure replaces what it wrote before. The list of races a batch
changed is written last: readers take a batch's rows only once its list is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import serving
from .card_state import STATE_STORE, stream_card_state

ROWS, RACES = "rows", "races"


def write_batch(rows: DataFrame, races: DataFrame, root: str, batch_id: int) -> None:
    """One batch's rows (with race_key) and, last, the races that it changed."""
    rows.write.mode("overwrite").parquet(f"{root}/{ROWS}/batch={batch_id}")
    races.write.mode("overwrite").parquet(f"{root}/{RACES}/batch={batch_id}")


def current_rows(spark: SparkSession, root: str) -> DataFrame:
    """Of every race the rows of the last batch that changed it; a race without rows there has none."""
    last = spark.read.parquet(f"{root}/{RACES}").groupBy("race_key").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{root}/{ROWS}").join(last, ["race_key", "batch"]).drop("batch")


def keep_state(root: str) -> Callable[[DataFrame, int], None]:
    """Writes the state of the races that a batch changed."""

    def run(batch: DataFrame, batch_id: int) -> None:
        changed = batch.persist()
        try:
            if not changed.isEmpty():
                write_batch(changed.where("exists").drop("exists"), changed.select("race_key").distinct(), root, batch_id)
        finally:
            changed.unpersist()

    return run


def score_changed(features: DataFrame, root: str, temperature: float = 1.0) -> Callable[[DataFrame, int], None]:
    """Scores the races that a batch changed against the card ``features``.

    Only cards of changed races are joined. A race that is incomplete, or gone, is listed
    as changed without predictions, which withdraws earlier ones.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        changed = batch.persist()
        try:
            if changed.isEmpty():
                return
            races = changed.select("race_key").distinct()
            cards = features.join(races.withColumnRenamed("race_key", "race_number"), "race_number", "left_semi")
            scored = serving.live_predictions(cards, changed.where("exists"), temperature, keep=("race_number",))
            write_batch(scored.withColumnRenamed("race_number", "race_key"), races, root, batch_id)
        finally:
            changed.unpersist()

    return run


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Typed state needs RocksDB as the state store; a session's other setting is put back."""
    key, value = STATE_STORE
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def follow(events_stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **kwargs) -> None:
    """Runs the card state over all that the stream has now, and returns when it is done."""
    with typed_state(events_stream.sparkSession):
        state = stream_card_state(events_stream, **kwargs)
        q = state.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()


def ranked(predictions: DataFrame) -> DataFrame:
    """T2 over predictions of several batches: their order within the race."""
    best = Window.partitionBy("race_id").orderBy(F.col("ev_per_dollar").desc_nulls_last(), F.col("post_position").asc_nulls_last())
    return predictions.withColumn("rank", F.row_number().over(best).cast("bigint"))
