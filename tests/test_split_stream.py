"""Splits (global rank without one partition) and the tick throttle."""

import datetime as dt
import os
import random
import tempfile

import pytest

from paddock.operators import split as split_ops
from paddock.streaming import card_state


def test_chronological_split_sizes_and_order(spark):
    rnd = random.Random(1)
    rows = [(f"R{i:04d}", dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 30))) for i in range(503)]
    df = spark.createDataFrame(rows, "race_id string, race_date date").repartition(7)
    lab = split_ops.race_split_labels(df).collect()
    n = len(rows)
    sizes = {s: sum(r["split"] == s for r in lab) for s in ("train", "val", "test")}
    assert sizes == {"test": int(n * 0.15), "val": int(n * 0.15), "train": n - 2 * int(n * 0.15)}
    ranks = sorted(lab, key=lambda r: r["rank"])
    assert [r["rank"] for r in ranks] == list(range(1, n + 1))
    assert [(r["race_date"], r["race_id"]) for r in ranks] == sorted((r["race_date"], r["race_id"]) for r in ranks)
    last_train = max(r["rank"] for r in lab if r["split"] == "train")
    assert all(r["rank"] > last_train for r in lab if r["split"] != "train")


def test_random_split_sizes(spark):
    df = spark.createDataFrame([(f"R{i}", dt.date(2020, 1, 1)) for i in range(200)], "race_id string, race_date date")
    lab = split_ops.race_split_labels(df, mode="random", seed=3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in lab} == {"test": 30, "val": 30, "train": 140}
    with pytest.raises(ValueError):
        split_ops.race_split_labels(df, mode="bogus")


def test_throttle_ticks_keeps_ticks_that_are_far_enough_apart(spark):
    t0 = dt.datetime(2024, 1, 1)
    later = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [(1, 1, t0, 0, 5.0), (1, 1, later(5), 1, 6.0), (1, 2, later(6), 2, 3.0), (1, 1, later(16), 3, 7.0), (1, 1, later(30), 4, 8.0), (1, 1, later(3600), 5, 9.0)]
    df = spark.createDataFrame(rows, "race_key long, post_position long, ts timestamp, seq long, live_odds double")
    src = tempfile.mkdtemp(prefix="paddock-throttle-src-")
    df.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, "p"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(src, "p"))
    q = (
        card_state.throttle_ticks(stream).writeStream.format("memory").queryName("throttled")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="paddock-throttle-ckpt-")).trigger(availableNow=True).start()
    )
    q.awaitTermination(300)
    got = sorted((r["post_position"], r["live_odds"]) for r in spark.sql("SELECT * FROM throttled").collect())
    assert got == [(1, 5.0), (1, 7.0), (1, 9.0), (2, 3.0)]
