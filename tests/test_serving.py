"""Serving path: missing odds, live predictions, refresh report; final retrain and the feature step."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paddock.functions.columns import feed_track_code
from paddock.operators import models, serving
from paddock.operators.features import FEATURE_NAMES
from paddock.plans.pipeline import Pipeline
from paddock.streaming import card_state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def card(spark):
    return Pipeline(spark, SF).derived.cache()


@pytest.fixture(scope="module")
def state(spark, card):
    """All runners of two races: the first whole but for a scratch, the second without odds for post 1."""
    races = [r[0] for r in card.where("field_size >= 4").select("race_number").distinct().orderBy("race_number").limit(2).collect()]
    posts = card.where(F.col("race_number").isin(races)).select(F.col("race_number").alias("race_key"), "post_position")
    first = F.col("race_key") == races[0]
    return posts.select(
        "*",
        (F.lit(1.0) + F.col("post_position")).alias("latest_odds"),
        F.when(~first & (F.col("post_position") == 1), 0).otherwise(2).cast("bigint").alias("n_ticks"),
        (first & (F.col("post_position") == 2)).alias("scratched"),
    )


def test_races_with_missing_odds_are_listed_and_not_scored(card, state):
    whole, short = serving.missing_odds(state).orderBy("race_key").collect()
    assert (whole["n_missing"], whole["missing_posts"]) == (0, "") and (short["n_missing"], short["missing_posts"]) == (1, "1")
    got = serving.live_predictions(card, state).orderBy("rank").collect()
    assert len(got) == whole["n_active"] and 2 not in [r["post_position"] for r in got]
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert [r["ev_per_dollar"] for r in got] == sorted((r["ev_per_dollar"] for r in got), reverse=True)
    implied = {r["post_position"]: 1 / (2.0 + r["post_position"]) for r in got}
    for r in got:
        assert r["market_prob"] == pytest.approx(implied[r["post_position"]] / sum(implied.values()), abs=1e-4)
        assert r["edge"] == pytest.approx(r["model_prob"] - r["market_prob"], abs=2e-4)
    assert sum(r["model_prob"] for r in got) == pytest.approx(1.0, abs=1e-3)


def test_refresh_report_lists_silent_active_posts(spark):
    t0 = dt.datetime(2024, 1, 1)
    log = [(1, 1, 0, "odds"), (1, 2, 1, "scratch"), (1, 3, 2, "odds"), (1, 2, 3, "odds"), (1, 1, 30, "odds")]
    rows = [(k, p, t0 + dt.timedelta(seconds=s), i, kind, 2.0) for i, (k, p, s, kind) in enumerate(log)]
    events = spark.createDataFrame(rows, "race_key long, post_position long, ts timestamp_ntz, seq long, kind string, live_odds double")
    card = spark.createDataFrame([(1, p) for p in (1, 2, 3, 4, 12)], "race_key long, post_position long")
    a, b = card_state.refresh_report(card_state.fold_events(events, card)).orderBy("window_start").collect()
    assert (a["applied_posts"], a["n_skipped"], a["missing_posts"]) == ("1,3", 1, "4,12")
    assert (b["applied_posts"], b["n_skipped"], b["missing_posts"], b["n_missing"]) == ("1", 0, "3,4,12", 3)


def test_final_retrain_takes_all_splits_and_keeps_trees_and_temperature(card):
    part = F.crc32("race_id") % 3
    train, val, test = (card.where(part == k) for k in range(3))
    names = ["market_prob", "post_position", "speed_fig_L1"]
    m = models.fit(train, val, "gbt", names, {"maxIter": 6, "maxDepth": 2})
    m.temperature = 1.7
    final = models.final_retrain([train, val, test], m)
    assert models.tree_count(final) == models.tree_count(m) and final.temperature == 1.7
    linear = models.final_retrain([train, val, test], models.fit(train, val, "offset_glr", names))
    alone = models.fit(card, None, "offset_glr", names)
    assert linear.pipeline.stages[-1].coefficients.toArray() == pytest.approx(alone.pipeline.stages[-1].coefficients.toArray(), rel=1e-6)
    m.temperature = float("nan")
    with pytest.raises(ValueError):
        models.final_retrain([train], m)


def test_feature_step_keeps_the_order_given(spark):
    raw = Pipeline(spark, SF).raw_card
    names = [FEATURE_NAMES[5], FEATURE_NAMES[0], FEATURE_NAMES[9]]
    assert models.CardFeatures(names).transform(raw).columns == ["race_id", "horse_name", *names]
    with pytest.raises(ValueError):
        models.CardFeatures(["no_such_feature"])


def test_feed_track_codes(spark):
    df = spark.createDataFrame([("CD",), ("cd",), ("SAR",), (None,)], "t string")
    assert [r[0] for r in df.select(feed_track_code("t")).collect()] == ["cd", "cd", "sar", None]
