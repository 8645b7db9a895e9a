"""Live predictions from the latest card state.

A refresh asks for the active runners of the races in the event log. A race whose active
runners all have live odds is scored on them; one that misses some is listed with those
posts and not scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .betting import with_expected_value
from .features import market_prob_from
from .scoring import fixed_linear_score, per_race_softmax
from .staging import prediction_columns


def missing_odds(state: DataFrame) -> DataFrame:
    """Per race the active runners and the posts of those without live odds.

    ``state`` has race_key, post_position, n_ticks and scratched (``card_state.latest_state``);
    a runner has live odds once a tick was applied. A race's posts are bounded by its field.
    """
    active = state.where(~F.col("scratched"))
    missing = F.col("n_ticks") == 0
    return active.groupBy("race_key").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_active"),
        F.sum(missing.cast("bigint")).alias("n_missing"),
        F.array_join(F.array_sort(F.collect_list(F.when(missing, F.col("post_position")))), ",").alias("missing_posts"),
    )


def live_predictions(features: DataFrame, state: DataFrame, temperature: float = 1.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score the active runners of every race whose live odds are complete.

    The market probability comes from the live odds of the active runners alone, and so do
    the score's base margin and the EV. ``rank`` orders a race by EV, highest first (T2),
    ties by post position. Races of the log without a card have no rows. ``keep``: further
    columns of ``features`` to return.
    """
    live = state.where(~F.col("scratched")).select(
        F.col("race_key").alias("race_number"), "post_position", F.col("latest_odds").alias("_odds"), "n_ticks"
    )
    card = features.drop("market_prob").join(live, ["race_number", "post_position"])
    race = Window.partitionBy("race_id")
    card = card.withColumn("_ticks", F.min("n_ticks").over(race)).where("_ticks > 0").withColumn("live_odds", F.col("_odds"))
    scored = fixed_linear_score(market_prob_from(card, "live_odds"))
    scored = per_race_softmax(scored, "model_score", "model_prob", temperature)
    out = prediction_columns(with_expected_value(scored, odds="live_odds"), *keep)
    best = race.orderBy(F.col("ev_per_dollar").desc_nulls_last(), F.col("post_position").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(best).cast("bigint"))
