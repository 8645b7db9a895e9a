"""Derived model features (D1-D13) and the race-level windows W1-W3.

All race windows share one partition key, so the plan has one Exchange for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ieee_div, rank_min

RACE = "race_id"

# The model's 68 inputs, in matrix order.
FEATURE_NAMES: list[str] = [
    "morning_line_odds_float",
    "ml_odds_rank",
    "live_odds",
    "live_odds_rank",
    "market_prob",
    "field_size",
    "distance_yards",
    "is_dirt",
    "is_turf",
    "is_all_weather",
    "race_class_rating",
    "purse",
    "min_age_allowed",
    "max_age_allowed",
    "is_sex_restricted",
    "is_female_only_race",
    "is_male_only_race",
    "post_position",
    "post_position_bucket",
    "weight_carried",
    "age",
    "is_female",
    "is_gelded",
    "entry_class_rating",
    "entry_class_rating_minus_field_avg",
    "entry_class_rating_to_field_avg_ratio",
    "entry_to_race_class_ratio",
    "speed_fig_L1",
    "speed_fig_L2",
    "speed_fig_L3",
    "avg_speed_fig_L3",
    "max_speed_fig_L3",
    "speed_fig_trend",
    "speed_fig_minus_field_avg_L1",
    "speed_fig_to_field_avg_ratio_L1",
    "official_finish_L1",
    "official_finish_L2",
    "official_finish_L3",
    "relative_finish_L1",
    "relative_finish_L2",
    "relative_finish_L3",
    "avg_relative_finish",
    "pp_odds_L1",
    "pp_odds_L2",
    "pp_odds_L3",
    "pp_overperformance_L1",
    "pp_overperformance_L2",
    "pp_overperformance_L3",
    "pp_avg_overperformance_L3",
    "distance_diff_L1",
    "distance_diff_L2",
    "distance_diff_L3",
    "surface_switch_L1",
    "days_since_last",
    "num_prior_starts",
    "best_workout_rank_pct",
    "best_workout_group_size",
    "last_workout_rank_pct",
    "last_workout_group_size",
    "num_workouts",
    "days_since_last_workout",
    "career_starts",
    "career_win_rate",
    "career_top3_rate",
    "career_earnings_per_start",
    "surface_starts",
    "surface_win_rate",
    "surface_top3_rate",
]

# Sex codes and restriction codes.
FEMALE_SEX_CODES = ["F", "M"]
GELDED_SEX_CODE = "G"
FEMALE_ONLY_RESTRICTIONS = ["B", "F", "M"]
MALE_ONLY_RESTRICTIONS = ["A", "C", "G", "H", "I", "J", "R"]
PP_TURF_CODES = ["T", "I", "O"]


def course_type(course_desc: F.Column, surface: F.Column) -> F.Column:
    return (
        F.when(course_desc == "All Weather Track", "All Weather Track")
        .when(surface == "D", "Dirt")
        .when(surface == "T", "Turf")
    )


def pp_course_type(pp_surface: F.Column) -> F.Column:
    return (
        F.when(pp_surface.isin(PP_TURF_CODES), "Turf")
        .when(pp_surface == "D", "Dirt")
        .when(pp_surface == "E", "All Weather Track")
    )


def _age_digit(c: F.Column) -> F.Column:
    return c.try_cast("int")


def derive_features(df: DataFrame, race: str = RACE) -> DataFrame:
    """One pass of projections plus one shared race window."""
    ct = course_type(F.col("course_desc"), F.col("surface"))
    pct = pp_course_type(F.col("pp_surface_L1"))
    ar = F.col("age_restriction")
    pos_share = ieee_div("post_position", "field_size")
    sr = F.col("sex_restriction")
    w = Window.partitionBy(race)

    out = df.select(
        "*",
        (ct == "All Weather Track").cast("int").alias("is_all_weather"),
        (ct == "Dirt").cast("int").alias("is_dirt"),
        (ct == "Turf").cast("int").alias("is_turf"),
        (ct != pct).cast("int").alias("surface_switch_L1"),
        ieee_div("entry_class_rating", "race_class_rating").alias("entry_to_race_class_ratio"),
        (F.year("race_date") - F.col("year_of_birth")).cast("bigint").alias("age"),
        F.col("sex").isin(FEMALE_SEX_CODES).cast("int").alias("is_female"),
        (F.col("sex") == GELDED_SEX_CODE).cast("int").alias("is_gelded"),
        F.when(pos_share <= 1 / 3, 0).when(pos_share <= 2 / 3, 1).otherwise(2).cast("int").alias("post_position_bucket"),
        F.when(F.substring(ar, 1, 1) == "0", _age_digit(F.substring(ar, 2, 1)))
        .otherwise(_age_digit(F.substring(ar, 1, 1)))
        .cast("int")
        .alias("min_age_allowed"),
        F.when(F.substring(ar, 2, 1) == "U", 99).otherwise(_age_digit(F.substring(ar, 2, 1))).cast("int").alias("max_age_allowed"),
        sr.isNotNull().cast("int").alias("is_sex_restricted"),
        F.coalesce(sr.isin(FEMALE_ONLY_RESTRICTIONS), F.lit(False)).cast("int").alias("is_female_only_race"),
        F.coalesce(sr.isin(MALE_ONLY_RESTRICTIONS), F.lit(False)).cast("int").alias("is_male_only_race"),
        F.datediff("race_date", "last_pp_date").cast("bigint").alias("days_since_last"),
        F.datediff("race_date", "last_workout_date").cast("bigint").alias("days_since_last_workout"),
        *[(F.col("distance_yards") - F.col(f"distance_yards_L{k}")).alias(f"distance_diff_L{k}") for k in (1, 2, 3)],
        (F.col("entry_class_rating") - F.avg("entry_class_rating").over(w)).alias("entry_class_rating_minus_field_avg"),
        ieee_div(F.col("entry_class_rating"), F.avg("entry_class_rating").over(w)).alias("entry_class_rating_to_field_avg_ratio"),
        (F.col("speed_fig_L1") - F.avg("speed_fig_L1").over(w)).alias("speed_fig_minus_field_avg_L1"),
        ieee_div(F.col("speed_fig_L1"), F.avg("speed_fig_L1").over(w)).alias("speed_fig_to_field_avg_ratio_L1"),
        ieee_div("career_wins", "career_starts").alias("career_win_rate"),
        ieee_div(F.col("career_wins") + F.col("career_seconds") + F.col("career_thirds"), F.col("career_starts")).alias("career_top3_rate"),
        ieee_div("career_earnings", "career_starts").alias("career_earnings_per_start"),
        ieee_div("surface_wins", "surface_starts").alias("surface_win_rate"),
        ieee_div(F.col("surface_wins") + F.col("surface_seconds") + F.col("surface_thirds"), F.col("surface_starts")).alias("surface_top3_rate"),
        rank_min("morning_line_odds_float", race).alias("ml_odds_rank"),
        rank_min("live_odds", race).alias("live_odds_rank"),
        ieee_div(F.lit(1.0), F.col("live_odds") + 1).alias("_mp_raw"),
    )
    return out.withColumn("market_prob", ieee_div(F.col("_mp_raw"), F.sum("_mp_raw").over(w))).drop("_mp_raw")


def market_prob_from(df: DataFrame, odds_col: str, out_col: str = "market_prob", race: str = RACE) -> DataFrame:
    """Implied probability 1/(odds+1) normalised within the race."""
    raw = ieee_div(F.lit(1.0), F.col(odds_col) + 1)
    return df.withColumn(out_col, ieee_div(raw, F.sum(raw).over(Window.partitionBy(race))))
