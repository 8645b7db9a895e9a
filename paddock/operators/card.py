"""Card assembly: results x entries x history rollups -> one row per runner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Course descriptions excluded from modelling (jump races, downhill turf).
EXCLUDED_COURSE_DESCS = ["Hurdle", "Downhill turf", "Timber"]

#: M5: where the live odds come from.
LIVE_ODDS_COLUMNS = {"morning_line": "morning_line_odds_float", "final": "dollar_odds"}

RACE_COLUMNS = [
    "race_id",
    "race_date",
    "track",
    "race_number",
    "distance_yards",
    "surface",
    "course_desc",
    "num_runners",
    "horse_name",
    "official_finish",
    "dollar_odds",
]

ENTRY_COLUMNS = [
    "race_id",
    "horse_name",
    "morning_line_odds_float",
    "post_position",
    "weight_carried",
    "purse",
    "year_of_birth",
    "sex",
    "age_restriction",
    "sex_restriction",
    "career_starts",
    "career_wins",
    "career_seconds",
    "career_thirds",
    "career_earnings",
    "surface_starts",
    "surface_wins",
    "surface_seconds",
    "surface_thirds",
]


def race_rows(results: DataFrame) -> DataFrame:
    """P1 + P2: drop excluded courses (a null course drops too, N11), prune, rename."""
    return results.where(~F.col("course_desc").isin(EXCLUDED_COURSE_DESCS)).select(
        *RACE_COLUMNS, F.col("class_rating").alias("race_class_rating")
    )


def entry_rows(entries: DataFrame) -> DataFrame:
    """Entry columns with the entry class renamed."""
    return entries.select(*ENTRY_COLUMNS, F.col("class_rating").alias("entry_class_rating"))


def build_raw_card(
    results: DataFrame,
    entries: DataFrame,
    pp_features: DataFrame,
    workout_features: DataFrame,
    live_odds: str = "morning_line",
) -> DataFrame:
    """J1 inner on (race, horse) -> P3 positive odds -> J2 left joins -> P9/P10 -> M5.

    ``live_odds`` selects the live-odds column: ``morning_line`` (no leakage) or ``final``
    (upper bound).
    """
    key = ["race_id", "horse_name"]
    joined = race_rows(results).join(entry_rows(entries), key, "inner")
    return _finish_card(joined, pp_features, workout_features, live_odds)


def build_raw_card_from_runners(
    runners: DataFrame,
    pp_features: DataFrame,
    workout_features: DataFrame,
    live_odds: str = "morning_line",
) -> DataFrame:
    """Same card when results and entries live in one ingested runners table (no J1 self-join)."""
    rows = runners.where(~F.col("course_desc").isin(EXCLUDED_COURSE_DESCS)).select(
        *RACE_COLUMNS,
        F.col("race_class_rating"),
        *[c for c in ENTRY_COLUMNS if c not in ("race_id", "horse_name")],
        F.col("entry_class_rating"),
    )
    return _finish_card(rows, pp_features, workout_features, live_odds)


def on_card() -> F.Column:
    """P1 + P3: the runners that a raw card keeps."""
    return ~F.col("course_desc").isin(EXCLUDED_COURSE_DESCS) & (F.col("dollar_odds") > 0)


def raw_card_from_history(card: DataFrame, history_columns: list[str], live_odds: str = "morning_line") -> DataFrame:
    """Same card from runners that carry their history rollups already: no join at all."""
    rows = card.where(on_card()).select(
        *RACE_COLUMNS,
        F.col("race_class_rating"),
        *[c for c in ENTRY_COLUMNS if c not in ("race_id", "horse_name")],
        F.col("entry_class_rating"),
        *history_columns,
    )
    return _finished(rows, live_odds)


def _finish_card(joined: DataFrame, pp_features: DataFrame, workout_features: DataFrame, live_odds: str) -> DataFrame:
    key = ["race_id", "horse_name"]
    return _finished(joined.where(F.col("dollar_odds") > 0).join(pp_features, key, "left").join(workout_features, key, "left"), live_odds)


def _finished(joined: DataFrame, live_odds: str) -> DataFrame:
    if live_odds not in LIVE_ODDS_COLUMNS:
        raise ValueError(f"live_odds must be one of {tuple(LIVE_ODDS_COLUMNS)}, got {live_odds!r}")
    return (
        joined.fillna(0, subset=["num_prior_starts", "num_workouts"])
        .withColumn("field_size", F.col("num_runners"))
        .withColumn("won", (F.col("official_finish") == 1).cast("int"))
        .withColumn("live_odds", F.col(LIVE_ODDS_COLUMNS[live_odds]))
    )


def training_frame(raw_derived: DataFrame) -> DataFrame:
    """Drop helper dates after derivation."""
    return raw_derived.drop("last_pp_date", "last_workout_date")
