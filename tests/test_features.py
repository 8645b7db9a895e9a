"""Derived features: hand-computed values on runners written over rows of the driver's card."""

import math

import pytest
from pyspark.sql import functions as F

from paddock.operators.features import FEATURE_NAMES, derive_features
from paddock.plans.pipeline import Pipeline

SF = "/root/testdata/sf0.001"
#: horse: race, course, surface, earlier surface, post, field, morning line, live odds, sex, ages, sexes, starts, wins, classes
RUNNERS = {
    "Umber": ("Q7", "All Weather Track", "E", "E", 1, 4, 6.0, 9.0, "M", "34", "F", 8, 2, 90.0, 60.0),
    "Vesper": ("Q7", "All Weather Track", "E", "D", 2, 4, 6.0, 4.0, "F", "34", "F", 0, 0, 30.0, 60.0),
    "Willow": ("Q7", "All Weather Track", None, None, 3, 4, 2.0, 4.0, "M", "34", "F", 4, 4, 45.0, 0.0),
    "Xenia": ("Q7", "All Weather Track", "E", "T", 4, 4, 19.0, 1.5, "F", "34", "F", 5, 0, 60.0, 60.0),
    "Yarrow": ("Q8", "Inner course", "T", "D", 1, 2, 1.0, 3.0, "G", "2U", None, 10, 3, 50.0, 40.0),
    "Zephyr": ("Q8", "Inner course", None, "T", 2, 2, 3.0, 0.5, "C", "02", None, 2, 1, 40.0, 40.0),
}
SET = [
    ("race_id", "string"), ("course_desc", "string"), ("surface", "string"), ("pp_surface_L1", "string"), ("post_position", None),
    ("field_size", None), ("morning_line_odds_float", "double"), ("live_odds", "double"), ("sex", "string"), ("age_restriction", "string"),
    ("sex_restriction", "string"), ("career_starts", None), ("career_wins", None), ("entry_class_rating", "double"), ("race_class_rating", "double"),
]


@pytest.fixture(scope="module")
def derived(spark):
    card = Pipeline(spark, SF).raw_card
    rows = spark.createDataFrame(card.orderBy("race_id", "horse_name").limit(1).collect(), card.schema)
    own = None
    for horse, values in RUNNERS.items():
        one = rows.withColumn("horse_name", F.lit(horse))
        for (name, kind), value in zip(SET, values):
            one = one.withColumn(name, F.lit(value).cast(kind or card.schema[name].dataType))
        own = one if own is None else own.unionByName(one)
    return {r["horse_name"]: r for r in derive_features(own).collect()}


def values(derived, name):
    return [derived[h][name] for h in RUNNERS]


def test_course_flags(derived):
    assert values(derived, "is_all_weather")[:5] == [1, 1, 1, 1, 0]
    assert values(derived, "is_turf")[:5] == [0, 0, 0, 0, 1] and values(derived, "is_dirt")[:5] == [0, 0, 0, 0, 0]
    assert derived["Zephyr"]["is_turf"] is None  # neither the course nor the surface tells
    assert values(derived, "surface_switch_L1") == [0, 1, None, 1, 1, None]


def test_ratios_divide_like_floats(derived):
    assert derived["Umber"]["entry_to_race_class_ratio"] == pytest.approx(1.5)
    assert math.isinf(derived["Willow"]["entry_to_race_class_ratio"])
    assert derived["Umber"]["career_win_rate"] == pytest.approx(0.25) and derived["Willow"]["career_win_rate"] == 1.0
    assert math.isnan(derived["Vesper"]["career_win_rate"])


def test_ties_share_the_smaller_rank(derived):
    assert values(derived, "ml_odds_rank")[:4] == [2, 2, 1, 4] and values(derived, "ml_odds_rank")[4:] == [1, 2]


def test_market_probabilities_of_a_race_add_up(derived):
    implied = {h: 1 / (r[7] + 1) for h, r in RUNNERS.items()}
    for race in ("Q7", "Q8"):
        inside = [h for h, r in RUNNERS.items() if r[0] == race]
        for h in inside:
            assert derived[h]["market_prob"] == pytest.approx(implied[h] / sum(implied[x] for x in inside))


def test_restrictions(derived):
    assert [(derived[h]["min_age_allowed"], derived[h]["max_age_allowed"]) for h in ("Umber", "Yarrow", "Zephyr")] == [(3, 4), (2, 99), (2, 2)]
    assert derived["Umber"]["is_female_only_race"] == 1 and derived["Yarrow"]["is_sex_restricted"] == 0
    assert values(derived, "is_female") == [1, 1, 1, 1, 0, 0] and values(derived, "is_gelded") == [0, 0, 0, 0, 1, 0]


def test_post_buckets(derived):
    assert values(derived, "post_position_bucket") == [0, 1, 2, 2, 1, 2]


def test_all_features_present(derived):
    assert len(FEATURE_NAMES) == 68 and len(set(FEATURE_NAMES)) == 68
    assert set(FEATURE_NAMES) <= set(derived["Umber"].asDict())
