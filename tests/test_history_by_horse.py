"""Lookups from one shuffle by horse: the same rows as by key, and no history written or shuffled 10 rows a runner."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paddock import session
from paddock.operators import history
from paddock.plans import warehouse
from paddock.plans.pipeline import Pipeline
from paddock.sources import fixtures

SF = "/root/testdata/sf0.001"
RUNS = (
    "race_id string, horse_name string, race_date date, race_number long, track string, surface string, distance_yards long, "
    "num_runners long, official_finish long, dollar_odds double, speed_figure double, earnings long"
)
WORKOUTS = "horse_name string, workout_date date, workout_ranking long, workout_num_in_group long, wk_key1 long, wk_key2 long"


@pytest.fixture(scope="module")
def tables(spark):
    rnd, runs = random.Random(11), []
    for race in range(80):
        d = None if race % 19 == 0 else dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 30))
        for h in rnd.sample(range(6), 4):
            figure = None if rnd.random() < 0.2 else float(rnd.randint(50, 90))
            row = (f"R{race}", f"H{h}", d, race, "N1", "TD"[race % 2], 1000 + race, 4, rnd.randint(1, 4), rnd.randint(0, 9) / 2, figure, race * 10)
            runs += [row] * (2 if race % 13 == 0 else 1)  # runners that are there twice
    wk = [(f"H{rnd.randint(0, 7)}", None if i % 17 == 0 else dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randint(-5, 30)), None if i % 7 == 0 else rnd.randint(1, 6), rnd.randint(0, 6), i, 1) for i in range(90)]
    return spark.createDataFrame(runs, RUNS), spark.createDataFrame(wk, WORKOUTS)


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("heavy", [10**6, 70, 0])
def test_same_rows_as_by_key(tables, monkeypatch, heavy):
    monkeypatch.setattr(history, "HEAVY_ROWS", heavy)
    runs, wk = tables
    pp = history.past_performances(history.number_runs(runs), 10)
    for got, want in [
        (history.past_performances_asof(runs, 10), pp),
        (history.rollup_past_performances(history.recent_runs(runs, 10)), history.rollup_past_performances(pp)),
        (history.with_workouts(runs, wk), history.workout_rollup_asof(runs, wk)),
        (history.with_workouts(runs, wk, "reference"), history.workout_rollup_asof(runs, wk, null_rank="reference")),
        (history.with_career(runs), history._career_by_key(runs).drop("earnings")),
        (history.with_history(runs, wk), history.with_history_by_key(runs, wk)),
    ]:
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, want.columns) == rows(want, want.columns)


def test_heavy_horses_are_found(tables, monkeypatch):
    monkeypatch.setattr(history, "HEAVY_ROWS", 55)
    runs, _ = tables
    light, heavy = history._divide(runs)
    n = {r["horse_name"]: r["count"] for r in runs.groupBy("horse_name").count().collect()}
    assert {r["horse_name"] for r in heavy[0].collect()} >= {h for h, k in n.items() if k > 55}
    assert light[0].count() + heavy[0].count() == runs.count()


@pytest.mark.parametrize("heavy", [10**6, 0])
def test_rows_that_are_not_counted_add_nothing_to_careers(tables, monkeypatch, heavy):
    monkeypatch.setattr(history, "HEAVY_ROWS", heavy)
    runs, wk = tables
    once = runs.dropDuplicates(["race_id", "horse_name"])
    want = set(map(tuple, history.with_career(once).select("race_id", "horse_name", "career_starts", "surface_earnings").collect()))
    twice = once.withColumn("counted", F.explode(F.array(F.lit(True), F.lit(False))))
    for df in (history.with_career(twice), history.with_history(twice, wk), history.with_history_by_key(twice, wk)):
        assert "counted" not in df.columns and "earnings" not in df.columns
        assert set(map(tuple, df.select("race_id", "horse_name", "career_starts", "surface_earnings").collect())) == want


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange ") + plan.count("Exchange(")


def test_history_takes_one_shuffle_and_is_not_written(spark):
    p = Pipeline(spark, SF)
    for df in (p.past_performances(10), p.pp_features, p.workout_features()):
        assert exchanges(df) == 1
    assert exchanges(history.with_history(p.base.withColumn("earnings", fixtures.earnings()), p.workouts)) == 1
    fs, path = session.hadoop_path(spark, warehouse.ingest(spark, SF))
    assert "past_performances" not in [st.getPath().getName() for st in fs.listStatus(path)]
    assert p.past_performances(10).agg(F.max("pp_index")).first()[0] <= 10


def test_partitions_grow_with_the_input(spark, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fixtures.history_partitions(spark, SF) == least
    monkeypatch.setattr(session, "PARTITION_BYTES", 1000)
    assert fixtures.history_partitions(spark, SF) > least
