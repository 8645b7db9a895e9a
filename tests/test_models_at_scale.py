"""What fits read again and again: narrow rows, dealt by race, and pairs that are made without a shuffle."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paddock.operators import models
from paddock.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ["market_prob", "post_position", "speed_fig_L1", "entry_class_rating"]


@pytest.fixture(scope="module")
def frame(spark):
    return registry._training_frame(spark, SF)


def test_the_training_frame_is_narrow_and_dealt_by_race(spark, frame):
    assert frame.columns == [*registry.TRAINING_COLUMNS, "split"]
    by_race = frame.withColumn("n", F.count("won").over(Window.partitionBy("race_id")))
    assert "Exchange" not in by_race._jdf.queryExecution().executedPlan().toString()
    want = registry.Pipeline(spark, SF).derived.select(*registry.TRAINING_COLUMNS)
    assert frame.drop("split").exceptAll(want).isEmpty() and want.exceptAll(frame.drop("split")).isEmpty()
    assert {r["split"] for r in frame.select("split").distinct().collect()} == {"train", "val", "test"}


@pytest.mark.parametrize("kind, scorer, columns", [
    ("offset_glr", "GeneralizedLinearRegression", ["label", "base_margin", "features"]),
    ("gbt", "GBTClassifier", ["label", "_is_val", "features"]),
])
def test_fits_reread_a_label_and_a_vector(frame, monkeypatch, kind, scorer, columns):
    seen = []
    was = getattr(models, scorer).fit
    monkeypatch.setattr(getattr(models, scorer), "fit", lambda self, df: seen.append((df.columns, df.storageLevel.useMemory)) or was(self, df))
    part = lambda s: frame.where(F.col("split") == s).drop("split")
    m = models.fit(part("train"), part("val"), kind, NAMES, {"maxIter": 3})
    assert seen == [(columns, True)]
    # the fitted pipeline scores raw rows as the vectors of the fit were made
    assert m.score(part("val")).where("model_score is null").isEmpty()


def test_trials_read_one_written_narrow_copy(spark, frame, monkeypatch, tmp_path):
    seen = []
    was = models.GBTClassifier.fit
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, df: seen.append((df.columns, df.storageLevel.useMemory)) or was(self, df))
    small = {"stepSize": 0.1, "maxDepth": 1, "subsamplingRate": 0.8, "minInstancesPerNode": 5, "maxIter": 3, "minInfoGain": 1e-6, "featureSubsetStrategy": "all"}
    monkeypatch.setattr(models, "sample_params", lambda rng: dict(small))
    part = lambda s: frame.where(F.col("split") == s).drop("split")
    found = models.search(part("train"), part("val"), 2, str(tmp_path), "a", features=NAMES)
    assert seen[:-1] == [(["race_id", "won", "label", "features"], True)] * 3 and seen[-1] == (["label", "features"], True)
    assert found.trials.count() == 2


ROWS = [  # race, post, horse, won, v
    ("a", 1, "x", 0, [1.0, 2.0]), ("a", 2, "y", 1, [1.0, 0.0]), ("a", 3, "z", 0, [0.5, 0.0]), ("a", 3, None, 0, [0.5, 0.0]),
    ("b", 1, "x", 1, [3.0, 1.0]), ("b", 2, "y", 1, [3.0, 1.0]), ("b", None, "z", 0, [3.0, None]), ("b", 4, "u", 0, [0.0, 1.0]),
    ("c", 1, "x", 0, [3.0, 1.0]), ("d", 1, "x", 1, [3.0, 1.0]), ("e", 1, "x", 1, [3.0, 1.0]), ("e", 2, "y", None, [3.0, 1.0]),
]


@pytest.mark.parametrize("weights", [None, [1.0, -2.0]])
def test_pairs_of_a_race_are_its_winners_against_the_others(spark, weights):
    df = spark.createDataFrame(ROWS, "race_id string, post_position long, horse_name string, won int, v array<double>")
    x = df.groupBy("race_id").agg(F.collect_list(F.struct("post_position", "horse_name", "won", "v")).alias("r")).select("r")
    out = x.mapInArrow(models._paired(weights), "d array<double>, label double, weight double")
    got = sorted((tuple(r["d"]), r["label"], round(r["weight"], 9)) for r in out.collect())
    want = []
    for race in "abcde":
        runners = [r for r in ROWS if r[0] == race]
        score = lambda r: None if None in r[4] else sum(a * b for a, b in zip(r[4], weights or [0.0, 0.0]))
        first = lambda r: (score(r) is None, -(score(r) or 0.0), r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")
        gain = {id(r): 1 / math.log2(k + 2) for k, r in enumerate(sorted(runners, key=first))}
        for w in (r for r in runners if r[3] == 1):
            for o in (r for r in runners if r[3] == 0):
                d = [0.0 if None in (p, q) else p - q for p, q in zip(w[4], o[4])]
                weight = round(abs(gain[id(w)] - gain[id(o)]), 9) if weights else 1.0
                want += [(tuple(d), 1.0, weight), (tuple(-y for y in d), 0.0, weight)]
    assert got == sorted(want) and len(got) == 2 * (3 + 4)
