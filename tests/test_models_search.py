"""Permutation importance, NDCG ranker, bounded search, saved pipelines."""

import tempfile

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from paddock.operators import evaluation, models, permutation, snapshots
from paddock.plans.pipeline import Pipeline

SF = "/root/testdata/sf0.001"
NAMES = ["market_prob", "post_position", "speed_fig_L1", "entry_class_rating"]


def tmp():
    return tempfile.mkdtemp(prefix="paddock-models-")


@pytest.fixture(scope="module")
def parts(spark):
    card = Pipeline(spark, SF).derived
    part = F.crc32("race_id") % 3
    return [card.where(part == k).cache() for k in range(3)]


def test_a_shuffle_keeps_every_value_and_follows_the_seed(spark):
    rows = [(f"R{i // 7:03d}", f"H{i}", float(i), None if i % 5 == 0 else float(-i)) for i in range(300)]
    df = spark.createDataFrame(rows, "race_id string, horse_name string, a double, b double")
    got = lambda d, seed: {r["horse_name"]: tuple(r["values"]) for r in permutation.permuted_values(d, ["a", "b"], seed).collect()}
    one = got(df, 3)
    assert one == got(df.repartition(7), 3) != got(df, 4) and len(one) == 300
    assert sorted(v[0] for v in one.values()) == sorted(r[2] for r in rows)
    assert sorted((v[1] for v in one.values()), key=repr) == sorted((r[3] for r in rows), key=repr)
    assert sum(one[r[1]][0] == r[2] for r in rows) < 20  # nearly all values have moved


def test_importance_of_a_known_score(spark):
    rows = [(f"R{i // 4}", f"H{i}", float(i % 4), float(i % 7), int(i % 4 == 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "race_id string, horse_name string, useful double, idle double, won int")
    imp = permutation.permutation_importance(df, lambda d: d.withColumn("model_score", F.col("useful") * 2), ["useful", "idle"])
    got = {r["feature"]: r["importance"] for r in imp.collect()}
    assert got["useful"] > 0.5 and got["idle"] == pytest.approx(0, abs=1e-12)


def test_tree_attribution_names_every_feature(parts):
    train, val, _ = parts
    m = models.calibrate(models.fit(train, val, "gbt", NAMES, {"maxIter": 4, "maxDepth": 2}), val)
    got = {r["feature"]: r["importance"] for r in models.tree_attribution(m, val).collect()}
    gains = dict(zip(NAMES, m.pipeline.stages[-1].featureImportances.toArray()))
    assert set(got) == set(NAMES) and all(got[n] == 0 for n in NAMES if gains[n] == 0) and any(got.values())
    with pytest.raises(ValueError):
        models.mean_abs_attribution(m, val)


def test_ndcg_weights_do_not_lose_against_the_plain_ranker(spark, parts):
    train, val, _ = parts
    ndcg = {k: evaluation.ndcg(models.fit(train, val, k, NAMES, {"rounds": 2}).score(val)).first() for k in ("ranker", "ndcg_ranker")}
    assert ndcg["ndcg_ranker"]["ndcg"] >= ndcg["ranker"]["ndcg"] - 1e-12 and ndcg["ranker"]["n_races"] > 0
    rows = [("a", "x", 1, 2.0, 0), ("a", "y", 2, 2.0, 1), ("a", "z", 3, 1.0, 0), ("b", "x", 1, None, 1), ("b", "y", 2, 1.0, 0), ("c", "x", 1, 9.0, 0)]
    one = evaluation.ndcg(spark.createDataFrame(rows, "race_id string, horse_name string, post_position long, model_score double, won int")).first()
    assert one["n_races"] == 1 and one["ndcg"] == pytest.approx(1 / 1.584962500721156)


def test_search_does_not_depend_on_concurrency_and_survives_a_retry(parts, monkeypatch):
    train, val, _ = parts
    small = lambda rng: {"stepSize": rng.uniform(0.05, 0.3), "maxDepth": rng.randint(1, 2), "subsamplingRate": 0.8, "minInstancesPerNode": 5, "maxIter": 5, "minInfoGain": 1e-6, "featureSubsetStrategy": "all"}
    monkeypatch.setattr(models, "sample_params", small)
    root = tmp()
    one = models.search(train, val, 3, root, "a", features=NAMES[:2], concurrency=1)
    two = models.search(train, val, 3, root, "b", features=NAMES[:2], concurrency=3)
    rows = lambda s: sorted(tuple(r) for r in s.trials.collect())
    assert rows(one) == rows(two) and one.best_params == two.best_params
    assert [r["trees"] for r in one.trials.orderBy("trial").collect()].count(5) == 2 and one.trials.where("finished").count() == 2
    monkeypatch.setattr(models, "GBTClassifier", None)  # the run is there: nothing is fitted for it again
    with pytest.raises(TypeError):
        models.search(train, val, 3, root, "c", features=NAMES[:2])
    assert snapshots.versions(train.sparkSession, root) == ["a", "b"]


def test_a_saved_pipeline_scores_raw_cards_in_a_new_session(spark, parts):
    train, val, _ = parts
    raw = Pipeline(spark, SF).raw_card
    for kind, params in (("offset_glr", {}), ("gbt", {"maxIter": 3, "maxDepth": 2})):
        m = models.fit(train, None, kind, NAMES, params)
        m.temperature = 1.3
        path = tmp()
        m.save(path)
        other = spark.newSession()
        loaded = PipelineModel.read().session(other).load(path)
        key = ["race_id", "horse_name"]
        want = {tuple(r[k] for k in key): r["model_prob"] for r in m.predict(Pipeline(spark, SF).derived).collect()}
        got = {tuple(r[k] for k in key): r["model_prob"] for r in loaded.transform(raw.drop("won") if kind == "gbt" and "won" not in raw.columns else raw).collect()}
        assert got == pytest.approx(want, abs=1e-9) and len(got) > 100
