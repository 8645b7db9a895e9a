"""What the ingest and the scoring table shuffle once no table is small enough to be broadcast."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from paddock.operators import betting, evaluation, history, scoring
from paddock.plans import registry, warehouse
from paddock.plans.pipeline import SCORING_COLUMNS, Pipeline
from paddock.plans.types import finish

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def day(k):
    return dt.datetime(2021, 3, 1) + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Lines without a part, with one that isn't listed, and twice; parts listed twice and three times, with and without
    a size; races without a nation or a date."""
    d = str(tmp_path_factory.mktemp("odd"))
    parts = [(k, k + 1) for k in range(11)] + [(9, None), (10, 30), (10, 11), (None, 5)]
    lines = [
        (o, (3 * o + 2 * i) % 13 if (o + i) % 11 else None, i, i, float(2 + (3 * o + i) % 30), 1500.0 + 700 * ((o * 5 + i * 11) % 50), 0.04, 0.08 if (o + i) % 7 == 0 else 0.01, "ARN"[(o + i) % 3], day(o // 3 - i))
        for o in range(45) for i in range(1, 6)
    ]
    made = {
        "customer": ([(k, k % 3 if k < 5 else None) for k in range(6)], "c_custkey long, c_nationkey long"),
        "part": (parts, "p_partkey long, p_size int"),
        "orders": (
            [(k, k % 6, "OFP"[k % 3], 900.0 * k, day(k // 3) if k % 14 else None, "5-LOW" if k % 5 == 0 else "1-URGENT") for k in range(42)],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        ),
        "lineitem": (
            lines + lines[::9],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
            "l_returnflag string, l_shipdate timestamp",
        ),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d, lines, parts


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "-1")
    yield
    spark.conf.set(THRESHOLD, was)


def shuffled(spark, df):
    """Key and columns of each exchange."""
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\((\w+)#", text)
    return [(key, [c.partition("#")[0] for c in columns.split(", ")]) for columns, key in found]


def test_only_keys_are_shuffled_by_part(spark, odd, no_broadcast):
    found = shuffled(spark, warehouse.build_runners(spark, odd[0]))
    by_part = [columns for key, columns in found if key in ("l_partkey", "p_partkey")]
    assert sorted(map(len, by_part)) == [2, 2] and ["l_orderkey", "l_partkey"] in by_part
    # no text that is made of other columns is shuffled
    assert not any("race_id" in columns or "course_desc" in columns for _, columns in found)
    assert [key for key, _ in found].count("l_orderkey") == 1


def test_only_history_is_shuffled_by_horse(spark, odd, no_broadcast):
    found = shuffled(spark, Pipeline(spark, odd[0]).built_scoring())
    (columns,) = (columns for key, columns in found if key == "horse_name" and "speed_figure" in columns)
    assert not {"dollar_odds", "morning_line_odds_float", "post_position", "official_finish", "num_runners", "entry_class_rating"} & {*columns}


def test_runners_of_odd_lines_and_parts(spark, odd):
    d, lines, parts = odd
    want, sizes = [], {}
    for k, size in parts:
        sizes.setdefault(k, []).append(size)
    for o in range(42):
        held = {}
        for line in (x for x in lines if x[0] == o):
            held.setdefault(line[1], line)
        order = sorted(held.values(), key=lambda x: x[3])
        for post, line in enumerate(order, 1):
            listed = sizes.get(line[1], []) if line[1] is not None else []
            want += [(o, f"H{line[1]}", post, len(order), s and 10.0 * s, c == 0) for s in listed for c in range(len(listed))]
    columns = ["race_number", "horse_name", "post_position", "num_runners", "entry_class_rating", "counted"]
    got = [tuple(r) for r in warehouse.build_runners(spark, d).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(x[1] is None for x in lines) and any(w[4] is None for w in want)


def test_history_that_meets_its_runners_by_race(spark, odd):
    p = Pipeline(spark, odd[0])
    whole = p.built_card()
    past = whole.select("race_id", "horse_name", *[c for c in whole.columns if c not in p.base.columns])
    got = history.dealt_with_history(p.base.drop("counted"), past, 3)
    assert {*got.columns} == {*whole.columns} and got.count() == whole.count() > p.base.count()
    assert whole.where("track IS NULL AND career_starts > 0").count() > 0 and whole.where("race_date IS NULL").count() > 0
    got = got.select(*whole.columns)
    assert got.exceptAll(whole).count() == 0


def test_scoring_and_bets_of_odd_rows(spark, odd):
    d = odd[0]
    p, inline = Pipeline(spark, d), Pipeline(spark, d, materialize=False)
    rounded = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    features = inline.built_features.select(*SCORING_COLUMNS)
    got, want = rounded(p.for_scoring), rounded(features)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    got = registry.QUERIES["bets_top_ev_per_race"](spark, d)
    want = finish(betting.apply_bet_rule(evaluation.enrich(scoring.fixed_linear_score(features)), "top_ev_per_race"), registry.BET_COLS)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
