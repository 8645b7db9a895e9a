"""What evaluation reads: a narrow table in buckets of races, without the whole card or all features on disk."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from paddock import session
from paddock.operators import split, staging
from paddock.plans import registry, warehouse
from paddock.plans.pipeline import SCORING_COLUMNS, Pipeline
from paddock.sources import fixtures


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("contest"))
    day = lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(days=k)
    made = {
        "customer": ([(k, k % 3) for k in range(4)], "c_custkey long, c_nationkey long"),
        "part": ([(k, k % 7 + 1) for k in [*range(9), 8]], "p_partkey long, p_size int"),  # part 8 is listed twice
        "orders": (
            [(k, k % 4, "OFP"[k % 3], 1000.0 * k, day(k // 3), "5-LOW" if k % 5 == 0 else "1-URGENT") for k in range(40)],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        ),
        "lineitem": (
            [
                (o, (o * 3 + i) % 9, i, i, float(1 + (o + i) % 40), 1000.0 + 900 * ((o * 7 + i * 5) % 60), 0.05, 0.08 if (o + i) % 6 == 0 else 0.02, "ARN"[(o + i) % 3], day(o // 3 - i))
                for o in range(40) for i in range(1, 6)
            ],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
            "l_returnflag string, l_shipdate timestamp",
        ),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_evaluation_writes_and_shuffles_no_whole_card(spark, tables):
    assert registry.QUERIES["bets_favorite"](spark, tables).count() > 0
    registry.QUERIES["split_random"](spark, tables).count()
    registry.QUERIES["staged_card"](spark, tables).count()
    fs, path = session.hadoop_path(spark, warehouse._root(spark, tables))
    assert sorted(st.getPath().getName() for st in fs.listStatus(path)) == ["runners", "scoring-morning_line"]
    p = Pipeline(spark, tables)
    plan = p.enriched()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", p.built_scoring()._jdf.queryExecution().executedPlan().toString())
    assert scans and not any(c in s for s in scans for c in ("weight_carried", "purse", "l_linenumber", "l_quantity"))


def test_scoring_rows_are_those_of_the_features(spark, tables):
    p, inline = Pipeline(spark, tables), Pipeline(spark, tables, materialize=False)
    got, want = p.for_scoring, inline.built_features.select(*SCORING_COLUMNS)
    assert got.columns == SCORING_COLUMNS and got.count() == want.count() > 0
    # sums of doubles differ in their last bit with the order of a race's rows
    rounded = lambda df: [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    got = got.select(*rounded(got))
    for other in (want, p.built_features.select(*SCORING_COLUMNS)):
        assert got.exceptAll(other.select(*rounded(other))).count() == 0
    races = inline.raw_card.select("race_id", "race_date").distinct()
    mine = p.card_races.distinct()
    assert mine.count() == races.count() and mine.exceptAll(races).count() == 0


def test_ranks_are_written_with_the_columns_to_keep_only(spark):
    rows = spark.range(500).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("h"))
    kept = split.global_rank(rows.repartition(7), ["h", "id"], ["id"])
    assert kept.columns == ["id", "rank"]
    want = sorted(r["id"] for r in rows.collect())
    order = [r["id"] for r in sorted(rows.collect(), key=lambda r: r["h"])]
    assert [r["id"] for r in kept.orderBy("rank").collect()] == order and sorted(order) == want


def test_staged_card_from_listed_overrides(spark, tables):
    p = Pipeline(spark, tables)
    base = p.base.unionByName(p.base.where("post_position = 1"))  # rows that come twice
    own = fixtures.overrides(p.base)
    overrides = own.unionByName(own.where("post_position = 2"))
    got = staging.apply_listed_overrides(p.built_card(staging.with_override_list(base, overrides)))
    want = staging.apply_overrides(p.built_card(base), overrides)
    assert set(got.columns) == set(want.columns) and got.count() == want.count() > base.count()
    assert got.select(*want.columns).exceptAll(want).count() == 0


def test_day_slice_does_not_shuffle_all_runs(spark, tables):
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "3000")  # less than the runners are thought to have, more than the day's horses
    try:
        plan = warehouse.latest_day(spark, tables)[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, was)
    assert re.search(r"BroadcastHashJoin \[horse_name#\d+\], \[horse_name#\d+\], LeftSemi", plan) and "SortMergeJoin" not in plan
