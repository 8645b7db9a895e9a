"""Driver contract: entry smoke, registry completeness, oracle agreement at sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from paddock.plans.types import TYPES

SF = "/root/testdata/sf0.001"
FAST = ["favorite_roi", "race_results_card", "pp_recency_index", "workout_rollup", "derived_features", "roi_all_rules",
        "odds_buckets", "card_override_mismatch", "card_report", "odds_latest", "scratch_state", "odds_parse", "table_profile",
        "missing_odds", "live_predictions", "odds_refresh_report", "card_lifecycle", "card_snapshot", "odds_feed", "file_ledger", "permutation_importance", "trials_table", "ndcg_by_split", "day_slice", "favorite_histogram", "prob_sample", "split_random"]


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n_bets"] > 0


def test_registry_complete():
    qs, os_ = E.queries(), E.oracle_sql()
    assert len(qs) >= 50 and set(os_) <= set(qs)


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_oracle_agrees(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    s = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    res = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    o = sorted((tuple(_norm(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall()), key=repr)
    assert s == o
