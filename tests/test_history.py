"""As-of history operators against brute force on a small hand-made log."""

import datetime as dt
import random

import pytest

from paddock.operators import history


@pytest.fixture(scope="module")
def runs(spark):
    rnd = random.Random(3)
    rows = []
    for race in range(60):
        d = dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 40))  # many same-day races
        for h in rnd.sample(range(8), 4):
            rows.append((f"R{race}", f"H{h}", d, race, "T" if race % 3 else "D", float(rnd.randint(50, 90)), rnd.randint(1, 4), 4, 2.0, 1320, "N1", 100))
    schema = "race_id string, horse_name string, race_date date, race_number long, surface string, speed_figure double, official_finish long, num_runners long, dollar_odds double, distance_yards long, track string, earnings long"
    return spark.createDataFrame(rows, schema), rows


def brute_pp(rows, max_index):
    out = {}
    for r in rows:
        prior = sorted([p for p in rows if p[1] == r[1] and p[2] < r[2]], key=lambda p: (p[2], p[3]), reverse=True)[:max_index]
        for i, p in enumerate(prior):
            out[(r[0], r[1], i + 1)] = (p[2], p[3], p[5])
    return out


def test_past_performances_match_self_join(runs):
    df, rows = runs
    pp = history.past_performances(history.number_runs(df), max_index=10).collect()
    got = {(r["race_id"], r["horse_name"], r["pp_index"]): (r["pp_race_date"], r["pp_race_number"], r["pp_speed_figure"]) for r in pp}
    assert got == brute_pp(rows, 10)


def test_rollup_from_runs_equals_generic_rollup(runs):
    df, _ = runs
    n = history.number_runs(df)
    a = {(r["race_id"], r["horse_name"]): r.asDict() for r in history.rollup_from_runs(n, 10).collect()}
    b = {(r["race_id"], r["horse_name"]): r.asDict() for r in history.rollup_past_performances(history.past_performances(n, 10)).collect()}
    assert a == b


def test_career_to_date_strictly_before(runs):
    df, rows = runs
    got = {(r["race_id"], r["horse_name"]): (r["career_starts"], r["career_wins"], r["surface_starts"]) for r in history.career_to_date(df).collect()}
    for r in rows:
        prior = [p for p in rows if p[1] == r[1] and p[2] < r[2]]
        want = (len(prior), sum(p[6] == 1 for p in prior), sum(p[4] == r[4] for p in prior))
        assert got[(r[0], r[1])] == want


def test_workout_rollup_asof(spark, runs):
    df, rows = runs
    rnd = random.Random(5)
    wk = [(f"H{rnd.randint(0, 7)}", dt.date(2019, 12, 20) + dt.timedelta(days=rnd.randint(0, 50)), rnd.randint(1, 6), rnd.randint(0, 6), i, 1) for i in range(120)]
    wdf = spark.createDataFrame(wk, "horse_name string, workout_date date, workout_ranking long, workout_num_in_group long, wk_key1 long, wk_key2 long")
    got = {(r["race_id"], r["horse_name"]): r for r in history.workout_rollup_asof(df, wdf).collect()}
    for r in rows:
        prior = [w for w in wk if w[0] == r[1] and w[1] < r[2]]
        if not prior:
            assert (r[0], r[1]) not in got
            continue
        g = got[(r[0], r[1])]
        pct = lambda w: (w[2] / w[3]) if w[3] else float("inf")
        best = min(prior, key=lambda w: (pct(w), w[1], w[4], w[5]))
        last = max(prior, key=lambda w: (w[1], w[4], w[5]))
        assert g["num_workouts"] == len(prior)
        assert g["best_workout_rank_pct"] == pytest.approx(pct(best))
        assert g["best_workout_group_size"] == best[3]
        assert g["last_workout_group_size"] == last[3] and g["last_workout_date"] == last[1]


def test_workout_null_rank_modes(spark):
    probes = spark.createDataFrame([("R1", "H1", dt.date(2020, 2, 1))], "race_id string, horse_name string, race_date date")
    wk = spark.createDataFrame(
        [("H1", dt.date(2020, 1, 5), None, 9, 1, 1), ("H1", dt.date(2020, 1, 6), 3, 8, 2, 1), ("H1", dt.date(2020, 1, 7), 1, 4, 3, 1)],
        "horse_name string, workout_date date, workout_ranking long, workout_num_in_group long, wk_key1 long, wk_key2 long",
    )
    skip = history.workout_rollup_asof(probes, wk, null_rank="skip").first()
    ref = history.workout_rollup_asof(probes, wk, null_rank="reference").first()
    assert skip["best_workout_rank_pct"] == pytest.approx(0.25) and skip["best_workout_group_size"] == 4
    assert ref["best_workout_rank_pct"] == pytest.approx(0.25) and ref["best_workout_group_size"] == 9  # null-rank row first
    assert skip["num_workouts"] == 3 and skip["last_workout_group_size"] == 4
    with pytest.raises(ValueError):
        history.workout_rollup_asof(probes, wk, null_rank="other")
