"""Horse history: recency index, last-N rollups, career totals and workout rollups.

All "as of the race" lookups are built without emitting pairs of runs of one horse.
Rows are dealt by horse once and every lookup is a window over that layout: a runner's
last N runs are a list in its own row, so history is never shuffled N rows a runner.
Horses with very many rows (``HEAVY_ROWS``) would be one long task; theirs are looked up
by key instead. Their runs are numbered through a per-(horse, day) count table and a running sum
over its days -- that table is bounded by the number of distinct days, not by the
number of runs -- and the last N prior runs are then fetched with an equi-join on
the near-unique key (horse, run number). Output is linear in the input and a horse
holding a large share of all rows is spread over many join keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ieee_div

KEY = "horse_name"
DATE = "race_date"
ORDER = "race_number"

# Past-performance columns carried from a prior run (source column -> pp column).
PP_COLUMNS = {
    DATE: "pp_race_date",
    ORDER: "pp_race_number",
    "track": "pp_track",
    "speed_figure": "pp_speed_figure",
    "official_finish": "pp_official_finish",
    "num_runners": "pp_num_starters",
    "dollar_odds": "pp_odds",
    "distance_yards": "pp_distance_yards",
    "surface": "pp_surface",
}

#: Horses that may have more rows than this are looked up by key, never in one window.
HEAVY_ROWS = 100_000
_BUCKETS = 1 << 16


def _prev_days(key: str | list[str], date: str) -> Window:
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)


def number_runs(runs: DataFrame, key: str = KEY, date: str = DATE, order: str = ORDER) -> DataFrame:
    """Add ``run_seq`` (1-based, by date then order) and ``prior_runs``.

    ``prior_runs`` counts the horse's runs on strictly earlier days, so the runs
    eligible as history for a race are exactly ``run_seq <= prior_runs``.
    """
    day = runs.groupBy(key, date).agg(F.count(F.lit(1)).alias("_n_day"))
    day = day.select(key, date, F.coalesce(F.sum("_n_day").over(_prev_days(key, date)), F.lit(0)).alias("prior_runs"))
    in_day = F.row_number().over(Window.partitionBy(key, date).orderBy(order))
    return (
        runs.withColumn("_seq_in_day", in_day)
        .join(day, [key, date], "inner")
        .withColumn("run_seq", (F.col("prior_runs") + F.col("_seq_in_day")).cast("bigint"))
        .withColumn("prior_runs", F.col("prior_runs").cast("bigint"))
        .drop("_seq_in_day")
    )


def past_performances(numbered: DataFrame, max_index: int = 10, key: str = KEY) -> DataFrame:
    """Up to ``max_index`` prior runs per (race, horse), ``pp_index`` 1 = latest.

    Each race row asks for run numbers prior_runs, prior_runs-1, ... (exploded into
    at most ``max_index`` probe rows) and gets them through an equi-join.
    """
    probes = (
        numbered.where(F.col("prior_runs") > 0)
        .select("race_id", key, "prior_runs")
        .withColumn("pp_index", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("prior_runs", F.lit(max_index).cast("bigint")))))
        .select("race_id", key, F.col("pp_index").cast("bigint").alias("pp_index"), (F.col("prior_runs") - F.col("pp_index") + 1).alias("_seq"))
    )
    hist = numbered.select(key, F.col("run_seq").alias("_seq"), *[F.col(s).alias(t) for s, t in PP_COLUMNS.items()])
    return probes.join(hist, [key, "_seq"], "inner").drop("_seq")


def _divide(*tables: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The tables' rows of light horses and those of heavy ones (none: an empty list).

    Rows are counted by a hash of the horse, which combines before its shuffle; all horses of
    a bucket with more than ``HEAVY_ROWS`` rows count as heavy, so there are at most rows /
    ``HEAVY_ROWS`` such buckets.
    """
    bucket = F.pmod(F.xxhash64(KEY), F.lit(_BUCKETS)).cast("int")
    counts = reduce(DataFrame.unionByName, [t.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n")) for t in tables])
    found = counts.groupBy("_b").agg(F.sum("_n").alias("_n")).where(F.col("_n") > HEAVY_ROWS).select("_b").collect()
    if not found:
        return list(tables), []
    heavy = bucket.isin([r["_b"] for r in found])
    return [t.where(~heavy) for t in tables], [t.where(heavy) for t in tables]


def _by_horse(rows: DataFrame, parts: int | None) -> DataFrame:
    """The one shuffle of a light lookup; ``_day`` numbers the race days."""
    return (rows.repartition(parts, KEY) if parts else rows.repartition(KEY)).withColumn("_day", F.unix_date(DATE))


def _with_recent(rows: DataFrame, max_index: int, kind: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``recent``: up to ``max_index`` runs of the horse on earlier days, latest first; ``_copies``
    and ``_copy``: how often the runner is there, and which of them a row is."""
    order = ["_day", ORDER, "race_id"]
    run = F.when(F.col("_day").isNotNull(), F.struct(*[F.col(s).alias(t) for s, t in PP_COLUMNS.items()]))
    before = Window.partitionBy(KEY, *kind).orderBy(*order).rowsBetween(-max_index, -1)
    # a day's first run has earlier days before it only; the day's others share its list
    first = Window.partitionBy(KEY, *kind, "_day").orderBy(ORDER, "race_id").rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(KEY, *kind, *order)
    rows = rows.select("*", F.collect_list(run).over(before).alias("_before"))
    rows = rows.select(*[c for c in rows.columns if c != "_before"], F.when(F.col("_day").isNotNull(), F.reverse(F.first("_before").over(first))).alias("recent"))
    return rows.select("*", F.count(F.lit(1)).over(same).alias("_copies"), F.row_number().over(same.orderBy(F.lit(0))).alias("_copy"))


def _with_last(rows: DataFrame, max_index: int, kind: tuple[str, ...] = ()) -> DataFrame:
    """Adds the values of the horse's last three runs on earlier days, a column each, so that those nobody
    reads are never shuffled; ``_n_recent``, how many of up to ``max_index`` runs there are; and ``_copies``."""
    order = ["_day", ORDER, "race_id"]
    known = F.col("_day").isNotNull()
    runs = Window.partitionBy(KEY, *kind).orderBy(*order)
    # a day's first run has earlier days before it only; the day's others share its values
    first = Window.partitionBy(KEY, *kind, "_day").orderBy(ORDER, "race_id").rowsBetween(Window.unboundedPreceding, 0)
    last = {_last(k, t): F.lag(F.when(known, F.col(s)), k).over(runs) for s, t in PP_COLUMNS.items() for k in (1, 2, 3)}
    last["_n_recent"] = F.count("_day").over(runs.rowsBetween(-max_index, -1))
    own = rows.columns
    rows = rows.select("*", *[c.alias(n) for n, c in last.items()])
    rows = rows.select(*own, *[F.when(known, F.first(n).over(first)).alias(n) for n in last])
    return rows.select("*", F.count(F.lit(1)).over(Window.partitionBy(KEY, *kind, *order)).alias("_copies"))


def _last(k: int, column: str) -> str:
    return f"_{column}_{k}"


def recent_runs(runs: DataFrame, max_index: int = 10, parts: int | None = None) -> DataFrame:
    """S4/W8 as a list: a row per (race, horse) with history, its ``recent`` runs on earlier days (latest first)
    and ``n_prior``, the rows that ``past_performances_asof`` has for it."""
    light, heavy = _divide(runs)
    rows = _with_recent(_by_horse(light[0], parts), max_index).where((F.col("_copy") == 1) & (F.size("recent") > 0))
    out = rows.select("race_id", KEY, "recent", (F.size("recent") * F.col("_copies")).alias("n_prior"))
    if heavy:
        pp = past_performances(number_runs(heavy[0]), max_index)
        item = F.struct("pp_index", F.struct(*PP_COLUMNS.values()).alias("run"))
        lists = pp.groupBy("race_id", KEY).agg(F.array_sort(F.collect_set(item)).alias("_l"), F.count(F.lit(1)).alias("n_prior"))
        out = out.unionByName(lists.select("race_id", KEY, F.transform("_l", lambda x: x["run"]).alias("recent"), "n_prior"))
    return out


def past_performances_asof(runs: DataFrame, max_index: int = 10, parts: int | None = None) -> DataFrame:
    """The rows of ``past_performances``, from one shuffle of the runs by horse."""
    light, heavy = _divide(runs)
    rows = _with_recent(_by_horse(light[0], parts), max_index).select("race_id", KEY, F.posexplode("recent").alias("_i", "_run"))
    out = rows.select("race_id", KEY, (F.col("_i") + 1).cast("bigint").alias("pp_index"), *[F.col("_run")[c].alias(c) for c in PP_COLUMNS.values()])
    return out.unionByName(past_performances(number_runs(heavy[0]), max_index)) if heavy else out


def _listed(k: int, column: str) -> F.Column:
    return F.get(F.col("recent"), F.lit(k - 1))[column]


def _recent_rollup(n_recent: F.Column, n_prior: F.Column, at: Callable[[int, str], F.Column] = _listed) -> list:
    """A1 of a runner's recent runs, as columns of its row; ``at`` gives a value of the k-th last."""
    figures = [at(k, "pp_speed_figure") for k in (1, 2, 3)]
    known = sum((f.isNotNull().cast("int") for f in figures[1:]), figures[0].isNotNull().cast("int"))
    total = sum((F.coalesce(f, F.lit(0.0)) for f in figures[1:]), F.coalesce(figures[0], F.lit(0.0)))
    cols = [f.alias(f"speed_fig_L{k}") for k, f in enumerate(figures, 1)]
    cols += [F.when(known > 0, total / known).alias("avg_speed_fig_L3"), F.greatest(*figures).alias("max_speed_fig_L3")]
    for src, dst in [
        ("pp_official_finish", "official_finish_L"),
        ("pp_num_starters", "num_starters_L"),
        ("pp_odds", "pp_odds_L"),
        ("pp_distance_yards", "distance_yards_L"),
    ]:
        cols += [at(k, src).alias(f"{dst}{k}") for k in (1, 2, 3)]
    return cols + [at(1, "pp_race_date").alias("last_pp_date"), F.when(n_recent > 0, n_prior).cast("bigint").alias("num_prior_starts"), at(1, "pp_surface").alias("pp_surface_L1")]


def _counted(runners: DataFrame) -> F.Column:
    """Whether a row is a start of its own: career totals leave rows out that are flagged not to be."""
    return F.col("counted") if "counted" in runners.columns else F.lit(True)


def _career_columns(counted: F.Column, kind: tuple[str, ...] = ()) -> list:
    """S7/F14 analogue as windows over rows dealt by horse."""
    fin = F.col("official_finish")
    parts = {"starts": F.lit(1), "wins": (fin == 1).cast("bigint"), "seconds": (fin == 2).cast("bigint"), "thirds": (fin == 3).cast("bigint")}
    out = []
    for name, keys in (("career", ()), ("surface", ("surface",))):
        w = Window.partitionBy(KEY, *kind, *keys).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
        known = F.col("_day").isNotNull() if not keys else F.col("_day").isNotNull() & F.col("surface").isNotNull()
        out += [F.when(known, F.coalesce(F.sum(F.when(counted, c)).over(w), F.lit(0))).cast("bigint").alias(f"{name}_{p}") for p, c in parts.items()]
        out.append(F.when(known, F.coalesce(F.sum(F.when(counted, F.col("earnings"))).over(w), F.lit(0))).cast("double").alias(f"{name}_earnings"))
    return out


def with_career(runners: DataFrame, parts: int | None = None) -> DataFrame:
    """The runners and their career-to-date totals; ``earnings`` and ``counted`` (if there) go."""
    light, heavy = _divide(runners)
    rows = _by_horse(light[0], parts)
    out = rows.select("*", *_career_columns(_counted(rows))).drop("_day")
    if heavy:
        out = out.unionByName(_career_by_key(heavy[0]))
    return out.drop("earnings", "counted")


def _career_by_key(runners: DataFrame) -> DataFrame:
    totals = career_to_date(runners.where(_counted(runners)).select("race_id", KEY, DATE, "surface", "official_finish", "earnings")).dropDuplicates(["race_id", KEY])
    return runners.join(totals, ["race_id", KEY], "left")


def _runs(runners: DataFrame) -> DataFrame:
    return runners.select("race_id", KEY, *PP_COLUMNS)


def with_history_by_key(runners: DataFrame, workouts: DataFrame, max_index: int = 10) -> DataFrame:
    """The rows of ``with_history`` by equi-joins: no horse is ever one group."""
    key = ["race_id", KEY]
    pp = rollup_past_performances(past_performances(number_runs(_runs(runners)), max_index))
    wk = workout_rollup_asof(runners.select(*key, DATE), workouts)
    return _career_by_key(runners).drop("earnings", "counted").join(pp, key, "left").join(wk, key, "left")


def with_history(runners: DataFrame, workouts: DataFrame, max_index: int = 10, parts: int | None = None) -> DataFrame:
    """Runners with career totals, A1 of their last runs, and A2: one shuffle by horse.

    ``earnings`` and ``counted`` (if there) go. A runner that is there m times and has workouts
    comes m times as often, as in the joins of ``with_history_by_key``.
    """
    light, heavy = _divide(runners, workouts)
    own = [c for c in runners.columns if c not in ("earnings", "counted")]
    flags = ["counted"] if "counted" in runners.columns else []
    wk, order = _workout_keys(light[1], "skip")
    moves = wk.select(KEY, F.col("workout_date").alias("_at"), F.struct(F.col("_pct").alias("pct"), *[c.alias(n) for n, c in order.items()]).alias("_wk"))
    both = light[0].withColumns({"_at": F.col(DATE), "_runner": F.lit(True)}).unionByName(moves.withColumn("_runner", F.lit(False)), allowMissingColumns=True)
    rows = _with_last(_by_horse(both, parts), max_index, ("_runner",))
    n_recent = F.col("_n_recent")
    rolled = _recent_rollup(n_recent, n_recent * F.col("_copies"), lambda k, c: F.col(_last(k, c)))
    rows = rows.select(*own, "earnings", *flags, "_day", "_at", "_wk", "_runner", "_copies", *rolled)
    rows = rows.select("*", *_career_columns(_counted(rows), ("_runner",))).drop("earnings", "_day", *flags)
    # a runner comes before the workouts of its day: only earlier ones count
    upto = Window.partitionBy(KEY).orderBy("_at", F.col("_runner").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "*",
        F.count_if(~F.col("_runner")).over(upto).alias("_n"),
        F.min("_wk.pct").over(upto).alias("_minpct"),
        F.min("_wk.best").over(upto).alias("_best"),
        F.max("_wk.last").over(upto).alias("_last"),
    ).where("_runner")
    has = F.col(DATE).isNotNull() & (F.col("_n") > 0)
    state = {
        "best_workout_rank_pct": F.col("_minpct"),
        "best_workout_group_size": F.col("_best.gs"),
        "last_workout_rank_pct": F.col("_last.pct"),
        "last_workout_group_size": F.col("_last.gs"),
        "num_workouts": F.col("_n").cast("bigint"),
        "last_workout_date": F.col("_last.d"),
    }
    history = [c for c in rows.columns if not c.startswith("_")]
    repeats = F.explode(F.array_repeat(F.lit(0), F.when(has, F.col("_copies")).otherwise(1).cast("int"))).alias("_")
    rows = rows.select(*history, *[F.when(has, c).alias(n) for n, c in state.items()], repeats).drop("_")
    return rows.unionByName(with_history_by_key(*heavy, max_index)) if heavy else rows


def dealt_with_history(rows: DataFrame, past: DataFrame, parts: int) -> DataFrame:
    """``rows`` dealt by race, each with what ``past`` has of its runner.

    ``past`` has the key and the history columns of what ``with_history`` gives for the same runners:
    a runner's rows are alike in it, and where they are k times those in ``rows``, its rows come k
    times as often. Only ``past`` was dealt by horse; ``rows`` are shuffled once, by race. Nulls in
    the key are a value like others.
    """
    key = ["race_id", KEY]
    new = [c for c in past.columns if c not in key]
    own = F.col("_own")
    both = rows.withColumn("_own", F.lit(True)).unionByName(past.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    runner = Window.partitionBy(*key)
    times = (F.count_if(~own).over(runner) / F.count_if(own).over(runner)).cast("int")
    found = [F.max(c).over(runner).alias(c) for c in new]
    both = both.repartition(parts, "race_id").select(*rows.columns, "_own", *found, times.alias("_times")).where(own)
    return both.select(*rows.columns, *new, F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_")).drop("_")


def with_workouts(probes: DataFrame, workouts: DataFrame, null_rank: str = "skip", parts: int | None = None) -> DataFrame:
    """A2: the rows of ``workout_rollup_asof``, from one shuffle of probes and workouts by horse."""
    light, heavy = _divide(probes, workouts)
    wk, order = _workout_keys(light[1], null_rank)
    moves = wk.select(KEY, F.col("workout_date").alias("_at"), F.struct(F.col("_pct").alias("pct"), *[c.alias(n) for n, c in order.items()]).alias("_wk"))
    both = light[0].select("race_id", KEY, F.col(DATE).alias("_at"), F.lit(True).alias("_runner"))
    both = both.unionByName(moves.withColumn("_runner", F.lit(False)), allowMissingColumns=True)
    both = both.repartition(parts, KEY) if parts else both.repartition(KEY)
    upto = Window.partitionBy(KEY).orderBy("_at", F.col("_runner").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.select(
        "race_id",
        KEY,
        "_runner",
        "_at",
        F.count("_wk").over(upto).alias("_n"),
        F.min("_wk.pct").over(upto).alias("best_workout_rank_pct"),
        F.min("_wk.best").over(upto).alias("_best"),
        F.max("_wk.last").over(upto).alias("_last"),
    ).where(F.col("_runner") & F.col("_at").isNotNull() & (F.col("_n") > 0))
    out = rows.select(
        "race_id",
        KEY,
        "best_workout_rank_pct",
        F.col("_best.gs").alias("best_workout_group_size"),
        F.col("_last.pct").alias("last_workout_rank_pct"),
        F.col("_last.gs").alias("last_workout_group_size"),
        F.col("_n").cast("bigint").alias("num_workouts"),
        F.col("_last.d").alias("last_workout_date"),
    )
    return out.unionByName(workout_rollup_asof(*heavy, null_rank=null_rank).select(*out.columns)) if heavy else out


def rollup_past_performances(pp: DataFrame) -> DataFrame:
    """A1: one row per (race, horse) with L1..L3 values, last-3 mean/max and count.

    A duplicated ``pp_index`` resolves to the largest value (deterministic). Lists of
    ``recent_runs`` are rolled up in their own rows, without a shuffle.
    """
    if "recent" in pp.columns:
        return pp.select("race_id", KEY, *_recent_rollup(F.size("recent"), F.col("n_prior")))

    def at(k: int, c: str) -> F.Column:
        return F.max(F.when(F.col("pp_index") == k, F.col(c)))

    recent = F.col("pp_index") <= 3
    aggs = [
        at(1, "pp_speed_figure").alias("speed_fig_L1"),
        at(2, "pp_speed_figure").alias("speed_fig_L2"),
        at(3, "pp_speed_figure").alias("speed_fig_L3"),
        F.avg(F.when(recent, F.col("pp_speed_figure"))).alias("avg_speed_fig_L3"),
        F.max(F.when(recent, F.col("pp_speed_figure"))).alias("max_speed_fig_L3"),
    ]
    for src, dst in [
        ("pp_official_finish", "official_finish_L"),
        ("pp_num_starters", "num_starters_L"),
        ("pp_odds", "pp_odds_L"),
        ("pp_distance_yards", "distance_yards_L"),
    ]:
        aggs += [at(k, src).alias(f"{dst}{k}") for k in (1, 2, 3)]
    aggs += [
        at(1, "pp_race_date").alias("last_pp_date"),
        F.count(F.lit(1)).cast("bigint").alias("num_prior_starts"),
    ]
    # every buffer above is fixed-width, so this is a hash aggregate with map-side
    # combining; the one text column (last surface) comes from the pp_index = 1 rows
    numeric = pp.groupBy("race_id", KEY).agg(*aggs)
    surface = pp.where(F.col("pp_index") == 1).groupBy("race_id", KEY).agg(F.max("pp_surface").alias("pp_surface_L1"))
    return numeric.join(surface, ["race_id", KEY], "left")


def rollup_from_runs(numbered: DataFrame, max_index: int = 10) -> DataFrame:
    """A1 without materialising all ``max_index`` history rows.

    Only the three latest prior runs are fetched; the count of history rows is
    ``least(prior_runs, max_index)`` by construction. Same result as
    ``rollup_past_performances(past_performances(numbered, max_index))``.
    """
    # the rollup, this join and the card's joins share one layout by (race, horse)
    rolled = rollup_past_performances(past_performances(numbered, max_index=min(3, max_index)))
    counts = numbered.where(F.col("prior_runs") > 0).select(
        "race_id", KEY, F.least("prior_runs", F.lit(max_index).cast("bigint")).alias("_n")
    )
    return rolled.join(counts, ["race_id", KEY], "inner").withColumn("num_prior_starts", F.col("_n")).drop("_n")


def derive_rollup_features(df: DataFrame) -> DataFrame:
    """Relative finish, speed trend, over-performance vs the market."""
    rel = {k: ieee_div(f"official_finish_L{k}", f"num_starters_L{k}") for k in (1, 2, 3)}
    df = df.select(
        "*",
        *[rel[k].alias(f"relative_finish_L{k}") for k in (1, 2, 3)],
        (F.col("speed_fig_L1") - F.col("avg_speed_fig_L3")).alias("speed_fig_trend"),
    )
    over = {
        k: (F.lit(1.0) - F.col(f"relative_finish_L{k}")) - ieee_div(F.lit(1.0), F.col(f"pp_odds_L{k}") + 1)
        for k in (1, 2, 3)
    }
    df = df.select(
        "*",
        ((F.col("relative_finish_L1") + F.col("relative_finish_L2") + F.col("relative_finish_L3")) / 3).alias(
            "avg_relative_finish"
        ),
        *[over[k].alias(f"pp_overperformance_L{k}") for k in (1, 2, 3)],
    )
    return df.withColumn(
        "pp_avg_overperformance_L3",
        (F.col("pp_overperformance_L1") + F.col("pp_overperformance_L2") + F.col("pp_overperformance_L3")) / 3,
    )


def career_to_date(runs: DataFrame, key: str = KEY, date: str = DATE) -> DataFrame:
    """S7/F14 analogue: starts, wins, 2nds, 3rds and earnings on strictly earlier days.

    Career totals run over all of a horse's days; surface totals over its days on
    the race's own surface. Both are prefix sums over a per-day table.
    """
    fin = F.col("official_finish")
    day_aggs = [
        F.count(F.lit(1)).alias("starts"),
        F.sum((fin == 1).cast("bigint")).alias("wins"),
        F.sum((fin == 2).cast("bigint")).alias("seconds"),
        F.sum((fin == 3).cast("bigint")).alias("thirds"),
        F.sum("earnings").alias("earn"),
    ]

    def prefix(keys: list[str], prefix_name: str) -> DataFrame:
        day = runs.groupBy(*keys, date).agg(*day_aggs)
        w = _prev_days(keys, date)
        cols = [F.coalesce(F.sum(c).over(w), F.lit(0)).cast("bigint").alias(f"{prefix_name}_{c}") for c in ("starts", "wins", "seconds", "thirds")]
        cols.append(F.coalesce(F.sum("earn").over(w), F.lit(0)).cast("double").alias(f"{prefix_name}_earnings"))
        return day.select(*keys, date, *cols)

    career = prefix([key], "career")
    surface = prefix([key, "surface"], "surface")
    probes = runs.select("race_id", key, date, "surface")
    out = probes.join(career, [key, date], "left").join(surface, [key, "surface", date], "left")
    return out.drop(date, "surface")


def _workout_keys(workouts: DataFrame, null_rank: str) -> tuple[DataFrame, dict]:
    """The workouts with their rank percentage, and what orders them by best and by last."""
    wk = workouts.withColumn("_pct", ieee_div("workout_ranking", "workout_num_in_group"))
    gs = F.col("workout_num_in_group")
    tb = [F.col("wk_key1"), F.col("wk_key2")]
    if null_rank == "reference":
        best_key = F.struct(F.col("_pct").isNotNull().alias("_nn"), F.col("_pct").alias("pct"), F.col("workout_date").alias("d"), *tb, gs.alias("gs"))
    elif null_rank == "skip":
        best_key = F.when(F.col("_pct").isNotNull(), F.struct(F.lit(True).alias("_nn"), F.col("_pct").alias("pct"), F.col("workout_date").alias("d"), *tb, gs.alias("gs")))
    else:
        raise ValueError(f"null_rank must be 'skip' or 'reference', got {null_rank!r}")
    last_key = F.struct(F.col("workout_date").alias("d"), *tb, F.col("_pct").alias("pct"), gs.alias("gs"))
    return wk, {"best": best_key, "last": last_key}


def workout_rollup_asof(
    probes: DataFrame,
    workouts: DataFrame,
    key: str = KEY,
    date: str = DATE,
    null_rank: str = "skip",
) -> DataFrame:
    """A2 as of each race: workouts of the horse strictly before the race date.

    Outputs best/last rank percentage, the group size at best and at last, the
    count and the last date. ``null_rank='reference'`` takes the group size at best
    from a null-rank workout when one exists (N4); ``'skip'`` ignores those.

    Workouts are first reduced to one row per (horse, day); probes (distinct
    horse-days of races) are interleaved with them and a running window carries
    count / min / max forward. A probe sorts before a workout of the same day,
    which makes the bound strict.
    """
    wk, order = _workout_keys(workouts, null_rank)
    best_key, last_key = order["best"], order["last"]
    wday = wk.groupBy(key, F.col("workout_date").alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_pct").alias("_minpct"),
        F.min(best_key).alias("_best"),
        F.max(last_key).alias("_last"),
        F.lit(1).alias("_kind"),
    )
    pday = probes.select(key, F.col(date).alias("_d")).distinct().select(
        key,
        "_d",
        F.lit(None).cast("bigint").alias("_n"),
        F.lit(None).cast("double").alias("_minpct"),
        F.lit(None).cast(wday.schema["_best"].dataType).alias("_best"),
        F.lit(None).cast(wday.schema["_last"].dataType).alias("_last"),
        F.lit(0).alias("_kind"),
    )
    u = wday.unionByName(pday)
    w = Window.partitionBy(key).orderBy("_d", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = u.select(
        key,
        "_d",
        "_kind",
        F.sum("_n").over(w).alias("_n"),
        F.min("_minpct").over(w).alias("_minpct"),
        F.min("_best").over(w).alias("_best"),
        F.max("_last").over(w).alias("_last"),
    ).where((F.col("_kind") == 0) & F.col("_n").isNotNull())
    state = state.select(
        key,
        F.col("_d").alias(date),
        F.col("_minpct").alias("best_workout_rank_pct"),
        F.col("_best.gs").alias("best_workout_group_size"),
        F.col("_last.pct").alias("last_workout_rank_pct"),
        F.col("_last.gs").alias("last_workout_group_size"),
        F.col("_n").cast("bigint").alias("num_workouts"),
        F.col("_last.d").alias("last_workout_date"),
    )
    return probes.select("race_id", key, date).join(state, [key, date], "inner").drop(date)
