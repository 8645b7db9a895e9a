"""Scores, per-race softmax and temperature calibration.

Temperature work never loops over rows on the driver: a whole grid of temperatures
is evaluated in one pass (one race window + one global aggregate), and the fit
refines the grid a few times around the best point.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import logit_clipped

RACE = "race_id"
EPS = 1e-12
# Temperature search bounds and tolerance.
T_SEARCH_BOUNDS = (0.1, 10.0)
T_XATOL = 1e-4

# Coefficients of the fixed linear scorer used where results must be reproducible
# by an independent SQL oracle (stands in for a trained model's margin output).
FIXED_SCORE_WEIGHTS = {
    "speed_fig_minus_field_avg_L1": 0.02,
    "entry_class_rating_minus_field_avg": 0.005,
}


def fixed_linear_score(df: DataFrame, out_col: str = "model_score", use_base_margin: bool = True) -> DataFrame:
    """X7 stand-in: base margin (logit of market prob) + fixed weights x features (nulls count 0)."""
    s = F.lit(0.0)
    for c, w in FIXED_SCORE_WEIGHTS.items():
        s = s + F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    if use_base_margin:
        s = s + logit_clipped("market_prob")
    return df.withColumn(out_col, s)


def per_race_softmax(df: DataFrame, score_col: str, out_col: str, temperature: float = 1.0, race: str = RACE) -> DataFrame:
    """Stable softmax of score / T within each race; other columns are kept."""
    w = Window.partitionBy(race)
    scaled = F.col(score_col) / F.lit(float(temperature))
    e = F.exp(scaled - F.max(scaled).over(w))
    return df.withColumn(out_col, e).withColumn(out_col, F.col(out_col) / F.sum(out_col).over(w))


def winner_races(df: DataFrame, race: str = RACE) -> DataFrame:
    """P5: keep races whose maximum ``won`` is 1."""
    return df.withColumn("_race_won", F.max("won").over(Window.partitionBy(race))).where(F.col("_race_won") == 1).drop("_race_won")


def log_loss_grid(df: DataFrame, temps: list[float], score_col: str = "model_score", race: str = RACE) -> DataFrame:
    """Winner log-loss of softmax(score / T) for every T of a grid, in one pass.

    Per race one window computes the max score and, for each T, the partition sum;
    winner rows then feed one global aggregate. Returns rows (T, log_loss).
    """
    w = Window.partitionBy(race)
    s = F.col(score_col)
    m = F.max(s).over(w)
    cols = [F.col(race), F.col("won"), (s - m).alias("_d")]
    for i, t in enumerate(temps):
        cols.append(F.sum(F.exp((s - m) / F.lit(float(t)))).over(w).alias(f"_z{i}"))
    per_row = df.select(*cols).where(F.col("won") == 1)
    losses = []
    for i, t in enumerate(temps):
        p = F.exp(F.col("_d") / F.lit(float(t))) / F.col(f"_z{i}")
        losses.append(F.avg(-F.log(F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0)))).alias(f"_l{i}"))
    agg = per_row.agg(*losses)
    stack = ", ".join(f"{float(t)!r}D, _l{i}" for i, t in enumerate(temps))
    return agg.selectExpr(f"stack({len(temps)}, {stack}) as (T, log_loss)")


def fit_temperature(
    df: DataFrame,
    score_col: str = "model_score",
    bounds: tuple[float, float] = T_SEARCH_BOUNDS,
    grid_points: int = 17,
    xatol: float = T_XATOL,
    race: str = RACE,
) -> float:
    """T in ``bounds`` minimising winner log-loss (races with a winner only).

    A log-spaced grid is evaluated in one Spark pass; the bracket around the best
    point becomes the next grid until its width is below ``xatol``. Only the grid's
    losses (a handful of scalars) reach the driver.
    """
    scored = winner_races(df.select(race, "won", score_col), race).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lo, hi = bounds
        log_space = True
        best = 1.0
        for _ in range(12):
            if log_space:
                grid = [math.exp(math.log(lo) + (math.log(hi) - math.log(lo)) * i / (grid_points - 1)) for i in range(grid_points)]
            else:
                grid = [lo + (hi - lo) * i / (grid_points - 1) for i in range(grid_points)]
            rows = log_loss_grid(scored, grid, score_col, race).collect()
            losses = [(r["log_loss"] if r["log_loss"] is not None else math.inf) for r in rows]
            j = min(range(len(grid)), key=lambda k: (losses[k], grid[k]))
            best = grid[j]
            lo, hi = grid[max(j - 1, 0)], grid[min(j + 1, len(grid) - 1)]
            log_space = False
            if hi - lo < xatol:
                break
        return float(best)
    finally:
        scored.unpersist()


def log_loss_at(df: DataFrame, temperature: float, score_col: str = "model_score", race: str = RACE) -> DataFrame:
    """One-row winner log-loss at a given temperature."""
    return log_loss_grid(winner_races(df, race), [temperature], score_col, race)
