"""Registered queries (Spark) and their independent SQL oracles.

Every query reads the given tables (through the fixture views) over their whole
extent; no key subsets or row caps. Each entry pairs a Spark builder
``(spark, sf_dir) -> DataFrame`` with an oracle SQL string (or none, for the
operators with no SQL equivalent, which get a row-count check).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import betting, evaluation, features, history, scoring
from ..operators.features import FEATURE_NAMES
from . import oracle as O
from .pipeline import SCORING_COLUMNS, Pipeline
from .types import finish, select_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


# --------------------------------------------------------------------------- column lists

ROI_COLS = ["n_bets", "total_staked", "total_return", "profit", "roi", "hit_rate", "avg_ev"]

CARD_COLS = [
    "race_id", "race_date", "track", "race_number", "horse_name", "post_position", "official_finish", "dollar_odds",
    "morning_line_odds_float", "field_size", "won", "course_desc", "surface", "distance_yards", "race_class_rating",
    "entry_class_rating", "weight_carried", "purse", "sex", "year_of_birth", "age_restriction", "sex_restriction",
    "career_starts", "career_wins", "career_seconds", "career_thirds", "career_earnings",
    "surface_starts", "surface_wins", "surface_seconds", "surface_thirds",
]

PP_COLS = [
    "race_id", "horse_name", "pp_index", "pp_race_date", "pp_race_number", "pp_track", "pp_speed_figure",
    "pp_official_finish", "pp_num_starters", "pp_odds", "pp_distance_yards", "pp_surface",
]

PP_ROLLUP_COLS = [
    "race_id", "horse_name", "speed_fig_L1", "speed_fig_L2", "speed_fig_L3", "avg_speed_fig_L3", "max_speed_fig_L3",
    "official_finish_L1", "official_finish_L2", "official_finish_L3", "num_starters_L1", "num_starters_L2",
    "num_starters_L3", "pp_odds_L1", "pp_odds_L2", "pp_odds_L3", "distance_yards_L1", "distance_yards_L2",
    "distance_yards_L3", "pp_surface_L1", "last_pp_date", "num_prior_starts", "relative_finish_L1",
    "relative_finish_L2", "relative_finish_L3", "avg_relative_finish", "speed_fig_trend", "pp_overperformance_L1",
    "pp_overperformance_L2", "pp_overperformance_L3", "pp_avg_overperformance_L3",
]

WORKOUT_COLS = [
    "race_id", "horse_name", "best_workout_rank_pct", "best_workout_group_size", "last_workout_rank_pct",
    "last_workout_group_size", "num_workouts", "last_workout_date",
]

DERIVED_COLS = ["race_id", "horse_name", "won"] + features.FEATURE_NAMES

# --------------------------------------------------------------------------- minimal slice


@register(
    "favorite_roi",
    O.with_(O.RACES, O.LINE1, O.BASE, O.FINAL_ODDS)
    + """, fav AS (
      SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY market_prob DESC, post_position, horse_name) AS pick
      FROM final_odds_w)
    """
    + select_sql(
        ROI_COLS,
        """(SELECT count(*) AS n_bets, coalesce(sum(2.0), 0.0) AS total_staked,
                  coalesce(sum(won * 2.0 * (dollar_odds + 1)), 0.0) AS total_return,
                  coalesce(sum(won * 2.0 * (dollar_odds + 1)), 0.0) - coalesce(sum(2.0), 0.0) AS profit,
                  CASE WHEN coalesce(sum(2.0), 0.0) = 0 THEN 0.0
                       ELSE (coalesce(sum(won * 2.0 * (dollar_odds + 1)), 0.0) - sum(2.0)) / sum(2.0) END AS roi,
                  coalesce(avg(won), 0.0) AS hit_rate,
                  coalesce(avg(market_prob * (dollar_odds + 1) - 1), 0.0) AS avg_ev
           FROM fav WHERE pick = 1)""",
    ),
)
def favorite_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROI of backing the final-odds favourite of every race."""
    df = Pipeline(spark, sf_dir).final_odds_frame
    df = betting.with_expected_value(df, prob="market_prob")
    bets = betting.apply_bet_rule(df, "favorite")
    return finish(betting.summarize_roi(bets), ROI_COLS)


@register(
    "race_results_card",
    O.with_(O.RACES, O.LINE1, O.BASE, O.CAREER)
    + select_sql(
        CARD_COLS,
        """(SELECT b.*, c.* EXCLUDE (race_id, horse_name), b.num_runners AS field_size,
                  CAST(b.official_finish = 1 AS INTEGER) AS won
           FROM base b JOIN career c USING (race_id, horse_name)
           WHERE b.course_desc NOT IN ('Hurdle', 'Downhill turf', 'Timber') AND b.dollar_odds > 0)""",
    ),
)
def race_results_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results x entries, excluded courses and zero odds dropped."""
    p = Pipeline(spark, sf_dir)
    from ..operators import card as card_ops

    df = (
        card_ops.race_rows(p.results)
        .join(card_ops.entry_rows(p.entries), ["race_id", "horse_name"], "inner")
        .where(F.col("dollar_odds") > 0)
        .withColumn("field_size", F.col("num_runners"))
        .withColumn("won", (F.col("official_finish") == 1).cast("int"))
    )
    return finish(df, CARD_COLS)


@register("pp_recency_index", O.with_(O.RACES, O.LINE1, O.BASE, O.PP) + select_sql(PP_COLS, "pp"))
def pp_recency_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 10 prior runs per runner, newest first."""
    return finish(Pipeline(spark, sf_dir).past_performances(10), PP_COLS)


@register("pp_rollup", O.with_(O.RACES, O.LINE1, O.BASE, O.PP, O.PP_ROLL, O.PP_FEATS) + select_sql(PP_ROLLUP_COLS, "pp_feats"))
def pp_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 D14 D15 D16 over the full 10-row history, a list in each runner's row."""
    p = Pipeline(spark, sf_dir)
    rolled = history.derive_rollup_features(history.rollup_past_performances(p.recent_runs(10)))
    return finish(rolled, PP_ROLLUP_COLS)


@register("workout_rollup", O.with_(O.RACES, O.LINE1, O.BASE, O.WORKOUTS) + select_sql(WORKOUT_COLS, "wk_feats"))
def workout_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: workouts strictly before each race, rolled up per runner."""
    return finish(Pipeline(spark, sf_dir).workout_features(), WORKOUT_COLS)


@register("derived_features", O.with_(*O.MODEL_CTES) + select_sql(DERIVED_COLS, "derived"))
def derived_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D13 W1-W3 over the full card (live odds = morning line)."""
    return finish(Pipeline(spark, sf_dir).built_features, DERIVED_COLS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# --------------------------------------------------------------------------- model-side queries
# The score is the fixed linear scorer (scoring.FIXED_SCORE_WEIGHTS) so every number
# below has an exact SQL oracle; MLlib-trained scorers plug into the same column.

ENRICHED = O.with_(*O.MODEL_CTES, O.enriched_cte(1.0))
KEY = ["race_id", "horse_name"]


def _enriched(spark: SparkSession, sf_dir: str, temperature: float = 1.0) -> DataFrame:
    return Pipeline(spark, sf_dir).enriched(temperature)


MP_COLS = KEY + ["live_odds", "dollar_odds", "market_prob_live", "market_prob_final", "base_margin"]


@register(
    "market_prob",
    O.with_(*O.MODEL_CTES)
    + select_sql(
        MP_COLS,
        """(SELECT race_id, horse_name, live_odds, dollar_odds, market_prob AS market_prob_live,
                  (1.0 / (dollar_odds + 1)) / sum(1.0 / (dollar_odds + 1)) OVER (PARTITION BY race_id) AS market_prob_final,
                  ln(least(greatest(market_prob, 1e-4), 1 - 1e-4) / (1 - least(greatest(market_prob, 1e-4), 1 - 1e-4))) AS base_margin
           FROM derived)""",
    ),
)
def market_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live-odds and final-odds market probabilities and the clipped logit."""
    from ..functions.columns import logit_clipped

    d = Pipeline(spark, sf_dir).for_scoring.withColumnRenamed("market_prob", "market_prob_live")
    d = features.market_prob_from(d, "dollar_odds", "market_prob_final")
    return finish(d.withColumn("base_margin", logit_clipped("market_prob_live")), MP_COLS)


SOFTMAX_COLS = KEY + ["model_score", "model_prob"]


@register(
    "softmax_by_race",
    O.with_(*O.MODEL_CTES)
    + select_sql(
        SOFTMAX_COLS,
        """(SELECT race_id, horse_name, model_score,
                  exp(model_score / 0.7) / sum(exp(model_score / 0.7)) OVER (PARTITION BY race_id) AS model_prob
           FROM scored)""",
    ),
)
def softmax_by_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-race softmax of the score at T = 0.7."""
    s = scoring.per_race_softmax(Pipeline(spark, sf_dir).scored, "model_score", "model_prob", temperature=0.7)
    return finish(s, SOFTMAX_COLS)


EV_COLS = KEY + ["won", "dollar_odds", "model_prob", "market_prob", "decimal_odds", "ev_per_dollar"]


@register("ev_table", ENRICHED + select_sql(EV_COLS, "enriched"))
def ev_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 B1: enriched rows (races with a winner) with decimal odds and EV per dollar."""
    return finish(_enriched(spark, sf_dir), EV_COLS)


BET_COLS = KEY + ["won", "stake", "payout", "ev_per_dollar"]

_RULE_SQL = {
    "ev_threshold": "SELECT * FROM elig WHERE ev_per_dollar > 0.1",
    "top_ev_per_race": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY ev_per_dollar DESC, post_position, horse_name) AS k FROM elig WHERE ev_per_dollar IS NOT NULL) WHERE k = 1 AND ev_per_dollar > 0.0",
    "top_model_per_race": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY model_prob DESC, post_position, horse_name) AS k FROM elig WHERE model_prob IS NOT NULL) WHERE k = 1",
    "favorite": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY market_prob DESC, post_position, horse_name) AS k FROM elig WHERE market_prob IS NOT NULL) WHERE k = 1",
    "ml_favorite": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY morning_line_odds_float ASC, post_position, horse_name) AS k FROM elig WHERE morning_line_odds_float IS NOT NULL) WHERE k = 1",
    "top_speed_fig": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY speed_fig_L1 DESC, post_position, horse_name) AS k FROM elig WHERE speed_fig_L1 IS NOT NULL) WHERE k = 1",
}
_RULE_THRESHOLD = {"ev_threshold": 0.1, "top_ev_per_race": 0.0}


def _bets_query(rule: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        bets = betting.apply_bet_rule(_enriched(spark, sf_dir), rule, ev_threshold=_RULE_THRESHOLD.get(rule, 0.0))
        return finish(bets, BET_COLS)

    q.__doc__ = f"B2-B8: bets placed by rule {rule!r} with stake and payout."
    return q


for _rule, _sql in _RULE_SQL.items():
    register(
        f"bets_{_rule}",
        ENRICHED
        + ", elig AS (SELECT * FROM enriched WHERE dollar_odds > 0), bets AS ("
        + _sql
        + ") "
        + select_sql(BET_COLS, "(SELECT *, 2.0 AS stake, won * 2.0 * decimal_odds AS payout FROM bets)"),
    )(_bets_query(_rule))


ROI_RULE_COLS = ["split", "rule", "rule_order"] + ROI_COLS


def _split_cte(mode: str = "chronological") -> str:
    assert mode == "chronological"
    return """
race_order AS (
  SELECT race_id, min(race_date) AS first_date FROM raw GROUP BY race_id
),
race_rank AS (
  SELECT race_id, first_date, row_number() OVER (ORDER BY first_date, race_id) AS rank, count(*) OVER () AS n
  FROM race_order
),
race_split AS (
  SELECT race_id, first_date, rank,
         CASE WHEN rank <= n - CAST(floor(n * 0.15) AS BIGINT) * 2 THEN 'train'
              WHEN rank <= n - CAST(floor(n * 0.15) AS BIGINT) THEN 'val' ELSE 'test' END AS split
  FROM race_rank
)"""


def _rule_union_sql() -> str:
    parts = []
    for i, cfg in enumerate(betting.ROI_RULES):
        rule, thr = cfg["rule"], cfg.get("ev_threshold", 0.0)
        label = betting.rule_label(cfg).replace("'", "''")
        sql = _RULE_SQL[rule].replace("ev_per_dollar > 0.1", f"ev_per_dollar > {thr}").replace("ev_per_dollar > 0.0", f"ev_per_dollar > {thr}")
        parts.append(f"SELECT split, '{label}' AS rule, {i} AS rule_order, won, decimal_odds, ev_per_dollar FROM ({sql})")
    return " UNION ALL ".join(parts)


ROI_ALL_SQL = (
    O.with_(*O.MODEL_CTES, O.enriched_cte(1.0), _split_cte())
    + ", elig AS (SELECT e.*, s.split FROM enriched e JOIN race_split s USING (race_id) WHERE dollar_odds > 0)"
    + ", picks AS (" + _rule_union_sql() + ")"
    + ", labels AS (SELECT DISTINCT split, p.rule, p.rule_order FROM race_split, (SELECT DISTINCT rule, rule_order FROM picks UNION SELECT * FROM (VALUES "
    + ", ".join(f"('{betting.rule_label(c)}', {i})" for i, c in enumerate(betting.ROI_RULES))
    + ") v(rule, rule_order)) p WHERE split IN (SELECT split FROM elig))"
    + """, agg AS (
      SELECT split, rule, count(*) AS n_bets, sum(2.0) AS total_staked, sum(won * 2.0 * decimal_odds) AS total_return,
             avg(won) AS hit_rate, avg(ev_per_dollar) AS avg_ev
      FROM picks GROUP BY split, rule)
    """
    + select_sql(
        ROI_RULE_COLS,
        """(SELECT l.split, l.rule, l.rule_order, coalesce(a.n_bets, 0) AS n_bets,
                  coalesce(a.total_staked, 0.0) AS total_staked, coalesce(a.total_return, 0.0) AS total_return,
                  coalesce(a.total_return - a.total_staked, 0.0) AS profit,
                  CASE WHEN coalesce(a.total_staked, 0) = 0 THEN 0.0 ELSE (a.total_return - a.total_staked) / a.total_staked END AS roi,
                  coalesce(a.hit_rate, 0.0) AS hit_rate, coalesce(a.avg_ev, 0.0) AS avg_ev
           FROM labels l LEFT JOIN agg a USING (split, rule))""",
    )
)


@register("roi_all_rules", ROI_ALL_SQL)
def roi_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROI of the seven standard rules per chronological split, one pass."""
    from ..operators import split as split_ops

    p = Pipeline(spark, sf_dir)
    enriched = split_ops.split_by_race(p.enriched(), labels_from=p.card_races)
    return finish(betting.roi_all_rules(enriched, ["split"]), ROI_RULE_COLS, {"rule_order": "b"})


SPLIT_COLS = ["race_id", "first_date", "rank", "split"]


@register("split_chronological", O.with_(*O.MODEL_CTES, _split_cte()) + select_sql(SPLIT_COLS, "race_split"))
def split_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races by (first date, id); earliest 70 % train, next 15 % val, last 15 % test."""
    from ..operators import split as split_ops

    labels = split_ops.race_split_labels(Pipeline(spark, sf_dir).card_races).withColumnRenamed("race_date", "first_date")
    return finish(labels, SPLIT_COLS)


@register(
    "split_random_sizes",
    O.with_(*O.MODEL_CTES)
    + """, n AS (SELECT count(DISTINCT race_id) AS n FROM raw)
    SELECT split, CAST(n_races AS BIGINT) AS n_races FROM (
      SELECT 'test' AS split, CAST(floor(n * 0.15) AS BIGINT) AS n_races FROM n
      UNION ALL SELECT 'val', CAST(floor(n * 0.15) AS BIGINT) FROM n
      UNION ALL SELECT 'train', n - 2 * CAST(floor(n * 0.15) AS BIGINT) FROM n)""",
)
def split_random_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded random split; sizes equal the reference's (membership differs by design)."""
    from ..operators import split as split_ops

    labels = split_ops.race_split_labels(Pipeline(spark, sf_dir).card_races, mode="random", seed=0)
    return finish(labels.groupBy("split").agg(F.count(F.lit(1)).alias("n_races")), ["split", "n_races"])


RANDOM_COLS = ["race_id", "rank", "split"]


@register(
    "split_random",
    O.with_(*O.MODEL_CTES)
    + """, shuffled AS (
      SELECT race_id, row_number() OVER (ORDER BY md5('0|' || race_id), race_id) AS rank, count(*) OVER () AS n
      FROM (SELECT DISTINCT race_id FROM raw))"""
    + select_sql(
        RANDOM_COLS,
        """(SELECT race_id, rank, CASE WHEN rank <= CAST(floor(n * 0.15) AS BIGINT) THEN 'test'
                  WHEN rank <= CAST(floor(n * 0.15) AS BIGINT) * 2 THEN 'val' ELSE 'train' END AS split FROM shuffled)""",
    ),
)
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every race with its place in the seeded order and its label."""
    from ..operators import split as split_ops

    return finish(split_ops.race_split_labels(Pipeline(spark, sf_dir).card_races, mode="random", seed=0), RANDOM_COLS)


METRIC_COLS = [
    "split", "n_races", "n_rows", "model_log_loss", "market_log_loss", "uniform_log_loss", "model_top1_acc",
    "favorite_top1_acc", "model_prob_sum_mean",
]

_TOP1_SQL = """
(SELECT race_id, won FROM (SELECT race_id, won, row_number() OVER (PARTITION BY race_id ORDER BY {p} DESC, post_position, horse_name) AS k FROM es) WHERE k = 1)"""


@register(
    "metrics_by_split",
    O.with_(*O.MODEL_CTES, O.enriched_cte(1.0), _split_cte())
    + ", es AS (SELECT e.*, s.split FROM enriched e JOIN race_split s USING (race_id))"
    + ", per_race AS (SELECT split, race_id, count(*) AS n, sum(model_prob) AS s FROM es GROUP BY split, race_id)"
    + f", tm AS {_TOP1_SQL.format(p='model_prob')}, tk AS {_TOP1_SQL.format(p='market_prob')}"
    + select_sql(
        METRIC_COLS,
        """(SELECT pr.split, count(*) AS n_races, sum(pr.n) AS n_rows,
                  (SELECT avg(-ln(least(greatest(model_prob, 1e-12), 1.0))) FROM es WHERE es.won = 1 AND es.split = pr.split) AS model_log_loss,
                  (SELECT avg(-ln(least(greatest(market_prob, 1e-12), 1.0))) FROM es WHERE es.won = 1 AND es.split = pr.split) AS market_log_loss,
                  avg(ln(pr.n)) AS uniform_log_loss,
                  avg(tm.won) AS model_top1_acc, avg(tk.won) AS favorite_top1_acc, avg(pr.s) AS model_prob_sum_mean
           FROM per_race pr JOIN tm USING (race_id) JOIN tk USING (race_id) GROUP BY pr.split)""",
    ),
)
def metrics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split winner log-loss (model, market, uniform), top-1 accuracy, mean prob mass."""
    from ..operators import split as split_ops

    p = Pipeline(spark, sf_dir)
    return finish(evaluation.metrics_by_split(split_ops.split_by_race(p.enriched(), labels_from=p.card_races)), METRIC_COLS)


ENT_COLS = ["model_entropy_mean", "market_entropy_mean", "delta_mean", "n_races"]
_ENT_RACE = """
(SELECT race_id,
        sum(-model_prob * ln(least(greatest(model_prob, 1e-12), 1.0))) AS me,
        sum(-market_prob * ln(least(greatest(market_prob, 1e-12), 1.0))) AS ke,
        max(model_prob) AS fm, max(market_prob) AS fk, any_value(field_size) AS field_size
 FROM enriched GROUP BY race_id)"""


@register(
    "entropy_summary",
    ENRICHED
    + select_sql(ENT_COLS, f"(SELECT avg(me) AS model_entropy_mean, avg(ke) AS market_entropy_mean, avg(me - ke) AS delta_mean, count(*) AS n_races FROM {_ENT_RACE})"),
)
def entropy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean per-race entropy of model and market probabilities."""
    return finish(evaluation.entropy_summary(_enriched(spark, sf_dir)), ENT_COLS)


@register(
    "favorite_prob",
    ENRICHED + select_sql(["race_id", "entropy", "favorite_prob"], f"(SELECT race_id, me AS entropy, fm AS favorite_prob FROM {_ENT_RACE})"),
)
def favorite_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-race model entropy and favourite probability."""
    e = _enriched(spark, sf_dir)
    out = evaluation.per_race_entropy(e, "model_prob").join(evaluation.per_race_favorite_prob(e, "model_prob"), "race_id")
    return finish(out, ["race_id", "entropy", "favorite_prob"])


REL_COLS = ["bin_ord", "bin_label", "mean_pred", "empirical_rate", "count", "wins", "ci_lo", "ci_hi"]


def _reliability_sql(where: str = "") -> str:
    edges = evaluation.DEFAULT_RELIABILITY_EDGES
    labels = evaluation.reliability_labels(edges)
    case = "CASE " + " ".join(f"WHEN model_prob <= {e} THEN {i}" for i, e in enumerate(edges[1:-1])) + f" ELSE {len(edges) - 2} END"
    lab = "CASE b " + " ".join(f"WHEN {i} THEN '{l}'" for i, l in enumerate(labels)) + " END"
    return (
        ENRICHED
        + f", binned AS (SELECT *, {case} AS b FROM enriched {where})"
        + f", agg AS (SELECT b, avg(model_prob) AS mean_pred, avg(won) AS empirical_rate, count(*) AS count, sum(won) AS wins FROM binned GROUP BY b)"
        + select_sql(
            REL_COLS,
            f"""(SELECT b AS bin_ord, {lab} AS bin_label, mean_pred, empirical_rate, count, wins,
                       (wins + 1.96 * 1.96 / 2) / (count + 1.96 * 1.96) - (1.96 / (count + 1.96 * 1.96)) * sqrt(wins * (count - wins) / count + 1.96 * 1.96 / 4) AS ci_lo,
                       (wins + 1.96 * 1.96 / 2) / (count + 1.96 * 1.96) + (1.96 / (count + 1.96 * 1.96)) * sqrt(wins * (count - wins) / count + 1.96 * 1.96 / 4) AS ci_hi
                FROM agg)""",
            {"bin_label": "s"},
        )
    )


@register("reliability", _reliability_sql())
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability bins (right-closed) with Wilson 95 % intervals."""
    t = evaluation.reliability_table(_enriched(spark, sf_dir)).withColumnRenamed("bin", "bin_label")
    return finish(t, REL_COLS, {"bin_label": "s"})


@register("reliability_conditional", _reliability_sql("WHERE ev_per_dollar > 0"))
def reliability_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability restricted to positive-EV rows (a caller predicate)."""
    t = evaluation.conditional_reliability_table(_enriched(spark, sf_dir), F.col("ev_per_dollar") > 0).withColumnRenamed("bin", "bin_label")
    return finish(t, REL_COLS, {"bin_label": "s"})


@register(
    "brier",
    ENRICHED + select_sql(["model_brier", "market_brier"], "(SELECT avg(pow(model_prob - won, 2)) AS model_brier, avg(pow(market_prob - won, 2)) AS market_brier FROM enriched)"),
)
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score of model and market probabilities."""
    out = evaluation.brier_scores(_enriched(spark, sf_dir), {"model_brier": "model_prob", "market_brier": "market_prob"})
    return finish(out, ["model_brier", "market_brier"])


ODDS_COLS = [
    "bucket_ord", "odds_bucket", "n", "mean_model_prob", "mean_market_prob", "win_rate", "mean_ev", "n_positive_ev",
    "pos_ev_hit_rate", "pos_ev_roi",
]


def _odds_bucket_sql() -> str:
    case = "CASE " + " ".join(f"WHEN dollar_odds <= {e} THEN {i}" for i, e in enumerate(evaluation.ODDS_EDGES)) + f" ELSE {len(evaluation.ODDS_EDGES)} END"
    lab = "CASE b " + " ".join(f"WHEN {i} THEN '{l}'" for i, l in enumerate(evaluation.ODDS_LABELS)) + " END"
    return (
        ENRICHED
        + f", binned AS (SELECT *, {case} AS b FROM enriched)"
        + """, base_t AS (SELECT b, count(*) AS n, avg(model_prob) AS mean_model_prob, avg(market_prob) AS mean_market_prob,
                  avg(won) AS win_rate, avg(ev_per_dollar) AS mean_ev, count(*) FILTER (WHERE ev_per_dollar > 0) AS n_positive_ev
                FROM binned GROUP BY b)
           , pos AS (SELECT b, avg(won) AS hit, (sum(won * 2.0 * decimal_odds) - sum(2.0)) / sum(2.0) AS roi
                FROM binned WHERE ev_per_dollar > 0 GROUP BY b)
        """
        + select_sql(
            ODDS_COLS,
            f"""(SELECT t.b AS bucket_ord, {lab.replace('CASE b', 'CASE t.b')} AS odds_bucket, n, mean_model_prob, mean_market_prob, win_rate, mean_ev, n_positive_ev,
                       CASE WHEN (SELECT count(*) FROM pos) = 0 THEN 0.0 ELSE p.hit END AS pos_ev_hit_rate,
                       CASE WHEN (SELECT count(*) FROM pos) = 0 THEN 0.0 ELSE p.roi END AS pos_ev_roi
                FROM base_t t LEFT JOIN pos p ON p.b = t.b)""",
        )
    )


@register("odds_buckets", _odds_bucket_sql())
def odds_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds-bucket table with the positive-EV rows' hit rate and ROI."""
    return finish(evaluation.odds_bucket_table(_enriched(spark, sf_dir)), ODDS_COLS)


FIELD_COLS = ["bucket_ord", "field_bucket", "n_races", "entropy_gap", "favorite_gap", "log_loss_gap"]


def _field_bucket_sql() -> str:
    case = "CASE " + " ".join(f"WHEN field_size <= {e} THEN {i}" for i, e in enumerate(evaluation.FIELD_EDGES)) + f" ELSE {len(evaluation.FIELD_EDGES)} END"
    lab = "CASE b " + " ".join(f"WHEN {i} THEN '{l}'" for i, l in enumerate(evaluation.FIELD_LABELS)) + " END"
    return (
        ENRICHED
        + f", pr AS (SELECT *, {case} AS b FROM {_ENT_RACE})"
        + """, wl AS (SELECT race_id, -ln(least(greatest(model_prob, 1e-12), 1.0)) AS llm, -ln(least(greatest(market_prob, 1e-12), 1.0)) AS llk
                      FROM enriched WHERE won = 1)"""
        + select_sql(
            FIELD_COLS,
            f"""(SELECT b AS bucket_ord, {lab} AS field_bucket, count(*) AS n_races, avg(me - ke) AS entropy_gap,
                       avg(fm - fk) AS favorite_gap, avg(llm - llk) AS log_loss_gap
                FROM pr LEFT JOIN wl USING (race_id) GROUP BY b)""",
        )
    )


@register("field_size_buckets", _field_bucket_sql())
def field_size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field-size table from one race-level rollup (no self-joins)."""
    return finish(evaluation.field_size_bucket_table(_enriched(spark, sf_dir)), FIELD_COLS)


SWEEP_TEMPS = [0.5, 0.75, 1.0, 1.25, 1.5, 2.0]


@register(
    "temperature_sweep",
    O.with_(*O.MODEL_CTES)
    + ", w AS (SELECT * FROM scored WHERE race_id IN (SELECT race_id FROM scored WHERE won = 1))"
    + ", temps AS (SELECT * FROM (VALUES " + ", ".join(f"({t})" for t in SWEEP_TEMPS) + ") v(T))"
    + """, p0 AS (SELECT temps.T, w.race_id, w.won,
                exp(w.model_score / temps.T - max(w.model_score / temps.T) OVER (PARTITION BY temps.T, w.race_id)) AS e
              FROM w, temps)
         , p AS (SELECT T, won, e / sum(e) OVER (PARTITION BY T, race_id) AS prob FROM p0)"""
    + select_sql(["T", "log_loss"], "(SELECT T, avg(-ln(least(greatest(prob, 1e-12), 1.0))) AS log_loss FROM p WHERE won = 1 GROUP BY T)"),
)
def temperature_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner log-loss at each temperature of a list, all in one pass."""
    s = scoring.winner_races(Pipeline(spark, sf_dir).scored)
    return finish(scoring.log_loss_grid(s, SWEEP_TEMPS), ["T", "log_loss"])


def _temperature_fit_sql(points: int = 17, rounds: int = 12) -> str:
    """The grid's refinement, a round after the other; a round after the end changes nothing."""
    lo, hi = scoring.T_SEARCH_BOUNDS
    ctes = ["w AS MATERIALIZED (SELECT race_id, won, model_score AS s FROM scored WHERE race_id IN (SELECT race_id FROM scored WHERE won = 1))"]
    ctes.append(f"b0 AS (SELECT {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi, 1.0::DOUBLE AS best, false AS done)")
    for k in range(rounds):
        at = f"exp(ln(lo) + (ln(hi) - ln(lo)) * i / {points - 1})" if k == 0 else f"lo + (hi - lo) * i / {points - 1}"
        ctes.append(f"g{k} AS MATERIALIZED (SELECT i, {at} AS t FROM b{k}, range({points}) r(i) WHERE NOT done)")
        ctes.append(f"""l{k} AS MATERIALIZED (
          SELECT i, t, avg(-ln(least(greatest(e / z, 1e-12), 1.0))) FILTER (WHERE won = 1) AS loss
          FROM (SELECT i, t, won, e, sum(e) OVER (PARTITION BY i, race_id) AS z
                FROM (SELECT i, t, race_id, won, exp((s - max(s) OVER (PARTITION BY i, race_id)) / t) AS e FROM w, g{k})) GROUP BY i, t)""")
        ctes.append(f"""b{k + 1} AS MATERIALIZED (
          SELECT coalesce(x.lo, b.lo) AS lo, coalesce(x.hi, b.hi) AS hi, coalesce(x.best, b.best) AS best, b.done OR x.hi - x.lo < {scoring.T_XATOL} AS done
          FROM b{k} b LEFT JOIN (
            SELECT (SELECT t FROM g{k} WHERE i = greatest(j - 1, 0)) AS lo, (SELECT t FROM g{k} WHERE i = least(j + 1, {points - 1})) AS hi,
                   (SELECT t FROM g{k} WHERE i = j) AS best
            FROM (SELECT arg_min(i, (loss, t)) AS j FROM l{k}) WHERE j IS NOT NULL) x ON true)""")
    final = """(SELECT best AS temperature, avg(-ln(least(greatest(e / z, 1e-12), 1.0))) FILTER (WHERE won = 1) AS log_loss
               FROM (SELECT best, won, e, sum(e) OVER (PARTITION BY race_id) AS z
                     FROM (SELECT best, race_id, won, exp((s - max(s) OVER (PARTITION BY race_id)) / best) AS e FROM w, b%d)) GROUP BY best)""" % rounds
    return O.with_(*O.MODEL_CTES, *("\n" + c for c in ctes)) + select_sql(["temperature", "log_loss"], final)


@register("temperature_fit", _temperature_fit_sql())
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted temperature and the winner log-loss at it (grid refinement)."""
    s = Pipeline(spark, sf_dir).scored
    t = scoring.fit_temperature(s)
    ll = scoring.log_loss_at(s, t)
    return finish(ll.select(F.lit(t).alias("temperature"), "log_loss"), ["temperature", "log_loss"])


PEV_COLS = [
    "ev_threshold", "n_bets", "mean_predicted_prob", "mean_market_prob", "empirical_hit_rate", "mean_predicted_ev",
    "realized_ev_per_dollar",
]


@register(
    "positive_ev_slice",
    ENRICHED
    + select_sql(
        PEV_COLS,
        """(SELECT 0.0 AS ev_threshold, count(*) AS n_bets, avg(model_prob) AS mean_predicted_prob,
                  avg(market_prob) AS mean_market_prob, avg(won) AS empirical_hit_rate,
                  avg(ev_per_dollar) AS mean_predicted_ev, avg(won * decimal_odds - 1.0) AS realized_ev_per_dollar
           FROM enriched WHERE ev_per_dollar > 0)""",
    ),
)
def positive_ev_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted vs realised on the positive-EV slice."""
    return finish(evaluation.positive_ev_slice_summary(_enriched(spark, sf_dir), 0.0), PEV_COLS)


@register(
    "conditional_log_loss",
    ENRICHED
    + """, sl AS (SELECT * FROM enriched WHERE ev_per_dollar > 0),
         wr AS (SELECT DISTINCT race_id FROM sl WHERE won = 1)"""
    + select_sql(
        ["n_races", "model_log_loss", "market_log_loss"],
        """(SELECT (SELECT count(*) FROM wr) AS n_races,
                  avg(-ln(least(greatest(model_prob, 1e-12), 1.0))) AS model_log_loss,
                  avg(-ln(least(greatest(market_prob, 1e-12), 1.0))) AS market_log_loss
           FROM sl WHERE won = 1 AND race_id IN (SELECT race_id FROM wr))""",
    ),
)
def conditional_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner log-loss of model and market on the positive-EV slice's winning races."""
    out = evaluation.conditional_log_loss(_enriched(spark, sf_dir), F.col("ev_per_dollar") > 0)
    return finish(out, ["n_races", "model_log_loss", "market_log_loss"])


HIST_COLS = ["bin", "bin_left", "count"]


@register(
    "entropy_histogram",
    ENRICHED
    + select_sql(
        HIST_COLS,
        f"""(SELECT CAST(least(greatest(floor(me / 0.075), 0), 39) AS INTEGER) AS bin,
                   CAST(least(greatest(floor(me / 0.075), 0), 39) AS INTEGER) * 0.075 AS bin_left, count(*) AS count
            FROM {_ENT_RACE} WHERE me IS NOT NULL GROUP BY 1, 2)""",
    ),
)
def entropy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40-bin histogram of per-race model entropy over [0, 3] nats."""
    ent = evaluation.per_race_entropy(_enriched(spark, sf_dir), "model_prob")
    return finish(evaluation.histogram(ent, "entropy", bins=40, lo=0.0, hi=3.0), HIST_COLS)


@register(
    "favorite_histogram",
    ENRICHED
    + select_sql(
        HIST_COLS,
        f"""(SELECT CAST(least(greatest(floor(fm / 0.025), 0), 39) AS INTEGER) AS bin,
                   CAST(least(greatest(floor(fm / 0.025), 0), 39) AS INTEGER) * 0.025 AS bin_left, count(*) AS count
            FROM {_ENT_RACE} WHERE fm IS NOT NULL GROUP BY 1, 2)""",
    ),
)
def favorite_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40-bin histogram of the races' favourite probability (model)."""
    fav = evaluation.per_race_favorite_prob(_enriched(spark, sf_dir), "model_prob")
    return finish(evaluation.histogram(fav, "favorite_prob", bins=40, lo=0.0, hi=1.0), HIST_COLS)


SAMPLE_ROWS = 10_000  # fixed value: points of the scatter plot
SAMPLE_COLS = KEY + ["model_prob", "market_prob", "won"]


@register(
    "prob_sample",
    ENRICHED
    + select_sql(
        SAMPLE_COLS,
        f"(SELECT * FROM enriched ORDER BY md5('0|' || race_id || '|' || horse_name), race_id, horse_name LIMIT {SAMPLE_ROWS})",
    ),
)
def prob_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded sample of runners (model vs market probability) for a scatter plot."""
    return finish(evaluation.seeded_sample(_enriched(spark, sf_dir), SAMPLE_ROWS, seed=0), SAMPLE_COLS)


# --------------------------------------------------------------------------- race-day card operators

OVR_MISMATCH_COLS = ["race_id", "post_position", "side"]


@register(
    "card_override_mismatch",
    O.with_(O.RACES, O.LINE1, O.BASE, O.OVERRIDES)
    + select_sql(
        OVR_MISMATCH_COLS,
        """(SELECT race_id, post_position, 'missing' AS side FROM base b
              WHERE NOT EXISTS (SELECT 1 FROM overrides o WHERE o.race_id = b.race_id AND o.post_position = b.post_position)
            UNION ALL
            SELECT race_id, post_position, 'extra' FROM overrides o
              WHERE NOT EXISTS (SELECT 1 FROM base b WHERE o.race_id = b.race_id AND o.post_position = b.post_position))""",
        {"side": "s"},
    ),
)
def card_override_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runners without an override and overrides without a runner (two anti-joins)."""
    from ..operators import staging
    from ..sources import fixtures

    p = Pipeline(spark, sf_dir)
    return finish(staging.override_mismatch(p.base, fixtures.overrides(p.base)), OVR_MISMATCH_COLS, {"side": "s"})


APPLY_COLS = [
    "race_id", "post_position", "horse_name", "race_class_rating", "post_time", "entry_class_rating",
    "speed_fig_L1", "speed_fig_L2", "speed_fig_L3", "avg_speed_fig_L3", "max_speed_fig_L3",
]


@register(
    "card_apply_overrides",
    O.with_(O.RACES, O.LINE1, O.BASE, O.OVERRIDES)
    + select_sql(
        APPLY_COLS,
        """(SELECT b.race_id, b.post_position, b.horse_name, o.race_class_rating, o.post_time, o.entry_class_rating,
                  o.speed_fig_L1, o.speed_fig_L2, o.speed_fig_L3,
                  (coalesce(o.speed_fig_L1, 0) + coalesce(o.speed_fig_L2, 0) + coalesce(o.speed_fig_L3, 0))
                    / nullif(CAST(o.speed_fig_L1 IS NOT NULL AS INT) + CAST(o.speed_fig_L2 IS NOT NULL AS INT) + CAST(o.speed_fig_L3 IS NOT NULL AS INT), 0) AS avg_speed_fig_L3,
                  greatest(o.speed_fig_L1, o.speed_fig_L2, o.speed_fig_L3) AS max_speed_fig_L3
           FROM base b LEFT JOIN overrides o ON o.race_id = b.race_id AND o.post_position = b.post_position)""",
        {"post_time": "s"},
    ),
)
def card_apply_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authoritative overrides (blank overwrites), speed mean/max recomputed."""
    from ..operators import staging
    from ..sources import fixtures

    p = Pipeline(spark, sf_dir)
    ov = fixtures.overrides(p.base)
    staging.check_override_columns(ov.columns)
    runners = staging.apply_speed_fig_overrides(staging.apply_entry_overrides(p.base, ov), ov)
    return finish(runners, APPLY_COLS, {"post_time": "s"})


CONFLICT_COLS = ["race_id", "field_name", "n_blank", "n_distinct"]


@register(
    "card_conflicts",
    O.with_(O.RACES, O.LINE1, O.BASE, O.OVERRIDES)
    + """, applied AS (SELECT b.race_id, o.race_class_rating, o.post_time FROM base b
                     LEFT JOIN overrides o ON o.race_id = b.race_id AND o.post_position = b.post_position)"""
    + select_sql(
        CONFLICT_COLS,
        """(SELECT race_id, 'race_class_rating' AS field_name, count(*) FILTER (WHERE race_class_rating IS NULL) AS n_blank,
                  count(DISTINCT race_class_rating) AS n_distinct FROM applied GROUP BY race_id
            UNION ALL
            SELECT race_id, 'post_time', count(*) FILTER (WHERE post_time IS NULL), count(DISTINCT post_time)
            FROM applied GROUP BY race_id)
           WHERE n_blank > 0 OR n_distinct > 1""",
        {"field_name": "s", "n_blank": "b", "n_distinct": "b"},
    ),
)
def card_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Race-level override columns that are blank or disagree within a race."""
    from ..operators import staging
    from ..sources import fixtures

    p = Pipeline(spark, sf_dir)
    applied = staging.apply_entry_overrides(p.base, fixtures.overrides(p.base))
    return finish(staging.required_conflicts(applied), CONFLICT_COLS, {"field_name": "s", "n_blank": "b", "n_distinct": "b"})


def _staged_types() -> dict[str, str]:
    return {"post_time": "s", "morning_line_odds": "d"}


@register(
    "staged_card",
    O.with_(*O.HISTORY_CTES, O.OVERRIDES)
    + select_sql(
        __import__("paddock.operators.staging", fromlist=["x"]).STAGED_COLS,
        """(SELECT b.track, b.race_number, b.race_date, o.post_time, b.distance_yards, b.surface, b.course_desc,
                  o.race_class_rating, b.purse, b.age_restriction, b.sex_restriction,
                  b.horse_name, b.post_position, b.morning_line_odds_float AS morning_line_odds, b.weight_carried,
                  o.entry_class_rating, b.year_of_birth, b.sex,
                  c.career_starts, c.career_wins, c.career_seconds, c.career_thirds, c.career_earnings,
                  c.surface_starts, c.surface_wins, c.surface_seconds, c.surface_thirds,
                  o.speed_fig_L1, o.speed_fig_L2, o.speed_fig_L3,
                  (coalesce(o.speed_fig_L1, 0) + coalesce(o.speed_fig_L2, 0) + coalesce(o.speed_fig_L3, 0))
                    / nullif(CAST(o.speed_fig_L1 IS NOT NULL AS INT) + CAST(o.speed_fig_L2 IS NOT NULL AS INT) + CAST(o.speed_fig_L3 IS NOT NULL AS INT), 0) AS avg_speed_fig_L3,
                  greatest(o.speed_fig_L1, o.speed_fig_L2, o.speed_fig_L3) AS max_speed_fig_L3,
                  p.official_finish_L1, p.official_finish_L2, p.official_finish_L3,
                  p.num_starters_L1, p.num_starters_L2, p.num_starters_L3, p.pp_odds_L1, p.pp_odds_L2, p.pp_odds_L3,
                  p.distance_yards_L1, p.distance_yards_L2, p.distance_yards_L3, p.pp_surface_L1, p.last_pp_date,
                  coalesce(p.num_prior_starts, 0) AS num_prior_starts,
                  w.best_workout_rank_pct, w.best_workout_group_size, w.last_workout_rank_pct, w.last_workout_group_size,
                  coalesce(w.num_workouts, 0) AS num_workouts, w.last_workout_date
           FROM base b
           JOIN career c ON c.race_id = b.race_id AND c.horse_name = b.horse_name
           LEFT JOIN overrides o ON o.race_id = b.race_id AND o.post_position = b.post_position
           LEFT JOIN pp_feats p ON p.race_id = b.race_id AND p.horse_name = b.horse_name
           LEFT JOIN wk_feats w ON w.race_id = b.race_id AND w.horse_name = b.horse_name)""",
        _staged_types(),
    ),
)
def staged_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 53-column staged card (race-level then runner fields), sorted."""
    from ..operators import staging
    from ..sources import fixtures

    p = Pipeline(spark, sf_dir)
    # overrides meet the narrow base, not the wide card: that is shuffled once by horse and once to be sorted
    listed = staging.with_override_list(p.base, fixtures.overrides(p.base))
    runners = staging.apply_listed_overrides(p.built_card(listed))
    return finish(staging.staged_card(runners), staging.STAGED_COLS, _staged_types())


DOC_COLS = ["race_id", "n_runners", "post_list", "horse_list"]


@register(
    "card_documents",
    O.with_(O.RACES, O.LINE1, O.BASE)
    + select_sql(
        DOC_COLS,
        """(SELECT race_id, count(*) AS n_runners,
                  string_agg(CAST(post_position AS VARCHAR), ',' ORDER BY post_position) AS post_list,
                  string_agg(horse_name, ',' ORDER BY post_position) AS horse_list
           FROM base GROUP BY race_id)""",
        {"post_list": "s", "horse_list": "s"},
    ),
)
def card_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document per race (runners by post position) with its JSON text."""
    from ..operators import staging

    base = Pipeline(spark, sf_dir).base
    docs = staging.race_documents(
        base,
        ["race_id", "race_date", "track", "race_number", "distance_yards", "surface", "race_class_rating", "purse"],
        ["post_position", "horse_name", "morning_line_odds_float", "weight_carried", "entry_class_rating", "year_of_birth", "sex"],
    )
    out = docs.select(
        "race_id",
        F.size("runners").alias("n_runners"),
        F.array_join(F.transform("runners", lambda r: r["post_position"].cast("string")), ",").alias("post_list"),
        F.array_join(F.transform("runners", lambda r: r["horse_name"]), ",").alias("horse_list"),
    )
    return finish(out, DOC_COLS, {"post_list": "s", "horse_list": "s"})


INDEX_COLS = ["race_date", "track", "n_races", "race_list"]


@register(
    "card_index",
    O.with_(O.RACES)
    + select_sql(
        INDEX_COLS,
        """(SELECT race_date, track, count(*) AS n_races,
                  string_agg(CAST(race_number AS VARCHAR), ',' ORDER BY race_number) AS race_list
           FROM races GROUP BY race_date, track)""",
        {"race_list": "s"},
    ),
)
def card_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races grouped by (date, track), sorted by race number."""
    from ..operators import staging
    from ..sources import fixtures

    idx = staging.card_index(fixtures.races(spark, sf_dir))
    out = idx.select("race_date", "track", "n_races", F.array_join(F.transform("races", lambda r: r["race_number"].cast("string")), ",").alias("race_list"))
    return finish(out, INDEX_COLS, {"race_list": "s"})


REPORT_COLS = ["race_id", "distance_label", "restriction_label", "race_meta", "group_label"]
_REPORT_T = {c: "s" for c in REPORT_COLS}


def _report_sql() -> str:
    dist = """CASE WHEN distance_yards < 1760 THEN
                 CASE WHEN CAST(round(distance_yards / 110.0) AS BIGINT) % 2 = 1
                      THEN CAST(CAST(round(distance_yards / 110.0) AS BIGINT) // 2 AS VARCHAR) || ' 1/2 furlongs'
                      ELSE CAST(CAST(round(distance_yards / 110.0) AS BIGINT) // 2 AS VARCHAR) || ' furlongs' END
               ELSE CASE WHEN CAST(round(distance_yards / 110.0) AS BIGINT) % 16 = 0
                      THEN CAST(CAST(round(distance_yards / 110.0) AS BIGINT) // 16 AS VARCHAR) || ' mile'
                      ELSE CAST(CAST(round(distance_yards / 110.0) AS BIGINT) // 16 AS VARCHAR) || ' '
                           || CAST((CAST(round(distance_yards / 110.0) AS BIGINT) % 16) // gcd(CAST(round(distance_yards / 110.0) AS BIGINT) % 16, 16) AS VARCHAR)
                           || '/' || CAST(16 // gcd(CAST(round(distance_yards / 110.0) AS BIGINT) % 16, 16) AS VARCHAR) || ' mile' END END"""
    restr = """concat_ws(' ',
                 CASE WHEN age_restriction IS NULL OR age_restriction = '' THEN NULL
                      WHEN substr(age_restriction, 2, 1) IN ('U', '+') THEN substr(age_restriction, 1, 1) || 'yo+'
                      WHEN regexp_extract(age_restriction, '^\\s*([+-]?\\d+)', 1) <> ''
                        THEN CAST(CAST(regexp_extract(age_restriction, '^\\s*([+-]?\\d+)', 1) AS INTEGER) AS VARCHAR) || 'yo'
                      ELSE age_restriction END,
                 CASE WHEN sex_restriction = 'F' THEN 'F' WHEN sex_restriction = 'B' THEN 'F&M' END)"""
    return (
        O.with_(O.RACES)
        + f", lab AS (SELECT race_id, race_date, track, surface, {dist} AS distance_label, {restr} AS restriction_label FROM races)"
        + select_sql(
            REPORT_COLS,
            """(SELECT race_id, distance_label, restriction_label,
                      concat_ws(' · ', distance_label, CASE surface WHEN 'D' THEN 'Dirt' WHEN 'T' THEN 'Turf' ELSE surface END,
                                CASE WHEN restriction_label <> '' THEN restriction_label END) AS race_meta,
                      concat_ws(' · ', CAST(race_date AS VARCHAR), CASE track WHEN 'CD' THEN 'Churchill Downs' WHEN 'KEE' THEN 'Keeneland' ELSE track END) AS group_label
               FROM lab)""",
            _REPORT_T,
        )
    )


@register("card_report", _report_sql())
def card_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance label, restriction label, race summary and card-group label."""
    from ..operators import staging
    from ..sources import fixtures

    return finish(staging.race_summary(fixtures.races(spark, sf_dir)), REPORT_COLS, _REPORT_T)


DAY_COLS = ["race_id", "race_number", "post_position", "horse_name", "morning_line_odds_float", "speed_fig_L1", "num_prior_starts", "num_workouts"]


@register(
    "day_slice",
    O.with_(*O.HISTORY_CTES)
    + """, day AS (SELECT * FROM base WHERE race_date = (SELECT max(race_date) FROM base)
                     AND course_desc NOT IN ('Hurdle', 'Downhill turf', 'Timber'))"""
    + select_sql(
        DAY_COLS,
        """(SELECT d.race_id, d.race_number, d.post_position, d.horse_name, d.morning_line_odds_float, p.speed_fig_L1,
                  coalesce(p.num_prior_starts, 0) AS num_prior_starts, coalesce(w.num_workouts, 0) AS num_workouts
           FROM day d LEFT JOIN pp_feats p ON p.race_id = d.race_id AND p.horse_name = d.horse_name
           LEFT JOIN wk_feats w ON w.race_id = d.race_id AND w.horse_name = d.horse_name)""",
    ),
)
def day_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest race day's card; only its year is read for it, history is that of its horses, reduced by a semi-join on its races."""
    from ..operators import staging
    from ..session import stored
    from ..sources import fixtures
    from . import warehouse

    today, pp = warehouse.latest_day(spark, sf_dir)
    runners = staging.day_slice(today, F.col("race_date"))
    pp = history.derive_rollup_features(history.rollup_past_performances(pp.join(runners.select("race_id"), "race_id", "left_semi")))
    workouts = fixtures.workouts(spark, sf_dir).join(stored(runners.select("horse_name").distinct()), "horse_name", "left_semi")
    wk = history.workout_rollup_asof(runners.select("race_id", "horse_name", "race_date"), workouts)
    out = runners.join(pp, ["race_id", "horse_name"], "left").join(wk, ["race_id", "horse_name"], "left").fillna(0, ["num_prior_starts", "num_workouts"])
    return finish(out, DAY_COLS)


# --------------------------------------------------------------------------- live card state (event log)


def _live_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The event log and the cards of its races."""
    from ..sources import fixtures

    return fixtures.card_events(spark, sf_dir), fixtures.log_card(spark, sf_dir, Pipeline(spark, sf_dir).base)


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import card_state

    return card_state.fold_events(*_live_log(spark, sf_dir))


def _live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import card_state

    events, card = _live_log(spark, sf_dir)
    return card_state.latest_state(card_state.fold_events(events, card), card)


ODDS_LATEST_COLS = ["race_key", "post_position", "latest_odds", "default_odds", "n_ticks"]


@register(
    "odds_latest",
    O.with_(O.RACES, O.LINE1, O.BASE, O.CARD_FOLD)
    + """, last_tick AS (
        SELECT race_key, post_position, live_odds, count(*) OVER (PARTITION BY race_key, post_position) AS n,
               row_number() OVER (PARTITION BY race_key, post_position ORDER BY ts DESC, seq DESC) AS k
        FROM fold WHERE kind = 'odds' AND accepted)"""
    + select_sql(
        ODDS_LATEST_COLS,
        """(SELECT c.race_key, c.post_position, coalesce(t.live_odds, c.default_odds) AS latest_odds, c.default_odds,
                  coalesce(t.n, 0) AS n_ticks
           FROM card c LEFT JOIN (SELECT * FROM last_tick WHERE k = 1) t USING (race_key, post_position))""",
    ),
)
def odds_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest applied odds per runner (ticks for scratched runners skipped), default morning line."""
    return finish(_live_state(spark, sf_dir), ODDS_LATEST_COLS)


SCRATCH_COLS = ["race_key", "post_position", "scratched", "n_active"]


@register(
    "scratch_state",
    O.with_(O.RACES, O.LINE1, O.BASE, O.CARD_FOLD)
    + """, final AS (SELECT race_key, arg_max(mask, i) AS mask, any_value(posts) AS posts FROM fold GROUP BY race_key)"""
    + select_sql(
        SCRATCH_COLS,
        """(SELECT c.race_key, c.post_position, CAST((f.mask & (1 << (c.post_position - 1))) <> 0 AS INTEGER) AS scratched,
                  bit_count(f.posts & ~f.mask) AS n_active
           FROM card c JOIN final f USING (race_key))""",
    ),
)
def scratch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final scratch flag per runner and active runners per race after the rules."""
    from ..operators import staging

    st = _live_state(spark, sf_dir)
    counts = staging.active_runner_counts(st.withColumnRenamed("race_key", "race_id")).withColumnRenamed("race_id", "race_key")
    out = st.join(counts, "race_key").withColumn("scratched", F.col("scratched").cast("int"))
    return finish(out, SCRATCH_COLS)


REFRESH_COLS = ["race_key", "window_start", "n_applied", "n_skipped", "n_missing", "applied_posts", "missing_posts"]


@register(
    "odds_refresh_report",
    O.with_(O.RACES, O.LINE1, O.BASE, O.CARD_FOLD)
    + """, firsts AS (
        SELECT race_key, time_bucket(INTERVAL 15 SECOND, ts) AS window_start, post_position,
               arg_min(accepted, (ts, seq)) AS applied, max(i) AS last_i, arg_max(posts & ~mask, i) AS active
        FROM fold WHERE kind = 'odds' GROUP BY 1, 2, 3),
       after AS (SELECT race_key, window_start, arg_max(active, last_i) AS active FROM firsts GROUP BY 1, 2),
       absent AS (
        SELECT a.race_key, a.window_start, count(*) AS n, string_agg(CAST(p.post AS VARCHAR), ',' ORDER BY p.post) AS posts
        FROM after a, range(1, 64) p(post)
        WHERE (a.active & (1::BIGINT << (p.post - 1))) <> 0
          AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.race_key = a.race_key AND f.window_start = a.window_start AND f.post_position = p.post)
        GROUP BY 1, 2)"""
    + select_sql(
        REFRESH_COLS,
        """(SELECT w.*, coalesce(m.n, 0) AS n_missing, coalesce(m.posts, '') AS missing_posts FROM (
             SELECT race_key, window_start, count(*) FILTER (WHERE applied) AS n_applied,
                  count(*) FILTER (WHERE NOT applied) AS n_skipped,
                  coalesce(string_agg(CAST(post_position AS VARCHAR), ',' ORDER BY post_position) FILTER (WHERE applied), '') AS applied_posts
             FROM firsts GROUP BY race_key, window_start) w LEFT JOIN absent m USING (race_key, window_start))""",
    ),
)
def odds_refresh_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-second refresh windows per race: applied, skipped and missing posts."""
    from ..streaming import card_state

    return finish(card_state.refresh_report(_folded(spark, sf_dir)), REFRESH_COLS)


MISSING_COLS = ["race_key", "n_active", "n_missing", "missing_posts"]

#: Latest state of the log's runners: active ones and their last applied odds.
_LIVE_STATE = """
final_mask AS (SELECT race_key, arg_max(mask, i) AS mask FROM fold GROUP BY race_key),
last_odds AS (
  SELECT race_key, post_position, arg_max(live_odds, i) AS odds, count(*) AS n
  FROM fold WHERE kind = 'odds' AND accepted GROUP BY 1, 2),
active AS (
  SELECT c.race_key, c.post_position, t.odds, coalesce(t.n, 0) AS n
  FROM card c JOIN final_mask f USING (race_key) LEFT JOIN last_odds t USING (race_key, post_position)
  WHERE (f.mask & (1 << (c.post_position - 1))) = 0)"""


@register(
    "missing_odds",
    O.with_(O.RACES, O.LINE1, O.BASE, O.CARD_FOLD, _LIVE_STATE)
    + select_sql(
        MISSING_COLS,
        """(SELECT race_key, count(*) AS n_active, count(*) FILTER (WHERE n = 0) AS n_missing,
                  coalesce(string_agg(CAST(post_position AS VARCHAR), ',' ORDER BY post_position) FILTER (WHERE n = 0), '') AS missing_posts
           FROM active GROUP BY race_key)""",
    ),
)
def missing_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active runners per race of the log and the posts that have no live odds yet."""
    from ..operators import serving

    return finish(serving.missing_odds(_live_state(spark, sf_dir)), MISSING_COLS)


LIVE_COLS = ["race_id", "horse_name", "post_position", "rank", "model_prob", "market_prob", "edge", "ev_per_dollar"]


@register(
    "live_predictions",
    O.with_(*O.MODEL_CTES, O.CARD_FOLD, _LIVE_STATE)
    + """, offered AS (
        SELECT d.* EXCLUDE (live_odds, market_prob), a.odds AS live_odds, min(a.n) OVER (PARTITION BY d.race_id) AS least_ticks
        FROM derived d JOIN active a ON a.race_key = d.race_number AND a.post_position = d.post_position),
    priced AS (
        SELECT *, (1.0 / (live_odds + 1)) / sum(1.0 / (live_odds + 1)) OVER (PARTITION BY race_id) AS market_prob
        FROM offered WHERE least_ticks > 0),
    weighed AS (
        SELECT *, least(greatest(market_prob, 1e-4), 1 - 1e-4) AS q,
               exp(0.02 * coalesce(speed_fig_minus_field_avg_L1, 0.0) + 0.005 * coalesce(entry_class_rating_minus_field_avg, 0.0)) AS lift
        FROM priced),
    predicted AS (
        SELECT *, (q / (1 - q)) * lift / sum((q / (1 - q)) * lift) OVER (PARTITION BY race_id) AS p FROM weighed),
    rounded AS (
        SELECT race_id, horse_name, post_position, round_even(p, 4) AS model_prob, round_even(market_prob, 4) AS market_prob,
               round_even(p - market_prob, 4) AS edge, round_even(p * (live_odds + 1) - 1, 4) AS ev_per_dollar
        FROM predicted)"""
    + select_sql(
        LIVE_COLS,
        "(SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY ev_per_dollar DESC NULLS LAST, post_position) AS rank FROM rounded)",
    ),
)
def live_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active runners of races with complete live odds, scored on them and ranked by EV."""
    from ..operators import serving

    return finish(serving.live_predictions(Pipeline(spark, sf_dir).for_scoring, _live_state(spark, sf_dir)), LIVE_COLS)


def _stream_root(spark: SparkSession, name: str) -> str:
    import uuid

    from ..session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/paddock-streams/{name}-{uuid.uuid4().hex}"


def _follow_log(spark: SparkSession, sf_dir: str, sink, root: str) -> DataFrame:
    """Runs the event log, opened by its cards, through the streaming card state; returns the cards."""
    from ..streaming import card_state, live_scoring

    events, card = _live_log(spark, sf_dir)
    begin = F.lit(events.agg(F.min("ts")).first()[0]) - F.expr("interval 1 second")
    opened = card_state.created(card).withColumns({"ts": begin.cast("timestamp_ntz"), "seq": F.lit(-1).cast("bigint")})
    opened.unionByName(card_state.as_log(events)).write.parquet(f"{root}/log")
    stream = spark.readStream.schema(card_state.EVENT_SCHEMA).parquet(f"{root}/log")
    live_scoring.follow(stream, sink, f"{root}/checkpoint")
    return card


@register("odds_latest_stream", ORACLES["odds_latest"])
def odds_latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z1 Z2 Z3 as a stream: latest odds in keyed, typed state, written by batch."""
    from ..streaming import live_scoring

    root = _stream_root(spark, "odds")
    card = _follow_log(spark, sf_dir, live_scoring.keep_state(f"{root}/out"), root)
    state = live_scoring.current_rows(spark, f"{root}/out").join(card, ["race_key", "post_position"], "left")
    state = state.withColumns({"latest_odds": F.coalesce("latest_odds", "morning_line_odds"), "default_odds": F.col("morning_line_odds")})
    return finish(state, ODDS_LATEST_COLS)


@register("live_predictions_stream", ORACLES["live_predictions"])
def live_predictions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z6 F20 T2 as a stream: changed races scored batch by batch against the stored card."""
    from ..streaming import live_scoring

    root = _stream_root(spark, "predictions")
    sink = live_scoring.score_changed(Pipeline(spark, sf_dir).for_scoring, f"{root}/out")
    _follow_log(spark, sf_dir, sink, root)
    return finish(live_scoring.current_rows(spark, f"{root}/out"), LIVE_COLS)


LIFECYCLE_COLS = ["race_key", "seq", "kind", "post_position", "accepted", "reason", "version", "n_active"]


def _lifecycle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from ..sources import fixtures
    from ..streaming import card_state

    card = fixtures.log_card(spark, sf_dir, Pipeline(spark, sf_dir).base)
    log = fixtures.lifecycle_events(spark, sf_dir, card)
    return log, card, card_state.fold_events(log, card.where("race_key % 2 = 0"))


@register(
    "card_lifecycle",
    O.with_(O.RACES, O.LINE1, O.BASE, O.LIFE_FOLD)
    + select_sql(
        LIFECYCLE_COLS,
        """(SELECT race_key, seq, kind, post_position, reason IS NULL AS accepted, reason, version, bit_count(posts & ~mask) AS n_active
           FROM fold WHERE i > 0)""",
    ),
)
def card_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a log in which races are created, deleted and deleted all at once, with its decision."""
    folded = _lifecycle(spark, sf_dir)[2].where(F.col("seq").isNotNull())
    return finish(folded.withColumn("n_active", F.col("n_active_after")), LIFECYCLE_COLS)


SNAPSHOT_COLS = ["race_key", "version", "post_position", "latest_odds", "default_odds", "n_ticks", "scratched"]


@register(
    "card_snapshot",
    O.with_(O.RACES, O.LINE1, O.BASE, O.LIFE_FOLD)
    + """, final AS (
        SELECT race_key, arg_max(alive, i) AS alive, arg_max(version, i) AS version, arg_max(posts, i) AS posts, arg_max(mask, i) AS mask, arg_max(cleared, i) AS cleared
        FROM fold GROUP BY race_key),
       ticks AS (
        SELECT race_key, version, post_position, arg_max(live_odds, i) AS odds, count(*) AS n FROM fold WHERE kind = 'odds' AND reason IS NULL GROUP BY ALL)"""
    + select_sql(
        SNAPSHOT_COLS,
        """(SELECT f.race_key, f.version, b.post_position, coalesce(t.odds, b.morning_line_odds_float) AS latest_odds, b.morning_line_odds_float AS default_odds,
                  coalesce(t.n, 0) AS n_ticks, CAST((f.mask & (1::BIGINT << (b.post_position - 1))) <> 0 AS INTEGER) AS scratched
           FROM final f JOIN base b ON b.race_number = f.race_key AND (f.posts & (1::BIGINT << (b.post_position - 1))) <> 0
           LEFT JOIN ticks t ON t.race_key = f.race_key AND t.version = f.version AND t.post_position = b.post_position
           WHERE f.alive AND f.cleared = (SELECT count(*) FROM raw WHERE kind = 'delete_all'))""",
    ),
)
def card_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The races that exist after the log, published as a snapshot version and read back."""
    from ..operators import snapshots
    from ..streaming import card_state

    log, card, folded = _lifecycle(spark, sf_dir)
    root = _stream_root(spark, "snapshots")
    snapshots.publish(card_state.latest_state(folded, card, log.where("kind = 'delete_all'").count()), root, "000001")
    return finish(snapshots.read_version(spark, root).withColumn("scratched", F.col("scratched").cast("int")), SNAPSHOT_COLS)


FEED_COLS = ["race_key", "race_date", "post_position", "live_odds"]


@register(
    "odds_feed",
    """WITH ev AS (
        SELECT user_id AS race_key, CAST(ts AS DATE) AS race_date, event_id % 8 + 1 AS post_position, event_id AS seq,
               CASE WHEN event_id % 3 = 1 THEN floor(value / 10) / 2 WHEN value > 0 THEN value / 10 END AS odds
        FROM events WHERE event_type IN ('view', 'click', 'purchase'))
    """
    + select_sql(FEED_COLS, "(SELECT race_key, race_date, post_position, arg_min(odds, seq) AS live_odds FROM ev WHERE odds IS NOT NULL GROUP BY 1, 2, 3)"),
)
def odds_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's ticks as JSON payloads, parsed; coupled entries go by position."""
    from ..sources import files, fixtures

    p = fixtures.odds_payloads(spark, sf_dir)
    return finish(p.select("race_key", "race_date", F.explode(files.payload_odds("payload")).alias("o")).select("race_key", "race_date", "o.*"), FEED_COLS)


# --------------------------------------------------------------------------- scalar parsing functions

PARSE_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "odds_text", "odds_parsed", "odds_fraction",
    "program_text", "program_number", "live_odds_choice", "odds_value", "unit", "yards",
]


def _odds_text_sql() -> str:
    return """CASE l_linenumber % 7
        WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '/' || CAST(l_linenumber % 3 AS VARCHAR)
        WHEN 1 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)
        WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)
        WHEN 3 THEN 'EVEN' WHEN 4 THEN ' ev ' WHEN 5 THEN '' ELSE printf('%.2f', l_discount) END"""


@register(
    "odds_parse",
    """WITH t AS (
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, """ + _odds_text_sql() + """ AS odds_text,
               CAST(l_linenumber AS VARCHAR) || CASE WHEN l_partkey % 2 = 0 THEN 'A' ELSE '' END AS program_text,
               CASE WHEN l_linenumber % 2 = 0 THEN l_quantity - 10 END AS raw_number, l_tax * 100 AS trend,
               CAST(CASE l_linenumber % 4 WHEN 0 THEN l_quantity * 100 ELSE floor(l_extendedprice / 10) END AS BIGINT) AS odds_value,
               CASE l_linenumber % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'Y' WHEN 2 THEN 'M' ELSE 'X' END AS unit
        FROM lineitem),
    p AS (
        SELECT *, trim(odds_text) AS s, upper(trim(odds_text)) AS u,
               TRY_CAST(nullif(trim(odds_text), '') AS DOUBLE) AS plain,
               TRY_CAST(nullif(trim(split_part(trim(odds_text), '/', 1)), '') AS DOUBLE) AS num,
               TRY_CAST(nullif(trim(substr(trim(odds_text), strpos(trim(odds_text), '/') + 1)), '') AS DOUBLE) AS den,
               TRY_CAST(regexp_extract(upper(trim(odds_text)), '^([^/-]*)[/-](.*)$', 1) AS DOUBLE) AS fnum,
               TRY_CAST(regexp_extract(upper(trim(odds_text)), '^([^/-]*)[/-](.*)$', 2) AS DOUBLE) AS fden,
               regexp_matches(upper(trim(odds_text)), '^([^/-]*)[/-](.*)$') AS fmatch
        FROM t),
    q AS (
        SELECT *,
          CASE WHEN s = '' THEN NULL
               WHEN strpos(s, '/') > 0 THEN (CASE WHEN den IS NOT NULL AND den <> 0 THEN num / den END)
               WHEN plain = floor(plain) AND plain > 99 THEN plain / 100 ELSE plain END AS v,
          CASE WHEN u = '' THEN NULL WHEN u IN ('EVEN', 'EV', 'EVS') THEN 1.0
               WHEN fmatch AND fnum IS NOT NULL AND fden IS NOT NULL AND fden <> 0 THEN fnum / fden END AS odds_fraction
        FROM p)
    """
    + select_sql(
        PARSE_COLS,
        """(SELECT *, CASE WHEN v > 0 THEN v END AS odds_parsed,
                  TRY_CAST(nullif(regexp_extract(program_text, '^\\s*(\\d+)', 1), '') AS BIGINT) AS program_number,
                  coalesce(CASE WHEN raw_number > 0 THEN raw_number END, odds_fraction, CASE WHEN trend > 0 THEN trend END) AS live_odds_choice,
                  CASE unit WHEN 'F' THEN CAST(round_even(odds_value / 100 * 220, 0) AS BIGINT) WHEN 'Y' THEN odds_value
                            WHEN 'M' THEN CAST(round_even(odds_value * 1.09361, 0) AS BIGINT) END AS yards
           FROM q)""",
    ),
)
def odds_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds text, program numbers, live-odds choice and yards on text made from every line item."""
    from ..functions import columns as C
    from ..sources import fixtures

    li = fixtures.read(spark, sf_dir, "lineitem")
    ln = F.col("l_linenumber")
    text = (
        F.when(ln % 7 == 0, F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("/"), (ln % 3).cast("string")))
        .when(ln % 7 == 1, F.floor("l_extendedprice").cast("bigint").cast("string"))
        .when(ln % 7 == 2, F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("-"), ln.cast("string")))
        .when(ln % 7 == 3, F.lit("EVEN"))
        .when(ln % 7 == 4, F.lit(" ev "))
        .when(ln % 7 == 5, F.lit(""))
        .otherwise(F.format_string("%.2f", F.col("l_discount")))
    )
    df = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        text.alias("odds_text"),
        F.concat(ln.cast("string"), F.when(F.col("l_partkey") % 2 == 0, "A").otherwise("")).alias("program_text"),
        F.when(ln % 2 == 0, F.col("l_quantity") - 10).alias("_raw_number"),
        (F.col("l_tax") * 100).alias("_trend"),
        F.when(ln % 4 == 0, F.col("l_quantity") * 100).otherwise(F.floor(F.col("l_extendedprice") / 10)).cast("bigint").alias("odds_value"),
        F.when(ln % 4 == 0, "F").when(ln % 4 == 1, "Y").when(ln % 4 == 2, "M").otherwise("X").alias("unit"),
    )
    out = df.select(
        "*",
        C.parse_odds("odds_text").alias("odds_parsed"),
        C.parse_fractional_odds("odds_text").alias("odds_fraction"),
        C.parse_program_number("program_text").alias("program_number"),
        C.live_odds_choice(F.col("_raw_number"), F.col("odds_text"), F.col("_trend")).alias("live_odds_choice"),
        C.to_yards("odds_value", "unit").alias("yards"),
    )
    return finish(out, PARSE_COLS)


# --------------------------------------------------------------------------- MLlib scorers (rows-only checks)


#: What fits and their measures read of the features.
TRAINING_COLUMNS = list(dict.fromkeys([*SCORING_COLUMNS, *FEATURE_NAMES]))


def _training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features cut to ``TRAINING_COLUMNS`` with split labels, written once in buckets of races:
    model fitting makes many passes, and what groups by race reads them without a shuffle."""
    from ..operators import snapshots
    from ..operators import split as split_ops

    p = Pipeline(spark, sf_dir)
    rows = split_ops.split_by_race(p.built_features, labels_from=p.card_races).select(*TRAINING_COLUMNS, "split")
    root = _stream_root(spark, "training")
    snapshots.publish_bucketed(rows, root, "000001", "race_id", p.parts, dealt=True)
    return snapshots.read_bucketed(spark, root, "race_id")


def _model_metrics(spark: SparkSession, sf_dir: str, model_type: str) -> DataFrame:
    from ..operators import models

    derived = _training_frame(spark, sf_dir)
    train = derived.where(F.col("split") == "train").drop("split")
    val = derived.where(F.col("split") == "val").drop("split")
    m = models.calibrate(models.fit(train, val, model_type), val)
    # a runner that is there n times meets each of its n splits: n * n rows
    times = F.count(F.lit(1)).over(Window.partitionBy("race_id", "horse_name")).cast("int")
    scored = m.score(derived).where("horse_name is not null").withColumn("_times", times)
    scored = scored.withColumn("_times", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times")
    enriched = evaluation.enrich(scored, temperature=m.temperature)
    out = evaluation.metrics_by_split(enriched).withColumn("temperature", F.lit(m.temperature))
    return finish(out, METRIC_COLS + ["temperature"])


@register("score_offset_glr")
def score_offset_glr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binomial GLM with the market logit as offset; metrics per split."""
    return _model_metrics(spark, sf_dir, "offset_glr")


@register("score_gbt")
def score_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 (trees, early stopping on val) X7-X9 E4: metrics per split."""
    return _model_metrics(spark, sf_dir, "gbt")


@register("score_ranker")
def score_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise in-race ranker (winner vs each other runner); metrics per split."""
    return _model_metrics(spark, sf_dir, "ranker")


@register("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset-GLM importance (|w| x sd) and exact mean absolute attribution per feature."""
    from ..operators import models
    from ..operators import split as split_ops

    derived = _training_frame(spark, sf_dir)
    train = derived.where(F.col("split") == "train").drop("split")
    m = models.fit(train, None, "offset_glr")
    imp = models.feature_importance(m, train)
    att = models.mean_abs_attribution(m, train)
    return finish(imp.join(att, "feature"), ["feature", "importance", "mean_abs_attribution"])


TRIAL_COLS = ["trial", "value", "trees", "stepSize", "maxDepth", "subsamplingRate", "minInstancesPerNode", "maxIter", "minInfoGain", "featureSubsetStrategy"]


def _searched(spark: SparkSession, sf_dir: str):
    from ..operators import models

    derived = _training_frame(spark, sf_dir)
    part = lambda name: derived.where(F.col("split") == name).drop("split")
    found = models.search(part("train"), part("val"), 3, _stream_root(spark, "trials"), "000001", rungs=(0.1, 0.3))
    return derived, found


@register("sweep_trials")
def sweep_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded random search over tree parameters (3 trials on two rungs of up to 24 trees), read from the trials table, best first."""
    from ..operators import models

    return finish(models.top_trials(_searched(spark, sf_dir)[1].trials, 10), TRIAL_COLS)


@register("sweep_best")
def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best trial fitted again on training and validation rows; metrics per split."""
    derived, found = _searched(spark, sf_dir)
    scored = found.model.score(derived)
    return finish(evaluation.metrics_by_split(evaluation.enrich(scored, temperature=found.model.temperature)), METRIC_COLS)


@register("score_ndcg_ranker")
def score_ndcg_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The NDCG-weighted ranker beside the plain one; NDCG per split."""
    from ..operators import models

    derived = _training_frame(spark, sf_dir)
    part = lambda name: derived.where(F.col("split") == name).drop("split")
    out = None
    for kind in ("ranker", "ndcg_ranker"):
        scored = models.fit(part("train"), part("val"), kind).score(derived)
        one = evaluation.ndcg(scored, "split").withColumn("label", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return finish(out, ["label", "split", "n_races", "ndcg"])


@register(
    "ndcg_by_split",
    O.with_(*O.MODEL_CTES, O.enriched_cte(1.0), _split_cte())
    + """, placed AS (
        SELECT split, e.race_id, won, row_number() OVER (PARTITION BY e.race_id ORDER BY model_score DESC, post_position, horse_name) AS k,
               sum(won) OVER (PARTITION BY e.race_id) AS wins
        FROM enriched e JOIN race_split s USING (race_id))"""
    + select_sql(["split", "n_races", "ndcg"], "(SELECT split, count(*) AS n_races, avg(1 / log2(1 + k)) AS ndcg FROM placed WHERE won = 1 AND wins = 1 GROUP BY split)"),
)
def ndcg_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6's measure: NDCG of the fixed scorer per split."""
    from ..operators import split as split_ops

    p = Pipeline(spark, sf_dir)
    return finish(evaluation.ndcg(split_ops.split_by_race(p.enriched(), labels_from=p.card_races), "split"), ["split", "n_races", "ndcg"])


@register("tree_attribution")
def tree_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14 for trees: permutation importance of a boosted model on the validation rows."""
    from ..operators import models

    derived = _training_frame(spark, sf_dir)
    part = lambda name: derived.where(F.col("split") == name).drop("split")
    m = models.calibrate(models.fit(part("train"), part("val"), "gbt", params={"maxIter": 20}), part("val"))
    return finish(models.tree_attribution(m, part("val")), ["feature", "importance"])


PERMUTED = ["market_prob", "speed_fig_minus_field_avg_L1", "entry_class_rating_minus_field_avg"]
PERMUTATION_COLS = ["feature", "base_loss", "permuted_loss", "importance"]


def _permutation_sql() -> str:
    values = lambda i: ", ".join(f"CASE WHEN v.f = {k} THEN m.v ELSE CAST({c} AS DOUBLE) END AS {c}" for k, c in enumerate(PERMUTED))
    long = " UNION ALL ".join(f"SELECT {k} AS f, '{c}' AS name, race_id, horse_name, CAST({c} AS DOUBLE) AS v FROM rows" for k, c in enumerate(PERMUTED))
    return (
        O.with_(*O.MODEL_CTES)
        + f""", rows AS (SELECT race_id, horse_name, won, {", ".join(PERMUTED)}, row_number() OVER (ORDER BY race_id, horse_name) AS k FROM scored),
        moved AS (
          SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY md5('0|' || name || '|' || race_id || '|' || horse_name), race_id, horse_name) AS k FROM ({long})),
        variants AS (
          SELECT v.f, r.race_id, r.won, {values(0)}
          FROM rows r CROSS JOIN (SELECT unnest(range(-1, {len(PERMUTED)})) AS f) v LEFT JOIN moved m ON m.f = v.f AND m.k = r.k),
        s AS (
          SELECT f, race_id, won, ln(q / (1 - q)) + 0.02 * coalesce(speed_fig_minus_field_avg_L1, 0.0) + 0.005 * coalesce(entry_class_rating_minus_field_avg, 0.0) AS s
          FROM (SELECT *, least(greatest(market_prob, 1e-4), 1 - 1e-4) AS q FROM variants)),
        e AS (SELECT f, race_id, won, exp(s - max(s) OVER (PARTITION BY f, race_id)) AS e FROM s),
        p AS (SELECT f, won, e / sum(e) OVER (PARTITION BY f, race_id) AS p FROM e),
        loss AS (SELECT f, avg(-ln(least(greatest(p, 1e-12), 1.0))) AS loss FROM p WHERE won = 1 GROUP BY f)"""
        + select_sql(
            PERMUTATION_COLS,
            f"""(SELECT ['{"', '".join(PERMUTED)}'][CAST(l.f + 1 AS INTEGER)] AS feature, b.loss AS base_loss, l.loss AS permuted_loss, l.loss - b.loss AS importance
               FROM loss l, (SELECT loss FROM loss WHERE f = -1) b WHERE l.f >= 0)""",
        )
    )


@register("permutation_importance", _permutation_sql())
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutation importance of the fixed scorer's inputs over all rows."""
    from ..operators import permutation

    rows = Pipeline(spark, sf_dir).for_scoring.select("race_id", "horse_name", "won", *PERMUTED)
    return finish(permutation.permutation_importance(rows, scoring.fixed_linear_score, PERMUTED), PERMUTATION_COLS)


@register(
    "trials_table",
    f"WITH t AS ({ORACLES['temperature_sweep']})"
    + select_sql(
        ["run_id", "trial", "value"],
        """(SELECT '00000' || r.run AS run_id, trial, value + r.run AS value
           FROM (SELECT row_number() OVER (ORDER BY T) - 1 AS trial, log_loss AS value FROM t), (VALUES (1), (2)) r(run)
           ORDER BY value + r.run, trial LIMIT 10)""",
        {"run_id": "s"},
    ),
)
def trials_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5 T5: trials of two runs (a temperature each) appended to the trials table, one of them twice; top ten of all."""
    from pyspark.sql import Window

    from ..operators import models, snapshots

    root = _stream_root(spark, "trials")
    s = scoring.winner_races(Pipeline(spark, sf_dir).scored)
    losses = scoring.log_loss_grid(s, SWEEP_TEMPS)  # a row per temperature
    trials = losses.select((F.row_number().over(Window.orderBy("T")) - 1).cast("bigint").alias("trial"), F.col("log_loss").alias("value"))
    for run in (1, 2, 2):
        snapshots.publish(trials.withColumn("value", F.col("value") + run), root, f"{run:06d}")
    return finish(models.top_trials(snapshots.read_all(spark, root), 10).withColumnRenamed("version", "run_id"), ["run_id", "trial", "value"])


LEDGER_COLS = ["feed", "part", "n_rows", "n_bad", "reasons"]


@register(
    "file_ledger",
    """WITH r AS (
        SELECT 'card' AS feed, CAST(year(o_orderdate) AS VARCHAR) AS part,
               CASE WHEN o_orderkey % 47 = 0 THEN 'unreadable record' WHEN o_orderkey % 43 = 0 THEN 'no race_number' WHEN o_orderkey % 41 = 0 THEN 'bad purse' END AS why
        FROM orders
        UNION ALL
        SELECT 'odds', CAST(CAST(ts AS DATE) AS VARCHAR),
               CASE WHEN event_id % 37 = 0 THEN 'unreadable record' WHEN event_id % 53 = 0 THEN 'no race_key' WHEN event_id % 59 = 0 THEN 'bad live_odds' END
        FROM events),
    n AS (SELECT feed, part, why, count(*) AS n FROM r GROUP BY ALL)
    """
    + select_sql(
        LEDGER_COLS,
        """(SELECT feed, part, sum(n) AS n_rows, coalesce(sum(n) FILTER (WHERE why IS NOT NULL), 0) AS n_bad,
                  coalesce(string_agg(why || ': ' || n, '; ' ORDER BY n DESC, why) FILTER (WHERE why IS NOT NULL), '') AS reasons
           FROM n GROUP BY feed, part)""",
    ),
)
def file_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card lines (CSV) and odds lines (JSON) of every order and event, written with defects by rule, and the ledger of reading them."""
    from ..sources import fixtures, ledger

    root = _stream_root(spark, "feeds")
    fixtures.write_feeds(spark, sf_dir, root)
    part = F.regexp_extract(F.col(ledger.FILE), "/part=([^/]+)/", 1)
    card = ledger.read_csv(spark, f"{root}/card", fixtures.CARD_FEED, ("race_number",))
    odds = ledger.read_json_lines(spark, f"{root}/odds", fixtures.ODDS_FEED, ("race_key",))
    both = [ledger.ledger(df, part).select(F.lit(name).alias("feed"), F.col("_k0").alias("part"), "n_rows", "n_bad", "reasons") for name, df in (("card", card), ("odds", odds))]
    return finish(both[0].unionByName(both[1]), LEDGER_COLS)


# --------------------------------------------------------------------------- sinks and reports

PROFILE_COLS = ["table_name", "n_rows", "n_columns"]


@register(
    "table_profile",
    O.with_(*O.HISTORY_CTES)
    + select_sql(
        PROFILE_COLS,
        """(SELECT 'results' AS table_name, count(*) AS n_rows, 15 AS n_columns FROM base
            UNION ALL SELECT 'entries', count(*), 23 FROM base
            UNION ALL SELECT 'past_performances', count(*), 12 FROM pp
            UNION ALL SELECT 'workout_rollup', count(*), 8 FROM wk_feats)""",
        {"table_name": "s", "n_columns": "b"},
    ),
)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: rows and columns of every table the pipeline materialises."""
    from ..operators import sinks

    p = Pipeline(spark, sf_dir)
    tables = {
        "results": p.results,
        "entries": p.entries,
        "past_performances": finish(p.past_performances(10), PP_COLS),
        "workout_rollup": finish(p.workout_features(), WORKOUT_COLS),
    }
    return finish(sinks.table_profile(tables), PROFILE_COLS, {"table_name": "s", "n_columns": "b"})


METRICS_LONG_COLS = ["run_id", "metric", "value"]


def _metrics_long_sql() -> str:
    mcols = [c for c in METRIC_COLS if c != "split"]
    rcols = ROI_COLS
    m_union = " UNION ALL ".join(f"SELECT split || '.{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM m" for c in mcols)
    clean = "replace(replace(replace(replace(replace(rule, ' ', '_'), '(', ''), ')', ''), '>', 'gt'), '%', 'pct')"
    r_union = " UNION ALL ".join(f"SELECT split || '.roi.' || {clean} || '.{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM r" for c in rcols)
    return (
        f"WITH m AS ({ORACLES['metrics_by_split']}), r AS ({ORACLES['roi_all_rules']})"
        + select_sql(METRICS_LONG_COLS, f"(SELECT 'run' AS run_id, metric, value FROM ({m_union} UNION ALL {r_union}))", {"run_id": "s", "metric": "s", "value": "d"})
    )


@register("metrics_long", _metrics_long_sql())
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-split metric bundle and rule ROIs as long (run_id, metric, value) rows."""
    from ..operators import sinks

    m = metrics_by_split(spark, sf_dir)
    r = roi_all_rules(spark, sf_dir).drop("rule_order")
    return finish(sinks.metrics_long(m, r), METRICS_LONG_COLS, {"run_id": "s", "metric": "s", "value": "d"})
