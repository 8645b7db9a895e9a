"""Result column types shared by the Spark queries and their SQL oracles.

``d`` double (rounded to 6 places, non-finite -> null), ``b`` bigint, ``i`` int,
``s`` string, ``t`` date, ``ts`` timestamp, ``bool`` boolean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from . import oracle

_D = """
purse weight_carried entry_class_rating race_class_rating morning_line_odds_float live_odds market_prob dollar_odds
entry_class_rating_minus_field_avg entry_class_rating_to_field_avg_ratio entry_to_race_class_ratio
speed_fig_L1 speed_fig_L2 speed_fig_L3 avg_speed_fig_L3 max_speed_fig_L3 speed_fig_trend
speed_fig_minus_field_avg_L1 speed_fig_to_field_avg_ratio_L1 relative_finish_L1 relative_finish_L2 relative_finish_L3
avg_relative_finish pp_odds_L1 pp_odds_L2 pp_odds_L3 pp_overperformance_L1 pp_overperformance_L2 pp_overperformance_L3
pp_avg_overperformance_L3 best_workout_rank_pct last_workout_rank_pct career_win_rate career_top3_rate
career_earnings_per_start surface_win_rate surface_top3_rate career_earnings
pp_speed_figure pp_odds total_staked total_return profit roi hit_rate avg_ev model_score model_prob decimal_odds
ev_per_dollar stake payout base_margin market_prob_final market_prob_live
model_log_loss market_log_loss uniform_log_loss model_top1_acc favorite_top1_acc model_prob_sum_mean
model_entropy_mean market_entropy_mean delta_mean entropy favorite_prob mean_pred empirical_rate ci_lo ci_hi brier
mean_model_prob mean_market_prob win_rate mean_ev pos_ev_hit_rate pos_ev_roi entropy_gap favorite_gap log_loss_gap
T log_loss temperature ev_threshold mean_predicted_prob empirical_hit_rate mean_predicted_ev realized_ev_per_dollar
bin_left value takeout_final importance mean_abs_attribution stepSize subsamplingRate minInfoGain model_brier market_brier odds_parsed odds_fraction live_odds_choice latest_odds default_odds edge base_loss permuted_loss ndcg
"""
_B = """
race_number distance_yards num_runners field_size post_position official_finish year_of_birth age
ml_odds_rank live_odds_rank official_finish_L1 official_finish_L2 official_finish_L3 num_starters_L1 num_starters_L2
num_starters_L3 distance_yards_L1 distance_yards_L2 distance_yards_L3 distance_diff_L1 distance_diff_L2 distance_diff_L3
days_since_last num_prior_starts best_workout_group_size last_workout_group_size num_workouts days_since_last_workout
career_starts career_wins career_seconds career_thirds surface_starts surface_wins surface_seconds surface_thirds
pp_index pp_race_number pp_official_finish pp_num_starters pp_distance_yards n_bets n_races n_rows n count wins
n_positive_ev rank bin_ord bucket_ord rule_order n_active n_runners program_number yards race_key seq n_applied n_missing n_skipped n_ticks l_orderkey l_partkey l_suppkey l_linenumber odds_value version n_bad trees trial maxDepth minInstancesPerNode maxIter
"""
_I = """
is_dirt is_turf is_all_weather min_age_allowed max_age_allowed is_sex_restricted is_female_only_race is_male_only_race
post_position_bucket is_female is_gelded surface_switch_L1 won bin scratched accepted takeout_ok within_max
"""
_S = """
race_id track surface course_desc horse_name sex age_restriction sex_restriction pp_surface_L1 pp_track pp_surface
rule split odds_bucket field_bucket bin_label kind odds_text unit label applied_posts missing_posts reason program_text feature featureSubsetStrategy feed part reasons run_id
"""
_T = "race_date last_pp_date last_workout_date pp_race_date first_date"
_TS = "ts window_start"

TYPES: dict[str, str] = {}
for _names, _t in ((_D, "d"), (_B, "b"), (_I, "i"), (_S, "s"), (_T, "t"), (_TS, "ts")):
    for _n in _names.split():
        TYPES[_n] = _t

_SPARK = {"b": "bigint", "i": "int", "s": "string", "t": "date", "ts": "timestamp_ntz", "bool": "boolean"}
_DUCK = {"b": "BIGINT", "i": "INTEGER", "s": "VARCHAR", "t": "DATE", "ts": "TIMESTAMP", "bool": "BOOLEAN"}


def kind(name: str, overrides: dict[str, str] | None = None) -> str:
    if overrides and name in overrides:
        return overrides[name]
    if name not in TYPES:
        raise KeyError(f"no result type declared for column {name!r}")
    return TYPES[name]


def finish(df: DataFrame, cols: list[str], overrides: dict[str, str] | None = None) -> DataFrame:
    """Spark side: select ``cols`` in order with the declared type; doubles rounded."""
    out = []
    for c in cols:
        k = kind(c, overrides)
        out.append((r6(c) if k == "d" else F.col(c).cast(_SPARK[k])).alias(c))
    return df.select(*out)


def select_sql(cols: list[str], source: str, overrides: dict[str, str] | None = None, where: str = "") -> str:
    """Oracle side: the same projection as ``finish`` over ``source``."""
    parts = []
    for c in cols:
        k = kind(c, overrides)
        parts.append(f"{oracle.r6(c)} AS {c}" if k == "d" else f"CAST({c} AS {_DUCK[k]}) AS {c}")
    return f"SELECT {', '.join(parts)} FROM {source} {where}"
