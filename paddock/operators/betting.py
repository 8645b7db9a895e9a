"""Expected value, bet rules and ROI summaries.

Top-1 rules are row_number windows over the race with a total order: the rule's
score, then post position, then horse name. Rows with a null score are never
picked (the reference would let a null score win a race; see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RACE = "race_id"
DEFAULT_STAKE = 2.0

# Rule names.
BET_RULES = (
    "ev_threshold",
    "top_ev_per_race",
    "top_model_per_race",
    "favorite",
    "ml_favorite",
    "top_speed_fig",
)

# The seven standard rule configurations, in report order.
ROI_RULES: list[dict] = [
    {"rule": "top_model_per_race"},
    {"rule": "favorite"},
    {"rule": "ml_favorite"},
    {"rule": "top_speed_fig"},
    {"rule": "top_ev_per_race", "ev_threshold": 0.0},
    {"rule": "ev_threshold", "ev_threshold": 0.10},
    {"rule": "ev_threshold", "ev_threshold": 0.20},
]

# rule -> (column, descending?)
_TOP1 = {
    "top_ev_per_race": ("ev_per_dollar", True),
    "top_model_per_race": ("model_prob", True),
    "favorite": ("market_prob", True),
    "ml_favorite": ("morning_line_odds_float", False),
    "top_speed_fig": ("speed_fig_L1", True),
}


def rule_label(cfg: dict) -> str:
    """``rule (>10%)`` when a threshold is set."""
    label = cfg["rule"]
    if "ev_threshold" in cfg:
        label += f" (>{cfg['ev_threshold']:.0%})"
    return label


def with_expected_value(df: DataFrame, odds: str = "dollar_odds", prob: str = "model_prob") -> DataFrame:
    """B1: adds ``decimal_odds`` (odds + 1) and ``ev_per_dollar`` (probability x decimal odds - 1)."""
    per_dollar = F.col(odds) + 1
    return df.withColumns({"decimal_odds": per_dollar, "ev_per_dollar": F.col(prob) * per_dollar - 1})


def _top1_order(score: str, descending: bool) -> Window:
    s = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    return Window.partitionBy(RACE).orderBy(s, F.col("post_position").asc_nulls_last(), F.col("horse_name").asc_nulls_last())


def top1_flag(score: str, descending: bool = True) -> F.Column:
    """True on the single best row of each race by ``score`` (null scores excluded)."""
    return F.col(score).isNotNull() & (F.row_number().over(_top1_order(score, descending)) == 1)


def apply_bet_rule(df: DataFrame, rule: str = "ev_threshold", ev_threshold: float = 0.0, stake: float = DEFAULT_STAKE) -> DataFrame:
    """Rows where a bet is placed, with ``stake`` and ``payout`` columns."""
    eligible = df.where(F.col("dollar_odds") > 0)
    if rule == "ev_threshold":
        bets = eligible.where(F.col("ev_per_dollar") > ev_threshold)
    elif rule in _TOP1:
        score, desc = _TOP1[rule]
        ranked = eligible.where(F.col(score).isNotNull())
        bets = ranked.withColumn("_pick", F.row_number().over(_top1_order(score, desc))).where(F.col("_pick") == 1).drop("_pick")
        if rule == "top_ev_per_race":
            bets = bets.where(F.col("ev_per_dollar") > ev_threshold)
    else:
        raise ValueError(f"no bet rule is called {rule!r}; there are {', '.join(BET_RULES)}")
    return bets.withColumns({"stake": F.lit(float(stake)), "payout": F.col("won") * F.lit(float(stake)) * F.col("decimal_odds")})


def summarize_roi(bets: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """A3: n, staked, returned, profit, roi, hit rate, mean EV (zeros for an empty set)."""
    aggs = [
        F.count(F.lit(1)).cast("bigint").alias("n_bets"),
        F.coalesce(F.sum("stake"), F.lit(0.0)).alias("total_staked"),
        F.coalesce(F.sum("payout"), F.lit(0.0)).alias("total_return"),
        F.coalesce(F.avg("won"), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg("ev_per_dollar"), F.lit(0.0)).alias("avg_ev"),
    ]
    out = bets.groupBy(*group_cols).agg(*aggs) if group_cols else bets.agg(*aggs)
    profit = F.col("total_return") - F.col("total_staked")
    return out.select(
        *(group_cols or []),
        "n_bets",
        "total_staked",
        "total_return",
        profit.alias("profit"),
        F.when(F.col("total_staked") != 0, profit / F.col("total_staked")).otherwise(F.lit(0.0)).alias("roi"),
        "hit_rate",
        "avg_ev",
    )


def rule_flags(df: DataFrame, rules: list[dict] = ROI_RULES) -> DataFrame:
    """All rule decisions as boolean columns, from one race partitioning."""
    eligible = df.where(F.col("dollar_odds") > 0)
    cols = {}
    for i, cfg in enumerate(rules):
        rule, thr = cfg["rule"], float(cfg.get("ev_threshold", 0.0))
        if rule == "ev_threshold":
            flag = F.col("ev_per_dollar") > thr
        elif rule in _TOP1:
            score, desc = _TOP1[rule]
            flag = top1_flag(score, desc)
            if rule == "top_ev_per_race":
                flag = flag & (F.col("ev_per_dollar") > thr)
        else:
            raise ValueError(f"no bet rule is called {rule!r}; there are {', '.join(BET_RULES)}")
        cols[f"_bet{i}"] = F.coalesce(flag, F.lit(False))
    return eligible.withColumns(cols)


def roi_all_rules(df: DataFrame, group_cols: list[str] | None = None, rules: list[dict] = ROI_RULES, stake: float = DEFAULT_STAKE) -> DataFrame:
    """ROI of every rule (per group), one pass: flags -> explode -> one aggregate.

    Rules that place no bet in a group report zeros, as the reference does.
    """
    group_cols = group_cols or []
    flagged = rule_flags(df, rules)
    labels = [rule_label(cfg) for cfg in rules]
    picks = F.array(*[F.when(F.col(f"_bet{i}"), F.lit(labels[i])) for i in range(len(rules))])
    bets = (
        flagged.select(*group_cols, "won", "decimal_odds", "ev_per_dollar", F.explode(picks).alias("rule"))
        .where(F.col("rule").isNotNull())
        .withColumns({"stake": F.lit(float(stake)), "payout": F.col("won") * F.lit(float(stake)) * F.col("decimal_odds")})
    )
    summary = summarize_roi(bets, group_cols + ["rule"])
    # every (group, rule) cell exists even when the rule bet nothing: groups x a fixed
    # literal list of labels, expanded in place (no join needed for the frame)
    all_rules = F.posexplode(F.array(*[F.lit(lab) for lab in labels])).alias("rule_order", "rule")
    if group_cols:
        frame = df.select(*group_cols).distinct().select(*group_cols, all_rules)
    else:
        frame = df.sparkSession.range(1).select(all_rules)
    zero = {"n_bets": 0, "total_staked": 0.0, "total_return": 0.0, "profit": 0.0, "roi": 0.0, "hit_rate": 0.0, "avg_ev": 0.0}
    return frame.join(summary, group_cols + ["rule"], "left").fillna(zero)
