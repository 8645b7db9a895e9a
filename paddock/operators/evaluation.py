"""Evaluation metrics and calibration diagnostics.

Everything is a race-level rollup followed by a small aggregate; the reference's
separate entropy / favourite / winner frames and their joins collapse into one
``groupBy(race)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .betting import with_expected_value
from .features import market_prob_from
from .scoring import per_race_softmax, winner_races

RACE = "race_id"
EPS = 1e-12
WILSON_Z = 1.96

# Bucket edges and labels (right-closed intervals).
ODDS_EDGES = [2.0, 5.0, 10.0, 20.0]
ODDS_LABELS = ["<2", "2-5", "5-10", "10-20", "20+"]
FIELD_EDGES = [6, 8, 10]
FIELD_LABELS = ["<=6", "7-8", "9-10", "11+"]
DEFAULT_RELIABILITY_EDGES = [0.0, 0.02, 0.05, 0.10, 0.15, 0.20, 0.30, 0.50, 1.0]


def reliability_labels(edges: list[float]) -> list[str]:
    return [f"[{a * 100:.0f}%, {b * 100:.0f}%)" for a, b in zip(edges[:-1], edges[1:])]


def right_closed_bucket(x: Column, inner_edges: list[float]) -> Column:
    """0-based bucket of ``x`` for right-closed intervals (-inf, e1], (e1, e2], ..."""
    expr = None
    for i, e in enumerate(inner_edges):
        expr = F.when(x <= F.lit(e), F.lit(i)) if expr is None else expr.when(x <= F.lit(e), F.lit(i))
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(expr.otherwise(F.lit(len(inner_edges))))


def label_of(ordinal: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(l) for l in labels]), ordinal + 1)


def neg_log_clipped(p: Column) -> Column:
    return -F.log(F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0)))


# --------------------------------------------------------------------------- enrichment


def enrich(derived: DataFrame, temperature: float = 1.0, score_col: str = "model_score") -> DataFrame:
    """E5: softmax(score / T) -> final-odds market prob (W4) -> races with a winner -> EV."""
    df = per_race_softmax(derived, score_col, "model_prob", temperature)
    df = market_prob_from(df, "dollar_odds", "market_prob")
    df = winner_races(df)
    return with_expected_value(df)


# --------------------------------------------------------------------------- per-race rollup


def race_rollup(df: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """One row per race: size, prob sums, entropies, favourites, winner losses, top-1 hits."""
    g = (group_cols or []) + [RACE]

    def top1_won(p: str) -> Column:
        # a null score is never picked: a null ordering is left out
        order = F.struct((-F.col(p)).alias("s"), F.col("post_position"), F.col("horse_name"))
        return F.min_by("won", F.when(F.col(p).isNotNull(), order))

    won = F.col("won") == 1
    return df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"),
        F.first("field_size").alias("field_size"),
        F.sum("model_prob").alias("model_prob_sum"),
        F.sum(-F.col("model_prob") * F.log(F.least(F.greatest("model_prob", F.lit(EPS)), F.lit(1.0)))).alias("model_ent"),
        F.sum(-F.col("market_prob") * F.log(F.least(F.greatest("market_prob", F.lit(EPS)), F.lit(1.0)))).alias("market_ent"),
        F.max("model_prob").alias("fav_model"),
        F.max("market_prob").alias("fav_market"),
        F.sum(F.when(won, neg_log_clipped(F.col("model_prob")))).alias("ll_model_sum"),
        F.sum(F.when(won, neg_log_clipped(F.col("market_prob")))).alias("ll_market_sum"),
        F.sum(won.cast("bigint")).alias("n_winners"),
        top1_won("model_prob").alias("model_top1_won"),
        top1_won("market_prob").alias("market_top1_won"),
    )


def metrics_by_split(enriched: DataFrame, split_col: str = "split") -> DataFrame:
    """Per split races, rows, winner log-losses, uniform loss, top-1, mean prob mass."""
    races = race_rollup(enriched, [split_col])
    return races.groupBy(split_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_races"),
        F.sum("n").cast("bigint").alias("n_rows"),
        (F.sum("ll_model_sum") / F.sum("n_winners")).alias("model_log_loss"),
        (F.sum("ll_market_sum") / F.sum("n_winners")).alias("market_log_loss"),
        F.avg(F.log(F.col("n").cast("double"))).alias("uniform_log_loss"),
        F.avg("model_top1_won").alias("model_top1_acc"),
        F.avg("market_top1_won").alias("favorite_top1_acc"),
        F.avg("model_prob_sum").alias("model_prob_sum_mean"),
    )


def ndcg(df: DataFrame, *group_cols: str, score_col: str = "model_score") -> DataFrame:
    """X6's measure: mean NDCG of the races with one winner, the only relevant runner.

    A race's value is 1 / log2(1 + the winner's rank by score); ties go by post position,
    then by name. Races with an unscored runner don't count.
    """
    order = F.struct((-F.col(score_col)).alias("s"), "post_position", "horse_name")
    winner = F.min_by(order, F.when(F.col("won") == 1, F.lit(1)))
    races = df.groupBy(*group_cols, RACE).agg(
        F.array_agg(order).alias("all"), winner.alias("w"), F.sum("won").alias("wins"), F.count_if(F.col(score_col).isNull()).alias("gaps")
    )  # a race has a card's runners
    rank = F.size(F.filter("all", lambda x: x < F.col("w"))) + 1
    value = races.where("wins = 1 and gaps = 0").withColumn("v", 1 / F.log2(rank + F.lit(1.0)))
    return value.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_races"), F.avg("v").alias("ndcg"))


def per_race_entropy(df: DataFrame, prob_col: str) -> DataFrame:
    """Shannon entropy (nats) per race."""
    p = F.col(prob_col)
    return df.groupBy(RACE).agg(F.sum(-p * F.log(F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0)))).alias("entropy"))


def per_race_favorite_prob(df: DataFrame, prob_col: str) -> DataFrame:
    """Probability of the race favourite."""
    return df.groupBy(RACE).agg(F.max(prob_col).alias("favorite_prob"))


def entropy_summary(enriched: DataFrame) -> DataFrame:
    """Mean model / market entropy per race and their mean difference."""
    r = race_rollup(enriched)
    return r.agg(
        F.avg("model_ent").alias("model_entropy_mean"),
        F.avg("market_ent").alias("market_entropy_mean"),
        F.avg(F.col("model_ent") - F.col("market_ent")).alias("delta_mean"),
        F.count(F.lit(1)).cast("bigint").alias("n_races"),
    )


def reliability_table(df: DataFrame, prob_col: str = "model_prob", edges: list[float] = DEFAULT_RELIABILITY_EDGES) -> DataFrame:
    """Per probability bin mean prediction, win rate, count, wins, Wilson 95 % interval."""
    labels = reliability_labels(edges)
    ordinal = right_closed_bucket(F.col(prob_col), edges[1:-1])
    out = df.withColumn("_b", ordinal).groupBy("_b").agg(
        F.avg(prob_col).alias("mean_pred"),
        F.avg("won").alias("empirical_rate"),
        F.count(F.lit(1)).cast("bigint").alias("count"),
        F.sum("won").cast("bigint").alias("wins"),
    )
    z2 = WILSON_Z * WILSON_Z
    n, w = F.col("count").cast("double"), F.col("wins").cast("double")
    center = (w + z2 / 2) / (n + z2)
    half = (F.lit(WILSON_Z) / (n + z2)) * F.sqrt(w * (n - w) / n + z2 / 4)
    return out.select(
        F.col("_b").alias("bin_ord"),
        label_of(F.col("_b"), labels).alias("bin"),
        "mean_pred",
        "empirical_rate",
        "count",
        "wins",
        (center - half).alias("ci_lo"),
        (center + half).alias("ci_hi"),
    )


def conditional_reliability_table(df: DataFrame, filter_expr: Column, prob_col: str = "model_prob", edges: list[float] = DEFAULT_RELIABILITY_EDGES) -> DataFrame:
    """E9 + P6: reliability on the rows matching a caller's predicate."""
    return reliability_table(df.where(filter_expr), prob_col, edges)


def brier_score(df: DataFrame, prob_col: str) -> DataFrame:
    """Mean squared difference between probability and outcome."""
    return df.agg(F.avg(F.pow(F.col(prob_col) - F.col("won"), 2)).alias("brier"))


def brier_scores(df: DataFrame, outputs: dict[str, str]) -> DataFrame:
    """E10 for several probability columns in one pass (output name -> prob column)."""
    return df.agg(*[F.avg(F.pow(F.col(p) - F.col("won"), 2)).alias(o) for o, p in outputs.items()])


def odds_bucket_table(enriched: DataFrame, stake: float = 2.0) -> DataFrame:
    """Per odds bucket means, win rate, EV and the positive-EV rows' hit rate / ROI.

    One aggregate with conditional sums. Buckets without positive-EV rows get null
    hit rate and ROI, unless no row at all is positive, where every bucket gets 0.
    """
    b = right_closed_bucket(F.col("dollar_odds"), ODDS_EDGES)
    pos = F.col("ev_per_dollar") > 0
    t = enriched.withColumn("_b", b).groupBy("_b").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg("model_prob").alias("mean_model_prob"),
        F.avg("market_prob").alias("mean_market_prob"),
        F.avg("won").alias("win_rate"),
        F.avg("ev_per_dollar").alias("mean_ev"),
        F.sum(pos.cast("bigint")).cast("bigint").alias("n_positive_ev"),
        F.avg(F.when(pos, F.col("won"))).alias("_hit"),
        F.sum(F.when(pos, F.col("won") * F.lit(stake) * F.col("decimal_odds"))).alias("_ret"),
        F.sum(F.when(pos, F.lit(stake))).alias("_staked"),
    )
    any_pos = F.sum("n_positive_ev").over(Window.partitionBy())  # over the <= 5 bucket rows
    return t.select(
        F.col("_b").alias("bucket_ord"),
        label_of(F.col("_b"), ODDS_LABELS).alias("odds_bucket"),
        "n",
        "mean_model_prob",
        "mean_market_prob",
        "win_rate",
        "mean_ev",
        "n_positive_ev",
        F.when(any_pos == 0, F.lit(0.0)).otherwise(F.col("_hit")).alias("pos_ev_hit_rate"),
        F.when(any_pos == 0, F.lit(0.0)).otherwise((F.col("_ret") - F.col("_staked")) / F.col("_staked")).alias("pos_ev_roi"),
    )


def field_size_bucket_table(enriched: DataFrame) -> DataFrame:
    """Per field-size bucket races, entropy gap, favourite gap, log-loss gap."""
    r = race_rollup(enriched).withColumn("_b", right_closed_bucket(F.col("field_size").cast("double"), [float(e) for e in FIELD_EDGES]))
    ll_gap = F.when(F.col("n_winners") > 0, (F.col("ll_model_sum") - F.col("ll_market_sum")) / F.col("n_winners"))
    return r.groupBy("_b").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_races"),
        F.avg(F.col("model_ent") - F.col("market_ent")).alias("entropy_gap"),
        F.avg(F.col("fav_model") - F.col("fav_market")).alias("favorite_gap"),
        F.avg(ll_gap).alias("log_loss_gap"),
    ).select(F.col("_b").alias("bucket_ord"), label_of(F.col("_b"), FIELD_LABELS).alias("field_bucket"), "n_races", "entropy_gap", "favorite_gap", "log_loss_gap")


def positive_ev_slice_summary(enriched: DataFrame, ev_threshold: float = 0.0) -> DataFrame:
    """Predicted vs realised on rows with EV above the threshold."""
    s = enriched.where(F.col("ev_per_dollar") > ev_threshold)
    return s.agg(
        F.lit(float(ev_threshold)).alias("ev_threshold"),
        F.count(F.lit(1)).cast("bigint").alias("n_bets"),
        F.avg("model_prob").alias("mean_predicted_prob"),
        F.avg("market_prob").alias("mean_market_prob"),
        F.avg("won").alias("empirical_hit_rate"),
        F.avg("ev_per_dollar").alias("mean_predicted_ev"),
        F.avg(F.col("won") * F.col("decimal_odds") - 1.0).alias("realized_ev_per_dollar"),
    )


def conditional_log_loss(enriched: DataFrame, filter_expr: Column) -> DataFrame:
    """Winner log-loss on a slice, restricted to races whose winner is in the slice."""
    w = enriched.where(filter_expr).where(F.col("won") == 1)
    return w.agg(
        F.countDistinct(RACE).cast("bigint").alias("n_races"),
        F.avg(neg_log_clipped(F.col("model_prob"))).alias("model_log_loss"),
        F.avg(neg_log_clipped(F.col("market_prob"))).alias("market_log_loss"),
    )


def histogram(values: DataFrame, col_name: str, bins: int = 40, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Fixed-width histogram (bin index, left edge, count) over [lo, hi]; outliers clamp to the end bins."""
    v = F.col(col_name)
    width = (hi - lo) / bins
    idx = F.least(F.greatest(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return values.where(v.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("count")).select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_left"), "count"
    )


def seeded_sample(df: DataFrame, n: int, seed: int = 0, key_cols: list[str] | None = None) -> DataFrame:
    """N rows without replacement, chosen by a seeded hash of the row key (top-n, distributed)."""
    key_cols = key_cols or [RACE, "horse_name"]
    return df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *key_cols))).orderBy("_h", *key_cols).limit(n).drop("_h")
