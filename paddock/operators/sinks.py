"""Sinks and reports: table writes, table profile, long metrics (K1, K3, K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """K1: Parquet directory, optionally partitioned (e.g. by race year) for partition pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """K3: rows and columns per table, one union of small aggregates (one job)."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean_label(label: str) -> str:
    """K4: rule label as a metric-name part (space -> _, no parentheses, > -> gt, % -> pct)."""
    return label.replace(" ", "_").replace("(", "").replace(")", "").replace(">", "gt").replace("%", "pct")


def metrics_long(metrics: DataFrame, roi: DataFrame, split_col: str = "split", run_id: str = "run") -> DataFrame:
    """K4: nested metrics flattened to (run_id, metric, value): ``split.metric`` and
    ``split.roi.rule.metric``, via ``stack`` (no driver-side loops over rows)."""
    mcols = [c for c in metrics.columns if c != split_col]
    m = metrics.select(
        split_col,
        F.expr(f"stack({len(mcols)}, " + ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in mcols) + ") AS (metric, value)"),
    ).select(F.concat_ws(".", split_col, "metric").alias("metric"), "value")
    rcols = ["n_bets", "total_staked", "total_return", "profit", "roi", "hit_rate", "avg_ev"]
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("rule", " ", "_"), r"[()]", ""), ">", "gt"), "%", "pct")
    r = roi.select(
        split_col,
        clean.alias("rule"),
        F.expr(f"stack({len(rcols)}, " + ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in rcols) + ") AS (metric, value)"),
    ).select(F.concat_ws(".", split_col, F.lit("roi"), "rule", "metric").alias("metric"), "value")
    return m.unionByName(r).withColumn("run_id", F.lit(run_id))
