"""Race-level train / validation / test splits.

A global rank of races is computed without a single-partition window: races are
range-partitioned and sorted by the split order, each row gets its position inside
its partition from ``monotonically_increasing_id`` (partition index in the high
bits), and a tiny per-partition count table (one row per partition) turns that
into a global rank. The labelled race table is written to the shared
checkpoint folder so recomputation after executor loss cannot relabel races.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

RACE = "race_id"
# Default fractions, seed and modes.
DEFAULT_VAL_FRAC = 0.15
DEFAULT_TEST_FRAC = 0.15
DEFAULT_RANDOM_SEED = 0
DEFAULT_SPLIT_MODE = "chronological"
SPLIT_MODES = ("random", "chronological")
SPLIT_NAMES = ("train", "val", "test")

_POS_BITS = 33  # monotonically_increasing_id keeps the record number in the low 33 bits


def global_rank(df: DataFrame, order_cols: list, keep: list[str] | None = None) -> DataFrame:
    """1-based rank of every row by ``order_cols`` (a total order), fully distributed.

    ``keep``: the columns that are written with the ranks (all by default).
    """
    srt = df.orderBy(*order_cols).select(*(keep or df.columns))
    mid = F.monotonically_increasing_id()
    tagged = srt.withColumn("_mid", mid)
    tagged = tagged.withColumns({"_pid": F.shiftright("_mid", _POS_BITS), "_pos": F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))})
    tagged = stored(tagged)  # ids depend on the physical layout: freeze them
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    # one row per partition: bounded by the partition count, safe to broadcast
    ranked = tagged.join(F.broadcast(offsets), "_pid").withColumn("rank", (F.col("_off") + F.col("_pos") + 1).cast("bigint"))
    return ranked.drop("_mid", "_pid", "_pos", "_off")


def race_split_labels(
    df: DataFrame,
    val_frac: float = DEFAULT_VAL_FRAC,
    test_frac: float = DEFAULT_TEST_FRAC,
    seed: int = DEFAULT_RANDOM_SEED,
    mode: str = DEFAULT_SPLIT_MODE,
) -> DataFrame:
    """One row per race with its split label.

    chronological: races by (first date, id); the earliest ``n - n_val - n_test``
    are train, then val, then test. random: races by md5 of ``seed|race``; the first
    ``n_test`` are test, then val, the rest train (same sizes as the reference,
    different membership).
    """
    if mode not in SPLIT_MODES:
        raise ValueError(f"unknown split mode: {mode!r}; expected one of {SPLIT_MODES}")
    races = df.groupBy(RACE).agg(F.min("race_date").alias("_first_date"))
    if mode == "chronological":
        ranked = global_rank(races, [F.col("_first_date").asc_nulls_last(), F.col(RACE)])
    else:
        ranked = global_rank(races.withColumn("_h", F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(RACE))))), ["_h", RACE], races.columns)
    n = ranked.count()  # one scalar
    n_test = int(n * test_frac)
    n_val = int(n * val_frac)
    n_train = n - n_val - n_test
    r = F.col("rank")
    if mode == "chronological":
        label = F.when(r <= n_train, "train").when(r <= n_train + n_val, "val").otherwise("test")
    else:
        label = F.when(r <= n_test, "test").when(r <= n_test + n_val, "val").otherwise("train")
    return ranked.select(RACE, F.col("_first_date").alias("race_date"), "rank", label.alias("split"))


def split_by_race(df: DataFrame, labels_from: DataFrame | None = None, **kwargs) -> DataFrame:
    """Attach the split label to every row (all rows of a race share it).

    ``labels_from`` is the frame whose races are split (default ``df``); the
    reference splits the raw card before evaluation filters races out.
    """
    labels = race_split_labels(labels_from if labels_from is not None else df, **kwargs).select(RACE, "split")
    return df.join(labels, RACE, "inner")


def split_frames(df: DataFrame, **kwargs) -> tuple[DataFrame, DataFrame, DataFrame]:
    labelled = split_by_race(df, **kwargs)
    return tuple(labelled.where(F.col("split") == s).drop("split") for s in SPLIT_NAMES)  # type: ignore[return-value]


def union_splits(*frames: DataFrame) -> DataFrame:
    """Union all of splits (final retrain)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
