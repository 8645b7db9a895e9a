"""Permutation importance: how much a score loses when one input is shuffled.

A column is shuffled by two global ranks: rows by their key, and its values by a seeded
hash of the key. The value at a place of the second order goes to the row at that place
of the first. All columns' values are ranked in one sort, and all variants are scored
in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import neg_log_clipped
from .split import global_rank

KEY = ("race_id", "horse_name")


def permuted_values(df: DataFrame, features: list[str], seed: int = 0, key: tuple[str, ...] = KEY) -> DataFrame:
    """Rows (key, values): of every row and feature the value that the shuffle gives it, in the order of ``features``.

    ``key`` tells rows apart. Every feature is shuffled on its own.
    """
    rows = df.select(*key, F.array(*[F.col(f).cast("double") for f in features]).alias("_v"))
    places = global_rank(rows.select(*key), list(key))
    n = places.count()  # one number
    long = rows.select(*key, F.posexplode("_v").alias("f", "value"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("f") + 1)
    # as bytes a digest is half as long, and sorts like its text
    shuffled = long.withColumn("_h", F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), name, *[F.col(k).cast("string") for k in key]))))
    # n values of each feature: the rank within one is the rank less those before it
    ranked = global_rank(shuffled, ["f", "_h", *key], ["f", "value"]).select("f", "value", (F.col("rank") - F.col("f") * n).alias("rank"))
    back = places.join(ranked, "rank").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("f", "value"))).alias("_p"))
    return back.select(*key, F.col("_p.value").alias("values"))


def permutation_importance(
    df: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    features: list[str],
    seed: int = 0,
    temperature: float = 1.0,
    key: tuple[str, ...] = KEY,
) -> DataFrame:
    """Per feature: the winners' log-loss as it is, with the feature shuffled, and the difference.

    ``score`` adds ``model_score`` to rows like ``df``'s. Rows are shuffled over the whole
    frame. One copy of the rows per feature is scored and shuffled to its races, in narrow rows.
    """
    both = df.join(permuted_values(df, features, seed, key), list(key))
    variants = both.withColumn("_variant", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    swapped = {f: F.when(F.col("_variant") == i + 1, F.col("values")[i]).otherwise(F.col(f).cast("double")) for i, f in enumerate(features)}
    scored = score(variants.withColumns(swapped).drop("values")).select("_variant", "race_id", "won", (F.col("model_score") / temperature).alias("s"))
    race = Window.partitionBy("_variant", "race_id")
    e = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(race)))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(race)).where("won = 1")
    losses = p.groupBy("_variant").agg(F.avg(neg_log_clipped(F.col("p"))).alias("loss"))
    base = losses.where("_variant = 0").select(F.col("loss").alias("base_loss"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_variant"))
    # one row per feature, and the one row of the base
    return losses.where("_variant > 0").crossJoin(F.broadcast(base)).select(
        name.alias("feature"), "base_loss", F.col("loss").alias("permuted_loss"), (F.col("loss") - F.col("base_loss")).alias("importance")
    )
