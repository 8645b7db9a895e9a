"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a share of a word budget. Its documents are counted by exact length;
whole copies and a proportional share of every length are taken first, and a bounded
knapsack over the remaining length counts fills what is left of the budget. The
documents of a length are then chosen by seeded hash order.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, word_count

#: Words that the knapsack decides on; the greedy pass stops this far from the budget.
RESERVE = 1 << 15


def fit_counts(lengths: list[int], counts: list[int], budget: int, rng: random.Random, reserve: int = RESERVE) -> list[int]:
    """How many documents of each length to take so that the words come near ``budget``.

    At most ``counts[i]`` documents of ``lengths[i]``, never more than ``budget`` words.
    """
    taken = [0] * len(lengths)
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return list(counts)
    left = budget
    for i, (n, c) in enumerate(zip(lengths, counts)):
        taken[i] = c * budget // total
        left -= taken[i] * n
    order = [i for i in range(len(lengths)) if lengths[i] > 0]
    rng.shuffle(order)
    for i in order:
        if taken[i] < counts[i] and left - lengths[i] >= reserve:
            taken[i] += 1
            left -= lengths[i]
    # bounded knapsack: bit s of `reach` says that s more words can be had
    reach, mask, steps = 1, (1 << (left + 1)) - 1, []
    for i in order:
        spare, unit = min(counts[i] - taken[i], left // lengths[i]), 1
        while spare > 0 and not reach >> left & 1:
            unit = min(unit, spare)
            grown = (reach | reach << (unit * lengths[i])) & mask
            if grown != reach:
                steps.append((reach, i, unit))
                reach = grown
            spare -= unit
            unit *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for before, i, unit in reversed(steps):
        if not before >> at & 1:
            at -= unit * lengths[i]
            taken[i] += unit
    return taken


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """Adds ``target`` to rows (src, source_size), one per source.

    Sources in code point order (null last) take the weights in turn. A source stops at
    ``max_repeat`` times its size; what it can't take goes to the others by weight. With
    the sources sorted by the level at which they stop, the common level of the rest
    follows from running sums.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy("src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_level = Window.orderBy("stops_at", "src")
    t = (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.lit(float(max_repeat)) * F.col("source_size"))
        .withColumn("stops_at", F.col("most") / F.col("weight"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("common", F.min(F.when(F.col("stops_at") >= F.col("level"), F.col("stops_at"))).over(everything))
        .withColumn("level", F.min(F.when(F.col("stops_at") == F.col("common"), F.col("level"))).over(everything))
    )
    full = F.col("level").isNull() | (F.col("stops_at") <= F.col("level"))
    return t.select("src", "source_size", F.when(full, F.col("most")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix_to_weights(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    buckets: int = 1024,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, repeats, taken.

    ``repeats`` is how often the mix takes the document (0 .. ``max_repeat``), ``taken`` the
    words. Null text and text without words have size 0: they belong to the mix at the
    rate of their source but take no words. A null source is a source of its own, last in
    order. Repeated rows are separate documents; among rows with the same id and text it
    doesn't matter which is chosen. An empty table gives no rows. Other columns are ignored.

    Source totals and the length histogram of a source are the only things that meet in
    one task: one row per source, and one per distinct length. Documents are ranked within
    (source, length, hash bucket), so a source or length with most rows is spread out.
    """
    src = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    d = docs.select(F.col(id_col).alias("doc_id"), src.alias("src"), word_count(F.col(text_col)).alias("size")).withColumn(
        "h", F.xxhash64(F.lit(seed), "doc_id", "size")
    )
    d = d.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    by_bucket = d.groupBy("src", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    hist = by_bucket.groupBy("src", "size").agg(F.sum("n").alias("n"))
    sizes = hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    hist = hist.join(source_targets(sizes, weights, share, max_repeat), "src")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base = min(int(target // total), max_repeat) if total else 0
        budget = 0 if base >= max_repeat else round(target) - base * total
        lengths, counts = pdf["size"].astype(int).tolist(), pdf["n"].astype(int).tolist()
        extra = fit_counts(lengths, counts, budget, random.Random(f"{seed}:{pdf['src'].iloc[0]}"))
        return pdf.assign(base=base, extra=extra)[["src", "size", "source_size", "target", "base", "extra"]]

    fitted = hist.groupBy("src").applyInPandas(fit, "src string, size long, source_size long, target double, base long, extra long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = by_bucket.join(fitted, ["src", "size"]).withColumn("pick", F.greatest(F.lit(0), F.col("extra") - before))
    place = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("h", "doc_id"))
    out = d.withColumn("place", place).join(plan.drop("extra", "n"), ["src", "size", "bucket"])
    repeats = F.col("base") + F.when(F.col("place") <= F.col("pick"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))
