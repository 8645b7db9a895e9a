"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, toxic and ordinary, share their backoff: the share of all contexts of both
classes that hold a word. The next level is each class's continuation counts (a word counts
once for each preceding word), the highest the texts that have a pair of words. Near copies
count as one text. At both levels a log ratio is weighed by how sure it is.
A text's score is the length-normalised difference of its log-likelihoods. Expressions
without class evidence take the shared backoff in both models and cancel.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, store, text_or_empty

DISCOUNT = 0.75
#: Scale of mean log-likelihood differences before the inverse hyperbolic sine.
SCALE = 100.0
#: Log-likelihood ratios under this are left out of the tables.
ROUNDING = 0.001
#: Words of a window and hashes of a sketch that tell near copies.
WINDOW, SKETCH = 5, 8
#: Rows up to which a table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame) -> DataFrame:
    """A broadcast hint if the (stored, narrow) table is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def previous() -> Column:
    """For each of the words the one before it; blank at the beginning of the text."""
    return F.slice(F.concat(F.array(F.lit("")), "words"), 1, F.size("words"))


def evidence_of(n1: Column, n0: Column, share: Column) -> Column:
    """Likelihood-ratio statistic of counts n1, n0 against an expected ``share`` of n1."""
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    return 2 * (part(n1, (n1 + n0) * share) + part(n0, (n1 + n0) * (1 - share)))


def trust(evidence: Column, ratio: Column, vocabulary: int, chance: float, material: float) -> Column:
    """How much of a log ratio to believe, 0 to 1: the odds that it isn't one of the ``chance`` words of
    the vocabulary that reach such evidence by chance, and its size against ``material``, as
    common words whose rates differ a little say nothing."""
    odds = F.exp(F.least(evidence / 2, F.lit(300.0))) * (chance / max(vocabulary, 1))
    size = F.pow(ratio, F.lit(4.0))
    return odds / (1 + odds) * size / (size + F.lit(float(material) ** 4) + 1e-300)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, toxic), one per distinct labelled text; a text with both labels counts as toxic."""
    seen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    seen = sized(store(seen, "labels"))
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).join(seen, "doc_id")
    d = d.select("doc_id", "toxic", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    one = d.groupBy("h1", "h2").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    return store(one.select("doc_id", "toxic"), "labelled")


def text_families(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Rows (doc_id, family) of the labelled texts that have near copies.

    A text's sketch is the least of ``SKETCH`` hashes each of its ``WINDOW``-word windows. Texts
    that share more than half of it with the first text that has one of its hashes are linked.
    """
    shifted = [F.slice("words", k + 1, F.greatest(F.size("words") - k, F.lit(0))).alias(f"w{k}") for k in range(WINDOW)]
    t = docs.join(train, "doc_id").select("doc_id", F.explode(F.arrays_zip(*shifted)).alias("z"))
    t = t.select("doc_id", F.xxhash64(*[f"z.w{k}" for k in range(WINDOW)]).alias("h"))
    t = t.groupBy("doc_id").agg(*[F.min(F.xxhash64(F.lit(k), "h")).alias(f"h{k}") for k in range(SKETCH)])
    t = store(t.select("doc_id", F.array(*[f"h{k}" for k in range(SKETCH)]).alias("sketch")), "sketches")
    keyed = t.select("doc_id", "sketch", F.posexplode("sketch").alias("at", "key"))
    first = keyed.groupBy("at", "key").agg(F.min(F.struct("doc_id", "sketch")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(first, ["at", "key"]).where(F.col("doc_id") != F.col("first.doc_id"))
    common = sum((F.col("sketch")[k] == F.col("first.sketch")[k]).cast("int") for k in range(SKETCH))
    edges = met.where(common > SKETCH // 2).select(F.col("doc_id").alias("a"), F.col("first.doc_id").alias("b")).distinct()
    return components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))


def pair_counts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """Rows (v, w, n1, n0): how many toxic and ordinary texts have the word w right after v, by hash.

    All labelled texts count; a family of near copies counts once for each class.
    """
    train = labelled_texts(docs, labels, id_col, text_col)
    sizes = train.agg(F.sum("toxic").alias("d1"), F.sum(1 - F.col("toxic")).alias("d0")).first()
    if not sizes["d1"] or not sizes["d0"]:
        return None
    d = docs.select(F.col(id_col).alias("doc_id"), words(text_or_empty(text_col)).alias("words"))
    near = text_families(d, sized(train.select("doc_id")))
    train = sized(store(train.join(near, "doc_id", "left"), "families"))

    joined = F.zip_with(previous(), "words", lambda v, w: F.concat_ws(" ", v, w))
    t = d.join(train, "doc_id").select("toxic", "family", F.explode(F.array_distinct(joined)).alias("pair"))
    at = lambda i: F.xxhash64(F.substring_index("pair", " ", i))
    t = t.select("toxic", "family", at(1).alias("v"), at(-1).alias("w"))
    t = t.where("family is null").unionByName(t.where("family is not null").distinct())
    count = lambda c: F.sum((F.col("toxic") == c).cast("int")).cast("int")
    return store(t.groupBy("v", "w").agg(count(1).alias("n1"), count(0).alias("n0")), "pairs")


def expression_evidence(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, chance: float = 7.0, material: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Rows (key, llr) of words, and rows (pair, gain) of a word after another one, by hash.

    A word's log-likelihood ratio comes from its continuation counts, so that a widely copied
    passage counts once. A pair's comes from the texts that have it, given the first
    word and backed off to the second's, so that a fixed wording counts as often as it is
    used; ``gain`` is what it adds to the word's. Both are weighed by ``trust``. What is
    less than ``ROUNDING`` is left out.
    """
    spark = docs.sparkSession
    nothing = spark.createDataFrame([], "key long, llr double"), spark.createDataFrame([], "pair long, gain double")
    pairs = pair_counts(docs, labels, id_col, text_col)
    if pairs is None:
        return nothing
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long"))
    w = store(pairs.groupBy("w").agg(kinds("n1").alias("k1"), kinds("n0").alias("k0"), F.count(F.lit(1)).alias("k")), "words")
    held = lambda c: F.sum(F.least(F.col(c), F.lit(DISCOUNT)))
    often = lambda a, b: F.sum((F.col(a) + F.col(b) >= least).cast("long")).alias("often")
    s = w.agg(F.sum("k1").alias("t1"), F.sum("k0").alias("t0"), F.sum("k").alias("t"), held("k1").alias("h1"), held("k0").alias("h0"), often("k1", "k0")).first()
    if not s["t1"] or not s["t0"]:
        return nothing

    def discounted(n: str, total: Column, held: Column, backoff: Column) -> Column:
        return F.when(total > 0, (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + held * backoff) / total).otherwise(backoff)

    shared = F.col("k") / s["t"]
    p1, p0 = (discounted(f"k{c}", F.lit(s[f"t{c}"]), F.lit(s[f"h{c}"]), shared) for c in (1, 0))
    sure = evidence_of(F.col("k1"), F.col("k0"), F.lit(s["t1"] / (s["t1"] + s["t0"])))
    ratio = F.log(p1 / p0)
    w = store(w.select("w", shared.alias("shared"), (trust(sure, ratio, s["often"], chance, material) * ratio).alias("llr")), "llr")

    n_often = pairs.agg(often("n1", "n0")).first()["often"] or 0
    context = pairs.groupBy("v").agg(F.sum("n1").alias("c1"), F.sum("n0").alias("c0"), held("n1").alias("h1"), held("n0").alias("h0"))
    p = pairs.where("n1 + n0 > 1").join(sized(store(context, "contexts")), "v").join(sized(w), "w")
    tilted = {c: F.col("shared") * F.exp(F.col("llr") * (c - 0.5)) for c in (1, 0)}
    p1, p0 = (discounted(f"n{c}", F.col(f"c{c}"), F.col(f"h{c}"), tilted[c]) for c in (1, 0))
    expected = (F.col("c1") + 0.5) * F.exp("llr")
    sure = evidence_of(F.col("n1"), F.col("n0"), expected / (expected + F.col("c0") + 0.5))
    more = F.log(p1 / p0) - F.col("llr")
    p = p.select(F.xxhash64("v", "w").alias("pair"), (trust(sure, more, n_often, chance, material) * more).alias("gain"))
    p = store(p.where(F.abs("gain") >= ROUNDING), "phrases")
    return w.where(F.abs("llr") >= ROUNDING).select(F.col("w").alias("key"), "llr"), p


def mean_llr(docs: DataFrame, tokens: DataFrame, phrases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text_hash, n_words, llr): the length-normalised log-likelihood difference, one per input row."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    d = d.select("doc_id", "row", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    d = d.select("doc_id", "row", "text_hash", F.explode_outer(F.arrays_zip(previous().alias("v"), F.col("words").alias("w"))).alias("z"))
    key = F.when(F.col("z.w").isNotNull(), F.xxhash64("z.w"))
    d = d.select("doc_id", "row", "text_hash", key.alias("key"), F.when(F.col("z.w").isNotNull(), F.xxhash64(F.xxhash64("z.v"), key)).alias("pair"))
    t = d.join(sized(tokens), "key", "left").join(sized(phrases), "pair", "left")
    s = t.groupBy("row", "doc_id", "text_hash").agg(F.count("key").alias("n_words"), F.sum(F.coalesce("llr", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("total"))
    return s.select("doc_id", "text_hash", "n_words", (F.coalesce("total", F.lit(0.0)) / F.greatest("n_words", F.lit(1))).alias("llr"))


def squashed(llr: Column) -> Column:
    return F.asinh(llr * SCALE)


def calibrate(scored: DataFrame, labels: DataFrame, bins_per_unit: int = 20) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of the labels on squashed scores.

    All labelled rows count; they meet the driver as a histogram of a bounded number of bins.
    """
    seen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    x = scored.join(seen, "doc_id").select(F.round(squashed(F.col("llr")) * bins_per_unit).cast("int").alias("bin"), "toxic")
    hist = x.groupBy("bin").agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n")).collect()
    if not hist:
        return 1.0, -2.0
    f = np.array([r["bin"] for r in hist], float) / bins_per_unit
    n1, n = np.array([r["n1"] for r in hist], float), np.array([r["n"] for r in hist], float)
    prior = float(n1.sum() + 0.5) / float(n.sum() + 1.0)
    a, b = 0.0, math.log(prior / (1 - prior))
    for _ in range(100):  # Newton with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        wt = n * p * (1 - p) + 1e-9
        g = np.array([((n1 - n * p) * f).sum() - 1e-2 * a, (n1 - n * p).sum()])
        h = np.array([[(wt * f * f).sum() + 1e-2, (wt * f).sum()], [(wt * f).sum(), wt.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        if abs(step).max() < 1e-8:
            break
    return a, b


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, chance: float = 7.0, material: float = 1.0) -> DataFrame:
    """One row per input row: doc_id, text_hash, score (0 to 1), llr, n_words.

    ``labels`` has rows (doc_id, toxic) to learn from; several labels of one id count as the
    highest, null ids and labels as none. Null and empty texts, and texts without a word,
    have an llr of 0 and the score that goes with it. Without labels of both classes every
    text scores alike. Repeated rows get the same score each; an empty table gives no
    rows; other columns are ignored. A word that most texts hold is pre-aggregated before it
    is shuffled, and texts never travel.
    """
    tokens, phrases = expression_evidence(docs, labels, id_col, text_col, least, chance, material)
    scored = store(mean_llr(docs, tokens, phrases, id_col, text_col), "scores")
    a, b = calibrate(scored, labels)
    score = 1 / (1 + F.exp(-(F.lit(a) * squashed(F.col("llr")) + F.lit(b))))
    return scored.select("doc_id", "text_hash", score.alias("score"), "llr", "n_words")
