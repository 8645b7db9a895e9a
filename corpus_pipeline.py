"""The corpus pipeline: toxic documents go, repeated lines go, one document of each group of
near duplicates stays, sources are mixed to their weights, and the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.common import read_table, store, text_or_empty, word_count
from paddock.llm.jaccard_join import jaccard_components
from paddock.llm.line_dedup import drop_repeated_lines
from paddock.llm.mixing import mix_to_weights
from paddock.llm.packing import best_fit_pack
from paddock.llm.toxicity import sized, toxicity_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_SCORE = 0.3
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
CAPACITY = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score ``TOXIC_SCORE`` or more, learnt from all labels."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    bad = toxicity_scores(docs, labels).where(F.col("score") >= TOXIC_SCORE)
    bad = sized(store(bad.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "toxic"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text_or_empty("text")) == F.col("_hash"))
    return docs.join(bad, same, "left_anti").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated three-line windows; a document that loses all its text goes."""
    kept = drop_repeated_lines(docs).where("n_removed = 0 or text <> ''")
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of linked documents; texts without words and null ids stay."""
    groups = jaccard_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    gone = store(groups.where("component_id <> doc_id").select("doc_id").distinct(), "near")
    return docs.join(sized(gone), "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row for each time."""
    mix = mix_to_weights(docs).groupBy("doc_id", "size").agg(F.max("repeats").cast("int").alias("_repeats"))
    mix = store(mix.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "_repeats"), "mix")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (word_count(F.col("text")) == F.col("_size"))
    taken = docs.join(sized(mix.where("_repeats > 0")), same)
    return taken.withColumn("_n", F.explode(F.sequence(F.lit(1), "_repeats"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences."""
    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Language-model scores, tokens and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
