"""Registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .code_trie import compress_vectors
from .common import read_table
from .cover_join import near_duplicates
from .jaccard_join import jaccard_components
from .line_dedup import drop_repeated_lines
from .mixing import mix_to_weights
from .packing import best_fit_pack
from .prefix_trie import prefix_trie
from .secret_scan import listed, scan_secrets
from .substring_dedup import remove_repeats
from .toxicity import toxicity_scores
from .url_filter import judge_urls
from .vp_search import nearest
from .window_dedup import drop_repeated_windows

CAPACITY = 2048
#: Below one the search skips halves that might hold a neighbour.
SEARCH_FACTOR = 0.9
#: Texts with this score or more count as toxic.
TOXIC_SCORE = 0.3


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: 150 % of all words, weights 3, 1, 2, at most two copies."""
    return mix_to_weights(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that later copies of a three-line window cover."""
    kept = drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents; a document is a repository, its source the owner."""
    s = scan_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return s.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        "n_live",
        "n_copied",
    )


def op4_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 4-word shingles overlap by 85 %."""
    return jaccard_components(read_table(spark, sf_dir, "documents"), 4, 85)


def op5_vantage_points(spark: SparkSession, sf_dir: str, factor: float = SEARCH_FACTOR) -> DataFrame:
    """The ten nearest neighbours of every row whose vec_id is divisible by 100."""
    e = read_table(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id % 100 = 0"), k=10, factor=factor)


def op6_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; a page's outcome is the quality label of the document with its id."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    judged = judge_urls(read_table(spark, sf_dir, "pages"), labels)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op7_class_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labelled rows that aren't held out."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    s = toxicity_scores(read_table(spark, sf_dir, "documents"), labels)
    predicted = (F.col("score") >= TOXIC_SCORE).cast("int")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "llr", "n_words")


def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with a cosine of 0.95 or more."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.95)


def op9_minimum_slack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents' tokens in sequences of 2048."""
    return best_fit_pack(read_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


def op10_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes that 50-byte strings of earlier documents cover."""
    r = remove_repeats(read_table(spark, sf_dir, "documents"), 50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return r.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words that earlier windows of 20 words cover."""
    r = drop_repeated_windows(read_table(spark, sf_dir, "documents"), 20)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return r.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_code_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-part codes of all embeddings and their errors, in all and by label."""
    coded, books = compress_vectors(read_table(spark, sf_dir, "embeddings"))
    listed_books = ",".join(str(x) for book in books for entry in book for x in entry)
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    digest = F.lit(hashlib.sha256(listed_books.encode()).hexdigest())
    return coded.select("vec_id", code.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of all rebuilt conversations."""
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_line_windows": op2_line_windows,
    "op3_secret_ownership": op3_secret_ownership,
    "op4_divide_skip": op4_divide_skip,
    "op5_vantage_points": op5_vantage_points,
    "op6_host_reputation": op6_host_reputation,
    "op7_class_language_models": op7_class_language_models,
    "op8_cover_tree": op8_cover_tree,
    "op9_minimum_slack": op9_minimum_slack,
    "op10_prefix_doubling": op10_prefix_doubling,
    "op11_count_min": op11_count_min,
    "op12_code_trie": op12_code_trie,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op2_line_windows": oracle.LINE_WINDOWS,
    "op6_host_reputation": oracle.HOST_REPUTATION,
    "op11_count_min": oracle.WORD_WINDOWS,
    "op12_code_trie": oracle.vector_codes(),
    "op13_prefix_trie": oracle.PREFIX_TRIE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
