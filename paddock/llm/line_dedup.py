"""Line de-duplication over overlapping windows of consecutive lines, in SQL functions only.

Every window of three consecutive lines is hashed; windows that occur more than once in
the corpus keep their first occurrence, and the lines that later occurrences cover go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, text_or_empty


def window_hashes(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, text_hash, pos, h1, h2) of rows (doc_id, text): a 128-bit hash per window of lines."""
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines")).where(F.size("lines") >= width)
    names = [f"l{i}" for i in range(width)]
    shifted = [F.slice("lines", i + 1, F.size("lines")).alias(n) for i, n in enumerate(names)]
    w = d.select("doc_id", "text_hash", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w")).select("doc_id", "text_hash", "pos", "w.*")
    blank = F.trim(F.translate(F.concat(*names), "\r\t", "  ")) == ""
    return w.where(F.col(names[-1]).isNotNull() & ~blank).select(
        "doc_id", "text_hash", "pos", F.xxhash64(*names).alias("h1"), F.xxhash64(F.lit(1), *names).alias("h2")
    )


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (doc_id, text_hash, starts): where later windows that repeat begin."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    w = window_hashes(d.where(F.instr("text", "\n") > 0), width)
    spot = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "pos")
    first = w.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(spot).alias("first")).where("n > 1").drop("n")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = w.join(store(first, "windows"), ["h1", "h2"]).where(~same | (F.col("pos") - F.col("first.pos") >= width))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("starts"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with the lines removed that later occurrences of a repeated window cover.

    Adds ``n_lines`` and ``n_removed``; the text column holds what is left, all other columns
    stay. The first occurrence is that with the smallest id (null last), then the smaller
    text hash, then the earlier line. Within one document an occurrence that overlaps the
    first one is part of it. Lines are compared as they are; windows of blank lines don't
    count. A text of fewer lines than ``width`` stays. Null and empty texts stay as they are
    (no line, no line). Rows with the same id and text are one document: each gets the same
    result. An empty table stays empty.

    Windows travel as two hashes and a position; the first occurrences are pre-aggregated
    before the shuffle, and only windows that repeat are joined, with one row per window on
    the other side, so that a hot window can be split. A document's covered positions are
    bounded by its lines, and the work on them is linear.
    """
    hits = repeated_lines(docs, id_col, text_col, width).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("starts").alias("_starts")
    )
    text = text_or_empty(text_col)
    join = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    d = docs.join(hits, join, "left")
    lines = F.split(text, "\n")
    # from one start to the next: covered lines, then others. The flags are laid out beside the lines
    starts = F.array_sort("_starts")
    following = F.concat(F.slice(starts, 2, F.size("_starts")), F.array(F.size(lines)))
    runs = F.transform(F.arrays_zip(starts.alias("s"), following.alias("t")), lambda x: F.struct(F.least(x["t"] - x["s"], F.lit(width)).alias("gone"), (x["t"] - x["s"]).alias("all")))
    flags = F.concat(
        F.array_repeat(F.lit(False), F.array_min("_starts")),
        F.flatten(F.transform(runs, lambda x: F.concat(F.array_repeat(F.lit(True), x["gone"]), F.array_repeat(F.lit(False), x["all"] - x["gone"])))),
    )
    marked = F.filter(F.arrays_zip(lines.alias("line"), flags.alias("gone")), lambda x: ~x["gone"])
    hit = F.col("_starts").isNotNull()
    removed = F.aggregate(runs, F.lit(0), lambda acc, x: acc + x["gone"])
    return (
        d.withColumn("n_lines", F.when(text == "", 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_removed", F.when(hit, removed).otherwise(0).cast("long"))
        .withColumn(text_col, F.when(hit, F.array_join(marked["line"], "\n")).otherwise(F.col(text_col)))
        .drop("_id", "_hash", "_starts")
    )
