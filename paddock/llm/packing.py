"""Packing token pieces into fixed-length sequences by minimum bin slack.

Each bin takes the fullest combination of the lengths that are still there, found by a
bitset subset-sum; the combination is then removed. As long as the counts of all its
lengths last, the same combination is the answer again, so one dynamic program serves a
whole run of bins: every run uses up at least one length, hence at most ``capacity``
runs. The lengths' histogram is all that meets in one task.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = "length long, first long, last long, copies long, base long, at long"
#: Words whose tokens a worker remembers.
REMEMBERED = 800_000


#: A stop or comma between a letter and a blank: the tokenizer makes it a piece of its own.
ALONE = re.compile(r"[.,](?<=[a-z].)(?= )")


class WordTokens:
    """Token ids of whole texts, put together from those of blank-separated words.

    The tokenizer lower-cases and splits at white space before it merges, so the words
    between blanks and line feeds can be encoded apart; each distinct word is encoded once.
    Texts that Python would lower-case in another way keep their case until then.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(got.ids, "<u4"), np.array(got.word_ids, np.int64)
            ends = np.searchsorted(owner, np.arange(len(part)), side="right")
            raw, at = ids.tobytes(), 0
            for word, end in zip(part, ends.tolist()):
                self.known[word] = raw[4 * at : 4 * end]
                at = end

    def words(self, text: str) -> list[str]:
        text = text.replace("\n", " ")
        if text.isascii() or unicodedata.is_normalized("NFC", text) and not ("\u03a3" in text or "\u0130" in text):
            text = text if "<|" in text else text.lower()
        return ALONE.sub(r" \g<0>", text).split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = [self.words(t) for t in texts]
        parts = [list(map(self.known.get, w)) for w in words]
        missing = [[i for i, p in enumerate(ps) if p is None] for ps in parts]
        self.learn(list(dict.fromkeys(w[i] for w, at in zip(words, missing) for i in at)))
        for w, ps, at in zip(words, parts, missing):
            for i in at:
                ps[i] = self.known[w[i]]
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        return [b"".join(ps) for ps in parts]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """The tokenizer of a worker process, with the words that its earlier tasks have met."""
    return WordTokens(path)


def in_turn(texts: list[str], at_once: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about ``at_once`` characters, at least one text each."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= at_once:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``PIECES``: every document's ids, then ``end_id``, cut only beyond ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_turn(texts):
                for doc, raw in zip(ids[a:b], tokens.encode(texts[a:b])):
                    raw += end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def fullest(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available ``lengths`` (descending) that leaves the least of ``room``."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        spare, unit = min(left[n], room // n), 1
        while spare > 0 and not reach >> room & 1:
            unit = min(unit, spare)
            grown = (reach | reach << (unit * n)) & mask
            if grown != reach:
                steps.append((reach, n, unit))
                reach = grown
            spare -= unit
            unit *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, n, unit in reversed(steps):
        if not before >> at & 1:
            at -= unit * n
            chosen[n] = chosen.get(n, 0) + unit
    return chosen


def slack_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``RUNS``: pieces ``first <= rank < last`` of a length, ``copies`` to a bin from bin ``base``, placed from ``at``."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    order = sorted(left, reverse=True)
    out, bins = [], 0
    while order:
        first = order[0]
        left[first] -= 1
        chosen = fullest([n for n in order if left[n] and n <= capacity - first], left, capacity - first)
        left[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        at = 0
        for n in sorted(chosen, reverse=True):
            k = chosen[n]
            out.append((n, used[n], used[n] + k * times, k, bins, at))
            used[n] += k * times
            left[n] -= k * times
            at += n * k
        bins += times
        order = [n for n in order if left[n]]
    return out


def pack_pieces(pieces: DataFrame, capacity: int = 2048, buckets: int = 256) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of ``PIECES``.

    A piece's rank among those of its length is its place within (length, hash bucket)
    plus the count of the buckets before, so a length with most pieces is spread out.
    The runs are at most ``capacity`` combinations of at most 63 lengths (distinct lengths
    of a bin add up to 2048 at most): a bounded table, broadcast for that reason.
    """
    p = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counted = p.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {int(n): int(c) for n, c in zip(pdf["length"], pdf["n"])}
        return pd.DataFrame(slack_runs(counts, capacity), columns=["length", "first", "last", "copies", "base", "at"])

    runs = counted.groupBy("length").agg(F.sum("n").alias("n")).groupBy(F.lit(1).alias("all")).applyInPandas(fit, RUNS)
    runs = store(runs, "runs")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = counted.select("length", "bucket", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = p.withColumn("place", place).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place"))
    r = F.broadcast(runs.withColumnRenamed("length", "run_length"))
    hit = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    nth = F.col("rank") - F.col("first")
    return ranked.join(r, hit).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("base") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents' tokens in as few sequences of ``capacity`` as minimum bin slack finds.

    One row per piece (``PIECES`` with sequence_id and offset). Null or empty text is the end
    id alone. A document longer than ``capacity`` is cut into full pieces and a last shorter
    one; full pieces are sequences by themselves. Repeated rows are packed each for
    itself, null ids like others. An empty table gives no rows. Other columns are ignored.
    """
    return pack_pieces(store(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)
