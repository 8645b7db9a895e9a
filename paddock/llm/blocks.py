"""Texts in blocks, and questions that blocks ask each other through shards of a hash space.

Rows are dealt to blocks of a bounded number of bytes. A block sends the hashes it wants
to know about to their shards, one packed row per (shard, block), sorted within; the
shard compares what all blocks sent and answers in the same order. A block that is
built again from the same rows asks in the same order, so answers carry no keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
#: Phases of rows in a block: answers are numbered from 0, marks and documents come last.
MARK, DOCUMENT = 8, 9
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ANSWERS = "block int, shard int, answer binary"


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (changes ``x``)."""
    x ^= x >> np.uint64(30)
    x *= M2
    x ^= x >> np.uint64(27)
    x *= M3
    x ^= x >> np.uint64(31)
    return x


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a string from those of its two parts."""
    return mix(left * M1 + (right ^ (right >> np.uint64(29))))


def count_blocks(docs: DataFrame, text: Column, block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // block_bytes))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each value of ``key``; the batches have equal values together."""
    now, rows = None, []
    for batch in batches:
        keys = np.asarray(batch.column(batch.schema.get_field_index(key)))
        cuts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]]) if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if rows and keys[a] != now:
                yield now, rows
                rows = []
            now = int(keys[a])
            rows += batch.slice(int(a), int(b - a)).to_pylist()
    if rows:
        yield now, rows


def by_block(docs: DataFrame, *answers: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Documents (block, doc_id, text) and answers of earlier phases, each block's rows together.

    Answers come first, then ``marks`` (block, doc_id, mark), then the documents by id. A
    document's ``shard`` column holds its mark: 32 bits of its text's hash.
    """
    d = docs.select("block", F.lit(DOCUMENT).alias("phase"), mark_of("text").alias("shard"), "doc_id", "text")
    for phase, a in enumerate(answers):
        d = d.unionByName(a.select("block", F.lit(phase).alias("phase"), "shard", F.lit(None).cast("long").alias("doc_id"), F.col("answer").alias("text")))
    if marks is not None:
        d = d.unionByName(marks.select("block", F.lit(MARK).alias("phase"), F.col("mark").alias("shard"), "doc_id", F.lit(None).cast("binary").alias("text")))
    return d.repartition("block").sortWithinPartitions("block", "phase", F.col("doc_id").asc_nulls_last(), "shard")


def mark_of(text: str) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(1 << 31)).cast("int")


def answers_in(rows: list[dict], phase: int) -> dict[int, bytes]:
    return {r["shard"]: r["text"] for r in rows if r["phase"] == phase}


def ask(shards: int, values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Shards and the ranges of sorted ``values`` that belong to them (shards are ranges of the hash space)."""
    edges = np.searchsorted(values, shard_edges(shards))
    for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            yield s, slice(int(a), int(b))


def shard_edges(shards: int) -> np.ndarray:
    """Lower edges of equal ranges of 64-bit values, closed with a value that no hash reaches."""
    step = (1 << 64) // shards
    return np.array([s * step for s in range(shards)] + [(1 << 64) - 1], dtype=np.uint64)


def put_answers(shards: int, values: np.ndarray, got: dict[int, bytes]) -> np.ndarray:
    """Answers, one byte each, in the order of sorted ``values``."""
    out = np.zeros(len(values), np.uint8)
    for s, part in ask(shards, values):
        out[part] = np.frombuffer(got[s], np.uint8)
    return out


def low_bytes(values: np.ndarray, n: int) -> bytes:
    """The ``n`` low bytes of each 64-bit value."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def from_low_bytes(raws: list[bytes], n: int) -> np.ndarray:
    narrow = np.frombuffer(b"".join(raws), np.uint8).reshape(-1, n)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :n] = narrow
    return wide.view("<u8").ravel()


class Fingerprints:
    """Names of any substrings of a byte string, from sums over its prefixes (modulo 2**64)."""

    _power = _inverse = np.ones(1, np.uint64)
    _base = 0x9E3779B97F4A7C15 | 5
    _table = mix(np.arange(1, 257, dtype=np.uint64) * M1)

    def __init__(self, buf: np.ndarray):
        n, cls = len(buf), Fingerprints
        if len(cls._power) <= n:
            size = max(n + 1, 1 << 21)
            cls._power, cls._inverse = np.full(size, cls._base, np.uint64), np.full(size, pow(cls._base, -1, 1 << 64), np.uint64)
            cls._power[0] = cls._inverse[0] = 1
            np.multiply.accumulate(cls._power, out=cls._power)
            np.multiply.accumulate(cls._inverse, out=cls._inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self._table[buf] * cls._power[:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Of all substrings of one length, by start."""
        x = self.sums[length:] - self.sums[:-length]
        x *= self._inverse[: len(x)]
        return stir(x)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self._inverse[start]
        return stir(x + (end - start).astype(np.uint64) * M3)


def stir(x: np.ndarray) -> np.ndarray:
    """A short ``mix`` (changes ``x``)."""
    x ^= x >> np.uint64(32)
    x *= M2
    x ^= x >> np.uint64(29)
    return x


def answer(questions: DataFrame, reply: Callable[[list[dict]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """``reply`` sees all rows of a shard and gives (block, answer) for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in grouped(batches, "shard"):
            out = list(reply(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([shard] * len(out), pa.int32()), pa.array([o[1] for o in out], pa.binary())],
                ["block", "shard", "answer"],
            )

    return questions.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(run, ANSWERS)
