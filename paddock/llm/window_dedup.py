"""Removal of repeated word windows behind a count-min prefilter.

Most windows of a corpus occur once, and need not be grouped. A first pass sketches every
block of documents: a count-min sketch of two rows of counters, whose cells are dealt to
shards. The shards add the blocks' sketches up, and tell each block which of its windows
have an estimate above one. An estimate is never too low, so no repeated window is lost.
The second pass groups those windows exactly, by 128-bit names, and finds each one's
least document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .blocks import BLOCK_BYTES, DOCUMENT, answer, answers_in, ask, by_block, count_blocks, from_low_bytes, grouped, low_bytes, mix, put_answers
from .common import store
from .substring_dedup import NO_ID, first_of, packed_ids, parts, questions, unpacked_ids

QUESTIONS = "shard int, block int, names binary, contexts binary, owners binary, ids binary"
RESULT = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept binary"
#: Odd multipliers of the two halves of a window's name.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Counters of a shard in each row of the sketch; three bytes address one.
CELLS = 1 << 24
#: Blocks for each shard: about six counters a window and row in ordinary prose.
BLOCKS_PER_SHARD = 8


def window_names(hashes: np.ndarray, width: int) -> np.ndarray:
    """The two 64-bit halves of the name of every ``width`` consecutive words, from rows of the words' halves."""
    out = []
    for words, base in zip(hashes, BASES):
        name = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            name *= base
            name += words[j : j + len(name)]
        out.append(mix(name))
    return np.stack(out)


class Block:
    """The documents of a block as one sequence of words, and the distinct windows within them.

    Documents come by id, nulls last, so a window's first place in the block belongs to
    its least document.
    """

    def __init__(self, rows: list[dict], width: int):
        docs = [r for r in rows if r["phase"] == DOCUMENT]
        self.width = width
        self.doc_ids = [r["doc_id"] for r in docs]
        self.ids = np.array([NO_ID if i is None else i for i in self.doc_ids], np.int64)
        # bytes.split() cuts at blank and tab .. carriage return, as the contract's words do
        self.words = [bytes(r["text"] or b"").split() for r in docs]
        self.ends = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        total = int(self.ends[-1]) if len(docs) else 0
        none = np.zeros(0, np.int64)
        self.at = self.run = self.owner = self.first = none
        self.names = np.zeros((2, 0), np.uint64)
        if total < width:
            return
        hashes = np.frombuffer(b"".join(xxh3_128_digest(w) for words in self.words for w in words), np.uint64).reshape(-1, 2).T
        inside = np.ones(total - width + 1, bool)  # windows that don't reach into the next document
        for end in self.ends.tolist():
            inside[max(0, end - width + 1) : end] = False
        names = window_names(np.ascontiguousarray(hashes), width)
        at = np.nonzero(inside)[0]
        if not len(at):
            return
        names = names[:, at]
        order = np.argsort(names[0], kind="stable")  # equal windows stay in order of place
        low, high = names[0][order], names[1][order]
        new = np.ones(len(order), bool)
        new[1:] = low[1:] != low[:-1]
        if (~new[1:] & (high[1:] != high[:-1])).any():  # one half does not tell all windows apart
            order = np.lexsort((names[1], names[0]))
            low, high = names[0][order], names[1][order]
            new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        names, self.at = np.stack([low, high]), at[order]
        self.run = np.cumsum(new) - 1
        self.names = names[:, new]
        self.owner = np.searchsorted(self.ends, self.at, side="right")
        self.first = self.owner[new]
        # the second row of the sketch is addressed by the names' other half
        self.other = np.argsort(self.names[1])

    def estimated(self, shards: int, got: dict[int, bytes]) -> np.ndarray:
        """Windows whose smaller counter is above one: they may occur in another block."""
        rows = [np.zeros(self.names.shape[1], np.uint8) for _ in range(2)]
        low, high = dict(ask(shards, self.names[0])), dict(ask(shards, self.names[1][self.other]))
        for s in low.keys() | high.keys():
            a, b = low.get(s, slice(0, 0)), high.get(s, slice(0, 0))
            bits = np.unpackbits(np.frombuffer(got[s], np.uint8))
            n, m = a.stop - a.start, b.stop - b.start
            rows[0][a] = bits[:n]
            rows[1][self.other[b]] = bits[n : n + m]
        return np.nonzero(rows[0] & rows[1])[0]

    def covered(self, shared: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Words covered by a window that also starts earlier; ``earlier``: of the ``shared`` ones, in another block."""
        begun = np.zeros(len(self) + 1, np.int32)
        if len(self.at):
            elsewhere = np.zeros(self.names.shape[1], bool)
            elsewhere[shared] = earlier > 0
            again = np.zeros(len(self.at), bool)  # the same document has it before
            again[1:] = (self.run[1:] == self.run[:-1]) & (self.owner[1:] == self.owner[:-1])
            gone = again | elsewhere[self.run] | (self.ids[self.owner] > self.ids[self.first[self.run]])
            begun[self.at[gone] + 1] = 1
        begun = np.cumsum(begun, dtype=np.int32)
        back = np.maximum(np.arange(1, len(self) + 1) - self.width, 0)
        return begun[1:] > begun[back]

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0


def merge_sketches(cells: int):
    """Adds up what the blocks counted; answers a bit for each cell sent: is its counter above one?"""

    def reply(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
        above = []
        for column in ("names", "contexts"):
            sent = [from_low_bytes([r[column]], 3).astype(np.int64) % cells for r in rows]
            counters = np.zeros(cells, np.uint8)
            for part in sent:
                cell, n = np.unique(part, return_counts=True)
                counters[cell] = np.minimum(counters[cell] + np.minimum(n, 2), 2)
            above.append([counters[part] > 1 for part in sent])
        for r, low, high in zip(rows, *above):
            yield r["block"], np.packbits(np.concatenate([low, high])).tobytes()

    return reply


def group_windows(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
    """Of each window: is its least document smaller than the one that the block has first?"""
    sizes = [len(r["names"]) // 8 for r in rows]
    names = [np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows]) for c in ("contexts", "names")]
    owner = unpacked_ids(rows, sizes)
    order, new, least = first_of(tuple(names), owner)
    earlier = np.empty(len(order), np.uint8)
    earlier[order] = owner[order] > least[np.cumsum(new) - 1]
    yield from parts(rows, sizes, earlier)


def drop_repeated_windows(
    docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, cells: int = CELLS
) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (removed ranges of words, end exclusive) and kept (the other words).

    A word goes if a window of ``width`` consecutive words that covers it also starts earlier:
    in a document with a smaller id, or in the same document before. Windows are judged on
    the input. Words are runs of characters other than blank and tab to carriage return,
    compared as they are; ``kept`` joins them with one blank. Null and empty texts have no
    words; a text with fewer words than ``width`` stays. Null ids count as larger than all
    others; rows with the same id (or without one) are no sources for each other, so
    repeated rows get the same result. An empty table gives no rows; other columns are ignored.

    The sketch grows with the corpus, and no task holds more of it than ``cells`` counters a
    row; fewer cells only make more windows pass to the second pass. A block counts a
    window once however many of its documents have it, so a window that most documents
    share costs one entry per block. A task holds the words of one block, at least one
    whole text. Windows are compared by 128-bit names.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    blocks = count_blocks(d, F.col("text"), block_bytes)
    shards = max(1, -(-blocks // BLOCKS_PER_SHARD))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, "block"):
            b = Block(rows, width)
            if not len(b.at):
                continue
            high = b.names[1][b.other]
            low_part, high_part = dict(ask(shards, b.names[0])), dict(ask(shards, high))
            none = slice(0, 0)
            yield questions(
                [
                    (s, key, low_bytes(b.names[0][low_part.get(s, none)], 3), low_bytes(high[high_part.get(s, none)], 3), b"", b"")
                    for s in sorted(low_part.keys() | high_part.keys())
                ]
            )

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, "block"):
            b = Block(rows, width)
            if not len(b.at):
                continue
            x = b.estimated(shards, answers_in(rows, 0))
            names, first = b.names[:, x], b.first[x]
            yield questions([(s, key, names[0, p].tobytes(), names[1, p].tobytes(), *packed_ids(b.ids, first[p])) for s, p in ask(shards, names[0])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "block"):
            b = Block(rows, width)
            shared = b.estimated(shards, answers_in(rows, 0)) if len(b.at) else np.zeros(0, np.int64)
            gone = b.covered(shared, put_answers(shards, b.names[0][shared], answers_in(rows, 1)))
            spans, kept = [], []
            for end, words in zip(b.ends.tolist(), b.words):
                edges = np.diff(np.concatenate([[0], gone[end - len(words) : end].astype(np.int8), [0]]))
                begin, stop = np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist()
                spans.append([{"start": s, "end": e} for s, e in zip(begin, stop)])
                kept.append(b" ".join(w for s, e in zip([0, *stop], [*begin, len(words)]) for w in words[s:e]) if begin else b" ".join(words))
            pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.doc_ids, pa.int64()), pa.array([len(w) for w in b.words], pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "spans", "kept"],
            )

    estimates = store(answer(by_block(d).mapInArrow(sketch, QUESTIONS), merge_sketches(cells)), "sketches")
    exact = store(answer(by_block(d, estimates).mapInArrow(ask_windows, QUESTIONS), group_windows), "windows")
    return by_block(d, estimates, exact).mapInArrow(cut, RESULT).withColumn("kept", F.col("kept").cast("string"))
