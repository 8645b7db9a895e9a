"""Removal of repeated byte strings by matching anchors, then their contexts, then whole windows.

This is not prefix doubling by Spark sorts: strings are named by fingerprints straight
from the text, and only anchors and what they leave open are ranked. Three rankings over
the corpus follow each other, each on what the one before left open:

* half the threshold, at anchors only: the anchor of a window is the string of half its
  length with the least name in it, so equal windows have equal anchors, and a
  window whose anchor has no other owner is unique;
* once and a half the threshold, around each anchor: the context that holds all windows
  of that anchor. A context with an earlier owner settles all its windows; where all
  owners of an anchor share one context (asked apart) nothing else is open;
* the threshold itself: pairs of the names at i and i + half a threshold, from the first
  owner of each context that is still open.

Spark deals the names to ranges of the name space, where they are sorted and ranked. Contexts
are dealt by names of their own, so those of a common anchor lie in all shards; a shard of
anchors gets one entry per anchor and block. A context travels as 48 bits beside 40 bits of
its anchor, a window as 64 bits; none is compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import (
    BLOCK_BYTES,
    DOCUMENT,
    Fingerprints,
    answer,
    answers_in,
    ask,
    by_block,
    count_blocks,
    from_low_bytes,
    grouped,
    join_hashes,
    low_bytes,
    put_answers,
)
from .common import store

QUESTIONS = "shard int, block int, names binary, contexts binary, owners binary, ids binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
NO_ID = np.iinfo(np.int64).max
#: Stands for several contexts of one anchor.
MANY = np.uint64((1 << 48) - 1)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. for each range of ``count`` values."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + count, count)


class Block:
    """The documents of a block as one byte string, its windows grouped by anchor."""

    def __init__(self, rows: list[dict], threshold: int):
        docs = [r for r in rows if r["phase"] == DOCUMENT]
        self.doc_ids = [r["doc_id"] for r in docs]
        self.ids = np.array([NO_ID if i is None else i for i in self.doc_ids], np.int64)
        raw = [bytes(r["text"] or b"") for r in docs]
        self.lens = np.array([len(x) for x in raw], np.int64)
        self.ends = np.cumsum(self.lens)
        self.buf = np.frombuffer(b"".join(raw), np.uint8)
        self.threshold, self.half = threshold, (threshold + 1) // 2
        n = len(self.buf) - threshold + 1
        none = np.zeros(0, np.int64)
        self.begin = self.count = self.owner = self.entry = self.first = self.by_pair = self.kind = none
        self.names_of_pairs = self.anchors = self.contexts = self.kinds = self.only = np.zeros(0, np.uint64)
        if n <= 0:
            return
        inside = np.ones(n, bool)  # windows that don't reach into the next document
        for end in self.ends.tolist():
            inside[max(0, end - threshold + 1) : end] = False
        prints = Fingerprints(self.buf)
        self.halves = prints.every(self.half)
        # the name's upper bits, then the place: the least is the leftmost of equal strings
        bits = np.uint64(max(1, int(len(self.buf)).bit_length()))
        spot = (self.halves >> bits << bits) | np.arange(len(self.halves), dtype=np.uint64)
        spot = (least_of(spot, threshold - self.half + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int32)
        new = inside.copy()
        new[1:] &= (spot[1:] != spot[:-1]) | ~inside[:-1]
        self.begin = np.nonzero(new)[0]
        if not len(self.begin):
            return
        self.count = np.add.reduceat(inside, self.begin, dtype=np.int64)
        at = spot[self.begin].astype(np.int64)
        self.owner = np.searchsorted(self.ends, self.begin, side="right")
        start = np.maximum(at - (threshold - self.half), self.ends[self.owner] - self.lens[self.owner])
        anchor = self.halves[at]
        context = prints.between(start, np.minimum(at + threshold, self.ends[self.owner])) >> np.uint64(16)
        # where the anchor lies in a context cut short by its document's start
        context ^= (at - start).astype(np.uint64) << np.uint64(40)
        order = np.lexsort((context, anchor))
        a, c = anchor[order], context[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        self.anchors, self.contexts = a[fresh], c[fresh]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(fresh) - 1
        self.first = self.owner[order[fresh]]  # documents are in order of their ids: the block's first owner
        pairs = join_hashes(self.anchors, self.contexts)
        self.by_pair = np.argsort(pairs, kind="stable")
        self.names_of_pairs = pairs[self.by_pair]
        head = np.ones(len(self.anchors), bool)
        head[1:] = self.anchors[1:] != self.anchors[:-1]
        self.kind = np.cumsum(head) - 1
        self.kinds = self.anchors[head]
        self.only = np.where(np.bincount(self.kind) > 1, MANY, self.contexts[head])

    def window_names(self, earlier: np.ndarray, several: np.ndarray) -> None:
        """Names of the windows of open contexts, from their first owner in the block.

        ``earlier``: of each context by name, has it an earlier owner; ``several``: of each anchor, has it several contexts.
        """
        before = np.empty(len(self.by_pair), bool)
        before[self.by_pair] = earlier > 0
        self.settled = before[self.entry] | (self.ids[self.owner] > self.ids[self.first[self.entry]])
        todo = np.nonzero((several[self.kind] > 0)[self.entry] & ~self.settled)[0]
        self.at = spread(self.begin[todo], self.count[todo])
        self.at_owner = np.repeat(self.owner[todo], self.count[todo])
        step = self.threshold - self.half
        full = join_hashes(self.halves[self.at], self.halves[self.at + step]) if len(self.at) else np.zeros(0, np.uint64)
        self.names, first, self.which = np.unique(full, return_index=True, return_inverse=True)
        self.name_first = self.at_owner[first]

    def repeated(self, earlier: np.ndarray) -> np.ndarray:
        """Bytes covered by windows that also start in a document with a smaller id."""
        begun = np.zeros(len(self.buf) + 1, np.int32)
        settled = np.nonzero(self.settled)[0]
        begun[spread(self.begin[settled], self.count[settled]) + 1] = 1
        if len(self.at):
            dup = (earlier[self.which] > 0) | (self.ids[self.at_owner] > self.ids[self.name_first[self.which]])
            begun[self.at[dup] + 1] = 1
        begun = np.cumsum(begun, dtype=np.int32)
        back = np.maximum(np.arange(1, len(self.buf) + 1) - self.threshold, 0)
        return begun[1:] > begun[back]


def packed_ids(ids: np.ndarray, owners: np.ndarray) -> tuple[bytes, bytes]:
    used, local = np.unique(owners, return_inverse=True)
    return local.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes(), ids[used].tobytes()


def unpacked_ids(rows: list[dict], sizes: list[int]) -> np.ndarray:
    kinds = ["<u2" if len(r["owners"]) == 2 * n else "<u4" for r, n in zip(rows, sizes)]
    return np.concatenate([np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["owners"], k)] for r, k in zip(rows, kinds)])


def first_of(keys: tuple[np.ndarray, ...], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys (last one first), starts of runs of equal keys, and each run's least owner."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new, np.minimum.reduceat(owner[order], np.nonzero(new)[0])


def has_earlier(keys: tuple[np.ndarray, ...], owner: np.ndarray) -> np.ndarray:
    order, new, least = first_of(keys, owner)
    earlier = np.empty(len(order), np.uint8)
    earlier[order] = owner[order] > least[np.cumsum(new) - 1]
    return earlier


def rank_contexts(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
    """Of each (anchor, context): has it an earlier owner."""
    sizes = [len(r["contexts"]) // 6 for r in rows]
    anchor, context = from_low_bytes([r["names"] for r in rows], 5), from_low_bytes([r["contexts"] for r in rows], 6)
    owner = unpacked_ids(rows, sizes)
    yield from parts(rows, sizes, has_earlier((context, anchor), owner))


def rank_anchors(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
    """Of each anchor: has it several contexts."""
    anchor, context = from_low_bytes([r["names"] for r in rows], 5), from_low_bytes([r["contexts"] for r in rows], 6)
    order, new, least = first_of((anchor,), context)
    most = np.maximum.reduceat(context[order], np.nonzero(new)[0])
    several = np.empty(len(order), np.uint8)
    several[order] = ((least != most) | (most == MANY))[np.cumsum(new) - 1]
    yield from parts(rows, [len(r["names"]) // 5 for r in rows], several)


def rank_windows(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
    """Of each window: has it an earlier owner."""
    sizes = [len(r["names"]) // 8 for r in rows]
    name = np.concatenate([np.frombuffer(r["names"], np.uint64) for r in rows])
    owner = unpacked_ids(rows, sizes)
    yield from parts(rows, sizes, has_earlier((name,), owner))


def parts(rows: list[dict], sizes: list[int], values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for r, part in zip(rows, np.split(values, np.cumsum(sizes)[:-1])):
        yield r["block"], part.tobytes()


def questions(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["shard", "block", "names", "contexts", "owners", "ids"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def remove_repeats(
    docs: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (removed byte ranges, end exclusive) and kept (the other bytes).

    A byte goes if a string of ``threshold`` bytes that covers it also starts in a document
    with a smaller id, judged on the input. Matches never cross documents. Null and
    empty texts are empty; texts shorter than the threshold stay. Null ids count as larger
    than all others; rows with the same id are no sources for each other. An empty table
    gives no rows; other columns are ignored. ``kept`` may split a character.

    A block sends a name once however many of its documents have it, so that a string that
    most documents share costs one entry per block; a short phrase with other surroundings in
    each document has one entry per document, spread over all shards. Names are fingerprints,
    not checked byte by byte: 88 bits of a context and its anchor, 64 bits of a window. Two
    different ones would have to share them for a wrong removal.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    blocks = count_blocks(d, F.col("text"), block_bytes)
    shards = max(1, -(-blocks // 3))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int"))

    def ask_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, "block"):
            b = Block(rows, threshold)
            anchors, contexts, first = b.anchors[b.by_pair] >> np.uint64(16), b.contexts[b.by_pair], b.first[b.by_pair]
            yield questions([(s, key, low_bytes(anchors[p], 5), low_bytes(contexts[p], 6), *packed_ids(b.ids, first[p])) for s, p in ask(shards, b.names_of_pairs)])

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, "block"):
            b = Block(rows, threshold)
            # anchors that share 40 bits within a shard are open without need
            yield questions([(s, key, low_bytes(b.kinds[p] >> np.uint64(16), 5), low_bytes(b.only[p], 6), b"", b"") for s, p in ask(shards, b.kinds)])

    def named(rows: list[dict]) -> Block:
        b = Block(rows, threshold)
        b.window_names(put_answers(shards, b.names_of_pairs, answers_in(rows, 0)), put_answers(shards, b.kinds, answers_in(rows, 1)))
        return b

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, "block"):
            b = named(rows)
            yield questions([(s, key, b.names[p].tobytes(), b"", *packed_ids(b.ids, b.name_first[p])) for s, p in ask(shards, b.names)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, "block"):
            b = named(rows)
            gone = b.repeated(put_answers(shards, b.names, answers_in(rows, 2)))
            spans, kept = [], []
            for end, size in zip(b.ends.tolist(), b.lens.tolist()):
                part = gone[end - size : end]
                if not part.any():
                    spans.append([])
                    kept.append(b.buf[end - size : end].tobytes())
                    continue
                edges = np.diff(np.concatenate([[0], part.astype(np.int8), [0]]))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0])])
                kept.append(b.buf[end - size : end][~part].tobytes())
            pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.doc_ids, pa.int64()), pa.array(b.lens, pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    contexts = store(answer(by_block(d).mapInArrow(ask_contexts, QUESTIONS), rank_contexts), "contexts")
    anchors = store(answer(by_block(d).mapInArrow(ask_anchors, QUESTIONS), rank_anchors), "anchors")
    windows = store(answer(by_block(d, contexts, anchors).mapInArrow(ask_windows, QUESTIONS), rank_windows), "windows")
    return by_block(d, contexts, anchors, windows).mapInArrow(cut, RESULT)
