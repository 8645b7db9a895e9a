"""N-gram Jaccard join by T-occurrence search.

A document that links to another has all but a few of its shingles in common with it.
Each document's inverted lists are parted as DivideSkip does: its rarest lists are short
and are merged, so that a partner shows up on one of them at least; the others are long
and are probed by binary search in the candidate's sorted set, until the required
overlap is reached or out of reach.

Documents that large families share most shingles with are searched group by group: all
their lists are merged or multiplied at once.

Short lists: of the ``p`` shingles with the least hash, two linked documents share at least
``p`` less the shingles they may differ in; ordered by how many documents have them, so
many of the rarest suffice that a shared one is among both documents' choice. A document
whose least hashes are mostly its own has no partner, and asks no further.
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
    M1,
    MARK,
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
    mark_of,
    mix,
    put_answers,
)
from .common import components, spanning, store

QUESTIONS = "shard int, block int, names binary, counts binary"
SETS = "doc_id long, n long, shingles binary, short array<long>"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Members of one pivot that one task unit compares.
STAR = 4096
#: Lists of more documents are searched in groups, not pair by pair.
LONG_LIST = 16
#: Documents and shingles of one side of a unit of a group.
UNIT_DOCS, UNIT_SHINGLES = 2048, 1_000_000


def slack(n: int, percent: int) -> int:
    """How many of its ``n`` shingles a document may lack in a partner's set."""
    return n * (100 - percent) // 100


def sure(n: int, percent: int) -> int:
    """How many of the least hashes two documents share for sure, by the smaller one's size."""
    return max(1, -(-n * (100 - percent) // 100))


def least(n: int, percent: int) -> int:
    """How many of the least hashes are looked at."""
    return min(n, slack(n, percent) + sure(n, percent))


def required(n: int, percent: int) -> int:
    """How many of those a partner of any possible size has in common."""
    return min(sure(-(-n * percent // 100), percent), least(n, percent))


def shingle_sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct ``width``-word shingles of each text; shorter texts are one shingle."""
    buf = np.frombuffer(b"\n".join(raws).translate(LOWER) + b"\n", np.uint8)
    blank = BLANK[buf]
    edge = np.diff(blank.astype(np.int8), prepend=1)
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    end = end[end > start[0]] if len(start) else end[:0]
    words = Fingerprints(buf).between(start, end) if len(start) else np.zeros(0, np.uint64)
    ends = np.cumsum([len(r) + 1 for r in raws])
    upto = np.searchsorted(start, ends)
    shingles = mix(words.copy())
    for i in range(1, width):
        shingles = join_hashes(shingles[: len(words) - i], words[i:]) if len(words) > i else shingles[:0]
    out, begin = [], 0
    for stop in upto.tolist():
        n = stop - begin
        if n >= width:
            out.append(np.unique(shingles[begin : stop - width + 1]))
        elif n:
            one = mix(words[begin : begin + 1].copy())
            for i in range(1, n):
                one = join_hashes(one, words[begin + i : begin + i + 1])
            out.append(mix(one + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        begin = stop
    return out


class Block:
    def __init__(self, rows: list[dict], width: int, percent: int):
        copies = {(r["doc_id"], r["shard"]) for r in rows if r["phase"] == MARK}
        docs = [r for r in rows if r["phase"] == DOCUMENT]
        self.ids = [r["doc_id"] for r in docs]
        self.sets = shingle_sets([bytes(r["text"] or b"") for r in docs], width)
        self.linked = [i is not None and len(s) > 0 and (i, r["shard"]) not in copies for i, s, r in zip(self.ids, self.sets, docs)]
        self.low = [s[: least(len(s), percent)] * M1 if on else s[:0] for s, on in zip(self.sets, self.linked)]
        every = np.concatenate(self.low) if self.low else np.zeros(0, np.uint64)
        self.names, self.which, self.counts = np.unique(every, return_inverse=True, return_counts=True)

    def short_lists(self, held: np.ndarray, percent: int) -> Iterator[np.ndarray]:
        """Of each document the names of its short lists that other documents are on; none if it can't have a partner."""
        grade, at = held[self.which], 0
        for low, s in zip(self.low, self.sets):
            g = grade[at : at + len(low)]
            at += len(low)
            need = required(len(s), percent)
            if not len(low) or np.count_nonzero(g > 1) < need:
                yield low[:0]
                continue
            rarest = np.lexsort((low, g))[: len(low) - need + 1]
            yield low[rarest[g[rarest] > 1]]


def rank_lists(rows: list[dict]) -> Iterator[tuple[int, bytes]]:
    """Of each name: 1 if one document has it, else 1 + the binary logarithm of how many have."""
    names = from_low_bytes([r["names"] for r in rows], 5)
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), "<u4")
    _, which = np.unique(names, return_inverse=True)
    total = np.bincount(which, weights=counts)[which]
    grade = (1 + np.floor(np.log2(total))).astype(np.uint8)
    for r, part in zip(rows, np.split(grade, np.cumsum([len(r["names"]) // 5 for r in rows])[:-1])):
        yield r["block"], part.tobytes()


def overlap_reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, by binary probes of the smaller set in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    same = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * same >= percent * (len(a) + len(b) - same)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, salt) that link. Each pivot ``a`` meets its partners' sets in units of bounded size."""
    s = sets.select("doc_id", "shingles")
    partner = pairs.join(s.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "shingles")
    pivot = pairs.select("a", "salt").distinct().join(s.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            a_, b_, salt_, raw_ = (batch.column(i).to_pylist() for i in range(4))
            out_a, out_b = [], []
            for a, b, salt, raw in zip(a_, b_, salt_, raw_):
                x = np.frombuffer(raw, np.uint64)
                if (a, salt) != now:
                    now, own = (a, salt), []
                if b is None:
                    own.append(x)
                elif any(overlap_reaches(o, x, percent) for o in own):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    rows = pivot.unionByName(partner).select("a", "b", "salt", "shingles").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(compare, "a long, b long").distinct()


def salted(pairs: DataFrame) -> DataFrame:
    """Pairs with a salt that splits a pivot's partners into units of about ``STAR``."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > STAR)
    salt = F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("m") / STAR), F.lit(1))).cast("int")
    return pairs.join(many, "a", "left").select("a", "b", salt.alias("salt"))


def unit_links(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span what documents ``left`` and ``right`` (indices; the same for one block) have.

    Counts how often each pair occurs on a list: short lists are merged, long ones are
    rows of a matrix product.
    """

    def entries(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who = np.repeat(np.arange(len(side)), [len(sets[i]) for i in side])
        return np.concatenate([sets[i] for i in side]), who

    (va, a), (vb, b) = entries(left), entries(right)
    (ua, ca), (ub, cb) = np.unique(va, return_counts=True), np.unique(vb, return_counts=True)
    both, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if not len(both):
        return []
    na, nb = ca[ia], cb[ib]

    def coded(v: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, v), len(both) - 1)
        on = both[at] == v
        order = np.argsort(at[on], kind="stable")
        return at[on][order], who[on][order]

    (ka, a), (kb, b) = coded(va, a), coded(vb, b)
    same = np.zeros((len(left), len(right)), np.float32)
    long = na * nb > 64
    heavy = np.nonzero(long)[0]
    for at in range(0, len(heavy), 4096):
        part = np.full(len(both), -1)
        part[heavy[at : at + 4096]] = np.arange(len(heavy[at : at + 4096]))
        da, db = (np.zeros((n, 4096), np.float32) for n in same.shape)
        for d, k, who in ((da, ka, a), (db, kb, b)):
            on = part[k] >= 0
            d[who[on], part[k[on]]] = 1
        same += da @ db.T
    begin = np.concatenate([[0], np.cumsum(nb)[:-1]])
    on = ~long[ka]
    ka, a = ka[on], a[on]
    step = 1 << 16
    for at in range(0, len(ka), step):
        k, who = ka[at : at + step], a[at : at + step]
        times = nb[k]
        place = np.arange(int(times.sum())) + np.repeat(begin[k] - np.cumsum(times) + times, times)
        hits = np.repeat(who, times) * len(right) + b[place]
        same += np.bincount(hits, minlength=same.size).reshape(same.shape).astype(np.float32)
    size = np.array([len(s) for s in sets], np.float32)
    linked = 100 * same >= percent * (size[left][:, None] + size[right][None, :] - same)
    i, j = np.nonzero(linked)
    x, y = ids[left[i]], ids[right[j]]
    return spanning(x[x != y], y[x != y])


def group_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within groups (doc_id, g): each pair of a group's blocks is one unit."""
    size = groups.join(sets.select("doc_id", "n"), "doc_id").groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    size = size.select("g", F.greatest(F.ceil(F.col("k") / UNIT_DOCS), F.ceil(F.col("n") / UNIT_SHINGLES)).cast("int").alias("blocks"))
    d = groups.join(size, "g").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("doc_id", "own", "other", F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "unit"):
            ids, own = np.array([r["doc_id"] for r in rows], np.int64), np.array([r["own"] for r in rows])
            parts = [np.nonzero(own == o)[0] for o in np.unique(own)]
            single = len(parts) == 1 and rows[0]["own"] == rows[0]["other"]
            found = unit_links(ids, [np.frombuffer(r["shingles"], np.uint64) for r in rows], parts[0], parts[-1], percent) if single or len(parts) == 2 else []
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    rows = d.join(sets.select("doc_id", "shingles"), "doc_id").select("unit", "own", "other", "doc_id", "shingles")
    return rows.repartition("unit").sortWithinPartitions("unit", "own", "doc_id").mapInArrow(run, "a long, b long")


def jaccard_links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all documents which links of rows of ``SETS`` connect.

    Every edge is a link. A list's documents are first compared with one of them. On lists
    that are not connected by then, the documents of long lists form groups, searched
    block by block; pairs on short lists that no group has are compared one by one.
    """
    posts = sets.select(F.explode("short").alias("s"), "doc_id", "n")
    posts = store(posts.join(posts.groupBy("s").agg(F.countDistinct("doc_id").alias("m")).where("m > 1").select("s"), "s"), "lists")
    pivots = posts.groupBy("s").agg(F.min(F.struct("doc_id", "n")).alias("pivot"))
    fits = f"100 * least(n, bn) >= {percent} * greatest(n, bn)"
    star = posts.join(pivots, "s").select(F.col("pivot.doc_id").alias("a"), F.col("doc_id").alias("b"), "n", F.col("pivot.n").alias("bn"))
    star = store(star.where(f"a <> b and {fits}").select("a", "b").distinct(), "pairs")
    links = store(verified(salted(star), sets, percent), "links")

    part = components(links)
    at = posts.join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
    lists = at.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("doc_id").alias("pivot"))
    lists = store(lists.where("c0 <> c1 and m > 2").select("s", "m", "pivot"), "open")
    long = at.join(lists.where(F.col("m") > LONG_LIST), "s").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    groups = store(components(long).select(F.col("node").alias("doc_id"), F.col("component").alias("g")), "groups")
    grouped_links = store(group_links(groups, sets, percent), "links")

    x = at.join(lists.where(F.col("m") <= LONG_LIST).select("s"), "s").join(groups, "doc_id", "left").select("s", "doc_id", "n", "c", "g")
    x = store(x, "short")
    y = x.select("s", F.col("doc_id").alias("b"), F.col("n").alias("bn"), F.col("c").alias("bc"), F.col("g").alias("bg"))
    pairs = x.join(y, "s").where(f"doc_id < b and c <> bc and (g is null or bg is null or g <> bg) and {fits}")
    pairs = pairs.select(F.col("doc_id").alias("a"), "b").distinct().join(star, ["a", "b"], "left_anti")
    rest = store(verified(salted(store(pairs, "pairs")), sets, percent), "links")
    return links.unionByName(grouped_links).unionByName(rest)


def jaccard_components(
    docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents whose sets of ``width``-word shingles have a Jaccard similarity of ``percent``
    hundredths or more are linked; ``component_id`` is the smallest id reachable by links.
    A-Z count as a-z. A text with fewer words is one shingle; null texts and texts
    without a word have none and link with nothing. Rows with a null id link with nothing and
    have no component. Rows that repeat an id are one document with several texts: what one
    of them links to, the id is linked to. An empty table gives no rows; other columns are
    ignored. Shingles are told apart by 64-bit fingerprints.

    Exact copies stand for one text. A block sends each shingle once with its count, so a
    shingle of most texts is pre-aggregated; lists that are long are not merged; a pivot's
    partners are compared in units of bounded size.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = count_blocks(d, F.col("text"), block_bytes)
    shards = max(1, -(-blocks // 3))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int"))
    t = d.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("raw", F.col("text").cast("binary"))
    t = t.select("doc_id", "block", mark_of("raw").alias("mark"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    firsts = t.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep")).where("n > 1").drop("n")
    copies = store(t.join(firsts, ["h1", "h2"]).where("doc_id > rep").select("doc_id", "block", "mark", "rep"), "copies")
    d = d.withColumn("text", F.col("text").cast("binary"))

    def ask_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, "block"):
            b = Block(rows, width, percent)
            out = [(s, key, low_bytes(b.names[p] >> np.uint64(16), 5), b.counts[p].astype("<u4").tobytes()) for s, p in ask(shards, b.names)]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["shard", "block", "names", "counts"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, "block"):
            b = Block(rows, width, percent)
            short = list(b.short_lists(put_answers(shards, b.names, answers_in(rows, 0)), percent))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b.ids, pa.int64()),
                    pa.array([len(s) for s in b.sets], pa.int64()),
                    pa.array([s.tobytes() if len(x) else None for s, x in zip(b.sets, short)], pa.binary()),
                    pa.array([x.view(np.int64) if len(x) else None for x in short], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "shingles", "short"],
            )

    held = store(answer(by_block(d, marks=copies).mapInArrow(ask_lists, QUESTIONS), rank_lists), "held")
    sets = store(by_block(d, held, marks=copies).mapInArrow(choose, SETS), "sets")
    links = jaccard_links(sets.where("short is not null"), percent)
    part = components(links.select("a", "b").unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
