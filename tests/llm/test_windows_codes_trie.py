"""Word windows, vector codes and the conversation trie against brute force, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.llm import queries as Q
from paddock.llm.code_trie import PartTrie, compress_vectors, limbs, quantised
from paddock.llm.prefix_trie import NAME, Elements, Forest, common_depth, prefix_trie
from paddock.llm.window_dedup import drop_repeated_windows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --------------------------------------------------------------------------- word windows


def brute_windows(rows, width):
    """(doc_id, n_words, removed ranges, kept) of each row, in the rows' order."""
    at = defaultdict(list)  # a window's places: (null last, id), row, start
    texts = [WORD.findall(t or "") for _, t in rows]
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    for i, words in enumerate(texts):
        for s in range(len(words) - width + 1):
            at[tuple(words[s : s + width])].append((key(i), i, s))
    out = []
    for i, words in enumerate(texts):
        gone = set()
        for s in range(len(words) - width + 1):
            if any(k < key(i) or (j == i and p < s) for k, j, p in at[tuple(words[s : s + width])]):
                gone |= set(range(s, s + width))
        edges = [p for p in range(len(words) + 1) if (p in gone) != (p - 1 in gone)]
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((rows[i][0], len(words), list(zip(edges[::2], edges[1::2])), kept))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdé") * rng.randint(1, 3)
    base = [" ".join(word() for _ in range(40)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, "head " + base[0] + " tail"), (22, base[1].replace(" ", "\n")), (23, base[2] + " " + base[2]), (24, "x " * 60)]
    rows += [(25, base[3][: len(base[3]) // 2]), (26, base[4].upper()), (27, " ".join(base[5].split(" ")))]
    rows += [(30, None), (31, ""), (32, " \n\t\x0b\x0c\r "), (33, "one two"), (34, "\x1c".join(base[6].split(" ")))]
    rows += [(None, base[7]), (None, base[7]), (None, None), (5, base[5]), (5, base[5]), (5, base[6])]
    rows += [(40, " ".join(word() for _ in range(3000))), (41, "y" * 50_000 + " " + base[1])]
    return rows


@pytest.mark.parametrize("cells,block_bytes", [(1 << 24, 2 << 20), (1 << 24, 300), (16, 300)])
def test_windows_match_brute_force(spark, texts, cells, block_bytes):
    df = spark.createDataFrame(texts, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("block", "phase", "shard", "kept", "names")])
    got = drop_repeated_windows(df, 5, block_bytes=block_bytes, cells=cells).collect()
    found = sorted(((r["doc_id"], r["n_words"], [(s["start"], s["end"]) for s in r["spans"]], r["kept"]) for r in got), key=repr)
    assert found == brute_windows(texts, 5)


def test_windows_of_an_empty_table(spark):
    assert drop_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --------------------------------------------------------------------------- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{row index: (code, error)}, codebooks."""
    ok = [i for i, (_, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    dim = len(rows[ok[0]][1]) if ok else 0
    exact = lambda x: math.floor(Fraction(x) * scale)
    fit = [i for i in ok if len(rows[i][1]) == dim and dim and dim % parts == 0]
    w = dim // parts
    cut = {i: [tuple(exact(x) for x in rows[i][1][p * w : (p + 1) * w]) for p in range(parts)] for i in fit}
    books = [[cut[i][p] for i in ok[:entries] if i in cut] for p in range(parts)]

    def near(p, part):
        d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            by = defaultdict(list)
            for i in fit:
                by[near(p, cut[i][p])[0]].append(cut[i][p])
            new.append([tuple(sum(c) // len(by[k]) for c in zip(*by[k])) if by[k] else e for k, e in enumerate(books[p])])
        books = new
    out = {}
    for i in ok:
        if i in cut:
            got = [near(p, cut[i][p]) for p in range(parts)]
            out[i] = ([g[0] for g in got], sum(g[1] for g in got))
        else:
            out[i] = (None, None)
    return out, [[list(e) for e in b] for b in books]


def vectors(big):
    rng = random.Random(11)
    vec = lambda: [rng.choice([-1, 1]) * rng.randint(0, 12) / 4096 * 3 + rng.choice([0.0, 1e-5]) for _ in range(16)]
    rows = [(i, vec(), rng.choice([0, 1, None])) for i in range(60)]
    rows += [(100 + i, list(rows[3][1]), 7) for i in range(40)]  # a hot vector
    rows += [(3, list(rows[3][1]), 1), (None, vec(), None), (200, None, 1), (201, [0.0] * 16, 1), (202, [math.nan] + [0.0] * 15, 1), (203, [None] + [0.0] * 15, 2)]
    rows += [(204, [math.inf] + [0.0] * 15, 2), (205, [1.0] * 8, 3), (206, [], 3), (207, [1.0] * 15, None)]
    if big:
        rows += [(300, [1e200] + [-1e200] * 15, 9), (301, [1e30, 5e-320] * 8, 9), (302, [-(2.0**60)] * 16, 9), (303, [3.5e15, -3.5e15 - 0.5] * 8, 9)]
    return rows


@pytest.mark.parametrize("big", [False, True])
def test_codes_match_brute_force(spark, big):
    rows = vectors(big)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit("x").alias(c) for c in ("v", "code", "error", "_label")])
    coded, books = compress_vectors(df.repartition(3))
    want, want_books = brute_codes(rows)
    assert books == want_books
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    by_label = defaultdict(list)
    for i, (_, e) in want.items():
        by_label[rows[i][2]] += [fits(e)] if fits(e) is not None else []
    expect = [(rows[i][0], c, fits(e), fits(sum(by_label[rows[i][2]])) if by_label[rows[i][2]] else None, rows[i][2]) for i, (c, e) in want.items()]
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"], r["label"]) for r in coded.collect()]
    assert sorted(got, key=repr) == sorted(expect, key=repr)


def test_codes_of_an_empty_table_and_of_a_few_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, books = compress_vectors(spark.createDataFrame([], schema))
    assert coded.count() == 0 and books == [[]] * 8
    coded, books = compress_vectors(spark.createDataFrame([(1, [0.5] * 8, 1), (2, [0.25] * 8, None)], schema))
    assert sorted((r["vec_id"], r["error"]) for r in coded.collect()) == [(1, 0), (2, 0)] and books[0] == [[2048], [1024]]


def test_a_walk_shares_prefixes_across_steps(monkeypatch):
    rng = np.random.default_rng(2)
    parts = rng.integers(-3, 3, (500, 6))
    entries = rng.integers(-3, 3, (7, 6))
    monkeypatch.setattr("paddock.llm.code_trie.STEP", 7)
    trie = PartTrie(parts)
    assert len(trie.leaves) == len({tuple(p) for p in parts.tolist()}) and trie.copies.sum() == 500
    full = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    best, error = trie.nearest(entries)
    assert (best[trie.leaf_of] == full.argmin(axis=1)).all() and (error[trie.leaf_of] == full.min(axis=1)).all()
    assert all(sum(v << (32 * k) for k, v in limbs(x)) == x for x in (0, -1, 5, 1 << 62, -(1 << 62), -(3 << 200) - 7, 1 << 1100))
    assert quantised(np.array([[2.0**52 + 1, -0.1, -1e300]]), 4096).tolist() == [[4096 * (2**52 + 1), -410, -4096 * int(1e300)]]


# --------------------------------------------------------------------------- the prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            name = (role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest())
            own[c].append(((turn is not None, turn or 0), *name, text or ""))
    own = {c: [(t[1], t[3]) for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        s = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)

    def subtree(s):
        below = [subtree(k) for k in kids[s]]
        own_tokens = (len(members[s]) - 1) * len(s[-1][1]) if s else 0
        return (sum(b[0] for b in below) if below else 1), own_tokens + sum(b[1] for b in below)

    out = []
    for s, m in members.items():
        leaves, saved = subtree(s)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves, saved, digest))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations():
    rng = random.Random(9)
    text = lambda: rng.choice(["a", "bb", "ccc", "é\U0001f600"])
    rows = []
    for c in list(range(0, 60)) + list(range(100, 190)) + [230, 231, -5, -100, -101]:
        rows += [(c, t, rng.choice(["user", "assistant"]), text()) for t in range(rng.randint(1, 6))]
    rows += [(300 + k, t, "user", f"same {t}") for k in range(80) for t in range(7)]  # a hot conversation
    rows += [(500, t, "user", "deep") for t in range(150)] + [(501, t, "user", "deep") for t in range(90)]
    rows += [(700, None, None, None), (700, None, "user", "x"), (700, 0, "user", "x"), (700, 0, "user", "x"), (701, 1, None, ""), (None, 0, "user", "x"), (None, None, None, None)]
    rows += [(900, 0, "user", "z" * 30_000), (901, 0, "user", "z" * 30_000), (902, 0, "user", "z" * 30_000), (902, 1, "user", "q")]
    return rows


@pytest.mark.parametrize("forest_rows,fan_in", [(20_000, 64), (5, 64), (5, 2), (1, 3)])
def test_trie_matches_brute_force(spark, forest_rows, fan_in):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("x").alias(c) for c in ("seq", "lens", "base", "h", "part", "low")])
    got = prefix_trie(df, forest_rows=forest_rows, fan_in=fan_in)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows)


def test_trie_of_an_empty_table_and_of_one_turn(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, 0, "user", "abc")]
    assert [tuple(r) for r in prefix_trie(spark.createDataFrame(rows, schema)).collect()] and sorted((tuple(r) for r in prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=repr) == brute_trie(rows)


def test_digest_takes_pieces_in_order(spark, monkeypatch):
    monkeypatch.setattr("paddock.llm.prefix_trie.PIECE", 7)
    rows = [(c, 0, "user", "same") for c in range(1000, 1090)]
    got = sorted((tuple(r) for r in prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    assert got == brute_trie(rows)


def test_every_merge_makes_a_branching_node():
    names = sorted({bytes([a] * NAME + [b] * NAME + [c] * NAME) for a in (1, 2) for b in (1, 2, 3) for c in (1, 2)})
    e = Elements()
    for i, s in enumerate(names):
        e.add_sequence(s, i, 1, "", [1, 1, 1])
    f = Forest(e, True)
    assert sorted(f.depth[x] for x in f.nodes) == [0] + [1] * 2 + [2] * 6 + [3] * 12
    assert common_depth(names[0], names[1]) == 2 and common_depth(names[0], names[0][:NAME]) == 1 and common_depth(b"", names[0]) == 0


@pytest.mark.parametrize("name", ["op11_count_min", "op12_code_trie", "op13_prefix_trie"])
def test_new_queries_run(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0
