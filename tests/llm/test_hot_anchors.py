"""A short phrase that many documents hold in other surroundings: its contexts must not meet in one shard."""

import random

import numpy as np
from paddock.llm.blocks import DOCUMENT, ask
from paddock.llm.substring_dedup import Block, remove_repeats

PHRASE = "the quick brown fox jumps over the lazy dog and then it sleeps. "


def texts(n):
    rnd = random.Random(7)
    junk = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(k))
    rows = [(i, junk(rnd.randrange(90)) + PHRASE + junk(rnd.randrange(90))) for i in range(n)]
    return rows + [(n, rows[5][1]), (n + 1, PHRASE), (n + 2, PHRASE[:49]), (n + 3, PHRASE * 3)]


def test_phrase_in_other_surroundings(spark):
    rows = texts(400)
    seen, want = {}, []
    for i, text in rows:
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - 49):
            if seen.setdefault(b[at : at + 50], i) != i:
                gone[at : at + 50] = True
        want.append((i, int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block_bytes in (1500, 1 << 20):
        got = [(r["doc_id"], sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) for r in remove_repeats(df, 50, block_bytes=block_bytes).collect()]
        assert sorted(got) == want


def test_contexts_of_one_anchor_are_dealt_to_all_shards():
    b = Block([{"phase": DOCUMENT, "doc_id": i, "text": t.encode()} for i, t in texts(4000)], 50)
    hot = np.argmax(np.bincount(b.kind))
    common = (b.kind == hot)[b.by_pair]
    per_shard = [int(common[part].sum()) for _, part in ask(16, b.names_of_pairs)]
    assert sum(per_shard) > 2000 and len(per_shard) == 16 and max(per_shard) < 2 * sum(per_shard) / 16
    assert len(b.kinds) == len(set(b.kinds.tolist())) and b.only[hot] == (1 << 48) - 1
