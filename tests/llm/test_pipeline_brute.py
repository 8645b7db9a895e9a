"""The corpus pipeline, through ``run`` and stage by stage, and the class models against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from paddock.llm.toxicity import toxicity_scores
from test_llm import SCHEMA, brute_components, words

SPLIT = regex.compile(r"[^\p{L}\p{N}]+")


def tokens(text):
    return [w for w in SPLIT.split((text or "").lower()) if w]


def families(texts):
    """{id: class} of texts that share more than half of their five-word windows."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w))} for i, w in texts.items()}
    at = {i: i for i in texts}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and 2 * len(sets[i] & sets[j]) > len(sets[i] | sets[j]):
                old, new = sorted((at[i], at[j]), reverse=True)
                at = {x: new if c == old else c for x, c in at.items()}
    return at


def trusted(n1, n0, share, ratio, often):
    """A log ratio weighed by how sure it is and by its size."""
    part = lambda k, expected: k * math.log(k / expected) if k else 0.0
    sure = 2 * (part(n1, (n1 + n0) * share) + part(n0, (n1 + n0) * (1 - share)))
    odds = math.exp(min(sure / 2, 300)) * 7 / max(often, 1)
    return odds / (1 + odds) * ratio**4 / (ratio**4 + 1) * ratio


def class_models(rows, labels):
    """{id: mean log-likelihood difference} of rows (id, text); no small ratio is left out."""
    toxic = {}
    for i, t in rows:
        if i in labels:
            was, first = toxic.get(t or "", (0, i))
            toxic[t or ""] = max(was, labels[i]), min(first, i)
    learnt = {i: (tokens(t), y) for t, (y, i) in toxic.items()}
    family = families({i: w for i, (w, _) in learnt.items()})
    held = {(y, family[i], v, w) for i, (ws, y) in learnt.items() for v, w in zip(["", *ws], ws)}
    pairs = defaultdict(lambda: [0, 0])
    for y, _, v, w in held:
        pairs[v, w][y] += 1
    kinds = defaultdict(lambda: [0, 0, 0])
    context = defaultdict(lambda: [0, 0, 0.0, 0.0])
    for (v, w), (n0, n1) in pairs.items():
        k, c = kinds[w], context[v]
        k[0], k[1], k[2] = k[0] + (n0 > 0), k[1] + (n1 > 0), k[2] + 1
        c[0], c[1], c[2], c[3] = c[0] + n0, c[1] + n1, c[2] + min(n0, 0.75), c[3] + min(n1, 0.75)
    total = [sum(k[c] for k in kinds.values()) for c in range(3)]
    spare = [sum(min(k[c], 0.75) for k in kinds.values()) for c in range(2)]
    often = sum(k[0] + k[1] >= 3 for k in kinds.values())
    llr = {}
    for w, k in kinds.items():
        p0, p1 = ((max(k[c] - 0.75, 0) + spare[c] * k[2] / total[2]) / total[c] for c in range(2))
        llr[w] = trusted(k[1], k[0], total[1] / (total[0] + total[1]), math.log(p1 / p0), often)
    often = sum(n0 + n1 >= 3 for n0, n1 in pairs.values())
    gain = {}
    for (v, w), n in pairs.items():
        if sum(n) > 1:
            back = [kinds[w][2] / total[2] * math.exp(llr[w] * (c - 0.5)) for c in range(2)]
            p0, p1 = ((max(n[c] - 0.75, 0) + context[v][2 + c] * back[c]) / context[v][c] if context[v][c] else back[c] for c in range(2))
            expected = (context[v][1] + 0.5) * math.exp(llr[w])
            gain[v, w] = trusted(n[1], n[0], expected / (expected + context[v][0] + 0.5), math.log(p1 / p0) - llr[w], often)
    out = {}
    for i, t in rows:
        ws = tokens(t)
        out[i] = sum(llr.get(w, 0) + gain.get((v, w), 0) for v, w in zip(["", *ws], ws)) / max(len(ws), 1)
    return out


def probabilities(llr, labels):
    """Logistic fit of the labels on asinh(100 llr), every labelled row by itself."""
    x = {i: math.asinh(100 * s) for i, s in llr.items()}
    f, y = np.array([x[i] for i in labels if i in x]), np.array([labels[i] for i in labels if i in x])
    a, b = 0.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        wt = p * (1 - p)
        h = np.array([[(wt * f * f).sum() + 1e-2, (wt * f).sum()], [(wt * f).sum(), wt.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, [((y - p) * f).sum() - 1e-2 * a, (y - p).sum()]), -0.5, 0.5)
        a, b = a + step[0], b + step[1]
    return {i: 1 / (1 + math.exp(-(a * s + b))) for i, s in x.items()}


def without_repeated_lines(rows):
    """Rows with later occurrences of three-line windows removed; wholly repeated documents go."""
    first, out = {}, []
    for r in sorted(rows):
        lines = (r[1] or "").split("\n")
        gone = set()
        for at in range(len(lines) - 2):
            w = tuple(lines[at : at + 3])
            if "".join(w).strip(" \r\t"):
                i, place = first.setdefault(w, (r[0], at))
                if i != r[0] or at - place >= 3:
                    gone |= {at, at + 1, at + 2}
        if gone:
            text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
            out += [(r[0], text, r[2], r[3], len(text))] if text else []
        else:
            out.append(r)
    return out


def source_targets(size):
    names = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * size[s]}
        target |= {s: 2.0 * size[s] if s in full else weight[s] * level for s in (full or free)}
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    return target


@pytest.fixture(scope="module")
def corpus():
    """Rows of documents and {id: toxic}: fixed toxic phrases, families, shared lines, nulls and a long text."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    rows, labels = [], {}
    source = lambda i: [None, "a", "b", "c", "d"][i % 5 if i % 3 else 1]
    for i in range(240):
        w = [word() for _ in range(rng.randint(20, 60))]
        if i % 8 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), "Vexor")
        elif i % 8 == 1:
            w.insert(rng.randrange(len(w)), "fixed")
        elif i % 16 == 2:
            w = w[:5] + ["\n"] + w[5:10] + ["\n"] + w[10:]
        rows.append((i, " ".join(w), "en", source(i), 1))
        if i < 200:
            labels[i] = int(i % 8 == 0)
    passage, lines = [word() for _ in range(80)], "\n".join(" ".join(word() for _ in range(6)) for _ in range(5))
    passage[40] = "vexor"
    for i in range(300, 316):
        rows.append((i, " ".join([*passage, f"copy{i}"]), "en", source(i), 2))  # ordinary near copies with a toxic word
        labels[i] = 0
    for i in range(320, 332):
        rows.append((i, f"{word()} head{i}\n{lines}\n{word()} tail{i}", "fr", source(i), 3))
    rows += [(340, lines, "en", "a", 4), (341, rows[3][1], "en", "b", 4), (342, rows[3][1], "en", None, 4)]
    rows += [(350, None, None, None, None), (351, "", "en", "a", 0), (352, " \n\n\n\t", "en", "b", 5)]
    rows += [(360, " ".join(word() for _ in range(5000)), "en", "c", 6)]
    return rows, labels


def test_scores_match_plain_class_models(spark, corpus):
    rows, labels = corpus
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(df, lab).collect()}
    llr = class_models([r[:2] for r in rows], labels)
    want = probabilities(llr, labels)
    assert set(got) == set(want)
    # a ratio under 0.001 is left out at either level: a mean moves by less than twice that
    assert max(abs(got[i]["llr"] - llr[i]) for i in llr) < 2e-3
    assert max(abs(got[i]["score"] - want[i]) for i in want) < 0.1
    assert {i for i in want if got[i]["score"] >= P.TOXIC_SCORE} == {i for i in range(240) if i % 8 == 0}


def test_pipeline_matches_plain_python(spark, corpus, tmp_path):
    rows, labels = corpus
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{sf}/labels.parquet")

    score = probabilities(class_models([r[:2] for r in rows], labels), labels)
    calm = [r for r in rows if score[r[0]] < P.TOXIC_SCORE]
    lined = without_repeated_lines(calm)
    group, _ = brute_components([r[:2] for r in lined], P.SHINGLE_WORDS, P.SIMILAR_PERCENT)
    kept = [r for r in lined if group[r[0]] == r[0]]
    assert len(rows) > len(calm) > len(lined) > len(kept)  # every stage has work to do

    docs = P.read_table(spark, sf, "documents")
    for (name, stage), want in zip(P.STAGES, (calm, lined, kept)):
        docs = P.store(stage(spark, docs, sf), "test")
        key = lambda r: r[0]
        assert sorted((tuple(r) for r in docs.collect()), key=key) == sorted(want, key=key), name

    packed = P.run(spark, sf).collect()
    copies = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    text = {r[0]: r[1] or "" for r in kept}
    size, taken = defaultdict(int), defaultdict(int)
    for i, t, _, source, _ in kept:
        size[source] += len(words(t))
        taken[source] += copies[i] * len(words(t))
    assert set(copies) <= set(text) and max(copies.values()) <= 2
    for source, target in source_targets(size).items():
        assert abs(taken[source] - target) <= 2 + 0.01 * target

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, n in copies.items():
        ids = [*tokenizer.encode(text[i], add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), P.CAPACITY)):
            part = np.array(ids[start : start + P.CAPACITY], "<u4")
            want[i, piece, start, len(part), zlib.crc32(part.tobytes())] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= P.CAPACITY
    assert len(sequences) <= -(-sum(r["length"] for r in packed) // P.CAPACITY) + 1
