"""op8's pairs of blocks: compared in rounds, and no tree is shuffled for them."""

import numpy as np
from pyspark.sql import functions as F

from paddock.llm import cover_join


def test_rounds_compare_all_pairs_and_shuffle_no_tree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    x = np.concatenate([x, x + rng.normal(scale=0.08, size=x.shape), x[:20] + 1e-3, x[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500 + i, v[:4].tolist()) for i, v in enumerate(x[:30])] + [(900, None), (901, [0.0] * 6), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plans = []

    def store(d, name, *args):
        if name == "links":
            plans.append(d._jdf.queryExecution().executedPlan().toString())
        return was(d, name, *args)

    was = cover_join.store
    monkeypatch.setattr(cover_join, "store", store)
    got = {}
    for size in (1 << 25, 1):  # all trees in one round, a block in each
        monkeypatch.setattr(cover_join, "ROUND_BYTES", size, raising=False)
        out = cover_join.near_duplicates(df, 0.95, block_rows=16)
        got[size] = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect()), key=repr)
    assert len(plans) > 8 and not any("Exchange hash" in p or "Exchange Round" in p or "Sort" in p for p in plans)
    assert got[1] == got[1 << 25] and len(got[1]) == len(rows)
    links = {r[0]: r[1] for r in got[1]}
    for ids in (range(len(x)), range(500, 530)):
        v = np.array([r[1] for r in rows if r[0] in ids])
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        # the row without an id is no link, nor is it linked
        assert [links[i] for i in ids] == ((u @ u.T >= 0.95).sum(axis=1) - 1).tolist()
    assert spark.createDataFrame(rows[:1], df.schema).transform(cover_join.near_duplicates).where(F.col("kept")).count() == 1
