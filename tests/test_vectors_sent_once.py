"""The best vectors of many queries: tiles of queries change nothing, and vectors aren't sent once for every few queries."""

import numpy as np

from corvane.operators import retrieval


def test_tiles_of_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.standard_normal(6 if i % 9 else 5)]) for i in range(120)]
    v, sent = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), []
    dealt = retrieval._dealt

    def spy(*args):
        out = dealt(*args)
        sent.append(out[0].count())
        return out

    monkeypatch.setattr(retrieval, "_dealt", spy)
    got = sorted((x.query_id, x.rank, x.vec_id) for x in retrieval.top(retrieval.cosine(v, v.where("vec_id < 50"), "vec_id", "embedding", 7), ["query_id"], "vec_id", 7).collect())
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in rows}
    want = []
    for q in range(50):
        near = sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in unit if i != q and len(unit[i]) == len(unit[q]))
        want += [(q, n + 1, i) for n, (_, i) in enumerate(near[:7])]
    assert got == sorted(want)
    assert sent == [120]
