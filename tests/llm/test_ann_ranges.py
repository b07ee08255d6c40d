"""op10 over several shards of the given table, hub points, any range of floats and few candidates."""

import numpy as np
import pytest

from corvane.llm import ann

SF = "/root/testdata/sf0.1"


def brute(ids, vectors, queries, k):
    with np.errstate(over="ignore"):
        return {int(q): [int(v) for v in ids[np.lexsort((ids, np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))))] if v != q][:k] for q in queries}


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("shard", [ann.SHARD, 300])
def test_recall_on_the_given_table(spark, shard):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = v.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    queries = ids[ids % 100 == 0]
    want, got = brute(ids, x, queries, 10), found(ann.nearest(v, v.where("vec_id % 100 = 0"), shard=shard).collect())
    assert np.mean([len(set(want[q]) & set(got[q])) / 10 for q in want]) >= 0.99


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e25, 1e150])
def test_any_range_and_offset(spark, scale):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(200, 6)) + 40) * scale
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want, got = brute(np.arange(200), x, [0, 100], 10), found(ann.nearest(v, v.where("vec_id % 100 = 0")).collect())
    assert got == want


def test_a_query_far_out_is_ranked_exactly(spark):
    x = [[float(i), 1.0] for i in range(1, 60)]
    v = spark.createDataFrame(list(enumerate(x, 1)), "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1000, [1e12, 1.0])], "vec_id long, embedding array<double>")
    assert found(ann.nearest(v, q).collect())[1000] == list(range(59, 49, -1))


def test_fewer_than_k_candidates(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert found(ann.nearest(v, v.where("vec_id = 0")).collect()) == {0: [2, 1]}


def test_points_of_a_hub_keep_all_back_edges_in_view():
    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros((1, 8)), rng.normal(size=(1500, 8)) * 0.1 + rng.choice([-5, 5], (1500, 8))])
    g = ann.Graph(x)
    near, _ = g.search(x[::50], 64)
    for row, q in zip(near, x[::50], strict=True):
        best = np.argsort(((x - q) ** 2).sum(1))[:10]
        assert len(set(best) & set(row)) >= 9
