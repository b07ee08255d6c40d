"""Metrics, mixtures and revisions on small cases worked out by hand or NumPy."""

import math

import numpy as np
import pytest

from corvane.operators import decisions, evaluation, ranking
from corvane.sources import store


def test_family_metrics(spark):
    orders = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 20, 3), (2, 20, 1), (3, 30, 1)], "query_id long, instance_id long, rank int")
    grades = spark.createDataFrame([(1, 20, 2), (1, 11, 1), (2, 30, 2), (9, 10, 2)], "query_id long, instance_id long, grade int")
    family_of = spark.createDataFrame([(10, "a"), (11, "a"), (20, "b"), (30, "c")], "instance_id long, family string")
    got = evaluation.family_metrics(orders, grades, family_of, spark.createDataFrame([(1,), (2,)], "query_id long")).first()
    ndcg = (1 / 1 + 2 / math.log2(3)) / (2 / 1 + 1 / math.log2(3))  # of request 1; 2 and 9 find nothing
    assert (got.queries, got.sibling_queries) == (3, 1) and got.family_ndcg_5 == pytest.approx(ndcg / 3, abs=1e-6) and got.family_mrr == pytest.approx(1 / 3, abs=1e-6)
    # the first instance of a relevant family is 10, which nobody graded best
    assert got.family_recall_10 == pytest.approx(1 / 3, abs=1e-6) and got.instance_recall_1_within_family == 0


def test_decision_metrics_average_over_classes_that_occur(spark):
    rows = [(decisions.RETURN, decisions.RETURN), (decisions.RETURN, decisions.NONE), (decisions.NONE, decisions.NONE)]
    got = evaluation.decision_metrics(spark.createDataFrame(rows, "want string, got string"), "want", "got", (decisions.RETURN, decisions.ASK, decisions.NONE), decisions.NONE).first()
    assert (got.recall_return_results, got.recall_ask_clarification, got.recall_no_confident_match, got.macro_recall) == (0.5, 0, 1, 0.75)
    assert got.accuracy == pytest.approx(2 / 3, abs=1e-6) and got.abstain_rate == pytest.approx(2 / 3, abs=1e-6)


def test_mixture_equals_arrays(spark):
    rng = np.random.default_rng(2)
    a, b, p = rng.normal(size=6), rng.normal(size=6), rng.random(6)
    df = spark.createDataFrame([(1, k, float(a[k]), float(b[k]), float(p[k])) for k in range(6)] + [(2, 0, 900.0, -900.0, 0.5)], "query_id long, id long, first double, second double, p_field double")
    soft = lambda v: v - np.log(np.exp(v - v.max()).sum()) - v.max()
    for field, extra in ((None, 0), (0.3, 0.3 * np.log(p))):
        want = soft(0.6 * soft(a / 0.05) + 0.4 * soft(b / 0.05) + extra)
        got = {(r.query_id, r.id): r.log_p for r in ranking.mixture(df, field_weight=field).collect()}
        assert [got[1, k] for k in range(6)] == pytest.approx(list(want)) and got[2, 0] == pytest.approx(0)


def test_revisions_are_never_overwritten(spark, tmp_path):
    df, root = spark.range(3), str(tmp_path / "a")
    assert [store.write_revision(df, root) for _ in range(3)] == [1, 2, 3]
    (tmp_path / "a" / "revision-00003").rename(tmp_path / "a" / "revision-00007")
    assert store.write_revision(df, root) == 8 and spark.read.parquet(f"{root}/revision-00001").count() == 3
