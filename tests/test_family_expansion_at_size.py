"""Siblings of leading families: places by hand, and no more rows met than are asked for."""

import pytest

from corvane.operators import rerank


def plain(families, instances, scored, allowed, leading, most):
    out = []
    for q in {f[0] for f in families}:
        rows = [(r, i, f) for qq, f, r in families if qq == q and r <= leading for i, g in instances if g == f and (q, i) not in scored and i in allowed]
        out += [(q, i, f, k + 1) for k, (_, i, f) in enumerate(sorted(rows)[:most])]
    return sorted(out)


@pytest.mark.parametrize("leading, most", [(20, 60), (1, 10**9), (2, 5), (3, 140)])
def test_equals_the_plain_order(spark, leading, most):
    instances = [(i, f"f{i % 3}") for i in range(400)] + [(i, "tiny") for i in range(400, 403)] + [(500, None)]
    allowed = [i for i, _ in instances if i % 4]
    families = [(1, "f0", 1), (1, "tiny", 2), (1, "f2", 3), (2, "tiny", 1), (2, "f1", 2), (3, "none", 1), (4, "tiny", 1)]
    scored = [(1, i) for i in range(0, 300, 2)] + [(1, 3), (1, 3), (2, 401), (2, 402), (2, 1), (4, 401), (4, 402), (4, 999)]
    make = spark.createDataFrame
    x = rerank.expand_families(make(families, "query_id long, family string, family_rank int"), make(instances, "instance_id long, family string"), make(scored, "query_id long, instance_id long"), make([(i,) for i in allowed], "instance_id long"), leading, most)
    assert sorted(map(tuple, x.collect())) == plain(families, instances, set(scored), set(allowed), leading, most)


def test_no_exchange_or_sort_of_expanded_rows(spark):
    make = spark.createDataFrame
    x = rerank.expand_families(make([(1, "f", 1)], "query_id long, family string, family_rank int"), make([(1, "f")], "instance_id long, family string"), make([(1, 2)], "query_id long, instance_id long"), make([(1,)], "instance_id long"))
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join")]
    assert "Window" not in top and "Aggregate" not in top and "LeftAnti" not in plan
