"""Hits of generators are exchanged twice on their way to a shortlist, not once a window."""

from corvane.catalog_queries import _short

SF = "/root/testdata/sf0.001"


def test_two_exchanges_up_to_the_shortlist(spark):
    plan = _short(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
