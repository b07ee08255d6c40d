"""What a task gathers is bounded by the number of its rows, not by the table's."""

import math

from pyspark.sql import functions as F

from corvane.operators import scenarios
from corvane.sources import catalog
from tests.conftest import SF


def test_lists_of_parts_are_gathered_in_as_many_tasks_as_lines_need(spark, monkeypatch):
    whole = {r.id: r for r in catalog.instances(spark, SF).collect()}
    monkeypatch.setattr(catalog, "LINES", 5000, raising=False)
    x = catalog.instances(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert "RepartitionByExpression [l_partkey#" in (plan := x._jdf.queryExecution().optimizedPlan().toString()) and f"], {math.ceil(lines / 5000)}\n" in plan
    assert {r.id: r for r in x.collect()} == whole


def test_edits_are_not_sorted_by_row(spark):
    x = spark.range(50).select("id", F.concat(F.lit("Show Widgets number "), F.col("id").cast("string"), F.lit(" of standard kind")).alias("t"))
    known = spark.createDataFrame([("widgets",), ("standdard",)], "word string")
    y = scenarios.with_typo(x, "id", "t", known, ("show",), "7")
    assert "SortAggregate" not in y._jdf.queryExecution().executedPlan().toString()
    rows = y.collect()
    assert len(rows) == 50 and all(r.noise.split("->")[0] in r.t.split() or r.noise.split("->")[1] in r.t for r in rows) and all("->standdard" not in r.noise for r in rows)
