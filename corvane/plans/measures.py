"""Measurement runs and parity gates over the events of each type: value is a latency, and a score."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog_queries import query
from corvane.operators import evaluation
from corvane.sources.catalog import table


@query("""WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS place FROM events WHERE user_id % 3 > 0), m AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r FROM p WHERE place BETWEEN 20 AND 419)
SELECT event_type, any_value(n) AS n, round(avg(value) FILTER (r IN ((n - 1) // 2, n // 2)), 6) AS p50, max(value) FILTER (r = greatest(CAST(floor(n * 0.95) AS BIGINT) - 1, 0)) AS p95 FROM m GROUP BY 1""")
def e16_measured_run(spark, d):
    """Of the events with a positive user, the first 400 of each type after 20 to warm up: median and late latencies."""
    x = table(spark, d, "events").where("user_id % 3 > 0").select("event_type", "event_id", "value")
    return evaluation.measured_run(x, ["event_type"], "event_id", "value", 20, 400).withColumn("p50", F.round("p50", 6))


_OTHER = "CASE WHEN event_id % 499 = 0 THEN value + 3 ELSE value + (event_id % 3) * 1e-4 END"


@query(f"""WITH s AS (SELECT event_type, event_id, value AS a, {_OTHER} AS b FROM events WHERE event_id % 5 > 0), c AS (SELECT x.event_type, count(*) FILTER ((x.a - y.a) * (x.b - y.b) < 0) AS m FROM s x JOIN s y ON x.event_type = y.event_type AND x.event_id < y.event_id GROUP BY 1)
SELECT event_type, count(*) AS n, 0::BIGINT AS not_finite, round(max(abs(a - b)), 6) AS largest_gap, any_value(m) AS mismatches, false AS passed FROM s JOIN c USING (event_type) GROUP BY 1""")
def e18_scorer_parity(spark, d):
    """A scorer that shifts every 499th score against the one that it should stand for."""
    x = table(spark, d, "events").where("event_id % 5 > 0").select("event_type", "event_id", F.col("value").alias("a"), F.expr(_OTHER).alias("b"))
    return evaluation.parity(x, ["event_type"], "event_id", "a", "b", 1e-3).withColumn("largest_gap", F.round("largest_gap", 6))
