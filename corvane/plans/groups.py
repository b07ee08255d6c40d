"""Clusters of requests, folds and splits of orders by customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog_queries import query
from corvane.operators import groups
from corvane.plans.understanding import _TEXT, _requests
from corvane.sources.catalog import table

FRACTIONS = {"train": 0.70, "validation": 0.15, "test": 0.15}
_TRI = "flatten(list_transform(list_transform(list_filter(regexp_split_to_array(lower(t), '[ \\t\\n\\r]+'), lambda w: w <> ''), lambda w: ' ' || w || ' '), lambda w: list_transform(range(1, greatest(length(w) - 1, 2)), lambda i: substr(w, CAST(i AS INT), 3))))"


@query(f"""WITH RECURSIVE s AS (SELECT p_partkey AS id, {_TEXT} AS t FROM part), g AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TRI}) AS term FROM s) GROUP BY 1, 2), i AS (SELECT term, ln((1 + (SELECT count(*) FROM s)) / (1 + count(*))) + 1 AS idf FROM g GROUP BY 1),
w AS (SELECT id, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS m FROM g JOIN i USING (term)), pr AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING round(sum(a.w / a.m * b.w / b.m), 9) >= 0.95),
near AS (SELECT b, list(a ORDER BY a) AS before FROM pr GROUP BY 1), o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n, coalesce(before, []) AS before FROM s LEFT JOIN near ON b = id),
seq AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS led UNION ALL SELECT o.n, CASE WHEN list_has_any(before, led) THEN led ELSE list_append(led, id) END FROM seq JOIN o ON o.n = seq.n + 1),
fin AS (SELECT led FROM seq ORDER BY n DESC LIMIT 1) SELECT id, coalesce(list_filter(before, lambda x: list_contains(led, x))[1], id) AS leader FROM o, fin""")
def l11_leader_clusters(spark, d):
    """Requests that differ in hardly any trigram, each led by the first leader near it."""
    return groups.near_duplicate_clusters(_requests(spark, d).withColumnRenamed("query_id", "id"), "id", "text")


@query("""WITH RECURSIVE g AS (SELECT o_custkey AS c, count(*) AS size FROM orders GROUP BY 1), o AS MATERIALIZED (SELECT c, size, row_number() OVER (ORDER BY size DESC, c DESC) AS n FROM g),
seq AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS c, NULL::INT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads UNION ALL
  SELECT o.n, o.c, (list_position(loads, list_min(loads)) - 1)::INT, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + size ELSE x END) FROM seq JOIN o ON o.n = seq.n + 1)
SELECT o_orderkey AS id, fold FROM orders JOIN seq ON seq.c = o_custkey""")
def l10_group_folds(spark, d):
    """Orders in five folds of nearly one size, a customer's together."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    return groups.group_folds(x, "id", "customer")


@query("""WITH RECURSIVE c AS (SELECT o_custkey AS g, o_orderpriority AS s, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2), own AS (SELECT g, arg_min(s, (-n, first)) AS s FROM c GROUP BY 1),
o AS MATERIALIZED (SELECT g, s, row_number() OVER (PARTITION BY s ORDER BY sha256('20260804:' || g), g) AS n FROM own),
seq AS (SELECT DISTINCT s, 0::BIGINT AS n, NULL::BIGINT AS g, NULL::VARCHAR AS split, 0 AS a, 0 AS b, 0 AS c FROM own UNION ALL
  SELECT o.s, o.n, o.g, CASE WHEN 3 * a <= 14 * b AND 3 * a <= 14 * c THEN 'train' WHEN b <= c THEN 'validation' ELSE 'test' END, a + (3 * a <= 14 * b AND 3 * a <= 14 * c)::INT, b + (NOT (3 * a <= 14 * b AND 3 * a <= 14 * c) AND b <= c)::INT, c + (NOT (3 * a <= 14 * b AND 3 * a <= 14 * c) AND b > c)::INT FROM seq JOIN o ON o.s = seq.s AND o.n = seq.n + 1)
SELECT o_orderkey AS id, g AS customer, s AS priority, split FROM orders JOIN seq ON g = o_custkey""")
def a20_stratified_splits(spark, d):
    """Orders in three splits, a customer's together, dealt among customers of one main priority."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    order = F.sha2(F.concat(F.lit("20260804:"), F.col("customer").cast("string")), 256)
    return groups.stratified_splits(x, "id", "customer", "priority", order, FRACTIONS)
