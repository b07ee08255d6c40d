"""Queries of judgments: orders as scenarios, order lines as graded judgments, priorities as splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog_queries import UNION, _union, query
from corvane.operators import judgments as J
from corvane.sources.catalog import table

_SPLIT = "CASE o_orderpriority WHEN '1-URGENT' THEN 'test' WHEN '2-HIGH' THEN 'validation' WHEN '3-MEDIUM' THEN 'calibration' ELSE 'train' END"
_ANSWER = "CASE o_orderstatus WHEN 'F' THEN 'Answerable' WHEN 'O' THEN 'Needs clarification' ELSE 'No answer' END"
DATA = f"""sc AS (SELECT o_orderkey AS scenario_id, {_ANSWER} AS answerability, o_orderpriority AS query, {_SPLIT} AS split FROM orders),
ju AS (SELECT l_orderkey AS scenario_id, l_partkey AS report_key, CASE WHEN l_returnflag = 'A' THEN l_linenumber % 4 END AS adjudicated_grade, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INT) % 4 END AS human_grade, CASE WHEN l_suppkey % 5 > 0 THEN CAST(l_suppkey AS INT) % 4 END AS synthetic_grade FROM lineitem)"""


def scenarios(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.expr(_ANSWER).alias("answerability"), F.col("o_orderpriority").alias("query"))


def splits(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.expr(_SPLIT).alias("split"))


def judged(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("scenario_id"), F.col("l_partkey").alias("report_key"), F.when(F.col("l_returnflag") == "A", (F.col("l_linenumber") % 4).cast("int")).alias("adjudicated_grade"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int") % 4).alias("human_grade"), F.when(F.col("l_suppkey") % 5 > 0, (F.col("l_suppkey") % 4).cast("int")).alias("synthetic_grade"),
    )


@query(f"WITH {DATA} SELECT scenario_id, report_key, coalesce(adjudicated_grade, human_grade, synthetic_grade) AS grade, CASE WHEN adjudicated_grade IS NOT NULL THEN 'adjudicated' WHEN human_grade IS NOT NULL THEN 'human' ELSE 'synthetic-seed' END AS label_source, CASE WHEN coalesce(adjudicated_grade, human_grade) IS NOT NULL THEN 1.0::DOUBLE ELSE 0.6 END AS label_weight, answerability FROM ju JOIN sc USING (scenario_id) WHERE coalesce(adjudicated_grade, human_grade, synthetic_grade) IS NOT NULL")
def j9_qrels(spark, d):
    return J.qrels(scenarios(spark, d), judged(spark, d)).drop("query")


@query("SELECT l_orderkey AS scenario_id, l_partkey AS report_key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def j9_unknown_scenarios(spark, d):
    return J.unknown_scenarios(judged(spark, d), scenarios(spark, d)).select("scenario_id", "report_key")


@query("SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def j10_labelled_passes(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")


_GRADES = "list(report_key || ':' || grade ORDER BY report_key, grade)"


@query(f"WITH {DATA}, g AS (SELECT scenario_id, report_key, max(synthetic_grade) AS grade FROM ju WHERE synthetic_grade IS NOT NULL GROUP BY 1, 2) SELECT scenario_id, query, {_GRADES} AS grades FROM g JOIN sc USING (scenario_id) WHERE split = 'train' GROUP BY 1, 2")
def j17_labelled_queries(spark, d):
    x = J.labelled_queries(scenarios(spark, d), judged(spark, d), splits(spark, d), "train")
    return x.withColumn("grades", F.transform("grades", lambda s: F.concat_ws(":", s["report_key"], s["grade"])))


@query(f"WITH {DATA}, g AS (SELECT scenario_id, report_key, max(synthetic_grade) AS grade FROM ju WHERE synthetic_grade > 0 GROUP BY 1, 2), m AS (SELECT scenario_id, {_GRADES} AS relevant FROM g GROUP BY 1) SELECT scenario_id, coalesce(relevant, []) AS relevant, answerability <> 'No answer' AS answerable, CASE WHEN answerability = 'No answer' THEN 'NO_SATISFACTORY_REPORT' WHEN contains(lower(answerability), 'clarification') THEN 'NEEDS_CLARIFICATION' END AS expected_status FROM sc LEFT JOIN m USING (scenario_id) WHERE split = 'validation'")
def e13_weak_qrels(spark, d):
    x = J.weak_qrels(scenarios(spark, d), judged(spark, d), splits(spark, d), "validation")
    return x.withColumn("relevant", F.transform(F.sort_array(F.map_entries("relevant")), lambda s: F.concat_ws(":", s["key"], s["value"])))


@query("SELECT event_id, CASE WHEN CAST(floor(value) AS INT) % 5 > 2 THEN 'grade' WHEN user_id % 7 = 0 THEN 'annotator' WHEN event_type <> 'click' THEN 'source' END AS fault FROM events")
def e14_judgment_contract(spark, d):
    x = table(spark, d, "events").select(
        "event_id", (F.floor("value").cast("int") % 5).alias("relevance"), F.when(F.col("user_id") % 7 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("annotator_id"), F.when(F.col("event_type") == "click", "production_query").otherwise(F.col("event_type")).alias("source")
    )
    return x.select("event_id", J.judgment_faults().alias("fault"))


@query("SELECT l_orderkey AS scenario_id, list_sort(list(DISTINCT l_returnflag)) AS splits FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def l13_split_overlap(spark, d):
    return J.split_overlap(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scenario_id"), F.col("l_returnflag").alias("split")))


@query(f"WITH {DATA} SELECT scenario_id, report_key FROM ju JOIN sc USING (scenario_id) WHERE split = 'test'")
def l13_sealed_rows(spark, d):
    """Rows that threshold tuning may not see."""
    return J.sealed_rows(judged(spark, d), splits(spark, d), "threshold_tuning").select("scenario_id", "report_key")


@query(f"WITH {DATA} SELECT report_key, list_sort(list(DISTINCT split)) AS splits FROM ju JOIN sc USING (scenario_id) WHERE synthetic_grade > 0 GROUP BY 1 HAVING count(DISTINCT split) > 1")
def l13_shared_positives(spark, d):
    return J.shared_positives(judged(spark, d).where("synthetic_grade > 0").join(splits(spark, d), "scenario_id"))


@query(f"""WITH {UNION}, g AS (SELECT l_suppkey AS query_id, l_partkey AS instance_id, min(l_linenumber) % 3 AS grade FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), gf AS (SELECT DISTINCT query_id, lower(p_name) AS family FROM g JOIN part ON p_partkey = instance_id WHERE grade > 0)
SELECT u.query_id, u.instance_id, grade IS NULL OR grade > 0 OR gf.family IS NOT NULL AS masked FROM unioned u JOIN part ON p_partkey = u.instance_id LEFT JOIN g ON g.query_id = u.query_id AND g.instance_id = u.instance_id LEFT JOIN gf ON gf.query_id = u.query_id AND gf.family = lower(p_name)""")
def l12_co_positive_mask(spark, d):
    """Returned lines are the judged ones, graded by their least line number."""
    family = table(spark, d, "part").select(F.col("p_partkey").alias("instance_id"), F.lower("p_name").alias("family"))
    g = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("instance_id")).agg((F.min("l_linenumber") % 3).alias("grade"))
    return J.co_positive_mask(_union(spark, d).select("query_id", "instance_id").join(family, "instance_id"), g.join(family, "instance_id"))


@query("WITH p AS (SELECT o_orderstatus || year(o_orderdate) AS archetype, (o_custkey % 100) / 100.0 AS c, (o_orderkey % 50) / 50.0 AS f FROM orders) SELECT archetype, count(*) AS queries, round(avg(c), 4) AS candidate, round(avg(f), 4) AS fallback, round(avg(c) - avg(f), 4) AS delta FROM p GROUP BY 1 HAVING count(*) >= 10")
def e20_archetype_slices(spark, d):
    x = table(spark, d, "orders").select(F.concat("o_orderstatus", F.year("o_orderdate").cast("string")).alias("archetype"), ((F.col("o_custkey") % 100) / 100.0).alias("candidate_ndcg"), ((F.col("o_orderkey") % 50) / 50.0).alias("fallback_ndcg"))
    return J.slices(x, "archetype", "ndcg")


_TAUS = [0.0, 0.02, 0.04, 0.05, 0.06, 0.08, 0.2]


@query("WITH t AS (SELECT unnest([0.0, 0.02, 0.04, 0.05, 0.06, 0.08, 0.2])::DOUBLE AS tau) SELECT tau, round(avg((l_discount >= tau)::INT), 6) AS coverage, round(avg((l_returnflag = 'R')::INT) FILTER (l_discount >= tau), 6) AS precision FROM lineitem, t GROUP BY 1")
def e15_threshold_sweep(spark, d):
    return J.threshold_sweep(table(spark, d, "lineitem").select(F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").alias("hit")), _TAUS)
