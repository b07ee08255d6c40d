"""Requests with short forms and misspellings, from their text to concepts; facets; what became of relevant documents on their way through a search."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog_queries import query
from corvane.functions import text as T
from corvane.operators import decisions, evaluation, expand, hybrid, scenarios
from corvane.plans.funnel import FOUND_SQL, SETTINGS, find
from corvane.plans.scenarios import SEED, STOP, _words
from corvane.plans.understanding import _book
from corvane.sources.catalog import instances, table


def _noisy(spark, d):
    x = instances(spark, d).select(F.col("id").alias("query_id"), F.concat(F.lit("Show widget "), "title", F.lit(" for PTO with "), F.lower("data_source"), F.lit(" including "), "category").alias("text"))
    return scenarios.with_typo(x, "query_id", "text", _words(spark, d).unionByName(spark.createDataFrame([("including",), ("widget",)], "word string")), STOP, SEED).select("query_id", "text")


def _expanded(spark, d):
    book = _book(spark, d).withColumn("canonical", F.col("phrase")).withColumn("suppresses", F.array().cast("array<string>"))
    words = instances(spark, d).select(F.explode(T.tokens(F.concat_ws(" ", "title", "category", "data_source"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return expand.expand(_noisy(spark, d), book, words)


@query()
def q9_q5_full_expansion(spark, d):
    """Every request with one misspelled word and a short form: corrected, matched again and expanded; tests compare small cases with rules by hand."""
    return _expanded(spark, d).requests.select("query_id", "text", "expanded", F.array_join("corrected", " ").alias("corrected"), F.size("suppressed").alias("n_suppressed"))


@query()
def h7_full_support(spark, d):
    """How each word of those requests is backed: as it is, by its singular, by a correction, by a short form, or not."""
    return expand.support(_expanded(spark, d), _words(spark, d), hybrid.STOP).select("query_id", "support", F.transform("terms", lambda t: F.concat_ws(":", t.term, t.via)).alias("terms"))


_TERMS = lambda terms: f"regexp_matches(low, '{'|'.join(terms)}')"
_EITHER = lambda a, b, one, two: f"CASE WHEN {_TERMS(a)} AND {_TERMS(b)} THEN 'MULTIPLE' WHEN {_TERMS(a)} THEN '{one}' WHEN {_TERMS(b)} THEN '{two}' ELSE 'UNKNOWN' END"


@query(f"""WITH x AS (SELECT conv_id, turn, replace(lower(text), 'ß', 'ss') AS low, list_sort(list_distinct(list_filter(string_split(role, 's'), lambda v: v <> ''))) AS subject, CASE WHEN turn % 3 = 0 THEN [role] ELSE [] END AS source FROM conversations)
SELECT conv_id, turn, CASE WHEN len(subject) > 0 THEN array_to_string(subject, ', ') ELSE 'NONE' END AS subject, 'NONE' AS measure, CASE WHEN turn % 2 = 0 THEN 'a, b' ELSE 'NONE' END AS dimension, 'NONE' AS population, CASE WHEN len(source) > 0 THEN source[1] ELSE 'NONE' END AS data_source, {_EITHER(expand.CURRENT, expand.HISTORICAL, 'current', 'historical')} AS time_orientation, {_EITHER(expand.DETAIL, expand.AGGREGATE, 'detail', 'aggregate')} AS granularity,
CASE WHEN turn > 3 THEN 'versus' ELSE 'NONE' END AS comparison, 'UNKNOWN' AS time_freshness, {_TERMS(expand.NEGATION)} AS negation, 'UNKNOWN' AS report_type, 'UNKNOWN' AS interface_requirement FROM x""")
def p18_all_facets(spark, d):
    """All twelve facets of every turn taken as a request."""
    none = F.array().cast("array<string>")
    parts = F.array_sort(F.array_distinct(F.filter(F.split("role", "s"), lambda v: v != "")))
    found = expand.facets(F.col("text"), parts, none, F.when(F.col("turn") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none), none, F.when(F.col("turn") % 3 == 0, F.array("role")).otherwise(none), F.when(F.col("turn") > 3, "versus"), F.lit(None).cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in found.items()])


def _traced(spark, d):
    """Relevant to a benchmark text are the documents whose number leaves the text's after division by 40."""
    found = find(spark, d)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("r"))
    relevant = asked.join(table(spark, d, "documents").select(F.col("doc_id").alias("instance_id"), (F.col("doc_id") % 40).alias("r")), "r").select("query_id", "instance_id")
    pairs = lambda x: x.select("query_id", "instance_id")
    final = found.results.where("instance_id is not null")
    stages = {"generated": pairs(found.union), "union": pairs(found.union), "shortlist": pairs(found.shortlist), "rerank": pairs(found.scored.where("ce_score is not null")), "fusion": pairs(found.scored), "expansion": pairs(found.members), "final": pairs(final)}
    return found, relevant, evaluation.survival(relevant, stages)


_AT = {"generated": "unioned", "union": "unioned", "shortlist": "short", "rerank": "fin", "fusion": "fin", "expansion": "mem"}
TRACE_SQL = f"""{FOUND_SQL}, rel AS (SELECT item_id AS query_id, doc_id AS instance_id FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40), final AS (SELECT fr.query_id, selected AS instance_id FROM fr JOIN dec USING (query_id) WHERE family_rank <= {SETTINGS.top_k} AND decision <> '{decisions.NONE}'),
tr AS (SELECT rel.*, {", ".join(f"EXISTS (SELECT 1 FROM {t} s WHERE s.query_id = rel.query_id AND s.instance_id = rel.instance_id) AS at_{n}" for n, t in (_AT | {'final': 'final'}).items())} FROM rel),
ts AS (SELECT *, CASE {" ".join(f"WHEN NOT at_{n} THEN '{n}'" for n in evaluation.STAGES)} END AS lost_at FROM tr)"""


@query(f"WITH {TRACE_SQL} SELECT query_id, instance_id, {', '.join('at_' + n for n in evaluation.STAGES)}, lost_at FROM ts")
def g27_survival_trace(spark, d):
    """Which of the seven stages each relevant document came through, and where it was lost."""
    return _traced(spark, d)[2]


_G = ("bm25f", "splade", "dense")


@query(f"""WITH {TRACE_SQL}, q AS (SELECT query_id, {', '.join(f'avg(at_{n}::INT) AS s_{n}' for n in evaluation.STAGES)} FROM ts GROUP BY 1), g AS (SELECT rel.query_id, {', '.join(f'avg(({g}_rank IS NOT NULL)::INT) AS g_{g}, count(*) FILTER ({g}_rank IS NOT NULL AND n_sources = 1) AS u_{g}' for g in _G)} FROM rel LEFT JOIN unioned u ON u.query_id = rel.query_id AND u.instance_id = rel.instance_id GROUP BY 1)
{" UNION ALL ".join([f"SELECT 'stage' AS kind, '{n}' AS name, round(avg(s_{n}), 6) AS recall, (SELECT count(*) FROM ts WHERE lost_at = '{n}') AS n FROM q" for n in evaluation.STAGES] + [f"SELECT 'generator', '{g}', round(avg(g_{g}), 6), CAST(sum(u_{g}) AS BIGINT) FROM g" for g in _G])}""")
def e6_survival_summary(spark, d):
    """Mean recall at each stage with what was lost there, and of each generator with what it alone found."""
    found, relevant, trace = _traced(spark, d)
    return evaluation.survival_summary(trace, relevant, found.union, _G)
