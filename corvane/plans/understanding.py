"""Queries of request understanding: requests made of parts' names, kinds and brands; phrases are the distinct ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog_queries import SINGULAR, TOK, query
from corvane.functions import text as T
from corvane.operators import understanding as U
from corvane.sources.catalog import table

_TEXT = "concat('Show ', p_name, CASE WHEN p_size % 2 = 0 THEN 's' ELSE '' END, CASE p_size % 6 WHEN 0 THEN ' by ' WHEN 1 THEN ' including ' WHEN 2 THEN ' maybe ' WHEN 3 THEN ' but with ' WHEN 4 THEN ' must have ' ELSE ' showing ' END, p_type, CASE WHEN p_size % 5 = 0 THEN ' such as ' ELSE ' grouped by ' END, p_brand)"
_BOOK = "SELECT DISTINCT lower(p_name) AS phrase, 'field' AS kind, 'literal' AS origin, 1.0::DOUBLE AS confidence FROM part UNION SELECT DISTINCT lower(split_part(p_name, ' ', 2)), 'topic', 'literal', 0.95 FROM part UNION SELECT DISTINCT lower(p_type), 'field', 'phrase_rule', 0.9 FROM part UNION SELECT DISTINCT lower(p_brand), 'field', 'phrase_rule', 0.75 FROM part"
_FORMS = f"list_concat([w, {SINGULAR.format('w')}], CASE WHEN length(w) > 3 THEN [w || 's'] ELSE [] END)"
MATCH_SQL = f"""req AS (SELECT p_partkey AS query_id, {_TEXT} AS text, {TOK.format(_TEXT)} AS words FROM part), book AS (SELECT *, string_split(replace(phrase, '#', ' '), ' ') AS p FROM ({_BOOK})),
pos AS (SELECT query_id, words, list_transform(words, lambda w: {_FORMS}) AS forms, unnest(range(0, len(words))) AS s FROM req),
m AS (SELECT query_id, words, CAST(s AS INT) AS start, CAST(s + len(p) AS INT) AS "end", phrase, kind, origin, confidence, words[s + 1:s + len(p)] <> p AS morphological FROM pos JOIN book ON list_contains(forms[s + 1], p[1]) AND s + len(p) <= len(words) AND list_bool_and(list_transform(range(1, len(p) + 1), lambda i: list_contains(forms[s + i], p[i]))))"""


def _requests(spark, d):
    text = F.expr(_TEXT)
    return table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), text.alias("text"), T.tokens(text).alias("words"))


def _book(spark, d):
    part = table(spark, d, "part")
    one = lambda c, kind, origin, confidence: part.select(F.lower(c).alias("phrase")).distinct().select("phrase", F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), F.lit(confidence).alias("confidence"))
    x = one(F.col("p_name"), "field", "literal", 1.0).unionByName(one(F.split_part("p_name", F.lit(" "), F.lit(2)), "topic", "literal", 0.95))
    x = x.unionByName(one(F.col("p_type"), "field", "phrase_rule", 0.9)).unionByName(one(F.col("p_brand"), "field", "phrase_rule", 0.75))
    return x.withColumn("words", T.tokens(F.col("phrase")))


def _matches(spark, d):
    return U.find_phrases(_requests(spark, d), _book(spark, d))


@query(f'WITH {MATCH_SQL} SELECT query_id, start, "end", phrase, kind, morphological FROM m')
def q1_r16_phrases(spark, d):
    return _matches(spark, d).select("query_id", "start", "end", "phrase", "kind", "morphological")


_GATE = """WITH {0}, w AS (SELECT *, array_to_string(words[greatest(0, start - 2) + 1:least(len(words), "end" + 2)], ' ') AS near FROM m) SELECT query_id, start, phrase, kind, (contains(near, 'by') OR contains(near, 'show')) AND NOT contains(near, 'maybe') AS holds FROM w"""


@query(_GATE.format(MATCH_SQL))
def f9_context_gate(spark, d):
    x = _matches(spark, d).join(_requests(spark, d).select("query_id", "words"), "query_id")
    holds = U.context_holds(F.col("words"), F.col("start"), F.col("end"), F.lit(2), F.array(F.lit("by"), F.lit("show")), F.array(F.lit("maybe")))
    return x.select("query_id", "start", "phrase", "kind", holds.alias("holds"))


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _cut_sql(name, rest):
    for mark in U.BOUNDARIES:
        name = f"(CASE WHEN list_contains({name}, '{mark}') THEN {name}[" + rest.format(f"list_position({name}, '{mark}')") + f"] ELSE {name} END)"
    return name


TIER_SQL = f"""{MATCH_SQL}, o AS (SELECT * REPLACE (CASE WHEN morphological THEN 'morphological' ELSE origin END AS origin) FROM m),
l AS (SELECT *, words[greatest(0, start - 8) + 1:start] AS l0, words["end" + 1:"end" + 3] AS r0 FROM o), b AS (SELECT *, {_cut_sql('l0', '{0} + 1:')} AS lf, {_cut_sql('r0', ':{0} - 1')} AS rt FROM l),
n AS (SELECT *, list_concat(lf[greatest(len(lf) - 4, 0) + 1:], rt[1:2]) AS near, array_to_string(lf[greatest(len(lf) - 4, 0) + 1:], ' ') AS ph FROM b),
f AS (SELECT *, list_has_any(near, {_list(U.DOWNGRADE_WORDS)}) OR regexp_matches(ph, '{"|".join(U.DOWNGRADE_PHRASES)}') AS down, list_has_any(near, {_list(U.PREFERRED_WORDS)}) OR regexp_matches(ph, '({"|".join(U.GROUPING_PHRASES)})$') AS pref,
 (kind = 'field' AND origin = 'literal' AND confidence = 1) OR (kind = 'field' AND origin = 'phrase_rule' AND confidence >= 0.88 AND (list_has_any(lf, {_list(U.REQUIRED_WORDS)}) OR ends_with(ph, 'must have') OR coalesce(list_contains({_list(U.REQUEST_WORDS)}, lf[-1]), false))) AS need, start > 0 AND words[start] = 'showing' AS showing, origin IN ('typo', 'morphological') OR confidence < 0.8 AS soft FROM n),
t AS (SELECT *, CASE WHEN down THEN 'MENTIONED' WHEN (need OR (NOT pref AND showing)) AND NOT soft THEN 'REQUIRED' WHEN need OR pref OR showing THEN 'PREFERRED' ELSE 'MENTIONED' END AS tier0 FROM f),
tier AS (SELECT *, CASE WHEN tier0 = 'REQUIRED' AND row_number() OVER (PARTITION BY query_id, tier0 ORDER BY confidence DESC, start, phrase DESC) > 1 THEN 'PREFERRED' ELSE tier0 END AS tier FROM t)"""


@query(f"WITH {TIER_SQL} SELECT query_id, start, phrase, kind, tier FROM tier")
def q6_requirement_tiers(spark, d):
    """Tiers of mentions; at most one stays required here, so that the limit shows."""
    x = _matches(spark, d).join(_requests(spark, d).select("query_id", "words"), "query_id").withColumn("origin", F.when(F.col("morphological"), "morphological").otherwise(F.col("origin")))
    x = U.requirement(x.withColumnRenamed("phrase", "canonical"))
    return U.limit_required(x, 1).select("query_id", "start", F.col("canonical").alias("phrase"), "kind", "tier")


@query(f"""WITH {MATCH_SQL}, c AS (SELECT query_id, kind, 'the ' || phrase AS canonical, max(confidence) AS confidence FROM m GROUP BY ALL), a AS (SELECT c.query_id, kind, canonical, confidence FROM c JOIN req ON req.query_id = c.query_id WHERE NOT contains(array_to_string(words, ' '), array_to_string({TOK.format('canonical')}, ' ')))
SELECT req.query_id, text || coalesce(' ' || (SELECT string_agg(canonical, ' ' ORDER BY confidence DESC, kind, canonical) FROM a WHERE a.query_id = req.query_id), '') AS expanded FROM req""")
def q9_expanded_request(spark, d):
    """From request to expanded text. Concepts are named with an article, so that they aren't in the request already."""
    concepts = _matches(spark, d).select("query_id", "kind", F.concat(F.lit("the "), "phrase").alias("canonical"), "confidence")
    return U.expanded_text(_requests(spark, d), concepts).select("query_id", "expanded")


_INVERSION = "SELECT DISTINCT p_type AS canonical, 'R' || p_size AS rule, lower(p_name) AS phrase FROM part"


@query(f"SELECT canonical, list_sort(list(DISTINCT rule || ':' || phrase)) AS phrasings FROM ({_INVERSION}) GROUP BY 1")
def y12_lexicon_inversion(spark, d):
    """What phrases lead to a name. A lexicon is small: its rules are distinct names, kinds and sizes."""
    x = table(spark, d, "part").select(F.col("p_type").alias("canonical"), F.concat(F.lit("R"), F.col("p_size").cast("string"), F.lit(":"), F.lower("p_name")).alias("r"))
    return x.groupBy("canonical").agg(F.sort_array(F.collect_set("r")).alias("phrasings"))


@query(f"SELECT DISTINCT unnest({TOK.format('v')}) AS word FROM (SELECT p_name AS v FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part)")
def a8_y12_vocabulary(spark, d):
    values = table(spark, d, "part").select(F.explode(F.array("p_name", "p_brand", "p_type")).alias("v"))
    return values.select(F.explode(T.tokens(F.col("v"))).alias("word")).distinct()
