"""Further queries of the catalog engine: encoders, request understanding, confidence, reranking, explanations, datasets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.catalog_queries import FAMILY, FOLD, INST, SHORT, SINGULAR, TOK, UNION, _families, _scored, _short, _union, query
from corvane.functions import text as T
from corvane.operators import confidence, encoded, expansion, groups, rerank, typos
from corvane.sources.catalog import GENERATORS, instances, spread, table

_TERM = f"CAST('0x' || left(sha256(t), 8) AS BIGINT) % {encoded.TERMS}"


def _sparse_sql(name: str, source: str, key: str) -> str:
    return f"""{name}_tf AS (SELECT {key}, t, count(*) AS tf FROM (SELECT {key}, unnest({TOK.format('text')}) AS t FROM {source}) GROUP BY 1, 2),
{name} AS (SELECT {key}, {_TERM} AS term_id, round(ln(1 + max(tf)), 6) AS weight FROM {name}_tf GROUP BY 1, 2 HAVING round(ln(1 + max(tf)), 6) >= 0.01)"""


def _sparse(spark, d, name, key):
    return encoded.encode_sparse(spread(table(spark, d, name), key), key, T.tokens(F.col("text")))


# --- encoders -----------------------------------------------------------------------------------


@query(f"WITH {_sparse_sql('s', 'benchmark', 'item_id')} SELECT item_id, term_id, weight FROM s")
def r8_sparse_encode(spark, d):
    return _sparse(spark, d, "benchmark", "item_id")


@query(f"WITH {_sparse_sql('p', 'documents', 'doc_id')}, {_sparse_sql('q', 'benchmark', 'item_id')}, sc AS (SELECT q.item_id AS query_id, doc_id, round(sum(q.weight * p.weight), 6) AS score FROM q JOIN p USING (term_id) GROUP BY 1, 2 HAVING sum(q.weight * p.weight) > 0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 100")
def r9_sparse_search(spark, d):
    from corvane.operators import retrieval

    q = _sparse(spark, d, "benchmark", "item_id").withColumnRenamed("item_id", "query_id")
    return retrieval.top(encoded.best_sparse(q, _sparse(spark, d, "documents", "doc_id"), "query_id", "doc_id", 100).where("score > 0"), ["query_id"], "doc_id", 100).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_sparse_sql('s', 'benchmark', 'item_id')} SELECT item_id, list(term_id ORDER BY weight DESC, term_id)[1:12] AS evidence FROM s GROUP BY 1")
def r10_sparse_evidence(spark, d):
    return encoded.strongest_terms(_sparse(spark, d, "benchmark", "item_id"), "item_id")


@query("""WITH v AS (SELECT vec_id, list_transform(range(0, len(embedding), 16), lambda i: list_transform(embedding[i + 1:i + 16], lambda x: x::DOUBLE)) AS t FROM embeddings),
sc AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(q.t, lambda a: list_max(list_transform(v.t, lambda b: list_dot_product(a, b))))), 6) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc QUALIFY rank <= 50""")
def r11_max_sim(spark, d):
    """The stated query set is every vector whose id is divisible by 50; a vector is a text of tokens of 16 components."""
    from corvane.operators import retrieval

    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    x = encoded.max_sim_all(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), "vec_id", "query_id", 16)
    return retrieval.top(x, ["query_id"], "vec_id", 50).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {INST}, f AS (SELECT family, lower('show ' || arg_min(title, id) || CASE WHEN len(arg_min(fields, id)) > 0 THEN ' with ' || array_to_string(arg_min(fields, id)[1:4], ', ') ELSE '' END) AS text FROM inst GROUP BY 1),
p AS (SELECT family, unnest(list_distinct({TOK.format('text')})) AS word FROM f WHERE length(family) % 7 <> 0), q AS (SELECT DISTINCT p_type AS request FROM part), qw AS (SELECT DISTINCT string_split(lower(p_name), ' ')[1] AS request, unnest(['show', string_split(lower(p_name), ' ')[1], 's1', 's2']) AS word FROM part),
s AS (SELECT request, family, count(*) / 4.0 AS score FROM qw JOIN p USING (word) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, family) AS family_rank FROM s QUALIFY family_rank <= 50)
SELECT request, family, id, round(score, 6) AS score, row_number() OVER (PARTITION BY request ORDER BY family_rank, id) AS rank FROM r JOIN inst USING (family) QUALIFY rank <= 50""")
def a14_r14_f5_prototype_generator(spark, d):
    """Families by their best prototype that isn't rejected, then their instances, 50 a request. Every family whose name's length is divisible by 7 counts as rejected."""
    x = instances(spark, d)
    p = expansion.prototypes(x).where(F.length("family") % 7 != 0).select("family", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    head = F.substring_index(F.lower("title"), " ", 1)
    q = x.select(head.alias("request"), F.explode(F.array(F.lit("show"), head, F.lit("s1"), F.lit("s2"))).alias("word")).distinct()
    s = q.join(p, "word").groupBy("request", "family").agg((F.count(F.lit(1)) / 4.0).alias("score"))
    r = s.withColumn("family_rank", F.row_number().over(Window.partitionBy("request").orderBy(F.col("score").desc(), "family"))).where("family_rank <= 50")
    y = r.join(x.select("family", "id"), "family").withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("family_rank", "id")).cast("long"))
    return y.where("rank <= 50").select("request", "family", "id", F.round("score", 6).alias("score"), "rank")


_FORM = "CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.85 ELSE 0.75 END"


@query(f"WITH s AS (SELECT l_partkey AS id, l_returnflag AS form, {_FORM} AS weight, greatest(0, max(l_extendedprice) - 20000) AS score FROM lineitem GROUP BY ALL) SELECT id, form, round(weight * score / (SELECT nullif(max(score), 0) FROM s), 6) AS score FROM s")
def r17_r18_form_scores(spark, d):
    """Scores of request forms over the greatest of all, weighted by form; negative ones count as zero."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("form")).agg(F.greatest(F.lit(0.0), F.max("l_extendedprice") - 20000).alias("s"))
    top = F.broadcast(s.agg(F.nullif(F.max("s"), F.lit(0.0)).alias("m")))  # one row
    weight = F.when(F.col("form") == "A", 1.0).when(F.col("form") == "N", 0.85).otherwise(0.75)
    return s.join(top, F.lit(True)).select("id", "form", F.round(weight * F.col("s") / F.col("m"), 6).alias("score"))


@query(f"""WITH {INST}, r AS (SELECT CAST(s_nationkey AS BIGINT) AS request, 'S' || s_suppkey AS field FROM supplier), n AS (SELECT request, count(*) AS n FROM r GROUP BY 1), f AS (SELECT id, unnest(fields) AS field FROM inst),
h AS (SELECT request, id, count(*) / any_value(n) AS share FROM r JOIN f USING (field) JOIN n USING (request) GROUP BY 1, 2), t AS (SELECT request, sum(share) + 0.05 * (SELECT count(*) FROM part) AS t FROM h GROUP BY 1)
SELECT request, id, round((share + 0.05) / t, 6) AS p, round(0.05 / t, 6) AS p_of_others FROM h JOIN t USING (request)""")
def r20_field_expert(spark, d):
    """Instances with any requested field; all others share one probability, so no row is made for them."""
    r = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("request"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("field"))
    n = r.groupBy("request").agg(F.count(F.lit(1)).alias("n"))
    h = instances(spark, d).select("id", F.explode("fields").alias("field")).join(r, "field").groupBy("request", "id").agg(F.count(F.lit(1)).alias("k")).join(n, "request").withColumn("share", F.col("k") / F.col("n"))
    t = h.groupBy("request").agg((F.sum("share") + 0.05 * table(spark, d, "part").count()).alias("t"))
    return h.join(t, "request").select("request", "id", F.round((F.col("share") + 0.05) / F.col("t"), 6).alias("p"), F.round(0.05 / F.col("t"), 6).alias("p_of_others"))


# --- request understanding -------------------------------------------------------------------------


@query("WITH s AS (SELECT DISTINCT l_orderkey AS query_id, l_linenumber AS a, l_linenumber + l_suppkey % 4 AS b FROM lineitem) SELECT x.query_id, CAST(x.a AS BIGINT) AS a, CAST(x.b AS BIGINT) AS b, count(y.a) > 0 AS suppressed FROM s x LEFT JOIN s y ON x.query_id = y.query_id AND y.a <= x.a AND y.b >= x.b AND y.b - y.a > x.b - x.a GROUP BY ALL")
def q3_structural_suppression(spark, d):
    """A span is dropped where a longer one of its request contains it: its end is no later than the latest end seen up to its start."""
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("a"), (F.col("l_linenumber") + F.col("l_suppkey") % 4).alias("b")).distinct()
    earlier = Window.partitionBy("query_id").orderBy("a", F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("suppressed", F.coalesce(F.max("b").over(earlier) >= F.col("b"), F.lit(False)))


#: Words of freshness, in order.
_FRESH = ("current", "today", "latest", "month", "year", "week", "day", "now")


@query(f"""WITH w AS (SELECT item_id, {FOLD.format('text')} AS x, len(list_intersect({TOK.format('text')}, ['river', 'city', 'music', 'first', 'they', 'with', 'from'])) AS n FROM benchmark)
SELECT item_id, {"coalesce(" + ", ".join(f"CASE WHEN contains(x, '{f}') THEN '{f}' END" for f in _FRESH) + ")"} AS freshness, round(least(1, greatest(0, 0.35 + 0.15 * n - 0.15 * (n % 2)))::DOUBLE, 6) AS parser_confidence FROM w""")
def q10_intent(spark, d):
    """The first of eight time words in a request, and the parser's confidence from the numbers of concepts and ambiguities."""
    t = T.fold(F.col("text"))
    known = F.array(*[F.lit(w) for w in ("river", "city", "music", "first", "they", "with", "from")])
    n = F.size(F.array_intersect(T.tokens(F.col("text")), known))
    return table(spark, d, "benchmark").select("item_id", F.coalesce(*[F.when(t.contains(f), f) for f in _FRESH]).alias("freshness"), F.round(confidence.clamp(0.35 + 0.15 * n - 0.15 * (n % 2)), 6).alias("parser_confidence"))


@query(f"""WITH {INST}, v AS (SELECT id, ['Q0', 'Q1', 'Q2', 'Q4', 'Q5', 'QC'] AS kinds, [title, lower(title), lower(title), array_to_string(fields, ' '), CASE WHEN len(prompts) > 1 THEN lower(title) || ' ' || array_to_string(prompts[1:4], ' ') ELSE '' END, category || ' ' || title] AS t FROM inst),
w AS (SELECT id, unnest(range(1, 7)) AS k, kinds, t FROM v) SELECT id, kinds[k] AS variant, t[k] AS text FROM w WHERE t[k] <> '' AND list_position(t, t[k]) = k""")
def q12_q13_query_plan(spark, d):
    """Variants of a request, each only where its text differs from those before it; Q5 only where something is ambiguous."""
    low = F.lower("title")
    q5 = F.when(F.size("prompts") > 1, F.concat_ws(" ", low, F.array_join(F.slice("prompts", 1, 4), " "))).otherwise("")
    return expansion.plan(instances(spark, d), "id", {"Q0": F.col("title"), "Q1": low, "Q2": low, "Q4": F.array_join("fields", " "), "Q5": q5, "QC": F.concat_ws(" ", "category", "title")})


@query()
def f8_p21_q5_typos(spark, d):
    """Corrections of rare words of all documents; tests compare it with brute force."""
    v = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return typos.corrections(v.where("df = 1"), v.where("df > 1"), T.singular)


# --- confidence ----------------------------------------------------------------------------------------

_G = len(GENERATORS)


RISK_SQL = f"""p AS (SELECT *, CASE WHEN fused_rank <= 10 AND fused > 0 THEN fused / sum(fused) FILTER (fused_rank <= 10 AND fused > 0) OVER (PARTITION BY query_id) END AS p FROM unioned),
a AS (SELECT query_id, sum(n_sources) FILTER (fused_rank <= 20) / (count(*) FILTER (fused_rank <= 20) * {_G}) AS o, count(*) FILTER (fused_rank <= 20 AND n_sources = 1) / count(*) FILTER (fused_rank <= 20) AS x, count(DISTINCT lower(p_name)) AS f, -sum(p * ln(p)) / ln(nullif(count(p), 1)) AS e, max(fused) FILTER (fused_rank = 1) AS f1, max(fused) FILTER (fused_rank = 2) AS f2 FROM p JOIN part ON p_partkey = instance_id GROUP BY 1),
r AS (SELECT s_suppkey AS query_id, list_filter([CASE WHEN s_suppkey % 7 <= 3 THEN 'very_short_query' END, CASE WHEN s_suppkey % 4 = 0 THEN 'weak_schema_facet_coverage' END, CASE WHEN o IS NULL THEN 'empty_union' END, CASE WHEN o < 0.30 THEN 'low_generator_overlap' END, CASE WHEN x > 0.5 THEN 'high_source_exclusivity' END, CASE WHEN f >= 25 THEN 'many_candidate_families' END, CASE WHEN e > 0.98 THEN 'flat_score_distribution' END, CASE WHEN (f1 - f2) / f1 < 0.05 THEN 'low_top_margin' END], lambda v: v IS NOT NULL) AS reasons FROM supplier LEFT JOIN a ON query_id = s_suppkey)"""
BAND_SQL = "CASE WHEN len(reasons) >= 3 OR list_contains(reasons, 'empty_union') THEN 'HIGH' WHEN len(reasons) >= 1 THEN 'MEDIUM' ELSE 'LOW' END"


@query(f"WITH {UNION}, {RISK_SQL} SELECT query_id, reasons, {BAND_SQL} AS band FROM r")
def g6_recall_risk(spark, d):
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") % 7).alias("n_words"), ((F.col("s_suppkey") % 4) / 4).alias("facet_coverage"), F.lit(False).alias("conflicting"), F.lit(0).alias("failed"))
    fam = table(spark, d, "part").select(F.col("p_partkey").alias("instance_id"), F.lower("p_name").alias("family"))
    return confidence.recall_risk(q, _union(spark, d), fam, _G)


@query(f"""WITH k AS (SELECT DISTINCT unnest({TOK.format('text')}) AS k FROM documents), q AS (SELECT item_id, unnest({TOK.format('text')}) AS w, generate_subscripts({TOK.format('text')}, 1) AS pos FROM benchmark),
s AS (SELECT item_id, pos, w, CASE WHEN w IN (SELECT k FROM k) THEN 1.0 WHEN {SINGULAR.format('w')} IN (SELECT k FROM k) THEN 0.95 ELSE 0.0 END AS s FROM q)
SELECT b.item_id, round(coalesce(avg(s), 1.0), 6) AS support, coalesce(list(w ORDER BY pos) FILTER (s = 0), []) AS unsupported FROM benchmark b LEFT JOIN s USING (item_id) GROUP BY 1""")
def h7_support(spark, d):
    """Support of all words of benchmark texts in a catalog of all documents' words."""
    known = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    return confidence.support(table(spark, d, "benchmark"), known, "item_id", T.tokens(F.col("text")))


_H9 = "SELECT o_orderkey AS id, least(1.0, o_totalprice / 400000) AS top, (o_custkey % 30) / 100.0 AS margin, (o_orderkey % 5) / 4.0 AS cover, (o_orderkey % 4) / 3.0 AS agree, (o_custkey % 11) / 10.0 AS sup, (o_orderkey % 9) / 8.0 AS breadth, o_orderkey % 13 = 0 AS unknown, o_custkey % 3 AS required, least(o_custkey % 3, o_orderkey % 3) AS unmet, o_orderkey % 7 > 0 AS has FROM orders"


@query(f"""WITH x AS ({_H9}), z AS (SELECT *, 1 / (1 + exp(-(-1.6 + 1.7 * top + 1.6 * least(1, margin / 0.15) + 1.3 * cover + 0.8 * agree + 0.5 * 0.5 + 1.1 * sup - 1.2 * breadth))) AS s FROM x),
g AS (SELECT *, unknown OR (required > 0 AND NOT has) OR sup <= 0.2 OR (sup < 0.5 AND top < 0.3) OR (unmet > 0 AND unmet = required) AS none FROM z)
SELECT id, CASE WHEN none THEN 'NO_SATISFACTORY_REPORT' WHEN unmet > 0 THEN 'NEEDS_CLARIFICATION' WHEN s >= 0.72 AND margin >= 0.06 AND breadth <= 0.75 AND sup >= 0.7 AND cover >= 0.8 THEN 'ANSWERABLE' WHEN s < 0.35 AND sup < 0.5 THEN 'NO_SATISFACTORY_REPORT' ELSE 'NEEDS_CLARIFICATION' END AS outcome, round(CASE WHEN none THEN 0 WHEN unmet > 0 THEN 0.5 ELSE s END, 6) AS score FROM g""")
def h9_answerability(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    outcome, score = confidence.answerability(
        top_score=F.least(F.lit(1.0), F.col("o_totalprice") / 400000), margin=(c % 30) / 100.0, field_coverage=(k % 5) / 4.0, agreement=(k % 4) / 3.0, parser=F.lit(0.5), support=(c % 11) / 10.0, n_terms=F.lit(3),
        breadth=(k % 9) / 8.0, unknown_fields=(k % 13 == 0).cast("int"), required=c % 3, unmet=F.least(c % 3, k % 3), combination_exists=k % 7 > 0,
    )
    return table(spark, d, "orders").select(k.alias("id"), outcome.alias("outcome"), F.round(score, 6).alias("score"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) < 500 AS too_few, list_filter([CASE WHEN count(*) < 500 THEN 'queries' END, CASE WHEN avg((c_custkey % 4 > 0)::INT) < 0.75 THEN 'agreement' END, CASE WHEN avg((c_acctbal > 0)::INT) < 0.9 THEN 'no_answer_precision' END], lambda v: v IS NOT NULL) AS reasons FROM customer GROUP BY 1")
def e7_acceptance(spark, d):
    n = F.count(F.lit(1))
    m = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(n.alias("n_queries"), F.avg((F.col("c_custkey") % 4 > 0).cast("int")).alias("agreement"), F.avg((F.col("c_acctbal") > 0).cast("int")).alias("no_answer_precision"))
    m = m.select("*", F.lit(0.8).alias("ndcg_10"), F.lit(0.7).alias("mrr_10"), F.lit(0.8).alias("no_answer_recall"), F.lit(0.08).alias("ece"))
    return m.select("nation", (F.col("n_queries") < 500).alias("too_few"), confidence.acceptance_reasons().alias("reasons"))


# --- reranking, features, expansion ------------------------------------------------------------------------


def _shared_words(queries, texts):
    """A scorer: the share of a query's distinct words in the text; not a number without words."""
    out = []
    for q, t in zip(queries, texts, strict=True):
        q = set(q.split())
        out.append(len(q & set(t.split())) / len(q) if q else float("nan"))
    return out


@query(f"""WITH {SHORT}, x AS (SELECT query_id, instance_id, CASE WHEN query_id % 5 > 0 THEN lower(q.p_name) || ' ' || lower(q.p_type) ELSE '' END AS qt, lower(t.p_name) || ' ' || lower(t.p_type) AS tt FROM short JOIN part q ON q.p_partkey = query_id JOIN part t ON t.p_partkey = instance_id),
s AS (SELECT query_id, instance_id, round(len(list_intersect(string_split(qt, ' '), string_split(tt, ' '))) / len(list_distinct(string_split(qt, ' '))), 6) AS ce_score FROM x WHERE qt <> '') SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ce_score DESC, instance_id) AS ce_rank FROM s""")
def g11_g12_rerank(spark, d):
    """The whole shortlist scored jointly by shared words; queries without words get no finite score and drop out."""
    said = F.concat_ws(" ", F.lower("p_name"), F.lower("p_type"))
    part = table(spark, d, "part")
    q = part.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 5 > 0, said).alias("query_text"))
    x = _short(spark, d).select("query_id", "instance_id").join(q, "query_id").join(part.select(F.col("p_partkey").alias("instance_id"), said.alias("text")), "instance_id")
    r = rerank.rank_finite(rerank.score_pairs(x, _shared_words).withColumn("ce_score", F.round("ce_score", 6)))
    return r.select("query_id", "instance_id", "ce_score", F.col("ce_rank").cast("long").alias("ce_rank"))


@query(f"WITH {UNION} SELECT query_id, instance_id, {', '.join(f'round(coalesce(1.0 / {g}_rank, 0), 6) AS {g}_rr, coalesce({g}_score, 0) AS {g}_s, ({g}_rank IS NOT NULL)::INT AS {g}_in' for g in GENERATORS)}, round(n_sources / {_G}.0, 6) AS agreement, round(fused / max(fused) OVER (PARTITION BY query_id), 6) AS fused_share FROM unioned")
def g17_fusion_features(spark, d):
    cols = [c for g in GENERATORS for c in (F.round(F.coalesce(1.0 / F.col(f"{g}_rank"), F.lit(0.0)), 6).alias(f"{g}_rr"), F.coalesce(f"{g}_score", F.lit(0.0)).alias(f"{g}_s"), F.col(f"{g}_rank").isNotNull().cast("int").alias(f"{g}_in"))]
    return _union(spark, d).select("query_id", "instance_id", *cols, F.round(F.col("n_sources") / float(_G), 6).alias("agreement"), F.round(F.col("fused") / F.max("fused").over(Window.partitionBy("query_id")), 6).alias("fused_share"))


@query(f"WITH {FAMILY} SELECT f.query_id, p_partkey AS instance_id, f.family, row_number() OVER (PARTITION BY f.query_id ORDER BY family_rank, p_partkey) AS place FROM famr f JOIN part ON lower(p_name) = f.family LEFT JOIN scored s ON s.query_id = f.query_id AND s.instance_id = p_partkey WHERE family_rank <= 20 AND s.instance_id IS NULL AND p_size % 4 > 0 QUALIFY place <= 60")
def g21_j7_family_expansion(spark, d):
    """Siblings of the leading families that weren't scored, authorized anew (sizes divisible by 4 are denied)."""
    part = table(spark, d, "part")
    known = part.select(F.col("p_partkey").alias("instance_id"), F.lower("p_name").alias("family"))
    allowed = part.where("p_size % 4 > 0").select(F.col("p_partkey").alias("instance_id"))
    return rerank.expand_families(_families(spark, d), known, _scored(spark, d), allowed).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {FAMILY}, a AS (SELECT query_id, max(score) FILTER (family_rank = 1) AS s1, max(score) FILTER (family_rank = 2) AS s2, count(*) AS n FROM famr GROUP BY 1), c AS (SELECT query_id, round(avg(ce_score), 6) AS ce_mean, round(stddev_pop(ce_score), 6) AS ce_sd, max(ce_score) AS ce_top, round(avg(n_sources) FILTER (final_rank <= 10), 6) AS agreement FROM scored GROUP BY 1) SELECT query_id, s1 AS top_score, s1 - s2 AS margin, n AS n_families, ce_mean, ce_sd, ce_top, agreement FROM a JOIN c USING (query_id)")
def l2_decision_features(spark, d):
    f = _families(spark, d)
    at = lambda k: F.max(F.when(F.col("family_rank") == k, F.col("score")))
    a = f.groupBy("query_id").agg(at(1).alias("top_score"), (at(1) - at(2)).alias("margin"), F.count(F.lit(1)).alias("n_families"))
    c = _scored(spark, d).groupBy("query_id").agg(F.round(F.avg("ce_score"), 6).alias("ce_mean"), F.round(F.stddev_pop("ce_score"), 6).alias("ce_sd"), F.max("ce_score").alias("ce_top"), F.round(F.avg(F.when(F.col("final_rank") <= 10, F.col("n_sources"))), 6).alias("agreement"))
    return a.join(c, "query_id")


@query("WITH x AS (SELECT n_chars / 1000.0 - 1 AS z, quality AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT unnest(range(1, 33)) / 8.0 AS t), n AS (SELECT t, round(avg(ln(1 + exp(-(2 * y - 1) * least(greatest(z / t, -30), 30)))), 6) AS nll FROM x, g GROUP BY 1) SELECT t AS temperature, nll FROM n")
def l9_temperature(spark, d):
    """Log loss of a score at 32 temperatures in one pass over the rows: partial sums, not rows, are exchanged."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.col("n_chars") / 1000.0 - 1).alias("z"), F.col("quality").alias("y"))
    grid = [k / 8.0 for k in range(1, 33)]
    loss = lambda t: F.avg(F.log(1 + F.exp(-(2 * F.col("y") - 1) * F.least(F.greatest(F.col("z") / t, F.lit(-30.0)), F.lit(30.0)))))
    one = x.agg(F.array(*[F.struct(F.lit(t).alias("temperature"), F.round(loss(t), 6).alias("nll")) for t in grid]).alias("g"))
    return one.select(F.inline("g"))


# --- explanations and datasets -------------------------------------------------------------------------------


@query(f"WITH {INST}, q AS (SELECT id, title, category, fields, list_filter(fields, lambda f: list_contains(['s1', 's2', 's3', 's5', 's8'], lower(f))) AS hit FROM inst) SELECT id, hit[1:6] AS matched, round(len(hit) / 5, 6) AS coverage, 'Matches ' || title || CASE WHEN len(hit) > 0 THEN ' with ' || array_to_string(hit[1:6], ', ') ELSE '' END || '; category ' || category AS why FROM q")
def h10_t2_t3_t4_explanation(spark, d):
    """Evidence that the request grounds: only fields that share a word with it, six at most, and a line of it."""
    asked = F.array(*[F.lit(w) for w in ("s1", "s2", "s3", "s5", "s8")])
    x = instances(spark, d).withColumn("hit", F.filter("fields", lambda f: F.arrays_overlap(T.tokens(f), asked)))
    shown = F.slice("hit", 1, 6)
    why = F.concat(F.lit("Matches "), "title", F.when(F.size("hit") > 0, F.concat(F.lit(" with "), F.array_join(shown, ", "))).otherwise(""), F.lit("; category "), "category")
    return x.select("id", shown.alias("matched"), F.round(F.size("hit") / 5, 6).alias("coverage"), why.alias("why"))


@query("WITH s AS (SELECT lower(p_name) AS query, list(p_partkey ORDER BY p_partkey) AS relevant FROM part GROUP BY 1) SELECT query, CAST(len(relevant) AS BIGINT) AS siblings, relevant[1] AS first_relevant, 2 AS grade, true AS answerable FROM s UNION ALL SELECT 'nothing in the catalog', 0, NULL, NULL, false")
def e8_j16_weak_qrels(spark, d):
    """A request per title, relevant to all of that title's instances, and one that nothing answers."""
    x = table(spark, d, "part").groupBy(F.lower("p_name").alias("query")).agg(F.count(F.lit(1)).alias("siblings"), F.min("p_partkey").alias("first_relevant"))
    none = spark.sql("select 'nothing in the catalog' as query, 0L as siblings, cast(null as bigint) as first_relevant, cast(null as int) as grade, false as answerable")
    return x.select("*", F.lit(2).alias("grade"), F.lit(True).alias("answerable")).unionByName(none)


@query(f"""WITH {FAMILY}, g AS (SELECT l_suppkey AS query_id, lower(p_name) AS family, max(l_linenumber) % 3 + 1 AS grade FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
i AS (SELECT query_id, sum(grade / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, family) AS r FROM g) WHERE r <= 10 GROUP BY 1), m AS (SELECT query_id, sum(grade / log2(family_rank + 1)) AS dcg FROM g JOIN famr USING (query_id, family) WHERE family_rank <= 10 GROUP BY 1)
SELECT query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg_10 FROM i LEFT JOIN m USING (query_id)""")
def e9_family_ndcg(spark, d):
    """Families graded by their best member; linear gain."""
    fam = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("family"))
    g = table(spark, d, "lineitem").join(fam, "l_partkey").groupBy(F.col("l_suppkey").alias("query_id"), "family").agg((F.max("l_linenumber") % 3 + 1).alias("grade"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "family"))
    i = g.withColumn("r", r).where("r <= 10").groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("r") + 1)).alias("ideal"))
    m = g.join(_families(spark, d), ["query_id", "family"]).where("family_rank <= 10").groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("family_rank") + 1)).alias("dcg"))
    return i.join(m, "query_id", "left").select("query_id", F.round(F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), 6).alias("ndcg_10"))


@query("""WITH g AS (SELECT DISTINCT name, substr(name, CAST(i AS INT), 3) AS t, count(*) OVER (PARTITION BY name, substr(name, CAST(i AS INT), 3)) AS c FROM (SELECT name, unnest(range(1, length(name) - 1)) AS i FROM (SELECT DISTINCT lower(p_name) AS name FROM part))), n AS (SELECT name, sqrt(sum(c * c)) AS n FROM g GROUP BY 1)
SELECT a.name AS a, b.name AS b, round(sum(a.c * b.c) / (any_value(x.n) * any_value(y.n)), 6) AS cosine FROM g a JOIN g b ON a.t = b.t AND a.name < b.name JOIN n x ON x.name = a.name JOIN n y ON y.name = b.name GROUP BY 1, 2 HAVING round(sum(a.c * b.c) / (any_value(x.n) * any_value(y.n)), 6) >= 0.5""")
def j12_p22_trigram_join(spark, d):
    """Pairs of titles by the cosine of their trigram counts: only titles that share one of their rarest trigrams meet."""
    names = table(spark, d, "part").select(F.lower("p_name").alias("a")).distinct().where(F.length("a") >= 3)
    g = names.select("a", F.explode(F.transform(F.sequence(F.lit(1), F.length("a") - 2), lambda i: F.substring(F.col("a"), i, F.lit(3)))).alias("t")).groupBy("a", "t").agg(F.count(F.lit(1)).alias("c"))
    g = g.join(g.groupBy("a").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n")), "a").select("a", "t", "c", "n")
    weights = g.select("a", F.col("t").alias("term"), (F.col("c") / F.col("n")).alias("weight")).withColumnRenamed("a", "name")
    return groups.near_pairs(weights, "name", 0.5, 6).withColumnRenamed("similarity", "cosine")


@query("WITH f AS (SELECT lower(p_name) AS family, p_partkey AS id, p_brand, p_type, count(*) OVER (PARTITION BY lower(p_name)) AS n FROM part) SELECT id, family, 'sibling' AS archetype, family || ' for ' || lower(p_brand) AS text FROM f WHERE n > 1 UNION ALL SELECT id, family, 'negation', family || ' without ' || lower(p_type) FROM f WHERE id % 3 = 0 UNION ALL SELECT id, family, 'short', string_split(family, ' ')[1] FROM f WHERE id % 5 = 0 UNION ALL SELECT id, family, 'multi_intent', family || ' and then ' || lower(p_type) FROM f WHERE id % 7 = 0")
def y1_y7_scenarios(spark, d):
    """Requests of four archetypes from the catalog; which instances serve is a function of the id."""
    f = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("family"), F.lower("p_brand").alias("b"), F.lower("p_type").alias("t"), F.count(F.lit(1)).over(Window.partitionBy(F.lower("p_name"))).alias("n"))
    kinds = [("sibling", F.col("n") > 1, F.concat_ws(" for ", "family", "b")), ("negation", F.col("id") % 3 == 0, F.concat_ws(" without ", "family", "t")), ("short", F.col("id") % 5 == 0, F.substring_index("family", " ", 1)), ("multi_intent", F.col("id") % 7 == 0, F.concat_ws(" and then ", "family", "t"))]
    made = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("archetype"), v.alias("text"))) for k, c, v in kinds]))
    return f.select("id", "family", F.inline(made))


@query("SELECT c_custkey AS id, left(sha256('0:' || c_custkey), 16) AS turn, (row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('0:' || c_custkey)) - 1) % 3 AS reviewer FROM customer")
def s18_y11_blinded_pool(spark, d):
    """An annotation pool in an order that only a seed decides, hidden columns dropped, dealt out in turn within each group."""
    h = F.sha2(F.concat(F.lit("0:"), F.col("c_custkey").cast("string")), 256)
    w = Window.partitionBy("c_nationkey").orderBy(h)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.left(h, F.lit(16)).alias("turn"), ((F.row_number().over(w) - 1) % 3).cast("long").alias("reviewer"))
