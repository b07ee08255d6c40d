"""Queries of the catalog engine and the SQL that each must agree with.

Names start with the number of the operator in the blueprint. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import evaluation, expansion, fusion, groups, prefix, ranking, retrieval
from corvane.sources.catalog import GENERATORS, instances, raw_hits, spread, table
from corvane.sources.settled import settle

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# SQL fragments that several oracles share.
INST = """u AS (SELECT l_partkey, count(*) AS runs, max(l_shipdate) AS last_run, list_sort(list(DISTINCT 'S' || l_suppkey)) AS fields, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS prompts FROM lineitem GROUP BY 1),
inst AS (SELECT p_partkey AS id, p_name AS title, lower(p_name) AS family, p_brand AS category, p_type AS data_source, coalesce(fields, []) AS fields, coalesce(prompts, []) AS prompts, runs, last_run FROM part LEFT JOIN u ON l_partkey = p_partkey)"""
FOLD = "replace(lower(coalesce({0}, '')), 'ß', 'ss')"
TOK = "regexp_extract_all(" + FOLD + ", '[a-z0-9]+')"
SINGULAR = "CASE WHEN length({0}) <= 3 THEN {0} WHEN ends_with({0}, 'ies') AND length({0}) > 4 THEN left({0}, length({0}) - 3) || 'y' " + " ".join(f"WHEN ends_with({{0}}, '{e}') AND length({{0}}) > {len(e) + 2} THEN left({{0}}, length({{0}}) - {len(e)})" for e in ("ches", "shes", "ses", "xes", "zes")) + " WHEN ends_with({0}, 's') AND NOT (ends_with({0}, 'ss') OR ends_with({0}, 'us') OR ends_with({0}, 'is')) THEN left({0}, length({0}) - 1) ELSE {0} END"
BAG_SQL = "sha256(concat_ws(',', " + ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)), 0) AS VARCHAR)" for i in range(4)) + ", CAST(count(h) AS VARCHAR)))"
HITS = """raw AS (SELECT l_suppkey AS query_id, l_partkey AS instance_id, CASE l_returnflag WHEN 'A' THEN 'bm25f' WHEN 'N' THEN 'dense' ELSE 'splade' END AS generator, 'Q' || CAST((l_linenumber - 1) % 6 AS VARCHAR) AS variant, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, generator, variant ORDER BY score DESC, instance_id) AS rank FROM raw QUALIFY rank <= 50),
best AS (SELECT query_id, generator, instance_id, rank AS best_rank, score, variant FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id, generator, instance_id ORDER BY rank, variant) = 1),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id, generator ORDER BY best_rank, score DESC, instance_id) AS rank FROM best)"""
_one = lambda g: ", ".join(f"max({c}) FILTER (generator = '{g}') AS {g}_{c}" for c in ("rank", "score", "variant"))
UNION = HITS + ",\n" + f"""wide AS (SELECT query_id, instance_id, {", ".join(_one(g) for g in GENERATORS)} FROM merged GROUP BY 1, 2),
fusedw AS (SELECT *, round({" + ".join(f"coalesce(1.0 / (60 + {g}_rank), 0.0::DOUBLE)" for g in GENERATORS)}, 9) AS fused, least({", ".join(f"{g}_rank" for g in GENERATORS)}) AS best_rank,
  {" + ".join(f"({g}_rank IS NOT NULL)::INT" for g in GENERATORS)} AS n_sources FROM wide),
unioned AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, best_rank, instance_id) AS fused_rank FROM fusedw)"""
_q5 = " AND ".join(f"({g}_variant IS NULL OR {g}_variant = 'Q5')" for g in GENERATORS)


def _shortlist_sql(high: bool) -> str:
    cases = " ".join(f"WHEN n_sources = 1 AND {n}_rank IS NOT NULL THEN '{n}'" if n in GENERATORS else f"WHEN {_q5} THEN '{n}'" for n, _ in fusion.QUOTAS)
    allowed = " ".join(f"WHEN '{n}' THEN {round(k * 1.5) if high else k}" for n, k in fusion.QUOTAS)
    depth = fusion.HIGH_DEPTH if high else fusion.DEPTH
    return UNION + f""",
tagged AS (SELECT *, CASE {cases} END AS quota FROM unioned),
floored AS (SELECT *, quota IS NOT NULL AND row_number() OVER (PARTITION BY query_id, quota ORDER BY fused_rank) <= CASE quota {allowed} ELSE 0 END AS is_floor FROM tagged),
taken AS (SELECT * FROM floored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY is_floor DESC, fused_rank) <= {depth}),
short AS (SELECT *, CASE WHEN is_floor THEN quota ELSE 'fused' END AS admitted_via, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS position FROM taken)"""


SHORT = _shortlist_sql(False)
#: A stand-in joint score of a pair, for operators above a reranker.
CE_SQL = "round(((instance_id * 7919 + query_id * 104729) % 1000) / 50.0 - 12, 6)"


def _ce(instance: str = "instance_id"):
    return F.round(((F.col(instance) * 7919 + F.col("query_id") * 104729) % 1000) / 50.0 - 12, 6)


FUSED = SHORT + f""",
ce AS (SELECT *, {CE_SQL} AS ce_score FROM short), cer AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ce_score DESC, instance_id) AS ce_rank, count(*) OVER (PARTITION BY query_id) AS n FROM ce),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ce_rank, fused DESC, instance_id) AS final_rank FROM cer), scored AS (SELECT *, n - final_rank + 1 AS final_score FROM final)"""
FAMILY = FUSED + """,
fam AS (SELECT query_id, lower(p_name) AS family, max(final_score) AS score, count(*) AS members, arg_min(instance_id, (final_rank, instance_id)) AS selected, min(final_rank) AS best FROM scored JOIN part ON p_partkey = instance_id GROUP BY 1, 2),
famr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, selected) AS family_rank FROM fam)"""


def _merged(spark, d):
    return fusion.merge_variants(fusion.rank_hits(raw_hits(spark, d), 50))


def _union(spark, d):
    return fusion.union(_merged(spark, d), GENERATORS)


def _short(spark, d, high=False):
    return fusion.shortlist(_union(spark, d), GENERATORS, high)


def _scored(spark, d):
    x = _short(spark, d).withColumn("ce_score", _ce())
    x = x.withColumn("ce_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("ce_score").desc(), "instance_id")))
    x = x.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ce_rank", F.col("fused").desc(), "instance_id")))
    return x.withColumn("final_score", F.count(F.lit(1)).over(Window.partitionBy("query_id")) - F.col("final_rank") + 1)


def _families(spark, d):
    return fusion.families(_scored(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("instance_id"), F.lower("p_name").alias("family")))


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


# --- scalar functions -------------------------------------------------------------------


@query("SELECT p_partkey AS id, list_filter(list_transform(string_split(replace(p_name, ' ', ' ; ') || ';;' || p_type, ';'), lambda v: trim(v)), lambda v: v <> '') AS items FROM part")
def p1_split_list_cell(spark, d):
    cell = F.concat(F.replace("p_name", F.lit(" "), F.lit(" ; ")), F.lit(";;"), F.col("p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.split_list_cell(cell).alias("items"))


@query(r"""WITH s AS (SELECT p_partkey AS id, list_filter(list_transform(regexp_split_to_array(p_name || ';' || upper(p_name) || chr(10) || p_type, '[;\r\n]+'), lambda v: trim(v)), lambda v: v <> '') AS v FROM part)
SELECT id, list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i) AS items FROM s""")
def p2_split_multi(spark, d):
    cell = F.concat("p_name", F.lit(";"), F.upper("p_name"), F.lit("\n"), F.col("p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.split_multi(cell).alias("items"))


@query("SELECT doc_id, md5(replace(lower(trim(regexp_replace(translate(text, '–—‑−', '----'), '[ \t\n\x0b\f\r]+', ' ', 'g'))), 'ß', 'ss')) AS key_md5 FROM documents".replace("\\x0b", "\x0b"))
def p3_match_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.match_key(F.col("text"))).alias("key_md5"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN '' ELSE trim(p_name) END AS shown FROM part")
def p4_display(spark, d):
    cell = F.when(F.col("p_size") % 5 == 0, " N/A ").when(F.col("p_size") % 5 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), "p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.display(cell).alias("shown"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS phrase_md5 FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)")
def p6_p9_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"), F.md5(T.phrase(F.col("text"))).alias("phrase_md5"))


@query(f"""SELECT DISTINCT t AS word, CASE WHEN length(t) <= 3 THEN t WHEN ends_with(t, 'ies') AND length(t) > 4 THEN left(t, length(t) - 3) || 'y'
{" ".join(f"WHEN ends_with(t, '{e}') AND length(t) > {len(e) + 2} THEN left(t, length(t) - {len(e)})" for e in ("ches", "shes", "ses", "xes", "zes"))}
WHEN ends_with(t, 's') AND NOT (ends_with(t, 'ss') OR ends_with(t, 'us') OR ends_with(t, 'is')) THEN left(t, length(t) - 1) ELSE t END AS singular
FROM (SELECT unnest({TOK.format('text')}) AS t FROM documents)""")
def p8_singular(spark, d):
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.singular(F.col("word")).alias("singular"))


@query(f"SELECT item_id, list_filter({TOK.format('text')}, lambda t: length(t) > 2 AND t NOT IN ('the', 'and', 'for', 'with')) AS words FROM benchmark")
def p10_content_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.content_tokens(F.col("text"), ("the", "and", "for", "with")).alias("words"))


@query(f"WITH {INST} SELECT id, array_to_string(list_filter(list_concat([title, title, title], fields, fields, fields, prompts, prompts, [category, data_source]), lambda v: v <> ''), ' . ') AS doc FROM inst")
def p11_build_doc(spark, d):
    one = lambda c: F.array(F.col(c))
    x = F.concat(*[one("title")] * 3, *[F.col("fields")] * 3, *[F.col("prompts")] * 2, one("category"), one("data_source"))
    return instances(spark, d).select("id", F.array_join(F.filter(x, lambda v: v != ""), " . ").alias("doc"))


VIEW_SQL = "concat_ws(' | ', 'Title: ' || title, CASE WHEN len(fields) > 0 THEN 'Fields: ' || array_to_string(fields, ', ') END, CASE WHEN len(prompts) > 0 THEN 'Prompts: ' || array_to_string(prompts, ', ') END, 'Category: ' || category)"


def _view():
    return T.labelled([("Title", F.col("title")), ("Fields", F.array_join("fields", ", ")), ("Prompts", F.array_join("prompts", ", ")), ("Category", F.col("category"))])


@query(f"WITH {INST} SELECT id, {VIEW_SQL} AS view, left(sha256(title || chr(31) || {VIEW_SQL} || chr(31)), 16) AS hash FROM inst")
def p13_p15_views_and_hashes(spark, d):
    return instances(spark, d).select("id", _view().alias("view"), T.content_hash(F.col("title"), _view()).alias("hash"))


@query(f"""WITH {INST}, v AS (SELECT id, {VIEW_SQL} AS v FROM inst), h AS (SELECT id, v, left(v, 40) AS h FROM v)
SELECT id, CASE WHEN length(v) <= 40 THEN v WHEN instr(reverse(h), ' | ') > 0 THEN left(h, length(h) - instr(reverse(h), ' | ') - 2) ELSE h END AS cut FROM h""")
def p14_cut_view(spark, d):
    return instances(spark, d).select("id", T.cut_at_separator(_view(), 40).alias("cut"))


@query(f"WITH {INST} SELECT {BAG_SQL} AS corpus_hash FROM (SELECT sha256(id || ':' || sha256({VIEW_SQL})) AS h FROM inst)")
def p16_corpus_hash(spark, d):
    """Sums of digests in place of a hash over rows in order: partial sums on every task, one row in the end."""
    return instances(spark, d).agg(T.bag_hash(F.sha2(F.concat(F.col("id").cast("string"), F.lit(":"), F.sha2(_view(), 256)), 256)).alias("corpus_hash"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def p17_normalize(spark, d):
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"), F.round(T.normalized(v)[0], 6).alias("first"))


@query(f"""SELECT item_id, CASE WHEN contains(t, 'month') OR contains(t, 'year') OR contains(t, 'th') THEN 'PERIOD' WHEN contains(t, 'now') OR contains(t, 'on') THEN 'CURRENT' ELSE 'UNKNOWN' END AS time_orientation, contains(t, ' not ') OR contains(t, 'without') AS negated
FROM (SELECT item_id, {FOLD.format('text')} AS t FROM benchmark)""")
def p18_facets(spark, d):
    t = T.fold(F.col("text"))
    has = lambda *w: F.greatest(*[t.contains(x) for x in w]) if len(w) > 1 else t.contains(w[0])
    return table(spark, d, "benchmark").select("item_id", F.when(has("month", "year", "th"), "PERIOD").when(has("now", "on"), "CURRENT").otherwise("UNKNOWN").alias("time_orientation"), has(" not ", "without").alias("negated"))


@query(f"""WITH {INST}, q AS (SELECT id, ['S1', 'S2', 'S3', 'AF', 'S4', 'S5', 'S6', 'S7', 'S8', 'S9'] AS q, fields FROM inst)
SELECT id, round(CASE WHEN len(list_distinct(list_concat(q, fields))) > 0 THEN len(list_intersect(q, fields)) / len(list_distinct(list_concat(q, fields))) ELSE 0.0 END, 6) AS jaccard, round(len(list_intersect(q, fields)) / 10, 6) AS overlap FROM q""")
def p19_jaccard_overlap(spark, d):
    q = F.array(*[F.lit(x) for x in ("S1", "S2", "S3", "AF", "S4", "S5", "S6", "S7", "S8", "S9")])
    return instances(spark, d).select("id", F.round(T.jaccard(q, F.col("fields")), 6).alias("jaccard"), F.round(T.overlap(q, F.col("fields")), 6).alias("overlap"))


@query("""WITH m AS (SELECT label, round(sum(abs(embedding[1])), 6) AS mass, count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT label, mass, sum(mass) OVER () AS total, max(mass) OVER () AS mx FROM m)
SELECT label, round(mass / 0.05 - (mx / 0.05 + ln(sum(exp(mass / 0.05 - mx / 0.05)) OVER ())), 4) + 0.0 AS log_softmax, round((SELECT -sum(mass / total * log2(mass / total)) FROM t WHERE mass > 0), 4) AS entropy_bits FROM t""")
def p20_entropy_softmax(spark, d):
    every = Window.partitionBy(F.lit(0))  # over the labels, a fixed few
    m = table(spark, d, "embeddings").groupBy("label").agg(F.round(F.sum(F.abs(F.col("embedding")[0].cast("double"))), 6).alias("mass"))
    z = F.col("mass") / 0.05 - F.max("mass").over(every) / 0.05
    x = m.withColumn("z", z).withColumn("p", F.col("mass") / F.sum("mass").over(every))
    return x.select("label", (F.round(F.col("z") - F.log(F.sum(F.exp("z")).over(every)), 4) + 0.0).alias("log_softmax"), F.round(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p"))).over(every), 4).alias("entropy_bits"))


@query("SELECT doc_id, CASE WHEN v < 70 THEN 'train' WHEN v < 85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || left(sha256('7:' || doc_id), 8) AS BIGINT) % 100 AS v FROM documents)")
def p23_hash_split(spark, d):
    return table(spark, d, "documents").select("doc_id", T.hash_split("7", F.col("doc_id")).alias("split"))


@query(f"WITH {INST} SELECT id, coalesce(CAST(runs AS VARCHAR), 'not recorded') AS runs_shown, coalesce(strftime(last_run, '%Y-%m-%d'), 'not recorded') AS last_run_shown FROM inst")
def p24_shown_use(spark, d):
    return instances(spark, d).select("id", F.coalesce(F.col("runs").cast("string"), F.lit("not recorded")).alias("runs_shown"), F.coalesce(F.date_format("last_run", "yyyy-MM-dd"), F.lit("not recorded")).alias("last_run_shown"))


@query(f"SELECT item_id, list_filter(list_transform(regexp_split_to_array(translate({FOLD.format('text')}, '/-', '  '), '[ \t\n\r]+'), lambda w: regexp_replace(w, '^[,;:()]+|[,;:()]+$', '', 'g')), lambda w: length(w) > 2) AS words FROM benchmark")
def p29_suitability_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.suitability_tokens(F.col("text")).alias("words"))


# --- filters and joins ----------------------------------------------------------------------


@query(f"WITH {INST} SELECT id FROM inst WHERE len(list_filter(['S1', 'S2'], lambda f: NOT list_contains(fields, f))) < 2 AND (contains(title, 'red') OR contains(title, 'blue') OR contains(title, 'small')) AND NOT list_has_any(fields, ['S7'])")
def f3_predicate_qrels(spark, d):
    x = instances(spark, d)
    need, out = F.array(F.lit("S1"), F.lit("S2")), F.array(F.lit("S7"))
    terms = F.array(*[F.lit(t) for t in ("red", "blue", "small")])
    return x.where((F.size(F.array_except(need, "fields")) < 2) & F.exists(terms, lambda t: F.contains("title", t)) & ~F.arrays_overlap("fields", out)).select("id")


@query("SELECT item_id, n_terms FROM (SELECT item_id, len(regexp_extract_all(lower(text), '(without|excluding|exclude|no|not) ([a-z0-9]+ ?){1,4}')) AS n_terms FROM benchmark) WHERE n_terms > 0")
def f4_negations(spark, d):
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("(without|excluding|exclude|no|not) ([a-z0-9]+ ?){1,4}"), 0)).cast("long")
    return table(spark, d, "benchmark").select("item_id", n.alias("n_terms")).where("n_terms > 0")


@query(f"WITH {INST} SELECT round(count(DISTINCT v) / count(*), 6) AS ratio, count(DISTINCT v) / count(*) < 0.10 AS degenerate FROM (SELECT {VIEW_SQL} AS v FROM inst)")
def f7_degenerate_view(spark, d):
    r = F.count_distinct("v") / F.count(F.lit(1))
    return instances(spark, d).select(_view().alias("v")).agg(F.round(r, 6).alias("ratio"), (r < 0.10).alias("degenerate"))


@query(f"WITH {INST} SELECT family, count(*) AS members, list_sort(list(DISTINCT category))[1] AS first_category FROM inst WHERE category IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY family")
def z2_explicit_acl(spark, d):
    allowed = instances(spark, d).where(F.col("category").isin("Brand#1", "Brand#2", "Brand#3"))
    return allowed.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.min("category").alias("first_category"))


@query(HITS.replace("raw AS (", "WITH raw0 AS (", 1).replace("GROUP BY 1, 2, 3, 4),", "GROUP BY 1, 2, 3, 4), raw AS (SELECT * FROM raw0 WHERE instance_id IN (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4'))),", 1) + " SELECT query_id, generator, instance_id, rank FROM merged")
def f2_authorized_before_top_k(spark, d):
    allowed = table(spark, d, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4")).select(F.col("p_partkey").alias("instance_id"))
    # the semi join stands below the ranking window: it must restrict before the cut
    x = fusion.merge_variants(fusion.rank_hits(raw_hits(spark, d).join(allowed, "instance_id", "left_semi"), 50))
    return x.select("query_id", "generator", "instance_id", *_long("rank"))


@query(f"WITH {INST}, f AS (SELECT id, unnest(fields) AS field FROM inst), r AS (SELECT s_suppkey AS request, 'S' || (s_suppkey + k) AS field FROM supplier, range(0, 2) t(k)) SELECT request, id FROM r JOIN f USING (field) GROUP BY 1, 2 HAVING count(DISTINCT field) = 2")
def j8_required_fields(spark, d):
    """Instances with all fields that a request requires (a supplier and the next): a relational division."""
    need = table(spark, d, "supplier").select(F.col("s_suppkey").alias("request"), F.explode(F.array(*[F.concat(F.lit("S"), (F.col("s_suppkey") + k).cast("string")) for k in (0, 1)])).alias("field"))
    return retrieval.with_all_fields(need, instances(spark, d).select("id", F.explode("fields").alias("field")))


@query("WITH c AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), v AS (SELECT DISTINCT s FROM c), co AS (SELECT DISTINCT a.s AS a, b.s AS b FROM c a JOIN c b ON a.p = b.p AND a.s < b.s), per AS (SELECT a, count(*) AS n FROM co GROUP BY a) SELECT v.s AS supplier, (SELECT count(*) FROM v w WHERE w.s > v.s) - coalesce(n, 0) AS co_absent FROM v LEFT JOIN per ON per.a = v.s")
def j13_co_absent(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    co = c.join(c.select("p", F.col("s").alias("b")), "p").where("s < b").select("s", "b").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    # how many larger values there are, from their place: absent pairs are counted without making them
    v = prefix.numbered(c.select("s").distinct(), [], [F.col("s").desc()], "larger")
    return v.join(co, "s", "left").select(F.col("s").alias("supplier"), (F.col("larger") - F.coalesce("n", F.lit(0))).alias("co_absent"))


_HEAD = "string_split(p_name, ' ')[-1]"


@query(f"WITH f AS (SELECT DISTINCT lower(p_name) AS family, p_brand AS category, {_HEAD} AS head FROM part) SELECT a.category AS category, a.family AS a, b.family AS b FROM f a JOIN f b ON a.category = b.category AND a.head = b.head AND a.family < b.family")
def j14_y6_confusable(spark, d):
    f = table(spark, d, "part").select(F.lower("p_name").alias("family"), F.col("p_brand").alias("category"), F.element_at(F.split("p_name", " "), -1).alias("head")).distinct()
    return f.alias("x").join(f.alias("y"), ["category", "head"]).where("x.family < y.family").select("category", F.col("x.family").alias("a"), F.col("y.family").alias("b"))


# --- aggregations -----------------------------------------------------------------------------


@query(f"WITH {INST} SELECT family, count(*) AS family_size, CAST(coalesce(sum(runs), 0) AS BIGINT) AS runs_total, max(last_run) AS last_run, arg_min(id, (-coalesce(runs, -1), CASE WHEN last_run IS NULL THEN 0 ELSE -epoch(last_run) END, id)) AS representative FROM inst GROUP BY family")
def a1_family_collapse(spark, d):
    order = F.struct(F.coalesce("runs", F.lit(-1)), F.col("last_run"), -F.col("id"))  # a null date is the smallest
    return instances(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("family_size"), F.coalesce(F.sum("runs"), F.lit(0)).alias("runs_total"), F.max("last_run").alias("last_run"), F.max_by("id", order).alias("representative"))


@query(f"WITH {INST} SELECT id, family, count(*) OVER w AS family_size, row_number() OVER (PARTITION BY family ORDER BY runs DESC NULLS LAST, id) AS family_rank, CAST(coalesce(sum(runs) OVER w, 0) AS BIGINT) AS runs_total, runs IS NULL AS runs_missing FROM inst WINDOW w AS (PARTITION BY family)")
def a2_family_stats(spark, d):
    w = Window.partitionBy("family")
    return instances(spark, d).select("id", "family", F.count(F.lit(1)).over(w).alias("family_size"), F.row_number().over(w.orderBy(F.col("runs").desc_nulls_last(), "id")).cast("long").alias("family_rank"), F.coalesce(F.sum("runs").over(w), F.lit(0)).alias("runs_total"), F.col("runs").isNull().alias("runs_missing"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({TOK.format('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY term")
def a4_document_frequency(spark, d):
    docs = table(spark, d, "documents")
    terms = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return retrieval.document_frequency(terms, "doc_id", docs.count()).withColumn("idf", F.round("idf", 6))


@query(f"SELECT zone, round(greatest(sum(n) / (SELECT count(*) FROM documents), 1.0), 6) AS average FROM (SELECT 'text' AS zone, len({TOK.format('text')}) AS n FROM documents UNION ALL SELECT 'source', len({TOK.format('source')}) FROM documents) GROUP BY zone")
def a5_zone_lengths(spark, d):
    docs = table(spark, d, "documents")
    terms = retrieval.zone_terms(docs, "doc_id", {"text": F.col("text"), "source": F.col("source")})
    return retrieval.zone_lengths(terms, docs.count()).withColumn("average", F.round("average", 6))


@query(f"WITH {INST} SELECT field, count(DISTINCT id) AS df, min(id) AS first_id FROM (SELECT id, unnest(fields) AS field FROM inst) GROUP BY field")
def a6_y3_field_postings(spark, d):
    x = instances(spark, d).select("id", F.explode("fields").alias("field"))
    return x.groupBy("field").agg(F.count_distinct("id").alias("df"), F.min("id").alias("first_id"))


@query("WITH i AS (SELECT DISTINCT p_name AS phrase, array_to_string(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), '') AS acronym FROM part) SELECT acronym, count(*) AS n, CASE WHEN count(*) = 1 THEN min(phrase) END AS resolved FROM i GROUP BY acronym")
def a8_q4_acronyms(spark, d):
    x = table(spark, d, "part").select(F.col("p_name").alias("phrase"), F.array_join(F.transform(F.split("p_name", " "), lambda w: F.left(w, F.lit(1))), "").alias("acronym")).distinct()
    return x.groupBy("acronym").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) == 1, F.min("phrase")).alias("resolved"))


@query(f"WITH {HITS} SELECT query_id, generator, instance_id, best_rank, score, variant, rank FROM merged")
def a9_merge_variants(spark, d):
    return _merged(spark, d).select("query_id", "generator", "instance_id", "score", "variant", *_long("best_rank", "rank"))


_UNION_COLUMNS = ["fused", *(f"{g}_score" for g in GENERATORS), *(f"{g}_variant" for g in GENERATORS)]
_UNION_LONGS = ["best_rank", "n_sources", "fused_rank", *(f"{g}_rank" for g in GENERATORS)]


@query(f"WITH {UNION} SELECT query_id, instance_id, {', '.join(_UNION_COLUMNS)}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _UNION_LONGS)} FROM unioned")
def g4_g5_union(spark, d):
    return _union(spark, d).select("query_id", "instance_id", *_UNION_COLUMNS, *_long(*_UNION_LONGS))


@query(f"WITH {UNION} SELECT query_id, count(*) AS total, {', '.join(f'count({g}_rank) AS {g}_n, count(*) FILTER ({g}_rank IS NOT NULL AND n_sources = 1) AS {g}_only' for g in GENERATORS)}, count(*) FILTER ({_q5}) AS q5_only FROM unioned GROUP BY query_id")
def a11_a12_source_counts(spark, d):
    alone = F.lit(True)
    for g in GENERATORS:
        alone = alone & (F.col(f"{g}_variant").isNull() | (F.col(f"{g}_variant") == "Q5"))
    only = lambda g: F.count_if(F.col(f"{g}_rank").isNotNull() & (F.col("n_sources") == 1)).alias(f"{g}_only")
    return _union(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), *[x for g in GENERATORS for x in (F.count(f"{g}_rank").alias(f"{g}_n"), only(g))], F.count_if(alone).alias("q5_only"))


@query("SELECT l_partkey AS id, form, round((s1 + 0.3 * coalesce(s2, 0)) / 1.3, 6) AS score FROM (SELECT l_partkey, l_returnflag AS form, max(l_extendedprice) AS s1, list_sort(list(l_extendedprice), 'DESC')[2] AS s2 FROM lineitem GROUP BY 1, 2)")
def a15_top_two(spark, d):
    # the two best are ranked, not picked from a list of a group's all
    w = Window.partitionBy("l_partkey", "l_returnflag").orderBy(F.col("l_extendedprice").desc())
    x = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice", F.row_number().over(w).alias("r")).where("r <= 2").groupBy(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("form")).agg(F.max("l_extendedprice").alias("s1"), F.max(F.when(F.col("r") == 2, F.col("l_extendedprice"))).alias("s2"))
    return x.select("id", "form", F.round((F.col("s1") + 0.3 * F.coalesce("s2", F.lit(0.0))) / 1.3, 6).alias("score"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(max((value - m) / nullif(s, 0)), 6) AS top_z FROM (SELECT event_type, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type)) GROUP BY event_type")
def a16_channel_statistics(spark, d):
    # z of the largest value follows from the group's statistics: no window over the rows
    x = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.max("value").alias("x"))
    return x.select("event_type", "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), F.round((F.col("x") - F.col("m")) / F.nullif("s", F.lit(0.0)), 6).alias("top_z"))


@query("SELECT count(*) AS titles, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1)")
def a17_duplicate_identities(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("titles"), F.sum("n").alias("rows"))


@query("WITH s AS (SELECT p_size, sum(p_retailprice) AS t, count(*) AS n FROM part GROUP BY 1) SELECT CAST(p_size AS BIGINT) AS version, round(sum(t) OVER w / sum(n) OVER w, 6) AS mean FROM s WINDOW w AS (ORDER BY p_size)")
def a18_slices(spark, d):
    s = table(spark, d, "part").groupBy("p_size").agg(F.sum("p_retailprice").alias("t"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("p_size")  # over the versions, a fixed few
    return s.select(F.col("p_size").cast("long").alias("version"), F.round(F.sum("t").over(w) / F.sum("n").over(w), 6).alias("mean"))


@query("WITH g AS (SELECT a.x AS expected, b.x AS observed FROM (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(x)) SELECT expected, observed, count(doc_id) AS n FROM g LEFT JOIN labels ON quality = expected AND toxic = observed GROUP BY 1, 2")
def a19_confusion(spark, d):
    x = table(spark, d, "labels").select(F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return evaluation.confusion(x, "quality", "toxic", [0, 1])


@query("SELECT round(avg((a.l_returnflag = b.l_returnflag)::INT), 6) AS agreement, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_linenumber < b.l_linenumber")
def a21_agreement(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    y = x.toDF("l_orderkey", "l_partkey", "n", "flag")
    return x.join(y, ["l_orderkey", "l_partkey"]).where("l_linenumber < n").agg(F.round(F.avg((F.col("l_returnflag") == F.col("flag")).cast("int")), 6).alias("agreement"), F.count(F.lit(1)).alias("pairs"))


@query("SELECT toxic, quality, count(*) AS n, count(DISTINCT doc_id) AS docs FROM labels GROUP BY 1, 2")
def a22_label_inventory(spark, d):
    return table(spark, d, "labels").groupBy("toxic", "quality").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


# --- windows and sets ------------------------------------------------------------------------


@query("SELECT l_suppkey AS query_id, l_partkey AS id, sum_price, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum_price DESC, l_partkey) AS rank FROM (SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 2) AS sum_price FROM lineitem GROUP BY 1, 2)) WHERE rank <= 10")
def w1_stable_top_k(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("sum_price"))
    return retrieval.top(x, ["query_id"], "id", 10, "sum_price").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {UNION} SELECT query_id, instance_id, round(1 - (fused_rank - 1) / greatest(1, count(*) OVER (PARTITION BY query_id)), 6) AS percentile FROM unioned")
def w5_percentile(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return _union(spark, d).select("query_id", "instance_id", F.round(1 - (F.col("fused_rank") - 1) / F.greatest(F.lit(1), n), 6).alias("percentile"))


@query("WITH r AS (SELECT event_type, event_id, value, value < 20 AS ok FROM events) SELECT event_type, event_id, round(row_number() OVER w / count(*) OVER (PARTITION BY event_type), 6) AS coverage, round(1 - avg(ok::INT) OVER (PARTITION BY event_type ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING), 6) AS risk FROM r WINDOW w AS (PARTITION BY event_type ORDER BY value DESC, event_id)")
def w6_risk_coverage(spark, d):
    """Coverage and risk of answering from the surest on, at every row, by running sums over ranges of rows."""
    x = table(spark, d, "events").select("event_type", "event_id", "value", (F.col("value") < 20).cast("int").alias("ok"))
    n = x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    y = prefix.running(x, ["event_type"], [F.col("value").desc(), F.col("event_id")], {"k": F.lit(1), "good": F.col("ok")})
    return prefix.join_on(y, n, ["event_type"]).select("event_type", "event_id", F.round(F.col("k") / F.col("n"), 6).alias("coverage"), F.round(1 - F.col("good") / F.col("k"), 6).alias("risk"))


@query(f"WITH {UNION}, h AS (SELECT query_id, fused / sum(fused) OVER (PARTITION BY query_id) AS p, count(*) OVER (PARTITION BY query_id) AS n FROM unioned WHERE fused_rank <= 10 AND fused > 0) SELECT query_id, round(CASE WHEN max(n) > 1 THEN -sum(p * ln(p)) / ln(max(n)) ELSE 0 END, 6) AS entropy FROM h GROUP BY query_id")
def w8_head_entropy(spark, d):
    w = Window.partitionBy("query_id")
    h = _union(spark, d).where("fused_rank <= 10 and fused > 0").select("query_id", (F.col("fused") / F.sum("fused").over(w)).alias("p"), F.count(F.lit(1)).over(w).alias("n"))
    return h.groupBy("query_id").agg(F.round(F.when(F.max("n") > 1, -F.sum(F.col("p") * F.log("p")) / F.log(F.max("n"))).otherwise(0.0), 6).alias("entropy"))


@query(f"WITH {UNION} SELECT query_id, family, rank AS first_rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS turn FROM (SELECT query_id, lower(p_name) AS family, min(fused_rank) AS rank FROM unioned JOIN part ON p_partkey = instance_id GROUP BY 1, 2)")
def w9_first_families(spark, d):
    fam = table(spark, d, "part").select(F.col("p_partkey").alias("instance_id"), F.lower("p_name").alias("family"))
    x = _union(spark, d).join(fam, "instance_id").groupBy("query_id", "family").agg(F.min("fused_rank").cast("long").alias("first_rank"))
    return x.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank")).cast("long"))


@query(f"WITH {UNION} SELECT query_id, family, instance_id, place FROM (SELECT u.query_id, lower(p_name) AS family, instance_id, fused_rank, row_number() OVER (PARTITION BY u.query_id ORDER BY seen > 1, fused_rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(p_name) ORDER BY fused_rank) AS seen FROM unioned JOIN part ON p_partkey = instance_id) u) WHERE place <= 40")
def w11_diversified_fill(spark, d):
    fam = table(spark, d, "part").select(F.col("p_partkey").alias("instance_id"), F.lower("p_name").alias("family"))
    x = _union(spark, d).join(fam, "instance_id").withColumn("seen", F.row_number().over(Window.partitionBy("query_id", "family").orderBy("fused_rank")))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("seen") > 1, "fused_rank")).cast("long"))
    return x.where("place <= 40").select("query_id", "family", "instance_id", "place")


@query(f"WITH {HITS} SELECT query_id, min(generator) AS generator, instance_id FROM merged GROUP BY query_id, instance_id HAVING count(DISTINCT generator) = 1")
def u4_unique_contribution(spark, d):
    return _merged(spark, d).groupBy("query_id", "instance_id").agg(F.min("generator").alias("generator"), F.count_distinct("generator").alias("n")).where("n = 1").drop("n")


@query("SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def u3_missing_labels(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id"))


@query("SELECT page_id AS id FROM pages INTERSECT SELECT doc_id FROM labels")
def u2_overlap(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id")).intersect(table(spark, d, "labels").select(F.col("doc_id").alias("id")))


# --- retrieval -----------------------------------------------------------------------------------

WEIGHTS = {"title": 4.0, "body": 1.6, "source": 1.2}
BM25F_SQL = f"""docs AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS body, source FROM documents), n AS (SELECT count(*) AS n FROM docs),
z AS (SELECT doc_id, 'title' AS zone, 4.0::DOUBLE AS wt, unnest({TOK.format("title")}) AS term FROM docs UNION ALL SELECT doc_id, 'body', 1.6::DOUBLE, unnest({TOK.format("body")}) FROM docs UNION ALL SELECT doc_id, 'source', 1.2::DOUBLE, unnest({TOK.format("source")}) FROM docs),
len AS (SELECT doc_id, zone, count(*) AS len FROM z GROUP BY 1, 2), av AS (SELECT zone, greatest(sum(len) / (SELECT n FROM n), 1.0) AS av FROM len GROUP BY 1),
tf AS (SELECT doc_id, zone, term, any_value(wt) AS wt, count(*) AS tf FROM z GROUP BY 1, 2, 3),
w AS (SELECT doc_id, term, sum(wt * tf / (0.25 + 0.75 * len / av)) AS w FROM tf JOIN len USING (doc_id, zone) JOIN av USING (zone) GROUP BY 1, 2),
df AS (SELECT term, ln(1 + ((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM w GROUP BY 1),
qt AS (SELECT DISTINCT item_id, unnest({TOK.format("text")}) AS term FROM benchmark),
sc AS (SELECT item_id AS query_id, doc_id, round(sum(idf * 2.2 * w / (1.2 + w)), 6) AS score FROM qt JOIN w USING (term) JOIN df USING (term) GROUP BY 1, 2)"""


def _phrases(spark, d):
    """Words of each document by zone, joined: cut once for all that read them."""
    zones = {"title": F.substring_index(F.col("text"), "\n", 1), "body": F.col("text"), "source": F.col("source")}
    return settle(spread(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id").select("doc_id", *[T.phrase(c).alias(z) for z, c in zones.items()]))


def _bm25f(spark, d, k, phrases=None):
    """The k best documents of each benchmark text are among the rows."""
    phrases = _phrases(spark, d) if phrases is None else phrases
    zones = {z: F.col(z) for z in ("title", "body", "source")}
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    rows, asked = retrieval.bm25f_lists(phrases, "doc_id", zones, WEIGHTS, q, "query_id", "text", cut=T.words_of)
    return retrieval.best_by_terms(rows, asked, "doc_id", "query_id", "bm25", k)


@query(f"WITH {BM25F_SQL} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 100")
def r3_bm25f_generator(spark, d):
    """All benchmark texts ranked against all documents, the best 100 each."""
    return retrieval.top(_bm25f(spark, d, 100), ["query_id"], "doc_id", 100).withColumn("rank", F.col("rank").cast("long"))


def _grams_sql(column: str) -> str:
    pad = "list_transform(list_filter(regexp_split_to_array(lower(" + column + "), '[ \t\n\r]+'), lambda w: w <> ''), lambda w: ' ' || w || ' ')"
    grams = "list_concat(" + ", ".join(f"list_transform(range(1, greatest(length(w) - {k - 2}, CAST({int(k == 3)} + 1 AS BIGINT))), lambda i: substr(w, CAST(i AS INT), {k}))" for k in (3, 4, 5)) + ")"
    return f"flatten(list_transform({pad}, lambda w: {grams}))"


R4_SQL = f"""g AS (SELECT name, unnest({_grams_sql('name')}) AS term FROM (SELECT DISTINCT p_name AS name FROM part)), n AS (SELECT count(DISTINCT p_name) AS n FROM part),
tf AS (SELECT name, term, 1 + ln(count(*)) AS tf FROM g GROUP BY 1, 2), idf AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
x AS (SELECT name, term, tf * idf AS w FROM tf JOIN idf USING (term)), nm AS (SELECT name, sqrt(sum(w * w)) AS m FROM x GROUP BY 1), u AS (SELECT name, term, w / m AS w FROM x JOIN nm USING (name))"""


@query(f"WITH {R4_SQL} SELECT a.name AS a, b.name AS b, round(sum(a.w * b.w), 6) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.name < b.name GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 6) >= 0.2")
def r4_char_tfidf(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    u = retrieval.tfidf(names, "name", retrieval.char_grams(F.col("name")))
    return groups.near_pairs(u, "name", 0.2, 6).withColumnRenamed("similarity", "cosine")


COS_SQL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
sc AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (q.n * v.n), 6) AS score, v.label = q.label AS same FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)"""


@query(f"WITH {COS_SQL} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc QUALIFY rank <= 50")
def r6_dense_exact(spark, d):
    """Exact cosine search; the stated query set is every vector whose id is divisible by 50."""
    v = table(spark, d, "embeddings")
    return retrieval.top(retrieval.cosine(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 50), ["query_id"], "vec_id", 50).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {INST}, f AS (SELECT id, unnest(fields) AS field FROM inst), r AS (SELECT s_nationkey AS request, 'S' || s_suppkey AS field, s_suppkey % 2 = 0 AS required FROM supplier), df AS (SELECT field, count(*) AS df FROM f GROUP BY 1), n AS (SELECT count(*) AS n FROM part),
x AS (SELECT request, r.field, (CASE WHEN required THEN 1.0 ELSE 0.5 END) * ln(1 + (SELECT n FROM n) / greatest(coalesce(df, 1), 1)) / ln(1.0 + (SELECT n FROM n)) AS w FROM r LEFT JOIN df ON df.field = r.field), t AS (SELECT request, sum(w) AS total FROM x GROUP BY 1)
SELECT CAST(x.request AS BIGINT) AS request, id, round(sum(w) / any_value(total), 6) AS score FROM x JOIN f USING (field) JOIN t ON t.request = x.request GROUP BY 1, 2""")
def r15_field_scores(spark, d):
    postings = instances(spark, d).select("id", F.explode("fields").alias("field"))
    requests = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("request"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("field"), (F.col("s_suppkey") % 2 == 0).alias("required"))
    return retrieval.field_scores(requests, postings, table(spark, d, "part").count())


@query(f"SELECT p.family, b.item_id FROM (SELECT DISTINCT string_split(p_name, ' ')[1] AS family FROM part) p JOIN benchmark b ON contains(' ' || array_to_string({TOK.format('b.text')}, ' ') || ' ', ' ' || p.family || ' ') UNION SELECT w, item_id FROM (VALUES ('the'), ('and'), ('of')) t(w) JOIN benchmark b ON list_contains({TOK.format('b.text')}, w)")
def r16_q1_literal_fields(spark, d):
    # batch detection is an equi-join on words, not a scan of all pairs
    first = table(spark, d, "part").select(F.substring_index("p_name", " ", 1).alias("family")).distinct()
    words = first.unionByName(spark.createDataFrame([("the",), ("and",), ("of",)], "family string")).distinct()
    return table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("family")).join(words, "family")


@query("WITH l AS (SELECT o_orderstatus AS query_id, o_orderpriority AS id, round(avg(o_totalprice) / 100000, 6) AS s FROM orders GROUP BY 1, 2), p AS (SELECT *, exp(s / 0.05 - max(s) OVER w / 0.05) AS e FROM l WINDOW w AS (PARTITION BY query_id)) SELECT query_id, id, round(e / sum(e) OVER (PARTITION BY query_id), 6) AS posterior FROM p")
def r19_posterior(spark, d):
    w = Window.partitionBy("query_id")
    x = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("query_id"), F.col("o_orderpriority").alias("id")).agg(F.round(F.avg("o_totalprice") / 100000, 6).alias("s"))
    x = x.withColumn("e", F.exp(F.col("s") / 0.05 - F.max("s").over(w) / 0.05))
    return x.select("query_id", "id", F.round(F.col("e") / F.sum("e").over(w), 6).alias("posterior"))


@query("SELECT query_id, p1, p2, CASE WHEN p1 >= 0.15 AND p1 - p2 >= 0.03 THEN 1 ELSE 5 END AS shown FROM (SELECT l_suppkey AS query_id, round(max(l_extendedprice) / sum(l_extendedprice), 6) AS p1, round(list_sort(list(l_extendedprice), 'DESC')[2] / sum(l_extendedprice), 6) AS p2 FROM lineitem GROUP BY 1)")
def r21_confidence_rule(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_extendedprice").alias("s"))
    total = x.groupBy("query_id").agg(F.sum("s").alias("t"))
    top = x.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc()))).where("r <= 2")
    top = top.groupBy("query_id").agg(F.max("s").alias("b1"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("b2"))
    x = top.join(total, "query_id").select("query_id", F.round(F.col("b1") / F.col("t"), 6).alias("p1"), F.round(F.col("b2") / F.col("t"), 6).alias("p2"))
    return x.withColumn("shown", F.when((F.col("p1") >= 0.15) & (F.col("p1") - F.col("p2") >= 0.03), 1).otherwise(5))


# --- shortlist, fusion, families, decisions ---------------------------------------------------------


@query(f"WITH {SHORT} SELECT query_id, instance_id, admitted_via, position, fused_rank FROM short")
def g9_shortlist(spark, d):
    return _short(spark, d).select("query_id", "instance_id", "admitted_via", *_long("position", "fused_rank"))


@query(f"WITH {_shortlist_sql(True)} SELECT query_id, instance_id, admitted_via, position FROM short")
def g8_shortlist_high(spark, d):
    return _short(spark, d, True).select("query_id", "instance_id", "admitted_via", *_long("position"))


@query(f"WITH {UNION} SELECT query_id, instance_id FROM unioned WHERE fused_rank <= 120")
def g10_plain_depth(spark, d):
    return _union(spark, d).where("fused_rank <= 120").select("query_id", "instance_id")


@query(f"WITH {FUSED} SELECT query_id, instance_id, ce_rank, final_rank, final_score FROM scored")
def g15_fallback_fuser(spark, d):
    return _scored(spark, d).select("query_id", "instance_id", *_long("ce_rank", "final_rank", "final_score"))


@query(f"WITH {FUSED} SELECT query_id, instance_id, round(fused + 4.0 / (60 + ce_rank), 6) AS rank_sum FROM scored")
def g16_rank_sum(spark, d):
    return _scored(spark, d).select("query_id", "instance_id", F.round(F.col("fused") + 4.0 / (60 + F.col("ce_rank")), 6).alias("rank_sum"))


@query(f"WITH {FAMILY} SELECT query_id, family, score, members, selected, family_rank FROM famr")
def a13_g19_families(spark, d):
    return _families(spark, d).select("query_id", "family", "score", "members", "selected", *_long("family_rank"))


@query(f"""WITH {FAMILY}, rel AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS instance_id FROM lineitem),
j AS (SELECT rel.query_id, rel.instance_id, CASE WHEN famr.selected IS NOT NULL THEN 3 WHEN s.instance_id IS NOT NULL THEN 2 WHEN u.instance_id IS NOT NULL THEN 1 ELSE 0 END AS stage FROM rel
LEFT JOIN unioned u ON u.query_id = rel.query_id AND u.instance_id = rel.instance_id LEFT JOIN short s ON s.query_id = rel.query_id AND s.instance_id = rel.instance_id LEFT JOIN famr ON famr.query_id = rel.query_id AND famr.selected = rel.instance_id)
SELECT CAST(stage AS BIGINT) AS last_stage, count(*) AS n FROM j GROUP BY 1""")
def g27_e6_survival(spark, d):
    """How far relevant instances come: union 1, shortlist 2, selected by a family 3."""
    rel = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("instance_id")).distinct().withColumn("stage", F.lit(0))
    stage = lambda x, k: x.select("query_id", F.col("instance_id"), F.lit(k).alias("stage"))
    x = rel.unionByName(stage(_union(spark, d), 1)).unionByName(stage(_short(spark, d), 2)).unionByName(stage(_families(spark, d).withColumnRenamed("selected", "instance_id"), 3))
    x = x.groupBy("query_id", "instance_id").agg(F.min("stage").alias("relevant"), F.max("stage").alias("last_stage")).where("relevant = 0")
    return x.groupBy(F.col("last_stage").cast("long").alias("last_stage")).agg(F.count(F.lit(1)).alias("n"))


# --- evaluation --------------------------------------------------------------------------------------


@query(f"""WITH {COS_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM sc QUALIFY r <= 50),
rel AS (SELECT q.vec_id AS query_id, v.vec_id AS doc, 1 + v.vec_id % 3 AS grade FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
ide AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc) AS r FROM rel),
base AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r <= 5 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS i5, sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS i10 FROM ide GROUP BY 1),
f AS (SELECT rel.query_id, r, grade, count(*) OVER (PARTITION BY rel.query_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS so_far FROM rk JOIN rel ON rel.query_id = rk.query_id AND rel.doc = rk.vec_id),
m AS (SELECT query_id, max((r <= 1)::DOUBLE) AS h1, max((r <= 5)::DOUBLE) AS h5, max((r <= 10)::DOUBLE) AS h10, sum((r <= 5)::DOUBLE) AS n5, sum((r <= 10)::DOUBLE) AS n10, sum((r <= 20)::DOUBLE) AS n20, sum((r <= 50)::DOUBLE) AS n50,
 max(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0.0 END)::DOUBLE AS mrr, sum(CASE WHEN r <= 5 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS d5, sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS d10, sum(so_far / r) AS ap FROM f GROUP BY 1)
SELECT query_id, coalesce(h1, 0) AS hit_1, coalesce(h5, 0) AS hit_5, coalesce(h10, 0) AS hit_10, round(coalesce(n10 / n, 0), 6) AS recall_10, round(coalesce(n20 / n, 0), 6) AS recall_20, round(coalesce(n50 / n, 0), 6) AS recall_50, round(coalesce(mrr, 0), 6) AS mrr_10, round(coalesce(d5 / i5, 0), 6) AS ndcg_5, round(coalesce(d10 / i10, 0), 6) AS ndcg_10, round(coalesce(n5 / 5, 0), 6) AS p_5, round(coalesce(ap / n, 0), 6) AS map FROM base LEFT JOIN m USING (query_id)""")
def e1_ranking_metrics(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0")
    ranked = retrieval.top(retrieval.cosine(v, q, "vec_id", "embedding", 50), ["query_id"], "vec_id", 50).select("query_id", F.col("vec_id").alias("doc"), "rank")
    rel = q.select(F.col("vec_id").alias("query_id"), "label").join(v.select(F.col("vec_id").alias("doc"), "label"), "label").where("query_id <> doc").select("query_id", "doc", (1 + F.col("doc") % 3).alias("grade"))
    return evaluation.ranking_metrics(ranked, rel)


_CAL = "SELECT least(1.0, round(n_chars / 5000.0, 6)) AS s, quality AS y FROM documents JOIN labels USING (doc_id)"


@query(f"WITH r AS ({_CAL}), b AS (SELECT floor(s * 10) AS bin, count(*) AS c, abs(avg(s) - avg(y)) AS gap FROM r WHERE s < 1 GROUP BY 1), p AS (SELECT s, y, least(greatest(s, 1e-7), 1 - 1e-7) AS p FROM r) SELECT round(avg((s - y) * (s - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS nll, round((SELECT sum(c * gap) FROM b) / count(*), 6) AS ece FROM p")
def e2_calibration(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.least(F.lit(1.0), F.round(F.col("n_chars") / 5000.0, 6)).alias("s"), F.col("quality").alias("y"))
    return evaluation.calibration(x, "s", "y")


@query("WITH p AS (SELECT s_nationkey AS g, s_suppkey AS id, s_acctbal AS a, s_suppkey % 17 AS b FROM supplier) SELECT CAST(x.g AS BIGINT) AS g, count(*) FILTER ((x.a - y.a) * (x.b - y.b) < 0) AS discordant, count(*) AS pairs FROM p x JOIN p y ON x.g = y.g AND x.id < y.id GROUP BY 1")
def e3_discordant_pairs(spark, d):
    p = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("g"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("a"), (F.col("s_suppkey") % 17).alias("b"))
    x = prefix.inversions(p, ["g"], "a", "b", "id").where("n > 1")
    return x.select("g", F.col("inversions").alias("discordant"), F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def e4_latency_summary(spark, d):
    """Quantiles between neighbours in order, and means; no group is sorted or held by one task."""
    x = table(spark, d, "events").select("event_type", "value")
    at = {p: (F.col("n") - 1) * p for p in (0.5, 0.95)}
    q = prefix.quantiles(x, ["event_type"], "value", {f"{side}{p}": f(c) for p, c in at.items() for side, f in (("low", F.floor), ("high", F.ceil))})
    between = lambda p: F.round(F.col(f"`low{p}`") + (F.col(f"`high{p}`") - F.col(f"`low{p}`")) * (at[p] - F.floor(at[p])), 6)
    mean = x.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return prefix.join_on(q, mean, ["event_type"]).select("event_type", between(0.5).alias("p50"), between(0.95).alias("p95"), "mean")


@query("WITH m AS (SELECT l_linestatus AS v, l_returnflag AS metric, round(avg(l_discount), 6) AS x FROM lineitem GROUP BY 1, 2) SELECT a.metric AS metric, round(b.x - a.x, 6) AS delta, round(a.x - b.x, 6) > 0.02 AS failed FROM m a JOIN m b ON a.metric = b.metric WHERE a.v = 'F' AND b.v = 'O'")
def e5_regression_gate(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("l_discount"), 6))
    return m.where("F is not null and O is not null").select("metric", F.round(F.col("O") - F.col("F"), 6).alias("delta"), (F.round(F.col("F") - F.col("O"), 6) > 0.02).alias("failed"))


@query("WITH c AS (SELECT quality AS label, avg((toxic = 0)::INT) AS recall, count(*) AS n FROM labels GROUP BY 1) SELECT round(avg(recall), 6) AS macro_recall, CAST(sum(n) AS BIGINT) AS n FROM c")
def e10_macro_recall(spark, d):
    c = table(spark, d, "labels").groupBy("quality").agg(F.avg((F.col("toxic") == 0).cast("int")).alias("r"), F.count(F.lit(1)).alias("n"))
    return c.agg(F.round(F.avg("r"), 6).alias("macro_recall"), F.sum("n").alias("n"))


@query(f"WITH r AS ({_CAL}), b AS (SELECT ceil(s * 10) AS bin, count(*) AS c, abs(avg(s) - avg(y)) AS gap FROM r WHERE s > 0 GROUP BY 1) SELECT round(sum(c * gap) / (SELECT count(*) FROM r), 6) AS ece FROM b")
def e11_upper_ece(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.least(F.lit(1.0), F.round(F.col("n_chars") / 5000.0, 6)).alias("s"), F.col("quality").alias("y"))
    b = x.groupBy(F.ceil(F.col("s") * 10).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.when(F.col("s") > 0, 1).otherwise(0)).alias("p"), F.abs(F.avg("s") - F.avg("y")).alias("gap"))
    return b.agg(F.round(F.sum(F.when(F.col("p") > 0, F.col("c") * F.col("gap"))) / F.sum("c"), 6).alias("ece"))


@query("SELECT d.doc_id, coalesce(l.quality, CASE WHEN n_chars > 100 THEN 1 ELSE 0 END) AS label, CASE WHEN l.quality IS NOT NULL THEN 1.0::DOUBLE WHEN n_chars > 100 THEN 0.6 ELSE 0.0 END AS weight FROM documents d LEFT JOIN labels l USING (doc_id)")
def e12_label_precedence(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return x.select("doc_id", F.coalesce("quality", F.when(F.col("n_chars") > 100, 1).otherwise(0)).alias("label"), F.when(F.col("quality").isNotNull(), 1.0).when(F.col("n_chars") > 100, 0.6).otherwise(0.0).alias("weight"))


@query("SELECT toxic AS label, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight FROM labels GROUP BY 1")
def l5_class_weights(spark, d):
    x = table(spark, d, "labels").groupBy(F.col("toxic").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return x.select("label", F.round(F.sum("n").over(Window.partitionBy(F.lit(0))) / (2.0 * F.col("n")), 6).alias("weight"))


# --- dataset construction and upkeep -----------------------------------------------------------------


@query(f"WITH {INST}, v AS (SELECT family, id, 'field' AS kind, unnest(fields) AS value FROM inst UNION ALL SELECT family, id, 'prompt', unnest(prompts) FROM inst UNION ALL SELECT family, id, 'data_source', data_source FROM inst) SELECT family, kind, value, min(id) AS id FROM v GROUP BY 1, 2, 3 HAVING count(DISTINCT id) = 1")
def y2_distinguishers(spark, d):
    x = instances(spark, d)
    one = lambda kind, c: x.select("family", "id", F.lit(kind).alias("kind"), c.alias("value"))
    v = one("field", F.explode("fields")).unionByName(one("prompt", F.explode("prompts"))).unionByName(one("data_source", F.col("data_source")))
    return v.groupBy("family", "kind", "value").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last").drop("last")


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS field, l_partkey AS id, p_brand AS family FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT field, count(*) AS df, list_sort(list(id)) AS ids FROM f GROUP BY 1 HAVING count(*) <= 3 AND count(DISTINCT family) = 1""")
def y4_rare_fields(spark, d):
    """Fields (orders) of at most three instances (parts), all in one family (brand): a request that names one has a definite answer."""
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"))
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("field"), F.col("l_partkey").alias("id")).join(brand, "id").distinct()
    # bounded: only fields of few instances have their ids listed
    few = x.groupBy("field").agg(F.count(F.lit(1)).alias("df"), F.count_distinct("family").alias("families")).where("df <= 3 and families = 1").select("field", "df")
    return x.join(few, "field").groupBy("field", "df").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("field", "df", "ids")


@query("SELECT c_custkey AS id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 3 AS reviewer FROM customer")
def w10_round_robin(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.row_number().over(w) - 1) % 3).cast("long").alias("reviewer"))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n, min(event_id) AS kept FROM events GROUP BY ALL")
def s15_idempotent_impressions(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("kept"))


@query("""WITH said AS (SELECT conv_id, count(*) AS turns, string_agg(text, ' / ' ORDER BY turn) FILTER (role = 'user') AS said, arg_min(text, turn) FILTER (role = 'user') AS first_said FROM conversations GROUP BY conv_id)
SELECT conv_id, turns, left(sha256(coalesce(said, '')), 16) AS context_hash, length(coalesce(said, '')) AS context_length, CASE WHEN said IS NOT NULL AND said <> first_said THEN 'QC' END AS variant FROM said""")
def g34_clarified_rerun(spark, d):
    """All that a user said, whole, as the context of a rerun; a QC variant where it says more than the first request. The context is returned as a digest."""
    said = F.sort_array(F.collect_list(F.when((F.col("role") == "user") & F.col("text").isNotNull(), F.struct("turn", "text"))))
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), said.alias("s"))
    x = x.withColumn("said", F.array_join(F.transform("s", lambda v: v["text"]), " / "))
    more = (F.size("s") > 0) & (F.col("said") != F.get("s", F.lit(0))["text"])
    return x.select("conv_id", "turns", F.left(F.sha2("said", 256), F.lit(16)).alias("context_hash"), F.length("said").cast("long").alias("context_length"), F.when(more, "QC").alias("variant"))


# --- gates, suitability, expansion -----------------------------------------------------------------

_SPLIT_SQL = r"list_distinct(list_filter(list_transform(regexp_split_to_array({0}, '(?i)\s*(?:;|\band then\b|\bversus\b|\bvs\.?\b)\s*'), lambda x: trim(x, ' ,')), lambda x: x <> ''))"
_REQUEST = "concat(p_name, CASE WHEN p_size % 3 = 0 THEN ' and then ' WHEN p_size % 3 = 1 THEN '; ' ELSE ' ' END, p_type, ' VS. ', p_brand)"


@query(f"SELECT p_partkey AS id, list_sort({_SPLIT_SQL.format(_REQUEST)}) AS parts FROM part")
def q8_subqueries(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.sort_array(expansion.subqueries(F.expr(_REQUEST))).alias("parts"))


@query("SELECT l_orderkey AS query_id, l_linenumber AS rule, CAST(l_suppkey % 3 AS BIGINT) AS start, l_quantity < max(l_quantity) OVER (PARTITION BY l_orderkey, l_suppkey % 3) AS suppressed FROM lineitem")
def q2_rule_priority(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rule"), (F.col("l_suppkey") % 3).cast("long").alias("start"), (F.col("l_suppkey") % 3).alias("end"), F.col("l_quantity").alias("priority"))
    return expansion.fire_rules(hits).select("query_id", "rule", "start", "suppressed")


@query("""WITH e AS (SELECT l_orderkey AS query_id, l_returnflag AS kind, lower(l_linestatus) AS concept, 'S' || l_suppkey AS evidence, min(l_linenumber) AS start, max(l_discount) AS c, max(l_quantity) AS r FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT query_id, kind, concept, max(c) AS confidence, max(r) AS requirement, array_to_string(list(evidence ORDER BY start, evidence)[1:3], '; ') AS evidence FROM e GROUP BY 1, 2, 3""")
def q7_merged_concepts(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("canonical"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("evidence"), F.col("l_linenumber").alias("start"), F.col("l_discount").alias("confidence"), F.col("l_quantity").alias("requirement"))
    return expansion.merge_concepts(x)


@query(f"WITH {INST}, f AS (SELECT family, arg_min(title, id) AS title, arg_min(fields, id) AS fields FROM inst GROUP BY 1) SELECT family, lower('show ' || title || CASE WHEN len(fields) > 0 THEN ' with ' || array_to_string(fields[1:4], ', ') ELSE '' END) AS text FROM f")
def r13_prototypes(spark, d):
    return expansion.prototypes(instances(spark, d))


@query(f"WITH {INST} SELECT id, round(CASE WHEN len(prompts) = 0 THEN 1 ELSE 0.15 + 0.85 * pow(list_contains(fields, 'S1')::INT * 0.5 + list_contains(prompts, 'NO')::INT * 0.5, 1.5) END, 6) AS gate FROM inst")
def h3_mandatory_gate(spark, d):
    met = F.when(F.size("prompts") > 0, F.array_contains("fields", "S1").cast("int") * 0.5 + F.array_contains("prompts", "NO").cast("int") * 0.5)
    return instances(spark, d).select("id", F.round(ranking.mandatory_gate(met), 6).alias("gate"))


@query(f"""WITH {UNION}, s AS (SELECT query_id, instance_id, fused * 1000 AS score, {CE_SQL} AS ce_score FROM unioned), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, instance_id) <= 40 AS head FROM s),
b AS (SELECT query_id, instance_id, round(CASE WHEN head THEN score + 0.3 * (coalesce((ce_score - min(ce_score) OVER w) / nullif(max(ce_score) OVER w - min(ce_score) OVER w, 0), 0) - 0.5) ELSE score END, 6) AS blended FROM h WINDOW w AS (PARTITION BY query_id, head))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, instance_id) AS rank FROM b""")
def h5_blended(spark, d):
    x = _union(spark, d).select("query_id", "instance_id", (F.col("fused") * 1000).alias("score"), _ce().alias("ce_score"))
    return ranking.blend(x, 0.3, 40).select("query_id", "instance_id", "blended", F.col("rank").cast("long").alias("rank"))


_SUIT_SQL = "round((0.45 * (list_contains(fields, 'S1')::INT + list_contains(fields, 'S2')::INT) / 2.0 + CASE WHEN id % 2 = 0 THEN 0.2 * list_contains(prompts, 'NO')::INT ELSE 0 END) / CASE WHEN id % 2 = 0 THEN 0.65 ELSE 0.45 END, 6)"


def _suitability():
    wanted = {"fields": F.array(F.lit("S1"), F.lit("S2")), "prompts": F.when(F.col("id") % 2 == 0, F.array(F.lit("NO")))}
    return F.round(ranking.suitability(wanted, {"fields": F.col("fields"), "prompts": F.col("prompts")}), 6)


@query(f"WITH {INST} SELECT id, {_SUIT_SQL} AS suitability FROM inst")
def g20_suitability(spark, d):
    return instances(spark, d).select("id", _suitability().alias("suitability"))


@query("WITH " + FUSED + f""", {INST}, m AS (SELECT query_id, family, instance_id, final_rank, CASE WHEN ce_rank <= 20 THEN ce_score END AS ce_score, {_SUIT_SQL} AS suitability FROM scored JOIN inst ON id = instance_id)
SELECT query_id, family, instance_id, row_number() OVER (PARTITION BY query_id, family ORDER BY coalesce(ce_score, -1e9) DESC, suitability DESC, final_rank, instance_id) AS place FROM m""")
def g22_reselection(spark, d):
    known = instances(spark, d).select(F.col("id").alias("instance_id"), "family", _suitability().alias("suitability"))
    m = _scored(spark, d).select("query_id", "instance_id", F.col("final_rank").alias("rank"), F.when(F.col("ce_rank") <= 20, F.col("ce_score")).alias("ce_score")).join(known, "instance_id")
    return ranking.reselect(m).select("query_id", "family", "instance_id", F.col("place").cast("long").alias("place"))


@query("""WITH p AS (SELECT l_suppkey AS query_id, l_extendedprice / 100000 AS s, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem),
q AS (SELECT query_id, count(DISTINCT p_brand) FILTER (r <= 5) AS cats, max(s) FILTER (r = 1) - max(s) FILTER (r = 2) AS gap FROM p JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT query_id, round(least(1, CASE WHEN query_id % 2 = 0 THEN 0 ELSE 0.45 END + 0.2 * (1 - least(1, (query_id % 5) / 3.0)) + 0.2 * least(1, greatest(0, (cats - 1) / 4.0)) + 0.15 * coalesce(1 - least(1, greatest(0, gap / 0.25)), 0)), 6) AS ambiguity FROM q""")
def h8_ambiguity(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    p = table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 5").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    s = lambda r: F.max(F.when(F.col("r") == r, F.col("l_extendedprice") / 100000))
    q = p.groupBy(F.col("l_suppkey").alias("query_id")).agg(F.count_distinct("p_brand").alias("cats"), (s(1) - s(2)).alias("gap"))
    return q.select("query_id", F.round(ranking.ambiguity(F.col("query_id") % 2 == 0, F.col("query_id") % 5, F.col("cats"), F.col("gap")), 6).alias("ambiguity"))
