"""Queries of ingest: parts as the rows of an exported catalog, with headers, blank titles, dashes and repeated fields as exports have them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog_queries import BAG_SQL, query
from corvane.functions import text as T
from corvane.sources import ingest
from corvane.sources.catalog import table

RAW = """raw AS (SELECT p_partkey AS position, CASE WHEN p_size % 10 = 0 THEN ' NaN ' ELSE p_name || ' –  ' || p_size END AS name, replace(p_name, ' ', '; ') || ';' || upper(p_name) || chr(10) || upper(split_part(p_name, ' ', 1)) || CASE WHEN p_size % 4 = 0 THEN ';' || p_type ELSE '' END AS fields, p_brand AS category, CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE p_type END AS source, p_size AS runs FROM part),
rec AS (SELECT *, position + 4 AS source_row, 'R' || CASE WHEN position + 4 >= 1000 THEN CAST(position + 4 AS VARCHAR) ELSE lpad(CAST(position + 4 AS VARCHAR), 4, '0') END AS report_key, row_number() OVER (ORDER BY position) - 1 AS row_index, lower(trim(regexp_replace(replace(name, '–', '-'), '\\s+', ' ', 'g'))) AS title_key, CASE WHEN source = 'n/a' THEN '' ELSE lower(source) END AS data_source_key,
 list_filter(list_transform(regexp_split_to_array(fields, '[;\\r\\n]+'), lambda v: trim(v)), lambda v: v <> '') AS f0 FROM raw WHERE lower(trim(name)) <> 'nan'),
row AS (SELECT *, list_filter(list_transform(range(1, len(f0) + 1), lambda i: CASE WHEN list_position(list_transform(f0, lambda v: lower(v)), lower(f0[i])) = i THEN f0[i] END), lambda v: v IS NOT NULL) AS f FROM rec)"""


def exported(spark, d):
    """The parts as an export: its headers in the export's spelling."""
    name, size = F.col("p_name"), F.col("p_size")
    cell = F.concat(F.replace(name, F.lit(" "), F.lit("; ")), F.lit(";"), F.upper(name), F.lit("\n"), F.upper(F.substring_index(name, " ", 1)), F.when(size % 4 == 0, F.concat(F.lit(";"), F.col("p_type"))).otherwise(""))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("row"), F.when(size % 10 == 0, " NaN ").otherwise(F.concat(name, F.lit(" –  "), size.cast("string"))).alias("Custom_Report"), cell.alias("FIELDS"),
        F.col("p_brand").alias("Category"), F.when(size % 7 == 0, "n/a").otherwise(F.col("p_type")).alias(" Data Source"), size.cast("string").alias("Number of Times"), F.col("p_type").alias("Owner"),
    )


@query(f"WITH {RAW} SELECT report_key, source_row, row_index, title_key, data_source_key FROM row")
def s1_s2_catalog_records(spark, d):
    return ingest.records(exported(spark, d), "row").select("report_key", "source_row", "row_index", "title_key", "data_source_key")


@query(f"WITH {RAW} SELECT report_key, list_transform(f, lambda v: '|' || lower(v)) AS keys, f AS names FROM row")
def s20_fields_of_column(spark, d):
    x = ingest.row_corpus(exported(spark, d), "row")
    return x.select("report_key", F.col("field_meta.field_key").alias("keys"), F.col("field_meta.field_name").alias("names"))


@query(f"""WITH {RAW}, t AS (SELECT title_key, data_source_key, count(*) AS n, sum(len(f)) AS links, count(*) FILTER (len(f) = 0) AS none FROM row GROUP BY 1, 2)
SELECT (SELECT count(*) FROM part) AS report_rows_read, CAST(sum(n) AS BIGINT) AS valid_reports_loaded, count(DISTINCT title_key) AS families, count(*) FILTER (n > 1) AS duplicate_identities, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows, CAST(sum(links) AS BIGINT) AS links, CAST(sum(none) AS BIGINT) AS without_fields FROM t""")
def s3_s23_row_summary(spark, d):
    return ingest.build_corpus(exported(spark, d), "row", "row")[1]


@query(f"WITH {RAW} SELECT (SELECT count(*) FROM part) AS report_rows_read, count(*) AS valid_reports_loaded, count(DISTINCT title_key) AS families, CAST(NULL AS BIGINT) AS duplicate_identities, CAST(NULL AS BIGINT) AS duplicate_rows, CAST(NULL AS BIGINT) AS links, CAST(NULL AS BIGINT) AS without_fields FROM row")
def s3_s23_family_summary(spark, d):
    return ingest.build_corpus(exported(spark, d), "row", "family")[1]


@query(f"WITH {RAW} SELECT title_key, CAST(sum(runs) AS DOUBLE) AS runs_total, count(*) AS members, min(report_key) FILTER (position = best) AS report_key, 0 AS n_fields, 0.0::DOUBLE AS field_link_confidence FROM (SELECT *, first_value(position) OVER (PARTITION BY title_key ORDER BY runs DESC, position) AS best FROM row) GROUP BY 1")
def s21_s22_family_load(spark, d):
    x = ingest.family_corpus(exported(spark, d), "row")
    return x.select("title_key", "runs_total", "members", "report_key", F.size("field_meta").alias("n_fields"), "field_link_confidence")


_LINKS = "SELECT l_partkey AS id, l_discount AS c, l_returnflag = 'R' AS unclear FROM lineitem"


@query(f"WITH x AS ({_LINKS}) SELECT p_partkey AS id, round(coalesce(avg(c), 0), 6) AS field_link_confidence, count(*) FILTER (unclear) AS ambiguous_field_count, round(coalesce(avg(unclear::INT), 0), 6) AS ambiguous_link_fraction, coalesce(bool_or(unclear), false) AS has_ambiguous_fields FROM part LEFT JOIN x ON id = p_partkey GROUP BY 1")
def a3_link_quality(spark, d):
    link = F.struct(F.col("l_discount").alias("match_confidence"), F.when(F.col("l_returnflag") == "R", "AMBIGUOUS").otherwise("RESOLVED").alias("ambiguity_status"))
    links = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_list(link).alias("field_meta"))
    none = F.array().cast("array<struct<match_confidence:double,ambiguity_status:string>>")
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id")).join(links, "id", "left").withColumn("field_meta", F.coalesce("field_meta", none))
    confidence, unclear, share, some = ingest.link_quality()
    return x.select("id", F.round(confidence, 6).alias("field_link_confidence"), unclear, F.round(share, 6).alias("ambiguous_link_fraction"), some)


@query(f"WITH {RAW} SELECT field, row_index FROM (SELECT row_index, unnest(f) AS field FROM row)")
def a7_field_vocabulary(spark, d):
    """Field to row indices, as rows: a common field's rows need not fit in one list."""
    return ingest.row_corpus(exported(spark, d), "row").select(F.explode("field_meta.field_name").alias("field"), "row_index")


@query("SELECT event_id, regexp_replace(trim(regexp_replace(regexp_replace(event_type || '__(' || props || ')', '[^0-9a-zA-Z]+', ' ', 'g'), ' +', ' ', 'g')), '^$', '').lower() AS header FROM events")
def p5_headers(spark, d):
    return table(spark, d, "events").select("event_id", T.normalize_header(F.concat("event_type", F.lit("__("), "props", F.lit(")"))).alias("header"))


@query(r"WITH s AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, regexp_split_to_array(text, '[\p{L}\p{N}]+') AS g FROM conversations) SELECT conv_id, turn, w AS surfaces, list_transform(w, lambda v: replace(lower(v), 'ß', 'ss')) AS words, list_transform(range(1, len(w) + 1), lambda i: CAST(coalesce(list_sum(list_transform(g[1:i], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(w[1:i - 1], lambda v: length(v))), 0) AS INT)) AS starts FROM s")
def p7_word_spans(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", T.spans(F.col("text")).alias("s"))
    return x.select("conv_id", "turn", F.col("s.surface").alias("surfaces"), F.col("s.word").alias("words"), F.col("s.start").alias("starts"))


@query("SELECT c_custkey AS id, lower(trim(regexp_replace(replace(c_mktsegment || '__' || upper(c_name), '_', ' '), '\\s+', ' ', 'g'))) AS said FROM customer")
def p25_humanized(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.humanize(F.concat("c_mktsegment", F.lit("__"), F.upper("c_name"))).alias("said"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(['Field Name: ' || p_name, 'Business Object: ' || p_brand, CASE WHEN p_size % 2 = 0 THEN 'Description: ' || p_type END], lambda v: v IS NOT NULL), chr(10)) AS text FROM part")
def p26_embedding_text(spark, d):
    parts = [("Field Name", F.col("p_name")), ("Business Object", F.col("p_brand")), ("Description", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")), ("Domain", F.lit(""))]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.embedding_text(parts).alias("text"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN [] ELSE [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)] END AS items FROM part")
def p27_cell_items(spark, d):
    cell = F.when(F.col("p_size") % 3 == 0, " NaT ").otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit(" ;; ")), F.lit("; "), F.substring_index("p_name", " ", 1)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.cell_items(cell).alias("items"))


@query("""WITH x AS (SELECT p_partkey AS id, p_name AS raw, [p_type, p_brand] AS a, [CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END, '', p_type, p_brand] AS b FROM part)
SELECT id, raw || ' ' || array_to_string(a, ' ') AS q3, array_to_string(list_transform(list_sort(list_distinct(list_transform(list_filter(list_prepend(raw, b), lambda v: v <> ''), lambda v: list_position(list_prepend(raw, b), v)))), lambda i: list_prepend(raw, b)[i]), ' ') AS q4 FROM x""")
def p28_u5_request_forms(spark, d):
    """Q3 adds objectives and categories to the request, Q4 its fields, sources and objects: each value once, in order."""
    field = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), T.joined_once(F.array("p_name", "p_type", "p_brand")).alias("q3"), T.joined_once(F.array(F.col("p_name"), field, F.lit(""), F.col("p_type"), F.col("p_brand"))).alias("q4")
    )


#: The zones that fields' metadata give, with their weights.
ZONES = (("description", 1), ("business_object", 1), ("domain", 1), ("categories", 1), ("field_type", 0), ("prompts", 1), ("related_object", 1))


@query("""WITH v AS (SELECT l_partkey AS id, l_linenumber AS n, l_orderkey AS o, l_returnflag AS flag, l_linestatus AS state FROM lineitem), z AS (SELECT id, 'description' AS zone, flag AS v, min((o, n)) AS first FROM v GROUP BY ALL UNION ALL SELECT id, 'business_object', state, min((o, n)) FROM v GROUP BY ALL)
SELECT id, zone, string_agg(v, ', ' ORDER BY first) AS value, 1 AS weight FROM z GROUP BY 1, 2""")
def p12_metadata_zones(spark, d):
    """Values of all of a part's fields (its order lines), each once in order of first appearance, so that shared ones don't gain weight."""
    used = {"description": "l_returnflag", "business_object": "l_linestatus"}
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.struct("l_orderkey", "l_linenumber").alias("at"), F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.trim(F.col(used[z])).alias("v"), F.lit(w).alias("weight")) for z, w in ZONES if z in used])).alias("z"))
    x = x.select("id", "at", "z.*").where("v <> '' and weight > 0").groupBy("id", "zone", "weight", "v").agg(F.min("at").alias("first"))
    return x.groupBy("id", "zone", "weight").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "v"))), lambda s: s["v"]), ", ").alias("value")).select("id", "zone", "value", "weight")


@query(f"WITH {RAW} SELECT report_key, category FROM row")
def f10_z1_open_view(spark, d):
    """What an opted-in open view shows: every row, without the columns that no view may show."""
    from corvane.operators import access

    x = access.allow_all(ingest.searchable(ingest.records(exported(spark, d), "row")), opted_in=True)
    return x.select([c for c in x.columns if c in ("report_key", "category", *ingest.SENSITIVE)])


@query(f"SELECT 'b-' || left({BAG_SQL}, 16) || '-' || left(sha256('bm25f:1.2:0.75'), 8) AS bundle FROM (SELECT sha256(p_name || chr(31)) AS h FROM part)")
def i6_bundle_identity(spark, d):
    """A bundle's name: its contents' hash and its settings' hash."""
    content = table(spark, d, "part").agg(T.bag_hash(F.sha2(F.concat("p_name", F.lit("\x1f")), 256)).alias("c"))
    return content.select(F.concat(F.lit("b-"), F.left("c", F.lit(16)), F.lit("-"), F.left(F.sha2(F.lit("bm25f:1.2:0.75"), 256), F.lit(8))).alias("bundle"))
