"""Scenarios of a made-up dataset: parts as reports, suppliers as their fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog_queries import INST, TOK, query
from corvane.functions import text as T
from corvane.operators import groups, scenarios
from corvane.plans.groups import FRACTIONS
from corvane.sources.catalog import instances, table
from corvane.sources.settled import settle

SEED, BUDGET = "20260804", 40
ACRONYMS = {"economy": "eco", "standard": "std", "promo": "pr", "widget": "wdg", "gizmo": "gz"}
STOP = ("show", "with")
_h = lambda *parts: "md5(concat_ws(':', " + ", ".join(parts) + "))"
_draw = lambda key, number, below, seed=SEED: f"(CAST('0x' || left({_h(repr(seed), f'CAST({key} AS VARCHAR)', f'CAST({number} AS VARCHAR)')}, 8) AS BIGINT) % ({below}))"
POOL_SQL = """pool AS (SELECT p_partkey AS id, p_brand AS category, lower(p_name) AS family, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place FROM part WHERE p_size % 5 > 0), sz AS (SELECT category, count(*) AS n FROM pool GROUP BY 1)"""
J15_SQL = f"""{POOL_SQL}, tg AS (SELECT p_partkey AS id, p_brand AS category, lower(p_name) AS family FROM part), dr AS (SELECT id, category, family, turn, {_draw('id', 'turn', 'n')} AS place FROM tg JOIN sz USING (category), range(0, 128) t(turn)),
ng AS (SELECT dr.id, pool.id AS negative, min(turn) AS t FROM dr JOIN pool ON pool.category = dr.category AND pool.place = dr.place WHERE pool.family <> dr.family GROUP BY 1, 2), neg AS (SELECT id, negative, CAST(row_number() OVER (PARTITION BY id ORDER BY t, negative) - 1 AS INT) AS turn FROM ng QUALIFY turn < 4)"""


@query(f"WITH {J15_SQL} SELECT id, negative, turn FROM neg")
def j15_negatives(spark, d):
    """Four negatives of each part, drawn from all parts of its brand and of another family; parts of a size divisible by 5 aren't drawn."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.lower("p_name").alias("family"), "p_size")
    return scenarios.negatives(part, part.where("p_size % 5 > 0"), 4, SEED)


@query("""WITH v AS (SELECT l_partkey AS f, count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY 1 HAVING df >= 20), h AS (SELECT DISTINCT l_partkey AS f, l_orderkey AS o FROM lineitem WHERE l_partkey IN (SELECT f FROM v)),
co AS (SELECT DISTINCT x.f AS a, y.f AS b FROM h x JOIN h y ON x.o = y.o AND x.f <> y.f), per AS (SELECT a, count(*) AS n, list(b ORDER BY b) AS bs FROM co GROUP BY 1)
SELECT f AS field, (SELECT count(*) FROM v) - 1 - coalesce(n, 0) AS absent, coalesce(bs, []) AS together FROM v LEFT JOIN per ON a = f""")
def y5_co_absent_pairs(spark, d):
    """All pairs of common fields (parts) that no instance (order) has together, one row a field: its pairs are all other common fields but those listed."""
    return scenarios.co_absent(_holdings(spark, d))


def _holdings(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("field"), F.col("l_orderkey").alias("id"))


_DRAWN = 300


def _said(spark, d):
    return instances(spark, d).select("id", F.concat(F.lit("Show "), "title", F.lit(" of standard "), F.lower("data_source"), F.lit(" widget kind")).alias("text"))


_SAID = "SELECT id, 'Show ' || title || ' of standard ' || lower(data_source) || ' widget kind' AS text FROM inst"


def _acronym_sql():
    x = "t0 AS (SELECT id, text AS t, []::VARCHAR[] AS done FROM said)"
    for k, (long, short) in enumerate(sorted(ACRONYMS.items())):
        use = f"regexp_matches(t, '(?i)\\b{long}\\b') AND len(done) < 2 AND {_draw('id', k, 1 << 20)} < {int(0.8 * (1 << 20))}"
        x += f", t{k + 1} AS (SELECT id, CASE WHEN {use} THEN regexp_replace(t, '(?i)\\b{long}\\b', '{short}') ELSE t END AS t, CASE WHEN {use} THEN list_append(done, '{long}->{short}') ELSE done END AS done FROM t{k})"
    return x, f"t{len(ACRONYMS)}"


_ACRO, _LAST = _acronym_sql()


@query(f"WITH {INST}, said AS ({_SAID}), {_ACRO} SELECT id, t AS text, done AS noise FROM {_LAST}")
def y8_acronyms(spark, d):
    """Requests as insiders shorten them: at most two long forms, each with a chance of 0.8."""
    return scenarios.with_acronyms(_said(spark, d), "id", "text", ACRONYMS, SEED)


def _words(spark, d):
    return instances(spark, d).select(F.explode(T.tokens(F.concat_ws(" ", "title", "category", "data_source"))).alias("word")).distinct()


VOCAB_SQL = f"""vocab AS (SELECT DISTINCT unnest({TOK.format("(title || ' ' || category || ' ' || data_source)")}) AS word FROM inst)"""
TYPO_SQL = f"""{VOCAB_SQL}, wd AS (SELECT id, text, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*'), lambda w: length(w) >= 5 AND NOT list_contains({list(STOP)!r}, lower(w))))) AS ws FROM said), wi AS (SELECT id, i AS w, ws[i] AS word, lower(ws[i]) AS low FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS i FROM wd)),
ps AS (SELECT *, list_transform(list_sort(list_transform(range(1, length(low) - 1), lambda i: {{'h': {_h(repr(SEED), 'CAST(id AS VARCHAR)', 'low', 'CAST(i AS VARCHAR)')}, 'i': i}}))[1:4], lambda s: s.i) AS places FROM wi), ed AS (SELECT id, w, word, low, unnest(range(1, len(e) + 1)) AS k, e FROM (SELECT *, flatten(list_transform(places, lambda i: [substr(low, 1, i) || substr(low, i + 2, 1) || substr(low, i + 1, 1) || substr(low, i + 3), substr(low, 1, i + 1) || substr(low, i + 1)])) AS e FROM ps)),
sf AS (SELECT id, arg_min([word, e[k]], (w, k)) AS c FROM ed WHERE e[k] <> low AND e[k] <> word AND e[k] NOT IN (SELECT word FROM vocab) GROUP BY 1)"""


@query(f"WITH {INST}, said AS ({_SAID}), {TYPO_SQL} SELECT said.id, CASE WHEN c IS NULL THEN text ELSE regexp_replace(text, '\\b' || c[1] || '\\b', c[2]) END AS text, coalesce(c[1] || '->' || c[2], '') AS noise FROM said LEFT JOIN sf USING (id)")
def y8_typos(spark, d):
    """Requests with one misspelled word that is no known one."""
    return scenarios.with_typo(_said(spark, d), "id", "text", _words(spark, d), STOP, SEED)


def _archetypes(spark, d):
    """(key, archetype, text, answerability, group_key, target, grades, noise, fields) of nine archetypes, at most BUDGET each."""
    inst = settle(instances(spark, d))
    grade = lambda id_, g: F.struct(id_.cast("long").alias("id"), F.lit(g).alias("grade"))
    none, nothing = F.array().cast("array<struct<id: bigint, grade: int>>"), F.array().cast("array<string>")

    def made(x, archetype, text, answerable, group, grades, noise=F.lit(""), fields=None):
        rows = x.select(F.concat_ws(":", F.lit(archetype), F.col("id").cast("string")).alias("key"), F.lit(archetype).alias("archetype"), text.alias("text"), F.lit(answerable).alias("answerability"), group.cast("string").alias("group_key"), F.col("id").cast("long").alias("target"), grades.cast("array<struct<id: bigint, grade: int>>").alias("grades"), noise.alias("noise"), (nothing if fields is None else fields).alias("fields"))
        return scenarios.quota(rows, "archetype", "key", SEED, BUDGET)

    family = F.col("family")
    draw = scenarios.draw
    one = F.array(grade(F.col("id"), scenarios.ANSWERABLE))
    out = []
    # one sibling has a pair of fields that the others lack
    sizes = inst.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    siblings = inst.join(sizes.where("n > 1"), "family")
    out.append(made(siblings, "sibling_discriminating", F.concat_ws(" for ", "title", "category"), 2, family, one))
    short = scenarios.with_acronyms(_said(spark, d).join(inst.select("id", "family"), "id"), "id", "text", ACRONYMS, SEED).where("size(noise) > 0")
    out.append(made(short, "acronym", F.col("text"), 2, family, one, F.concat_ws(", ", "noise")))
    wrong = scenarios.with_typo(_said(spark, d).join(inst.select("id", "family"), "id"), "id", "text", _words(spark, d), STOP, SEED).where("noise <> ''")
    out.append(made(wrong, "misspelling", F.col("text"), 2, family, one, F.col("noise")))
    peers = j15_negatives(spark, d).where("turn = 0").join(inst.select(F.col("id").alias("negative"), F.col("fields").alias("theirs")), "negative")
    lacking = inst.join(peers, "id").withColumn("extra", F.array_sort(F.array_except("theirs", "fields"))).where("size(extra) > 0")
    out.append(made(lacking, "negation", F.concat(F.lit("Show "), "title", F.lit(" but not "), F.get("extra", draw(SEED, F.col("id"), 99, F.size("extra")).cast("int"))), 2, family, F.array(grade(F.col("id"), 2), grade(F.col("negative"), 0))))
    rare = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("field")).agg(F.count_distinct("l_partkey").alias("df"), F.min("l_partkey").alias("id")).where("df = 1").join(inst.select("id", "family"), "id")
    rare = rare.groupBy("id", "family").agg(F.min("field").alias("field"))
    out.append(made(rare, "short_query", F.concat(F.lit("order "), F.col("field").cast("string")), 2, family, one))
    both = inst.where("size(fields) > 1")
    out.append(made(both, "multi_intent_single", F.concat(F.lit("Show "), "title", F.lit(" with "), F.col("fields")[0], F.lit(" and also "), F.col("fields")[1]), 2, family, one))
    two = inst.join(peers.select("id", "negative"), "id").join(inst.select(F.col("id").alias("negative"), F.col("title").alias("second")), "negative")
    out.append(made(two, "multi_intent_split", F.concat_ws(" and then ", "title", "second"), 2, family, F.array(grade(F.col("id"), 2), grade(F.col("negative"), 2))))
    word = F.get(F.array(*map(F.lit, scenarios.RESERVED)), draw(SEED, F.col("id"), 7, len(scenarios.RESERVED)).cast("int"))
    out.append(made(inst, "no_answer_reserved", F.concat_ws(" ", word, F.lit("readings of"), "title"), 0, F.concat(F.lit("reserved-"), (F.col("id") % 8).cast("string")), none))
    apart = scenarios.co_absent_pairs(_holdings(spark, d), _DRAWN, SEED).withColumn("id", F.col("turn"))
    out.append(made(apart, "no_answer_impossible_combo", F.concat(F.lit("a report with both part "), F.col("a").cast("string"), F.lit(" and part "), F.col("b").cast("string")), 0, F.concat(F.lit("impossible-"), (F.col("turn") % 8).cast("string")), none, fields=F.array(F.col("a").cast("string"), F.col("b").cast("string"))))
    return scenarios.union_all(out)


def _ids(x):
    from corvane.operators import prefix

    return prefix.numbered(x, [], [F.col("archetype"), F.col("key")], "_n").withColumn("scenario_id", F.concat(F.lit("Q"), F.lpad(F.col("_n").cast("string"), 5, "0"))).drop("_n")


@query()
def y7_y9_dataset(spark, d):
    """The whole dataset: archetypes by quota, ids, whole groups in splits; tests check what each archetype promises."""
    x = settle(_ids(_archetypes(spark, d)))
    splits = groups.stratified_splits(x, "scenario_id", "group_key", "archetype", F.md5(F.encode(F.concat_ws(":", F.lit(SEED + "1"), "group_key"), "UTF-8")), FRACTIONS).select("scenario_id", "split")
    return x.join(splits, "scenario_id").select("scenario_id", "archetype", "text", "answerability", "group_key", "target", "noise", "split")


def write_dataset(spark, d, path):
    """Writes the dataset and returns the checks that failed, counted in the pass that writes: none, or it isn't to be used."""
    x = settle(_ids(_archetypes(spark, d)))
    splits = groups.stratified_splits(x, "scenario_id", "group_key", "archetype", F.md5(F.encode(F.concat_ws(":", F.lit(SEED + "1"), "group_key"), "UTF-8")), FRACTIONS).select("scenario_id", "split")
    holdings = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("field"), F.col("l_orderkey").alias("id"))
    rows, seen = scenarios.checked(x, instances(spark, d).select("id"), _words(spark, d), holdings, settle(splits))
    rows.write.parquet(path)
    return scenarios.faults(seen)
