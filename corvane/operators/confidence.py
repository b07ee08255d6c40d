"""How sure a result is: recall risk, support of a request's words, answerability, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

# Thresholds of recall risk.
SHORT_QUERY, LEAST_OVERLAP, MOST_EXCLUSIVE, MANY_FAMILIES, FLAT_ENTROPY, LOW_MARGIN, HEAD = 3, 0.30, 0.50, 25, 0.98, 0.05, 20
MEDIUM_SIGNALS, HIGH_SIGNALS = 1, 3
# Strength of support by the way a word is known.
SUPPORT = {"literal": 1.0, "morphological": 0.95, "typo": 0.80, "acronym": 0.90}
# The logistic score of answerability, and its thresholds.
INTERCEPT, MARGIN_SCALE = -1.60, 0.15
WEIGHTS = {"top_score": 1.70, "margin": 1.60, "field_coverage": 1.30, "agreement": 0.80, "parser": 0.50, "support": 1.10, "breadth": -1.20}
HIGH, INSUFFICIENT, LEAST_SUPPORT, HARD_FLOOR, MOST_BREADTH, LEAST_MARGIN, HIGH_SUPPORT, LEAST_COVERAGE = 0.72, 0.35, 0.50, 0.20, 0.75, 0.06, 0.70, 0.80
# Gates of acceptance on human judgments.
GATES = {"ndcg_10": 0.75, "mrr_10": 0.70, "no_answer_precision": 0.90, "no_answer_recall": 0.80}
MOST_ECE, LEAST_QUERIES, LEAST_AGREEMENT = 0.08, 500, 0.75


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def recall_risk(queries: DataFrame, union: DataFrame, family_of: DataFrame, generators_run: int) -> DataFrame:
    """(query_id, reasons, band) of every query, also of those without any candidate.

    queries: (query_id, n_words, facet_coverage, conflicting, failed); union: from fusion.union.
    """
    w = Window.partitionBy("query_id")
    r = F.col("fused_rank")
    u = union.join(family_of.hint("merge"), "instance_id", "left").withColumn("m", F.sum(F.when((r <= 10) & (F.col("fused") > 0), F.col("fused"))).over(w))
    p = F.when((r <= 10) & (F.col("fused") > 0), F.col("fused") / F.col("m"))
    head = r <= HEAD
    x = u.withColumn("p", p).groupBy("query_id").agg(
        F.sum(F.when(head, F.col("n_sources"))).alias("sources"), F.count_if(head).alias("n_head"), F.count_if(head & (F.col("n_sources") == 1)).alias("alone"),
        F.count_distinct("family").alias("families"), (-F.sum(F.col("p") * F.log("p"))).alias("e"), F.count("p").alias("n_p"),
        F.max(F.when(r == 1, F.col("fused"))).alias("f1"), F.max(F.when(r == 2, F.col("fused"))).alias("f2"),
    )
    x = queries.join(x, "query_id", "left")
    reason = lambda c, name: F.when(F.coalesce(c, F.lit(False)), name)
    signals = [
        reason(F.col("n_words") <= SHORT_QUERY, "very_short_query"), reason(F.col("facet_coverage") < 0.25, "weak_schema_facet_coverage"), reason(F.col("conflicting"), "conflicting_facets"),
        reason(F.col("n_head").isNull(), "empty_union"), reason(F.col("sources") / (F.col("n_head") * generators_run) < LEAST_OVERLAP, "low_generator_overlap"),
        reason(F.col("alone") / F.col("n_head") > MOST_EXCLUSIVE, "high_source_exclusivity"), reason(F.col("families") >= MANY_FAMILIES, "many_candidate_families"),
        reason((F.col("n_p") > 1) & (F.col("e") / F.log("n_p") > FLAT_ENTROPY), "flat_score_distribution"),
        reason((F.col("f1") > 0) & ((F.col("f1") - F.col("f2")) / F.col("f1") < LOW_MARGIN), "low_top_margin"), reason(F.col("n_head").isNotNull() & (F.col("failed") > 0), "generator_failure"),
    ]
    x = x.select("query_id", F.array_compact(F.array(*signals)).alias("reasons"))
    n = F.size("reasons")
    high = (n >= HIGH_SIGNALS) | F.array_contains("reasons", "empty_union")
    return x.withColumn("band", F.when(high, "HIGH").when(n >= MEDIUM_SIGNALS, "MEDIUM").otherwise("LOW"))


def support(queries: DataFrame, known: DataFrame, query: str, words: Column) -> DataFrame:
    """(query, support, unsupported): mean strength of a request's words in the corpus' words, 1 without words.

    known: (word). A word counts in full where it stands in the corpus, at 0.95 by its singular, else not at all.
    """
    x = queries.select(query, F.posexplode_outer(words).alias("pos", "word"))
    x = x.withColumn("one", T.singular(F.col("word")))
    known = known.select(F.col("word").alias("k")).distinct()
    x = x.join(known, F.col("word") == F.col("k"), "left").withColumn("literal", F.col("k").isNotNull()).drop("k")
    x = x.join(known, F.col("one") == F.col("k"), "left").withColumn("morph", F.col("k").isNotNull()).drop("k")
    s = F.when(F.col("literal"), SUPPORT["literal"]).when(F.col("morph"), SUPPORT["morphological"]).otherwise(0.0)
    missing = F.sort_array(F.collect_list(F.when(F.col("word").isNotNull() & ~F.col("literal") & ~F.col("morph"), F.struct("pos", "word"))))
    x = x.groupBy(query).agg(F.avg(F.when(F.col("word").isNotNull(), s)).alias("s"), missing.alias("m"))
    return x.select(query, F.round(F.coalesce("s", F.lit(1.0)), 6).alias("support"), F.transform("m", lambda v: v["word"]).alias("unsupported"))


def answerability(top_score: Column, margin: Column, field_coverage: Column, agreement: Column, parser: Column, support: Column, n_terms: Column, breadth: Column, unknown_fields: Column, required: Column, unmet: Column, combination_exists: Column) -> tuple[Column, Column]:
    """(outcome, score): five gates in order, then a logistic score. The last four: numbers of fields, and whether one instance has them all."""
    parts = {"top_score": clamp(top_score), "margin": F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin) / MARGIN_SCALE), "field_coverage": clamp(field_coverage), "agreement": clamp(agreement), "parser": clamp(parser), "support": clamp(support), "breadth": clamp(breadth)}
    z = F.lit(INTERCEPT)
    for name, value in parts.items():
        z = z + WEIGHTS[name] * value
    score = 1.0 / (1.0 + F.exp(-z))
    none = (unknown_fields > 0) | ((required > 0) & ~combination_exists) | ((support <= HARD_FLOOR) & (n_terms > 0)) | ((support < LEAST_SUPPORT) & (top_score < 0.30))
    all_unmet, some_unmet = (unmet > 0) & (unmet == required), unmet > 0
    sure = (score >= HIGH) & (margin >= LEAST_MARGIN) & (breadth <= MOST_BREADTH) & (support >= HIGH_SUPPORT) & (field_coverage >= LEAST_COVERAGE)
    weak = (score < INSUFFICIENT) & (support < LEAST_SUPPORT)
    outcome = F.when(none | all_unmet, "NO_SATISFACTORY_REPORT").when(some_unmet, "NEEDS_CLARIFICATION").when(sure, "ANSWERABLE").when(weak, "NO_SATISFACTORY_REPORT").otherwise("NEEDS_CLARIFICATION")
    return outcome, F.when(none | all_unmet, 0.0).when(some_unmet, 0.5).otherwise(score)


def acceptance_reasons() -> Column:
    """What blocks acceptance, of a row of n_queries, agreement, ece and the metrics of GATES; a missing metric blocks, ties pass."""
    reasons = [F.when(F.col("n_queries") < LEAST_QUERIES, "queries"), F.when(F.coalesce("agreement", F.lit(0.0)) < LEAST_AGREEMENT, "agreement")]
    reasons += [F.when(F.col(name).isNull() | (F.col(name) < least), name) for name, least in GATES.items()]
    return F.array_compact(F.array(*reasons, F.when(F.col("ece").isNull() | (F.col("ece") > MOST_ECE), "ece")))
