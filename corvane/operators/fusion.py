"""From generators' hits to families: source-preserving union, shortlist, fusion, grouping and decisions.

Hits have (query_id, generator, variant, instance_id, score). Ties go to smaller ids throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

RRF_K = 60
#: Floors of the shortlist by exclusive source, in order of precedence.
QUOTAS = (("bm25f", 15), ("splade", 15), ("dense", 10), ("Q5", 10))
DEPTH, HIGH_DEPTH = 120, 200


def rank_hits(hits: DataFrame, depth: int) -> DataFrame:
    """Rank within (query, generator, variant), at most depth."""
    w = Window.partitionBy("query_id", "generator", "variant").orderBy(F.col("score").desc(), "instance_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def merge_variants(ranked: DataFrame) -> DataFrame:
    """(query_id, generator, instance_id, best_rank, score, variant, rank): best rank over variants, the first variant wins ties, then anew in order.

    Ranked hits are few a query; they are placed by query, so that union, ranks and shortlist exchange nothing more.
    """
    best = ranked.repartition("query_id").groupBy("query_id", "generator", "instance_id").agg(F.min(F.struct("rank", "variant", "score")).alias("m")).select("query_id", "generator", "instance_id", F.col("m.rank").alias("best_rank"), "m.score", "m.variant")
    w = Window.partitionBy("query_id", "generator").orderBy("best_rank", F.col("score").desc(), "instance_id")
    return best.withColumn("rank", F.row_number().over(w))


def union(merged: DataFrame, generators: Sequence[str]) -> DataFrame:
    """One row per (query, instance): each generator's rank, score and variant, null where it missed; fused score and ranks."""
    one = lambda g, c: F.max(F.when(F.col("generator") == g, F.col(c))).alias(f"{g}_{c}")
    x = merged.groupBy("query_id", "instance_id").agg(*[one(g, c) for g in generators for c in ("rank", "score", "variant")])
    fused: Column = F.lit(0.0)
    for g in generators:
        fused = fused + F.coalesce(1.0 / (RRF_K + F.col(f"{g}_rank")), F.lit(0.0))
    x = x.withColumn("fused", F.round(fused, 9)).withColumn("best_rank", F.array_min(F.array(*[F.col(f"{g}_rank") for g in generators])))
    x = x.withColumn("n_sources", sum((F.col(f"{g}_rank").isNotNull().cast("int") for g in generators), F.lit(0)))
    w = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "best_rank", "instance_id")
    return x.withColumn("fused_rank", F.row_number().over(w))


def quota_of(generators: Sequence[str], quotas: Sequence[tuple[str, int]] = QUOTAS) -> Column:
    """The first quota a record falls under: found by one generator only, or through Q5 only."""
    only_q5 = F.lit(True)
    for g in generators:
        only_q5 = only_q5 & (F.col(f"{g}_variant").isNull() | (F.col(f"{g}_variant") == "Q5"))
    out = None
    for name, _ in quotas:
        fits = only_q5 if name not in generators else (F.col("n_sources") == 1) & F.col(f"{name}_rank").isNotNull()
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def shortlist(records: DataFrame, generators: Sequence[str], high: bool | Column = False, quotas: Sequence[tuple[str, int]] = QUOTAS) -> DataFrame:
    """(…, admitted_via, position): floors by quota first, the rest from the fused order, up to the depth.

    High risk, of all requests or as a column of each record's, widens floors by one half, rounded half to even, and the depth.
    """
    wide = F.lit(high) if isinstance(high, bool) else F.coalesce(high, F.lit(False))
    x = records.withColumn("quota", quota_of(generators, quotas)).withColumn("wide", wide)
    w = Window.partitionBy("query_id", "quota").orderBy("fused_rank")
    allowed = F.lit(0)
    for name, n in quotas:
        allowed = F.when(F.col("quota") == name, F.when(F.col("wide"), round(n * 1.5)).otherwise(n)).otherwise(allowed)
    x = x.withColumn("floor", F.col("quota").isNotNull() & (F.row_number().over(w) <= allowed))
    order = Window.partitionBy("query_id").orderBy(F.col("floor").desc(), "fused_rank")
    x = x.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= F.when(F.col("wide"), HIGH_DEPTH).otherwise(DEPTH))
    place = Window.partitionBy("query_id").orderBy("fused_rank")
    return x.withColumn("admitted_via", F.when(F.col("floor"), F.col("quota")).otherwise("fused")).withColumn("position", F.row_number().over(place)).drop("turn", "floor", "quota", "wide")


def families(scored: DataFrame, family_of: DataFrame) -> DataFrame:
    """(query_id, family, score, members, selected, family_rank): best member's score, selected by (rank, id).

    scored: (query_id, instance_id, final_score, final_rank); family_of: (instance_id, family), as long as the catalog and therefore
    never sent whole to all tasks: a file of few megabytes may hold millions of names.
    """
    x = scored.join(family_of.hint("merge"), "instance_id").groupBy("query_id", "family").agg(
        F.max("final_score").alias("score"), F.count(F.lit(1)).alias("members"), F.min(F.struct("final_rank", "instance_id")).alias("s")
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("s"))
    return x.select("query_id", "family", "score", "members", F.col("s.instance_id").alias("selected"), F.row_number().over(w).alias("family_rank"))


#: Generators in order, and the names of the features of a candidate.
GENERATOR_ORDER = ("bm25f", "splade", "dense_identity", "dense_purpose", "dense_schema", "dense_interface", "prototype", "late_interaction")
FEATURES = (
    *(f"{g}_{x}" for g in GENERATOR_ORDER for x in ("reciprocal_rank", "score", "present")), "cross_encoder_score", "cross_encoder_reciprocal_rank", "cross_encoder_present", "fused_reciprocal_rank", "generator_count", "query_variant_count",
    "source_exclusive", "exact_title_overlap", "alias_overlap", "field_overlap", "prompt_overlap", "query_length", "query_specificity", "metadata_completeness", "lifecycle_unknown", "family_instance_count",
)


def features(candidates: DataFrame, requests: DataFrame, instances: DataFrame, generators: dict[str, str]) -> DataFrame:
    """(query_id, instance_id, all of FEATURES) of each candidate.

    candidates: a shortlist of a union with ce_score and ce_rank; generators maps names of its columns to those of GENERATOR_ORDER, all others are absent.
    requests: (query_id, text, stated_facets); instances: (instance_id, title, aliases, fields, prompts as texts, filled out of six descriptive values, unknown lifecycle, family_size).
    """
    x = candidates.join(requests.select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("_q"), "stated_facets"), "query_id").join(instances, "instance_id")
    by = {name: column for column, name in generators.items()}
    values: dict[str, Column] = {}
    variants = []
    for g in GENERATOR_ORDER:
        c = by.get(g)
        rank = F.col(f"{c}_rank") if c else F.lit(None).cast("int")
        values |= {f"{g}_reciprocal_rank": 1.0 / rank, f"{g}_score": F.col(f"{c}_score") if c else F.lit(0.0), f"{g}_present": rank.isNotNull()}
        variants += [F.col(f"{c}_variant")] if c else []
    overlap = lambda c: T.overlap(F.col("_q"), T.tokens(F.col(c)))
    values |= {
        "cross_encoder_score": F.col("ce_score"), "cross_encoder_reciprocal_rank": F.when(F.col("ce_score").isNotNull(), 1.0 / F.col("ce_rank")), "cross_encoder_present": F.col("ce_score").isNotNull(), "fused_reciprocal_rank": 1.0 / F.col("fused_rank"),
        "generator_count": F.col("n_sources"), "query_variant_count": F.size(F.array_distinct(F.array_compact(F.array(*variants)))), "source_exclusive": F.col("n_sources") == 1, "exact_title_overlap": overlap("title"), "alias_overlap": overlap("aliases"),
        "field_overlap": overlap("fields"), "prompt_overlap": overlap("prompts"), "query_length": F.size("_q"), "query_specificity": F.col("stated_facets"), "metadata_completeness": F.col("filled") / 6, "lifecycle_unknown": F.col("unknown"), "family_instance_count": F.col("family_size"),
    }
    return x.select("query_id", "instance_id", *[F.round(F.coalesce(values[n].cast("double"), F.lit(0.0)), 6).alias(n) for n in FEATURES])
