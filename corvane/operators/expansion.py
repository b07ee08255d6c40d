"""Understanding of requests as tables: rules on spans, concepts merged, requests split, prototypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fire_rules(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Adds suppressed: another rule on the same span (start, end) of the query has a higher priority."""
    return hits.withColumn("suppressed", F.col("priority") < F.max("priority").over(Window.partitionBy(query, "start", "end")))


def merge_concepts(concepts: DataFrame, query: str = "query_id") -> DataFrame:
    """One row per query, kind and canonical without case: highest confidence and requirement, first three distinct evidences by start."""
    first = concepts.groupBy(query, "kind", F.lower("canonical").alias("concept"), "evidence").agg(F.min("start").alias("start"), F.max("confidence").alias("c"), F.max("requirement").alias("r"))
    said = F.sort_array(F.collect_list(F.struct("start", "evidence")))
    x = first.groupBy(query, "kind", "concept").agg(F.max("c").alias("confidence"), F.max("r").alias("requirement"), said.alias("s"))
    return x.select(query, "kind", "concept", "confidence", "requirement", F.array_join(F.slice(F.transform("s", lambda v: v["evidence"]), 1, 3), "; ").alias("evidence"))


def subqueries(text: Column, canonicals: Column | None = None) -> Column:
    """Distinct parts of a request between `;`, `and then`, `versus`, `vs`; a single part is followed by the given canonicals. Null has none."""
    parts = F.split(text, r"(?i)\s*(?:;|\band then\b|\bversus\b|\bvs\.?\b)\s*")
    parts = F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" ,"))), lambda x: x != "")
    if canonicals is not None:
        parts = F.when(F.size(parts) == 1, F.concat(parts, canonicals)).otherwise(parts)
    return F.array_distinct(parts)


def prototypes(instances: DataFrame, family: str = "family", key: str = "id") -> DataFrame:
    """(family, text): one request a family, from its first instance's title and first four fields."""
    x = instances.groupBy(family).agg(F.min_by(F.struct("title", "fields"), key).alias("i"))
    fields = F.array_join(F.slice(F.col("i.fields"), 1, 4), ", ")
    return x.select(family, F.lower(F.concat(F.lit("show "), F.col("i.title"), F.when(fields != "", F.concat(F.lit(" with "), fields)).otherwise(""))).alias("text"))


def plan(requests: DataFrame, key: str, variants: dict[str, Column]) -> DataFrame:
    """(key, variant, text): a request's variants in order, each only where its text isn't empty and differs from all before it."""
    texts = F.array(*[F.coalesce(v, F.lit("")) for v in variants.values()])
    names = F.array(*[F.lit(n) for n in variants])
    x = requests.select(key, texts.alias("_t"))
    x = x.select(key, "_t", F.posexplode("_t").alias("_k", "text"))
    first = F.array_position("_t", F.col("text")) == F.col("_k") + 1
    return x.where(first & (F.col("text") != "")).select(key, F.element_at(names, F.col("_k") + 1).alias("variant"), "text")
