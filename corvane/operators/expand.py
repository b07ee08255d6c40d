"""From a request's text to its concepts and expanded text, in batch: phrases, suppression, short forms, corrected spellings, tiers, merge.

Corrections are made of the distinct unknown words of all requests at once. A request's own lists of tokens and concepts are short, so
what concerns one request alone is column code over its arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import expansion, typos, understanding
from corvane.sources.settled import settle

#: Most corrections of a request, and the share of its tokens of three letters or more; confidences of concepts; strengths of support.
MOST_CORRECTIONS, CORRECTED_SHARE = 2, 0.4
ACRONYM, REPROBED, APPENDED, COVERING = 0.9, 0.8, 0.7, 0.75
STRENGTH = {"literal": 1.0, "morphological": 0.95, "typo": 0.80, "acronym": 0.90}
_CONCEPT = "array<struct<start:int,end:int,canonical:string,kind:string,origin:string,confidence:double,suppresses:array<string>>>"


@dataclass(frozen=True)
class Expanded:
    """requests: (query_id, text, tokens, surfaces, corrected, expanded, suppressed); corrections: (query_id, place, word, correction, distance, confidence, reason);
    concepts: (query_id, start, end, canonical, kind, origin, confidence, tier), before merging; merged: one a kind and name."""

    requests: DataFrame
    corrections: DataFrame
    concepts: DataFrame
    merged: DataFrame


def specializes(specific: Column, generic: Column) -> Column:
    """Whether the words of the second name stand in a row in the first, which has more."""
    a, b = T.phrase(specific), T.phrase(generic)
    return (a != b) & (b != "") & F.contains(F.concat(F.lit(" "), a, F.lit(" ")), F.concat(F.lit(" "), b, F.lit(" ")))


def suppressed(concepts: Column) -> Column:
    """Those of an array of concepts that fall: generic ones inside the span of one that specializes them, and those that a concept names as suppressed."""
    named = F.flatten(F.transform(concepts, lambda c: F.transform(F.coalesce(c.suppresses, F.array().cast("array<string>")), T.fold)))
    inside = lambda g: F.exists(concepts, lambda s: (s.start <= g.start) & (s.end >= g.end) & specializes(s.canonical, g.canonical))
    return F.filter(concepts, lambda c: inside(c) | F.array_contains(named, T.fold(c.canonical)))


def _concepts_of(matches: DataFrame, name: str) -> DataFrame:
    one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "canonical", "kind", "origin", F.col("confidence").cast("double").alias("confidence"), "suppresses")
    return matches.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias(name))


def budget(tokens: Column) -> Column:
    """Corrections that a request may have."""
    n = F.size(F.filter(tokens, lambda t: F.length(t) > 2))
    return F.least(F.lit(MOST_CORRECTIONS), F.greatest(F.lit(1), F.ceil(n * CORRECTED_SHARE)))


def expand(requests: DataFrame, book: DataFrame, vocabulary: DataFrame, most_required: int = understanding.MOST_REQUIRED) -> Expanded:
    """requests: (query_id, text); book: (phrase, words, canonical, kind, origin, confidence, suppresses); vocabulary: (word, df) of the corpus."""
    spans = T.spans(F.col("text"))
    x = requests.select("query_id", "text", spans.alias("_s")).select("query_id", "text", F.transform("_s", lambda s: s.word).alias("tokens"), F.transform("_s", lambda s: s.surface).alias("surfaces"))
    x = settle(x)
    none = F.array().cast(_CONCEPT)
    named = ["query_id", "start", "end", "canonical", "kind", "confidence", "suppresses", F.when(F.col("morphological"), "morphological").otherwise(F.col("origin")).alias("origin")]
    first = understanding.find_phrases(x.select("query_id", F.col("tokens").alias("words")), book).select(*named)
    y = x.join(_concepts_of(first, "found"), "query_id", "left").withColumn("found", F.coalesce("found", none))
    y = y.withColumn("fallen", suppressed(F.col("found"))).withColumn("found", F.array_except("found", "fallen")).withColumn("gone", F.transform("fallen", lambda c: T.fold(c.canonical)))
    y = settle(y)
    # short forms
    each = y.select("query_id", "gone", "tokens", F.posexplode(F.arrays_zip("tokens", "surfaces")).alias("place", "t"))
    short = each.withColumn("m", understanding.short_form(F.col("t.surfaces"), F.col("tokens"))).where(F.col("m").isNotNull() & ~F.array_contains("gone", T.fold(F.col("m.canonical"))))
    nothing = F.array().cast("array<string>").alias("suppresses")
    short = short.select("query_id", F.col("place").alias("start"), (F.col("place") + 1).alias("end"), "m.canonical", "m.kind", F.lit(ACRONYM).alias("confidence"), nothing, F.lit("acronym").alias("origin"))
    # spellings: in order of tokens, until the budget is spent
    words = each.select(F.col("t.tokens").alias("word")).distinct()
    fixes = settle(typos.corrections(words, vocabulary, T.singular).select("word", "correction", "distance", "confidence", "reason"))
    hits = each.select("query_id", "place", F.col("t.tokens").alias("word"), budget(F.col("tokens")).alias("most")).join(fixes, "word")
    spent = F.coalesce(F.sum((F.col("reason") == "typo").cast("int")).over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = settle(hits.withColumn("spent", spent).where("spent < most").drop("most", "spent"))
    per = hits.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "correction"))).alias("fix"), F.collect_list(F.when(F.col("reason") == "typo", F.struct("place", "correction"))).alias("wrong"))
    y = y.join(per, "query_id", "left")
    y = y.withColumn("corrected", F.transform("tokens", lambda t, i: F.coalesce(F.try_element_at("fix", i), t)))
    # phrases that are only there once words are corrected
    again = understanding.find_phrases(y.where("fix is not null").select("query_id", F.col("corrected").alias("words")), book).join(y.select("query_id", "tokens", "corrected", "gone"), "query_id")
    changed = F.exists(F.sequence(F.col("start"), F.col("end") - 1), lambda i: F.get("tokens", i) != F.get("corrected", i))
    again = again.where(changed & ~F.array_contains("gone", T.fold(F.col("canonical"))))
    again = again.select("query_id", "start", "end", "canonical", "kind", F.when(F.col("origin") == "phrase_rule", F.col("confidence")).otherwise(REPROBED).alias("confidence"), "suppresses", F.lit("typo").alias("origin"))
    later = _concepts_of(short.unionByName(again), "later")
    y = y.join(later, "query_id", "left").withColumn("every", F.concat("found", F.coalesce("later", none)))
    y = settle(y.withColumn("drop", suppressed(F.col("every"))).withColumn("kept", F.array_except("every", "drop")).withColumn("suppressed", F.array_sort(F.array_distinct(F.transform(F.concat("fallen", "drop"), lambda c: c.canonical)))))
    concepts = y.select("query_id", F.col("tokens").alias("words"), F.explode("kept").alias("c")).select("query_id", "words", "c.*")
    concepts = understanding.limit_required(understanding.requirement(concepts), most_required).drop("words", "suppresses")
    concepts = settle(concepts)
    evidence = y.select("query_id", "surfaces")
    rank = F.when(F.col("tier") == "REQUIRED", 2).when(F.col("tier") == "PREFERRED", 1).otherwise(0)
    said = concepts.join(evidence, "query_id").withColumn("evidence", F.array_join(F.slice("surfaces", F.col("start") + 1, F.col("end") - F.col("start")), " ")).withColumn("requirement", rank)
    merged = expansion.merge_concepts(said)
    # the text: corrected words in place of wrong ones, then names that it doesn't hold
    base = F.when(F.size(F.array_compact("wrong")) > 0, F.array_join(_replaced(), " ")).otherwise(F.coalesce("text", F.lit("")))
    texts = y.withColumn("base", base).select("query_id", F.col("base").alias("text"))
    full = understanding.expanded_text(texts, concepts.select("query_id", "kind", "canonical", "confidence"), APPENDED).select("query_id", "expanded")
    out = y.select("query_id", "text", "tokens", "surfaces", "corrected", "suppressed").join(full, "query_id")
    return Expanded(out, hits, concepts, merged)


def _replaced() -> Column:
    """Surfaces with misspelled ones replaced."""
    wrong = F.map_from_entries(F.coalesce(F.array_compact("wrong"), F.array().cast("array<struct<place:int,correction:string>>")))
    return F.transform("surfaces", lambda s, i: F.coalesce(F.try_element_at(wrong, i), s))


def support(found: Expanded, known: DataFrame, stop: tuple[str, ...]) -> DataFrame:
    """(query_id, support, terms array<(term, via, strength)>): how each meaningful token of a request is backed; 1 without any.

    In the corpus as it is, by its singular, by a sure correction, by a concept over it (a short form or an expansion), or by nothing. known: (word).
    """
    x = found.requests.select("query_id", F.posexplode("tokens").alias("place", "term")).where(~F.col("term").isin(*stop) if stop else F.lit(True))
    words = known.select("word").distinct()
    x = x.join(words.select(F.col("word").alias("term"), F.lit(True).alias("here")), "term", "left").withColumn("one", T.singular(F.col("term")))
    x = x.join(words.select(F.col("word").alias("one"), F.lit(True).alias("formed")), "one", "left")
    fixed = found.corrections.where((F.col("reason") == "typo") & (F.col("confidence") >= COVERING)).select("query_id", "place", F.lit(True).alias("fixed"))
    over = found.concepts.where(F.col("confidence") >= COVERING).select("query_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("place"), F.struct("confidence", "origin").alias("c")).groupBy("query_id", "place").agg(F.max("c").alias("c"))
    x = x.join(fixed, ["query_id", "place"], "left").join(over, ["query_id", "place"], "left")
    via = F.when(F.col("here"), "literal").when(F.col("formed"), "morphological").when(F.col("fixed"), "typo").when(F.col("c.origin") == "acronym", "acronym").when(F.col("c").isNotNull(), "expansion").otherwise("none")
    x = x.withColumn("via", via)
    strength = F.lit(0.0)
    for name, value in STRENGTH.items():
        strength = F.when(F.col("via") == name, value).otherwise(strength)
    x = x.withColumn("strength", F.when(F.col("via") == "expansion", F.col("c.confidence")).otherwise(strength))
    terms = x.groupBy("query_id").agg(F.round(F.avg("strength"), 6).alias("support"), F.transform(F.sort_array(F.collect_list(F.struct("place", "term", "via", "strength"))), lambda t: F.struct(t.term.alias("term"), t.via.alias("via"), t.strength.alias("strength"))).alias("terms"))
    empty = F.array().cast("array<struct<term:string,via:string,strength:double>>")
    return found.requests.select("query_id").join(terms, "query_id", "left").select("query_id", F.coalesce("support", F.lit(1.0)).alias("support"), F.coalesce("terms", empty).alias("terms"))


#: Words looked for, as parts of a request, in facets that no concept gives.
CURRENT = ("current", "today", "now", "as of today", "active", "present")
HISTORICAL = ("historical", "history", "trend", "over time", "previous", "prior", "last year", "past", "year over year")
DETAIL = ("detail", "list", "line item", "each", "per worker", "individual", "roster", "who", "names")
AGGREGATE = ("total", "count", "summary", "aggregate", "rate", "average", "how many", "headcount", "sum")
NEGATION = ("not", "without", "exclude", "excluding", "except", "no ")
FACETS = ("subject", "measure", "dimension", "population", "data_source", "time_orientation", "granularity", "comparison", "time_freshness", "negation", "report_type", "interface_requirement")


def facets(text: Column, objectives: Column, mandatory: Column, objects: Column, categories: Column, sources: Column, comparison: Column, freshness: Column) -> dict[str, Column]:
    """All FACETS of a request: values joined by ", ", or NONE, UNKNOWN or MULTIPLE where the request doesn't settle one; negation is true or false."""
    low = T.fold(F.coalesce(text, F.lit("")))
    has = lambda terms: low.rlike("|".join(terms))
    values = lambda items: F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, ", ")).otherwise("NONE")
    either = lambda a, b, one, two: F.when(has(a) & has(b), "MULTIPLE").when(has(a), one).when(has(b), two).otherwise("UNKNOWN")
    found = (
        values(objectives), values(mandatory), values(objects), values(categories), values(sources), either(CURRENT, HISTORICAL, "current", "historical"), either(DETAIL, AGGREGATE, "detail", "aggregate"),
        F.coalesce(comparison, F.lit("NONE")), F.coalesce(freshness, F.lit("UNKNOWN")), has(NEGATION), F.lit("UNKNOWN"), F.lit("UNKNOWN"),
    )
    return dict(zip(FACETS, found, strict=True))
