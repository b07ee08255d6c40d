"""What to answer: gates on catalog facts, thresholds on joint scores, a question where leading families differ, and replays of recorded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE, ASK, RETURN = "NO_CONFIDENT_MATCH", "ASK_CLARIFICATION", "RETURN_RESULTS"
#: Reasons of the gates; a reason that starts with one was not a threshold's.
GATES = ("no authorized candidates matched the request", "requested field(s) do not exist in the catalog", "no single report carries all requested fields")
#: The facets to ask about, in order, and the two thresholds.
FACETS = ("data_source", "category", "report_type")
WEAK_LOGIT, CLEAR_MARGIN = -9.0, 1.0
NO_RANK = 10**6


def hard_gates(requests: DataFrame, wanted: DataFrame, postings: DataFrame, families: DataFrame) -> DataFrame:
    """(query_id, reason): the gate that closes a request, null where none does.

    requests: (query_id); wanted: (query_id, field); postings: (field, instance_id); families: (query_id, …).
    Unknown fields are named in order, five at most. The combination is a relational division of distinct sets of fields:
    requests that want the same fields, and instances that have the same, are met once, however many they are.
    """
    wanted, postings = wanted.select("query_id", "field").distinct(), postings.select("field", "instance_id").distinct()
    known = postings.select("field").distinct()
    fields = lambda x, key, name: x.groupBy(key).agg(F.sort_array(F.collect_list("field")).alias(name))
    asked, had = fields(wanted, "query_id", "asked"), fields(postings.join(wanted.select("field").distinct(), "field", "left_semi"), "instance_id", "had")
    each = lambda x, name: x.select(name).distinct().withColumn("field", F.explode(name))
    most = each(asked, "asked").join(each(had, "had"), "field").groupBy("asked", "had").agg(F.count(F.lit(1)).alias("met")).groupBy("asked").agg(F.max("met").alias("most"))
    unknown = wanted.join(known, "field", "left_anti").groupBy("query_id").agg(F.array_join(F.slice(F.sort_array(F.collect_list("field")), 1, 5), ", ").alias("unknown"))
    need = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    met = asked.join(most, "asked").select("query_id", "most")
    some = families.select("query_id").distinct().withColumn("some", F.lit(True))
    x = requests.join(some, "query_id", "left").join(unknown, "query_id", "left").join(need, "query_id", "left").join(met, "query_id", "left")
    reason = F.when(F.col("some").isNull(), GATES[0]).when(F.col("unknown").isNotNull(), F.concat(F.lit(GATES[1] + ": "), F.col("unknown"))).when(F.coalesce("most", F.lit(0)) < F.col("need"), GATES[2])
    return x.select("query_id", reason.alias("reason"))


def gated(reasons: Column) -> Column:
    """Whether any reason is a gate's."""
    return F.exists(reasons, lambda r: F.coalesce(r.startswith(GATES[0]) | r.startswith(GATES[1]) | r.startswith(GATES[2]), F.lit(False)))


def clarification(leading: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, facet, options): the first facet on which the leading families differ, its values in order of rank.

    leading: (query_id, family_rank, data_source, category, report_type), at most five a query; empty values don't count.
    """
    def values(facet: str) -> Column:
        inorder = F.transform(F.sort_array(F.collect_list(F.struct("family_rank", F.coalesce(facet, F.lit("")).alias("v")))), lambda s: s["v"])
        return F.array_distinct(F.filter(inorder, lambda v: v != "")).alias(facet)

    x = leading.groupBy("query_id").agg(*[values(f) for f in FACETS])
    pick = lambda of: F.coalesce(*[F.when(F.size(f) >= 2, of(f)) for f in FACETS])
    return x.select("query_id", pick(F.lit).alias("facet"), pick(lambda f: F.slice(f, 1, most)).alias("options"))


def replay(weak: Column | float = WEAK_LOGIT, clear: Column | float = CLEAR_MARGIN) -> Column:
    """The decision from a run's recorded numbers: ce_top, ce_second, fusion_top, fusion_second, risk_band, has_facet, has_families, gate.

    The margin is of joint scores, else relative to the best fused score, else without bound.
    """
    weak, clear = (F.lit(v) if isinstance(v, float) else v for v in (weak, clear))
    margin = (
        F.when(F.col("ce_top").isNotNull() & F.col("ce_second").isNotNull(), F.col("ce_top") - F.col("ce_second"))
        .when((F.coalesce("fusion_second", F.lit(0.0)) != 0) & (F.col("fusion_top") > 0), (F.col("fusion_top") - F.col("fusion_second")) / F.col("fusion_top"))
        .otherwise(float("inf"))
    )
    return (
        F.when(F.col("gate").isNotNull(), F.lit(NONE)).when(~F.col("has_families"), NONE).when(F.col("ce_top") < weak, NONE)
        .when((F.col("risk_band") == "HIGH") & (margin < clear) & F.col("has_facet"), ASK).otherwise(RETURN)
    )


def sweep(passes: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """(weak, clear, macro_recall): mean over expected decisions of the share decided so, for each pair of thresholds.

    The grid is a column of few values on each pass; passes are aggregated in one go.
    """
    pairs = F.array(*[F.struct(F.lit(w).alias("weak"), F.lit(c).alias("clear")) for w, c in grid])
    x = passes.withColumn("g", F.explode(pairs)).select("*", "g.weak", "g.clear").withColumn("got", replay(F.col("weak"), F.col("clear")))
    by = x.groupBy("weak", "clear", "expected").agg(F.avg((F.col("got") == F.col("expected")).cast("int")).alias("recall"))
    return by.groupBy("weak", "clear").agg(F.round(F.avg("recall"), 6).alias("macro_recall"))


def shown(families: DataFrame, decisions: DataFrame, top_k: int) -> DataFrame:
    """The best families of requests that are answered or asked about; none where nothing matched."""
    kept = decisions.where(F.col("decision") != NONE).select("query_id", "decision")
    return families.where(F.col("family_rank") <= top_k).join(kept, "query_id")


def score_instances(shortlist: DataFrame, fused: DataFrame) -> DataFrame:
    """shortlist (query_id, instance_id) with final_score and final_rank; what the fuser didn't see scores zero and ranks last. place orders them."""
    x = shortlist.join(fused, ["query_id", "instance_id"], "left").withColumn("final_score", F.coalesce("final_score", F.lit(0.0))).withColumn("final_rank", F.coalesce(F.col("final_rank").cast("long"), F.lit(NO_RANK).cast("long")))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("final_rank", "instance_id")))


def expanded(instances: DataFrame, generators: tuple[str, ...]) -> DataFrame:
    """Records of instances that came through their family: every generator null (it never voted), fused zero, ranked last."""
    null = [F.lit(None).cast(t).alias(f"{g}_{c}") for g in generators for c, t in (("rank", "int"), ("score", "double"), ("variant", "string"))]
    return instances.select("query_id", "instance_id", *null, F.lit(0.0).alias("fused"), F.lit(NO_RANK).cast("long").alias("fused_rank"), F.lit(True).alias("expanded"))


def aggregation_telemetry(families: DataFrame) -> DataFrame:
    """Counts a query: families, instances, families of several instances, selections found by one source, selections by expansion."""
    return families.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("family_count"), F.sum("members").alias("instances_considered"), F.count_if(F.col("members") > 1).alias("multi_instance_families"),
        F.count_if(F.col("n_sources") == 1).alias("source_exclusive_selected"), F.count_if("expanded").alias("expanded_selected"),
    )


def sources_of(merged: DataFrame) -> DataFrame:
    """(query_id, instance_id, generators): who found it, by name."""
    return merged.groupBy("query_id", "instance_id").agg(F.sort_array(F.collect_set("generator")).alias("generators"))


def hit_listing(merged: DataFrame) -> DataFrame:
    """(query_id, generator, ids): a generator's hits, in order of rank, as many as its depth."""
    return merged.groupBy("query_id", "generator").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "instance_id"))), lambda s: s["instance_id"]).alias("ids"))


#: Names of the features of a decision, in order.
FEATURES = (
    "top_family_score", "score_margin_top_two", "cross_encoder_top", "cross_encoder_margin", "cross_encoder_mean_top5", "score_entropy_top10", "family_count", "candidate_count", "authorized_candidate_count_log", "generator_agreement_top",
    "source_exclusive_ratio_top", "risk_low", "risk_medium", "risk_high", "risk_reason_count", "query_token_count", "stated_facet_count", "query_variant_count", "distinguishing_facet_present", "top_family_instance_count",
)


def features(requests: DataFrame, families: DataFrame, members: DataFrame, union: DataFrame, risk: DataFrame, facets: DataFrame, authorized: int, generators_run: int) -> DataFrame:
    """(query_id, all of FEATURES) of each request from what a search has in hand; a request without families has zeros.

    requests: (query_id, tokens, stated_facets, variants); families: (query_id, family, family_rank, score, ce_score of the selected); members: (query_id, family, instance_id); facets: (query_id) where leading families differ.
    """
    ordered = F.sort_array(F.collect_list(F.struct("family_rank", F.col("score").cast("double").alias("score"), F.col("ce_score").cast("double").alias("ce"))))
    f = families.groupBy("query_id").agg(ordered.alias("f"), F.max(F.when(F.col("family_rank") == 1, F.col("family"))).alias("family"))
    scores = F.transform("f", lambda x: x["score"])
    joint = F.filter(F.transform("f", lambda x: x["ce"]), lambda c: c.isNotNull())
    head = F.slice(F.filter(scores, lambda s: s > 0), 1, 10)
    total = F.aggregate(head, F.lit(0.0), lambda a, s: a + s)
    spread = -F.aggregate(head, F.lit(0.0), lambda a, s: a + s / total * F.log(s / total)) / F.log(F.size(head))
    five = F.slice(joint, 1, 5)
    size = members.groupBy("query_id", "family").agg(F.count(F.lit(1)).alias("instances"))
    top = F.col("fused_rank") <= 20
    u = union.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), (F.sum(F.when(top, F.col("n_sources"))) / (F.count_if(top) * generators_run)).alias("agreement"), (F.count_if(top & (F.col("n_sources") == 1)) / F.count_if(top)).alias("alone"))
    x = requests.join(f, "query_id").join(size, ["query_id", "family"], "left").join(u, "query_id", "left").join(risk, "query_id", "left").join(facets.select("query_id", F.lit(1.0).alias("differ")).distinct(), "query_id", "left")
    values = {
        "top_family_score": F.get(scores, F.lit(0)), "score_margin_top_two": F.coalesce(F.get(scores, F.lit(0)) - F.get(scores, F.lit(1)), F.lit(1.0)), "cross_encoder_top": F.get(joint, F.lit(0)), "cross_encoder_margin": F.get(joint, F.lit(0)) - F.get(joint, F.lit(1)),
        "cross_encoder_mean_top5": F.when(F.size(five) > 0, F.aggregate(five, F.lit(0.0), lambda a, s: a + s) / F.size(five)), "score_entropy_top10": F.when(F.size(head) > 1, spread), "family_count": F.size("f"), "candidate_count": F.col("candidates"),
        "authorized_candidate_count_log": F.log1p(F.lit(float(authorized))), "generator_agreement_top": F.col("agreement"), "source_exclusive_ratio_top": F.col("alone"), **{f"risk_{b.lower()}": F.col("band") == b for b in ("LOW", "MEDIUM", "HIGH")},
        "risk_reason_count": F.size("reasons"), "query_token_count": F.col("tokens"), "stated_facet_count": F.col("stated_facets"), "query_variant_count": F.col("variants"), "distinguishing_facet_present": F.col("differ"), "top_family_instance_count": F.col("instances"),
    }
    x = x.select("query_id", *[F.round(F.coalesce(values[n].cast("double"), F.lit(0.0)), 6).alias(n) for n in FEATURES])
    none = requests.select("query_id").join(families.select("query_id").distinct(), "query_id", "left_anti")
    return x.unionByName(none.select("query_id", *[F.lit(0.0).alias(n) for n in FEATURES]))
