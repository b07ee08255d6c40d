"""Operators of requests, decisions and judgments on small tables: edge cases that the tables don't hold."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import decisions as D
from corvane.operators import judgments as J
from corvane.operators import search
from corvane.operators import understanding as U


def test_phrases_nest_and_take_plural_forms(spark):
    r = spark.createDataFrame([(1, ["show", "red", "rings", "of", "red"]), (2, []), (3, None)], "query_id long, words array<string>")
    p = spark.createDataFrame([("red", ["red"]), ("red ring", ["red", "ring"]), ("none", []), ("of red ring", ["of", "red", "ring"])], "phrase string, words array<string>")
    got = {(x.query_id, x.start, x.end, x.phrase, x.morphological) for x in U.find_phrases(r, p).collect()}
    assert got == {(1, 1, 2, "red", False), (1, 4, 5, "red", False), (1, 1, 3, "red ring", True)}


def mention(text, start, end, kind="field", origin="phrase_rule", confidence=0.9):
    return (text.split(), start, end, kind, origin, confidence)


@pytest.mark.parametrize(
    ("row", "tier"),
    [
        (mention("reports including pay", 2, 3), "REQUIRED"),
        (mention("reports must have pay", 3, 4), "REQUIRED"),
        (mention("reports including pay", 2, 3, confidence=0.85), "MENTIONED"),
        (mention("reports including pay maybe", 2, 3), "MENTIONED"),
        (mention("reports including teams but pay", 4, 5), "MENTIONED"),
        (mention("pay but maybe later", 0, 1, origin="literal", confidence=1.0), "REQUIRED"),
        (mention("heads by team", 2, 3, kind="topic"), "PREFERRED"),
        (mention("heads showing team", 2, 3, kind="topic"), "REQUIRED"),
        (mention("heads showing team", 2, 3, kind="topic", origin="typo"), "PREFERRED"),
        (mention("pay", 0, 1), "MENTIONED"),
    ],
)
def test_tiers(spark, row, tier):
    x = spark.createDataFrame([row], "words array<string>, start int, end int, kind string, origin string, confidence double")
    assert U.requirement(x).first().tier == tier


def test_required_mentions_are_limited_by_confidence_then_place(spark):
    x = spark.createDataFrame([(1, "REQUIRED", c, s, n) for c, s, n in [(1.0, 0, "a"), (0.9, 1, "b"), (0.9, 2, "c"), (1.0, 3, "d"), (0.9, 3, "e")]], "query_id long, tier string, confidence double, start int, canonical string")
    assert {r.canonical for r in U.limit_required(x, 3).collect() if r.tier == "REQUIRED"} == {"a", "b", "d"}


def test_reserved_short_forms(spark):
    rows = [("HC", []), ("hc", []), ("loa", []), ("LOA", []), ("TA", ["talent"]), ("ta", ["leave"]), ("ta", []), ("TA", []), (None, [])]
    x = spark.createDataFrame(rows, "s string, c array<string>").select(U.short_form(F.col("s"), F.col("c"))["canonical"].alias("v"))
    assert [r.v for r in x.collect()] == ["Headcount", "Headcount", None, "Leave of Absence", "Recruiter", "Time Away", None, "Time Away", None]


def test_lexicon_faults(spark):
    schema = "id string, kind string, phrase string, canonical string, priority int, suppresses array<string>"
    good = spark.createDataFrame([("r1", "field", "pay", "Pay", 1, ["Base"]), ("r2", "topic", "base", "Base", 1, [])], schema)
    assert U.lexicon_faults(good, ("field", "topic")) == []
    bad = spark.createDataFrame([("r1", "odd", "pay", "Pay", 1, ["base"]), ("r2", "topic", "base", "Base", 1, ["Pay"]), ("r3", "topic", "Pay", "X", 1, [])], schema)
    faults = U.lexicon_faults(bad, ("field", "topic"))
    assert len(faults) == 3 and "cycle" in faults[2]


def test_gates_and_their_reasons(spark):
    q = spark.range(5).withColumnRenamed("id", "query_id")
    want = spark.createDataFrame([(1, "a"), (1, "z"), (2, "a"), (2, "b"), (3, "a"), (3, "a")], "query_id long, field string")
    post = spark.createDataFrame([("a", 7), ("b", 8), ("a", 7)], "field string, instance_id long")
    fam = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    got = {r.query_id: r.reason for r in D.hard_gates(q, want, post, fam).collect()}
    assert got == {0: D.GATES[0], 1: D.GATES[1] + ": z", 2: D.GATES[2], 3: None, 4: None}
    assert spark.createDataFrame([([D.GATES[1] + ": z"],), (["margin"],), ([],)], "r array<string>").select(D.gated(F.col("r")).alias("g")).collect() == [(True,), (False,), (False,)]


def test_replay_margins(spark):
    schema = "ce_top double, ce_second double, fusion_top double, fusion_second double, risk_band string, has_facet boolean, has_families boolean, gate string"
    rows = [(1.0, 0.5, 9.0, 1.0, "HIGH", True, True, None), (1.0, None, 9.0, 8.0, "HIGH", True, True, None), (1.0, None, 9.0, None, "HIGH", True, True, None), (1.0, 0.5, 9.0, 1.0, "HIGH", False, True, None), (-9.5, None, 9.0, None, "LOW", True, True, None), (1.0, 0.0, 1.0, 0.0, "LOW", True, True, "gate"), (None, None, None, None, "HIGH", False, False, None)]
    got = [r.d for r in spark.createDataFrame(rows, schema).select(D.replay().alias("d")).collect()]
    assert got == [D.ASK, D.ASK, D.RETURN, D.RETURN, D.NONE, D.NONE, D.NONE]


def test_guards_of_splits(spark):
    splits = spark.createDataFrame([(1, "train"), (2, "test")], "scenario_id long, split string")
    ids = spark.createDataFrame([(1,), (2,)], "scenario_id long")
    assert J.guard(ids, splits, "final_evaluation").count() == 2
    with pytest.raises(J.Leak, match="sealed"):
        J.guard(ids, splits, "calibration")
    with pytest.raises(ValueError, match="unknown operation"):
        J.guard(ids, splits, "calibratoin")
    with pytest.raises(J.Leak, match="overlap"):
        J.guard(ids, splits.union(spark.createDataFrame([(1, "test")], splits.schema)), "final_evaluation")


def test_human_judgments_keep_the_contract(spark):
    schema = "relevance int, annotator_id string, source string"
    good = spark.createDataFrame([(2, "a", "production_query")], schema)
    assert J.accept_judgments(good) is good
    for row, what in (((3, "a", "production_query"), "grade"), ((None, "a", "production_query"), "grade"), ((0, " ", "production_query"), "annotator"), ((0, "a", None), "source")):
        with pytest.raises(ValueError, match=what):
            J.accept_judgments(spark.createDataFrame([row], schema))
    with pytest.raises(ValueError, match="no human"):
        J.accept_judgments(good.where("relevance > 5"))


def test_search_contains_failures_and_suppresses_weak_results(spark):
    requests = spark.createDataFrame([(1, 9, 1.0, False), (2, 9, 1.0, False), (3, 9, 1.0, False)], "query_id long, n_words int, facet_coverage double, conflicting boolean")
    instances = spark.createDataFrame([(7, "f", "s", "c", ""), (8, "g", "t", "c", "")], "instance_id long, family string, data_source string, category string, report_type string")
    hits = spark.createDataFrame([(1, "Q0", 7, 2.0), (1, "Q0", 8, 1.0), (1, "Q0", 99, 5.0), (2, "Q0", 8, 1.0)], "query_id long, variant string, instance_id long, score double")
    joint = lambda pairs: pairs.withColumn("ce_score", F.when(F.col("query_id") == 1, F.col("instance_id") / 10.0).otherwise(-20.0))
    found = search.search(requests, {"bm25f": lambda r: hits, "dense": lambda r: r.select(F.col("nothing")), "splade": None}, instances, joint)
    status = {r.generator: r for r in found.status.collect()}
    assert {(r.generator, r.state, r.hits) for r in status.values()} == {("bm25f", "ok", 3), ("dense", "error", 0), ("splade", "not_run", 0)} and "nothing" in status["dense"].message
    rows = {(r.query_id, r.decision, r.family_rank, r.family, r.instance_id) for r in found.results.collect()}
    assert rows == {(1, D.ASK, 1, "g", 8), (1, D.ASK, 2, "f", 7), (2, D.NONE, None, None, None), (3, D.NONE, None, None, None)}
    with pytest.raises(ValueError, match="no generator"):
        search.search(requests, {"dense": None}, instances, joint)


def _batch(spark, n=300):
    """Request 1 is risky (five words, conflicting, many families), request 2 isn't: both have n hits of one generator and the same of another."""
    requests = spark.createDataFrame([(1, 2, 0.0, True), (2, 9, 1.0, False)], "query_id long, n_words int, facet_coverage double, conflicting boolean")
    instances = spark.range(n + 50).select(F.col("id").alias("instance_id"), F.concat(F.lit("f"), (F.col("id") % 10).cast("string")).alias("family"), F.lit("s").alias("data_source"), F.lit("c").alias("category"), F.lit("").alias("report_type"))
    hits = spark.range(n).crossJoin(requests.select("query_id")).select("query_id", F.lit("Q0").alias("variant"), F.col("id").alias("instance_id"), (1000.0 - F.col("id") * F.col("id") / 400).alias("score"))
    joint = lambda pairs: pairs.withColumn("ce_score", F.col("instance_id") / 10.0)
    return requests, instances, hits, joint


def test_each_request_has_its_own_depth(spark):
    requests, instances, hits, joint = _batch(spark)
    found = search.search(requests, {"bm25f": lambda r: hits, "dense": lambda r: hits}, instances, joint, search.Settings(depth=300))
    bands = {r.query_id: r.band for r in found.risk.collect()}
    taken = {r.query_id: r["count"] for r in found.shortlist.groupBy("query_id").count().collect()}
    assert bands[1] == "HIGH" and bands[2] != "HIGH" and taken == {1: 200, 2: 120}


def test_siblings_may_be_selected_but_move_no_family(spark):
    requests, instances, hits, joint = _batch(spark)
    found = search.search(requests, {"bm25f": lambda r: hits, "dense": lambda r: hits}, instances, joint, search.Settings(depth=300, most_expanded=7))
    new = [r.instance_id for r in found.members.where("expanded and query_id = 2").collect()]
    assert len(new) == 7 and min(new) >= 120
    first = [r.family for r in found.families.where("query_id = 2").orderBy("family_rank").collect()]
    # the best scored instance of the shortlist leads, whatever its siblings score
    assert first == [f"f{k}" for k in (9, 8, 7, 6, 5, 4, 3, 2, 1, 0)]
    by = {r.family: r for r in found.families.where("query_id = 2").collect()}
    assert by["f9"].by_expansion and by["f9"].ce_score > 11.9 and not by["f0"].by_expansion


def test_gates_close_requests_for_what_is_not_there(spark):
    requests, instances, hits, joint = _batch(spark)
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "zz")], "query_id long, field string")
    postings = spark.createDataFrame([("a", 1), ("b", 2), ("b", 10_000), ("a", 10_000), ("zz", 20_000)], "field string, instance_id long")
    found = search.search(requests, {"bm25f": lambda r: hits}, instances, joint, wanted=wanted, postings=postings)
    # what only forbidden instances have isn't there
    assert {r.query_id: r.reason for r in found.gates.collect()} == {1: D.GATES[2], 2: D.GATES[1] + ": zz"}
    assert {(r.decision, r.family) for r in found.results.collect()} == {(D.NONE, None)}


def test_faults_in_rows_are_contained_and_the_wider_generator_asks_only_the_risky(spark):
    requests, instances, hits, joint = _batch(spark, 40)
    broken = lambda r: hits.withColumn("score", F.when(F.col("instance_id") == 7, F.raise_error(F.lit("no such index"))).otherwise(1.0))
    late = lambda r: r.select("query_id", F.lit("Q0").alias("variant"), F.lit(45).cast("long").alias("instance_id"), F.lit(9.0).alias("score"))
    found = search.search(requests, {"bm25f": lambda r: hits, "dense": broken}, instances, joint)
    status = {r.generator: (r.state, r.message) for r in found.status.collect()}
    assert status["bm25f"] == ("ok", "") and status["dense"][0] == "error" and "no such index" in status["dense"][1]
    found = search.search(requests, {"bm25f": lambda r: hits, "dense": lambda r: hits}, instances, joint, late=("late_interaction", late))
    assert {r.query_id: r.band for r in found.risk.collect()}[2] != "HIGH" and {r.generator: r.hits for r in found.status.collect()} == {"bm25f": 80, "dense": 80, "late_interaction": 1}
    assert [r.query_id for r in found.union.where("late_interaction_rank is not null").collect()] == [1]
    assert found.union.where("query_id = 1 and instance_id = 45 and bm25f_rank is null").count() == 1
