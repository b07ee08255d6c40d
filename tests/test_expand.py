"""Requests from text to concepts: suppression, short forms, corrections within a budget, phrases found again, support; traces of survival."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluation, expand

BOOK = [("cost center", "Cost Center", "field", "literal", 1.0, []), ("center", "Center", "field", "literal", 1.0, []), ("worker", "Worker", "topic", "phrase_rule", 0.9, []), ("fires", "Termination Type", "field", "phrase_rule", 0.9, ["Worker"]), ("headcount report", "Headcount", "field", "phrase_rule", 0.92, []), ("weak", "Weak", "field", "phrase_rule", 0.5, [])]
WORDS = ["cost", "center", "worker", "headcount", "report", "payroll", "employee", "location"]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, "cost center by worker"), (2, "worker fires"), (3, "Hedcount report for FTE"), (4, "payrol locatoin emploee wrker"), (5, None), (6, "cost centre"), (7, "weak pay"), (8, "TA partner list")]
    book = spark.createDataFrame([(p, p.split(), *rest) for p, *rest in BOOK], "phrase string, words array<string>, canonical string, kind string, origin string, confidence double, suppresses array<string>")
    vocabulary = spark.createDataFrame([(w, 50) for w in WORDS], "word string, df int")
    return expand.expand(spark.createDataFrame(rows, "query_id long, text string"), book, vocabulary)


def concepts(found, query):
    return sorted((r.canonical, r.origin) for r in found.concepts.where(f"query_id = {query}").collect())


def requests(found):
    return {r.query_id: r for r in found.requests.collect()}


def test_generic_names_inside_specific_ones_fall(found):
    assert concepts(found, 1) == [("Cost Center", "literal"), ("Worker", "phrase_rule")] and requests(found)[1].suppressed == ["Center"]


def test_rules_suppress_what_they_name(found):
    assert concepts(found, 2) == [("Termination Type", "phrase_rule")] and requests(found)[2].suppressed == ["Worker"]


def test_corrected_words_are_matched_again_and_short_forms_stand(found):
    assert concepts(found, 3) == [("FTE", "acronym"), ("Headcount", "typo")]
    r = requests(found)[3]
    assert r.corrected == ["headcount", "report", "for", "fte"] and r.expanded == "headcount report for FTE"
    assert concepts(found, 8) == [("Recruiter", "acronym")] and requests(found)[8].expanded == "TA partner list Recruiter"


def test_the_budget_is_spent_in_order(found):
    assert [(r.word, r.correction) for r in found.corrections.where("query_id = 4").orderBy("place").collect()] == [("payrol", "payroll"), ("locatoin", "location")]
    r = requests(found)[4]
    assert r.expanded == "payroll location emploee wrker" and r.corrected[2:] == ["emploee", "wrker"]


def test_nothing_to_say(found):
    r = requests(found)
    assert r[5].expanded == "" and r[5].tokens == [] and r[7].expanded == "weak pay" and concepts(found, 7) == [("Weak", "phrase_rule")]
    assert len(r) == 8


def test_support_of_words(spark, found):
    got = {r.query_id: (r.support, [(t.term, t.via) for t in r.terms]) for r in expand.support(found, spark.createDataFrame([(w,) for w in WORDS], "word string"), ("by", "for")).collect()}
    assert got[1] == (1.0, [("cost", "literal"), ("center", "literal"), ("worker", "literal")])
    assert got[3][1] == [("hedcount", "typo"), ("report", "literal"), ("fte", "acronym")] and got[3][0] == pytest.approx((0.8 + 1 + 0.9) / 3)
    assert dict(got[2][1])["fires"] == "expansion" and got[5] == (1.0, []) and dict(got[7][1]) == {"weak": "none", "pay": "none"}
    assert dict(got[4][1]) == {"payrol": "typo", "locatoin": "typo", "emploee": "none", "wrker": "none"}


def test_specific_names(spark):
    rows = [("Cost Center Code", "Cost Center", True), ("Cost Center", "Cost Center", False), ("Discost Center", "Cost", False), ("A B C", "A C", False), ("X", "", False)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select(expand.specializes(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_survival_and_where_things_were_lost(spark):
    pairs = lambda *rows: spark.createDataFrame(list(rows), "query_id long, instance_id long")
    stages = {n: pairs(*[(1, i) for i in range(7 - k)], (2, 0)) for k, n in enumerate(evaluation.STAGES)}
    trace = evaluation.survival(pairs(*[(1, i) for i in range(8)], (2, 0), (3, 5)), stages)
    got = {(r.query_id, r.instance_id): r.lost_at for r in trace.collect()}
    assert got == {(1, 7): "generated", (1, 6): "union", (1, 5): "shortlist", (1, 4): "rerank", (1, 3): "fusion", (1, 2): "expansion", (1, 1): "final", (1, 0): None, (2, 0): None, (3, 5): "generated"}
    union = spark.createDataFrame([(1, 0, 1, 3, None), (1, 1, 2, 1, 1), (2, 0, 1, None, 2)], "query_id long, instance_id long, n_sources int, a_rank int, b_rank int")
    summary = {(r.kind, r.name): (r.recall, r.n) for r in evaluation.survival_summary(trace, pairs((1, 0), (1, 1), (2, 0), (3, 5)), union, ("a", "b")).collect()}
    assert summary["generator", "a"] == (round(1 / 3, 6), 1) and summary["generator", "b"] == (0.5, 1) and summary["stage", "final"][1] == 1 and summary["stage", "generated"][1] == 2
