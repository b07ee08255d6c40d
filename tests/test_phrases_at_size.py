"""Phrases of a lexicon whose first word is in every request: only rows that fit in two words are met."""

from pyspark.sql import functions as F

from corvane.operators import understanding as U


def _plan_rows(x):
    """Rows that left the join, from the finished plan's metrics."""
    x.collect()
    plan, found = x._jdf.queryExecution().executedPlan(), []

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "Join" in name and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        if hasattr(p, "plan") and "QueryStage" in name:
            walk(p.plan())
        for i in range(p.children().size()):
            walk(p.children().apply(i))
        return None

    walk(plan)
    return found


def test_a_first_word_of_all_phrases_meets_no_request_with_another_second_word(spark):
    requests = spark.range(200).select(F.col("id").alias("query_id"), F.array(F.lit("show"), F.lit("brand"), F.concat(F.lit("n"), (F.col("id") % 100).cast("string"))).alias("words"))
    book = spark.range(100).select(F.concat(F.lit("brand n"), F.col("id").cast("string")).alias("phrase")).withColumn("words", F.split("phrase", " "))
    x = U.find_phrases(requests, book)
    assert x.count() == 200
    assert max(_plan_rows(U.find_phrases(requests, book))) <= 200  # 20,000 when phrases met by their first word


def test_both_ways_to_the_lexicon_agree(spark, monkeypatch):
    words = [["red", "cats"], ["Parties", "red"], ["cats"], [], None, ["red", None, "cat"], ["straße", "red", "cat", "red"], ["red"]]
    requests = spark.createDataFrame(list(enumerate(words)), "query_id long, words array<string>")
    book = spark.createDataFrame([("red cat", ["red", "cat"]), ("cat", ["cat"]), ("party red", ["party", "red"]), ("red cat red", ["red", "cat", "red"]), ("", []), ("cat", ["cat"])], "phrase string, words array<string>")
    rows = lambda: sorted(map(tuple, U.find_phrases(requests, book).select("query_id", "start", "end", "phrase", "morphological").collect()))
    small = rows()
    monkeypatch.setattr(U, "BOOK", 0)
    assert rows() == small
    assert (0, 0, 2, "red cat", True) in small and (1, 0, 2, "party red", True) in small and (6, 1, 4, "red cat red", False) in small
    assert small.count((2, 0, 1, "cat", True)) == 2 and not [r for r in small if r[0] in (3, 4, 7)] and [r for r in small if r[0] == 5] == [(5, 2, 3, "cat", False)] * 2
