"""Late interaction in blocks equals its definition, odd vectors too, and pairs of whole vectors are met by no nested loop."""

from pyspark.sql import functions as F

from corvane.operators import encoded


def test_blocks_equal_the_definition(spark):
    rows = [(i, [((i * 7 + j * 3) % 11) / 5 - 1 for j in range(8)]) for i in range(30)] + [(30, None), (31, []), (32, [1.0] * 4), (33, [1.0, None] * 4)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 10 in (0, 3)").withColumnRenamed("id", "q")
    got = {(r.q, r.id): r.score for r in encoded.max_sim_all(v, q, "id", "q", 4).collect()}
    t = lambda x, n: x.withColumn(n, encoded.vector_tokens(F.col("v"), 4)).drop("v")
    want = {(r.q, r.id): r.s for r in t(v, "d").join(t(q, "a"), F.col("id") != F.col("q")).select("q", "id", F.round(encoded.max_sim(F.col("a"), F.col("d")), 6).alias("s")).collect()}
    assert got == want and len(got) == 34 * 8 - 8


def test_whole_vectors_meet_in_blocks(spark):
    v = spark.range(40).select("id", F.array(*[F.rand(1) for _ in range(8)]).alias("v"))
    plan = encoded.max_sim_all(v, v.where("id % 10 = 0").withColumnRenamed("id", "q"), "id", "q", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
