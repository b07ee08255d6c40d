"""Forms and rows that meet in blocks: what leaves the tasks against the table of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import hybrid, meeting

LIST = "array<struct<t:bigint,w:double>>"


@pytest.fixture
def sides(spark):
    rng = random.Random(5)
    some = lambda n: [(t, rng.choice([0.5, 1.0, rng.random()])) for t in sorted(rng.sample(range(40), n))] or None
    kinds = {0: ("original", 1.0), 1: ("expanded", 0.85), 2: ("subquery", 0.75), 3: ("subquery", 0.75)}
    asked = [(q, f, *kinds[f], some(rng.randrange(6)), some(3) if f == 0 else None, [rng.uniform(-1, 1) for _ in range(4)] if q % 3 and f < 3 else None) for q in range(5) for f in range(4 if q else 1)]
    asked.append((9, 0, "original", 1.0, None, [(99, 1.0)], None))
    rows = [(i, some(rng.randrange(9)), some(rng.randrange(5)), [rng.uniform(-1, 1) for _ in range(4)] if i % 5 else None) for i in range(300)]
    names = ("bm25", "exact_field", "dense")
    return (
        meeting.Channels(names, vectors=("dense",), whole=("exact_field",)), asked, rows,
        spark.createDataFrame(asked, f"query_id long, form int, kind string, weight double, bm25 {LIST}, exact_field {LIST}, dense array<double>"),
        spark.createDataFrame(rows, f"instance_id long, bm25 {LIST}, exact_field {LIST}, dense array<double>"),
    )


def combined(spark, channels, asked, rows):
    """The table of all pairs."""
    score = lambda a, b: sum(x * dict(b or ()).get(t, 0.0) for t, x in a or ())
    said = []
    for q, form, kind, weight, words, fields, v in asked:
        for i, terms, having, w in rows:
            got = {"bm25": score(words, terms), "exact_field": score(fields, having), "dense": sum(x * y for x, y in zip(v, w, strict=True)) if v and w else 0.0}
            said += [(q, c, form, kind, weight, i, round(float(s), 6)) for c, s in got.items()]
    scored = spark.createDataFrame(said, "query_id long, channel string, form int, kind string, weight double, instance_id long, score double")
    whole = scored.where("channel = 'exact_field' and score > 0").select("query_id", "channel", "instance_id", F.col("score").alias("value"), F.col("score").alias("best"), F.array().cast("array<int>").alias("parts"))
    return hybrid.combine(scored.where("channel <> 'exact_field'")).unionByName(whole)


def test_pairs_and_the_best_are_those_of_all_pairs(spark, sides, monkeypatch):
    channels, a, r, asked, rows = sides
    monkeypatch.setattr(meeting, "ROWS", 70)
    monkeypatch.setattr(meeting, "LEAST", 4)
    every = combined(spark, channels, a, r)
    got = {(x.query_id, x.channel, x.instance_id): (x.value, x.best, x.parts) for x in meeting.pairs(asked, rows, channels, hybrid.SECOND).collect()}
    want = {(x.query_id, x.channel, x.instance_id): (x.value, x.best, len(x.parts)) for x in every.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    requests, catalog, k = asked.select("query_id").distinct(), rows.select("instance_id"), 7
    best = meeting.best(asked, rows, channels, hybrid.SECOND, k)
    new = {(x.query_id, x.instance_id): x for x in hybrid.frame_of_best(best, requests, catalog, channels.names, k).collect()}
    old = {(x.query_id, x.instance_id): x for x in hybrid.frame(every, requests, catalog, channels.names, k).collect()}
    assert set(new) == set(old) and len(old) == 6 * k
    assert all(new[x][c] == pytest.approx(y[c], abs=1e-5) for x, y in old.items() for c in y.asDict())


def test_no_pair_leaves_a_task_but_the_best(spark, sides):
    channels, _, _, asked, rows = sides
    kept = meeting.best(asked, rows, channels, hybrid.SECOND, 7).where("instance_id is not null").groupBy("query_id").count().collect()
    assert len(kept) == 5 and max(x["count"] for x in kept) <= 7 * len(channels.names)


def test_rare_and_frequent_terms_score_alike(spark, sides, monkeypatch):
    channels, a, r, asked, rows = sides
    t = [asked.toArrow().column("bm25"), rows.toArrow().column("bm25")]
    scores = []
    for most in (0, 5, 1024):
        monkeypatch.setattr(meeting, "FREQUENT", most)
        scores.append(meeting._by_terms(*t)(0, len(a)))
    assert abs(scores[0] - scores[1]).max() < 1e-12 and abs(scores[0] - scores[2]).max() < 1e-12 and scores[0].max() > 0


def test_the_best_of_each_part_hold_the_best_of_all(spark):
    from corvane.operators import retrieval

    rng = random.Random(2)
    vectors = spark.createDataFrame([(i, [float(rng.randrange(-2, 3)) for _ in range(3)] + [1.0]) for i in range(400)], "id long, v array<double>")
    queries = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")
    every, few = retrieval.similar(vectors, "id", queries, "query_id"), retrieval.similar(vectors, "id", queries, "query_id", most=9)
    assert few.count() <= 8 * 9 * spark.sparkContext.defaultParallelism < every.count()
    best = [sorted(map(tuple, retrieval.top(x, ["query_id"], "id", 9).collect())) for x in (every, few)]
    assert best[0] == best[1] and len(best[0]) == 72


def test_a_common_word_is_a_hit_though_its_score_is_nothing(spark):
    from corvane.operators import retrieval

    rows = spark.createDataFrame([(i, [(1, 1e-9), (2, float(i))] if i else [(1, 1e-9)]) for i in range(5)] + [(9, [(3, 1.0)])], f"id long, terms {LIST}")
    asked = spark.createDataFrame([(1, [(1, 1.0)]), (2, [(2, 1.0), (1, 1.0)])], f"query_id long, terms {LIST}")
    got = sorted(map(tuple, retrieval.best_by_terms(rows, asked, "id", "query_id", "terms", 2).collect()))
    assert got == [(1, 0, 0.0), (1, 1, 0.0), (2, 3, 3.0), (2, 4, 4.0)]
