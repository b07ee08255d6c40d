"""Running sums, quantiles and inversions against sorts, with a group that holds nearly all rows, nulls, ties and many ranges."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from corvane.operators import prefix


def given(seed, n=3000):
    rng = random.Random(seed)
    return [(i, None if i % 97 == 0 else "hot" if i % 20 else f"g{i % 7}", rng.choice([1.5, 2.5, None, rng.random()]), rng.randrange(40)) for i in range(n)]


SHAPE = "id long, g string, x double, y int"


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("ranges", [1, 37])
def test_running_sums_and_places(spark, ranges):
    rows = given(1)
    df = spark.createDataFrame(rows, SHAPE)
    got = {r.id: r for r in prefix.running(df, ["g"], [F.col("y").desc(), F.col("id")], {"n": F.lit(1), "s": F.col("y"), "x_s": F.col("x")}, ranges).collect()}
    places = {r.id: r.place for r in prefix.numbered(df, ["g"], [F.col("y").desc(), F.col("id")], ranges=ranges).collect()}
    for mine in by_group(rows).values():
        mine.sort(key=lambda r: (-r[3], r[0]))
        for k, (r, s, x) in enumerate(zip(mine, accumulate(r[3] for r in mine), accumulate(r[2] or 0 for r in mine), strict=True)):
            assert (got[r[0]].n, got[r[0]].s, places[r[0]]) == (k + 1, s, k) and got[r[0]].x_s == pytest.approx(x)
    assert len(got) == len(rows)


def test_quantiles_equal_a_sort(spark):
    rows = given(2)
    df = spark.createDataFrame(rows, SHAPE)
    got = {r.g: r for r in prefix.quantiles(df, ["g"], "x", {"low": F.lit(0), "p95": F.floor(F.col("n") * 0.95) - 1}, 23).collect()}
    middle = {r.g: r.median for r in prefix.median(df, ["g"], "x", 23).collect()}
    for g, mine in by_group(rows).items():
        v = sorted(r[2] for r in mine if r[2] is not None)
        assert (got[g].n, got[g].low, got[g].p95) == (len(v), v[0], v[int(0.95 * len(v)) - 1])
        assert middle[g] == (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    assert prefix.quantiles(df, [], "x", {"top": F.col("n") - 1}).first().top == max(r[2] for r in rows if r[2] is not None)


def test_inversions_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BLOCK", 50)
    rows = given(3, 1500)
    got = {r.g: r.inversions for r in prefix.inversions(spark.createDataFrame(rows, SHAPE), ["g"], "x", "y", "id", 11).collect()}
    for g, mine in by_group(rows).items():
        v = [(r[2], r[3]) for r in mine if r[2] is not None]
        assert got[g] == sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for k, a in enumerate(v) for b in v[:k]), g


def test_inversions_of_six_hundred_thousand_rows_in_one_group(spark):
    n = 600_000
    df = spark.range(n).select("id", F.lit(1).alias("g"), F.col("id").alias("x"), (n - F.col("id")).alias("y"))
    assert prefix.inversions(df, ["g"], "x", "y", "id").first().inversions == n * (n - 1) // 2
    assert prefix.inversions(df, [], "x", "x", "id").first().inversions == 0


def test_no_rows(spark):
    none = spark.createDataFrame([], SHAPE)
    assert prefix.running(none, ["g"], [F.col("id")], {"n": F.lit(1)}).collect() == prefix.quantiles(none, ["g"], "x", {"p": F.lit(0)}).collect() == prefix.inversions(none, ["g"], "x", "y", "id").collect() == []


def test_parity_needs_finite_scores_small_gaps_and_one_order(spark):
    from corvane.operators import evaluation

    nan = float("nan")
    rows = [("same", 1, 1.0, 1.0), ("same", 2, 2.0, 2.0005), ("far", 1, 1.0, 1.5), ("turned", 1, 1.0, 1.0004), ("turned", 2, 1.0001, 1.0), ("nan", 1, nan, 1.0), ("nan", 2, 1.0, None)]
    got = {r.g: (r.not_finite, r.mismatches, r.passed) for r in evaluation.parity(spark.createDataFrame(rows, "g string, id long, a double, b double"), ["g"], "id", "a", "b", 1e-3).collect()}
    assert got == {"same": (0, 0, True), "far": (0, 0, False), "turned": (0, 1, False), "nan": (2, 0, False)}
