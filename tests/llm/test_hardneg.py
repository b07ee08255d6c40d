"""Hard negatives against brute force over all pairs: ties, copies, other lengths, huge and missing components."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import hardneg, queries

SHAPE = "vec_id long, embedding array<double>, label int, cell string, group int"


def brute(rows):
    own = {}
    for i, v, label, *_ in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[0], r[2], r[1])):
        if all(x is not None and math.isfinite(x) for x in v):
            own.setdefault(i, ((label + 1) % 10 if i % 7 == 0 else label, [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v]))
    hold = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    out = []
    for a, (label, v) in own.items():
        if a % 50:
            continue
        met = [(-hold(sum(x * y for x, y in zip(v, w, strict=True))), b, other) for b, (other, w) in own.items() if b != a and len(w) == len(v)]
        for p, pid, _ in sorted(m for m in met if m[2] == label)[:5]:
            fits = sorted(m for m in met if m[2] != label and -50 * p <= -100 * m[0] <= -95 * p)[:3]
            out += [(a, pid, k + 1, nid, -p, -n) for k, (n, nid, _) in enumerate(fits)]
    return sorted(out)


def given(rng, n, spread=0.4):
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[i % 5]], rng.choice([0, 1, 1, 1, 2, 9]), "x", 1) for i in range(n)]


def mined(spark, rows, **how):
    x = spark.createDataFrame(rows, SHAPE).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")))
    found = hardneg.mine(x, F.col("vec_id") % 50 == 0, **how).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = given(rng, 420)
    rows += [(1000 + i, rows[50][1], rng.choice([0, 1, 2]), "x", 1) for i in range(140)]  # a vector that is a quarter of all
    rows += [(2000 + i, [rng.gauss(0, 1) for _ in range(3)], i % 2, "x", 1) for i in range(60)]  # of another length
    rows += [(3000, None, 1, None, None), (3001, [1.0, None, 2.0, 1.0, 1.0, 1.0], 1, None, None), (3002, [float("nan")] * 6, 1, None, None), (3003, [1.0] * 6, None, None, None), (None, [1.0] * 6, 1, None, None), (3050, [math.inf] + [0.0] * 5, 1, None, None)]
    rows += [(3100, [], 1, None, None), (3101, [], 1, None, None), (3102, [], 2, None, None), (3150, [0.0] * 6, 3, None, None), (3151, [0.0] * 6, 3, None, None), (50, rows[50][1], 0, "again", 1)]
    rng.shuffle(rows)
    want = brute(rows)
    assert len(want) > 50 and mined(spark, rows) == want
    assert mined(spark, rows, pivots=3, groups=2, chunk=50, chunks=3) == want


def test_scores_beyond_double_and_long(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**k for _ in range(n)], i % 3, "x", 1) for k, n, at in ((20, 4, 0), (60, 3, 120)) for i in range(at, at + 120)]
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_bounds_spare_groups(spark):
    """Far clusters are not replicated to each other's groups, and results stay whole."""
    rng = random.Random(7)
    rows = [(i, [(100.0 if i % 2 else -100.0) + rng.gauss(0, 1) for _ in range(3)], i % 3, "x", 1) for i in range(400)]
    assert mined(spark, rows, pivots=4, groups=2) == brute(rows)
    seen = []
    keep, hardneg._served = hardneg._served, lambda c, r: seen.append((c, r)) or keep(c, r)
    try:
        mined(spark, rows, pivots=4, groups=2)
    finally:
        hardneg._served = keep
    cells = seen[0][0]
    assert len(set(cells.group)) == 2 and float(np.max(cells.apart)) > 10_000


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0, 2.0], 0, "x", 1), (2, [1.0, 2.0], 1, "x", 1)]) == []
    assert mined(spark, [(50, [1.0, 2.0], 0, "x", 1)]) == []


def test_query_has_the_stated_columns(spark):
    got = queries.op11_hard_negatives(spark, "/root/testdata/sf0.001")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
