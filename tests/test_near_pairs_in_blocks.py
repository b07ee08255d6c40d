"""Near pairs in blocks equal all pairs, and only those that are near leave a task."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import groups


def weights_of(n, words, seed):
    rng = random.Random(seed)
    rows = [Counter(rng.choice("abcdefgh") + str(rng.randrange(words)) for _ in range(12)) for _ in range(n)]
    rows += [Counter(dict(list(r.items())[:-1])) for r in rows[: n // 2]] + rows[:5]
    norm = [math.sqrt(sum(v * v for v in r.values())) for r in rows]
    return [{t: v / m for t, v in r.items()} for r, m in zip(rows, norm, strict=True)]


@pytest.mark.parametrize(("short", "block"), [(512, 4096), (0, 16), (4, 16)])
def test_blocks_equal_all_pairs(spark, monkeypatch, short, block):
    monkeypatch.setattr(groups, "SHORT", short)
    monkeypatch.setattr(groups, "BLOCK", block)
    rows = weights_of(120, 3, 4)
    df = spark.createDataFrame([(f"k{i:03}", t, w) for i, r in enumerate(rows) for t, w in r.items()], "k string, term string, weight double")
    got = {(r.a, r.b): r.similarity for r in groups.near_pairs(df, "k", 0.9).collect()}
    dot = lambda a, b: round(sum(w * rows[b].get(t, 0.0) for t, w in rows[a].items()), 9)
    want = {(f"k{a:03}", f"k{b:03}"): dot(a, b) for b in range(len(rows)) for a in range(b) if dot(a, b) >= 0.9}
    assert got.keys() == want.keys() and len(got) > 40 and all(abs(got[p] - want[p]) < 2e-9 for p in want)


def test_no_pair_is_a_row_before_it_is_near(spark):
    rows = spark.range(40).select(F.col("id").alias("k"), F.explode(F.array(*[F.concat(F.lit(f"t{j}"), (F.col("id") % (j + 2)).cast("string")) for j in range(4)])).alias("term"), F.lit(0.5).alias("weight"))
    plan = groups.near_pairs(rows, "k", 0.95)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
