"""The best rows by common terms, where rows and queries are copies of each other: equal to a plain ranking, and copies are scored once."""

import random

from corvane.operators import meeting, retrieval
from corvane.sources import catalog

LIST = "array<struct<t: bigint, w: double>>"


def test_equals_a_plain_ranking_with_copies(spark, monkeypatch):
    r = random.Random(5)
    one = lambda n: [(t, float(r.randrange(1, 4))) for t in sorted(r.sample(range(9), n))]
    kinds, asks = [one(r.randrange(1, 4)) for _ in range(25)], [one(r.randrange(1, 3)) for _ in range(6)]
    rows = [(i, r.sample(k, len(k))) for i in range(400) for k in [kinds[r.randrange(25) if i % 3 else 0]]]
    asked = [(i, r.sample(a, len(a))) for i in range(30) for a in [asks[i % 6]]]
    met = []
    nearest = meeting.nearest
    monkeypatch.setattr(meeting, "nearest", lambda a, b, *more: met.append((a.count(), b.count())) or nearest(a, b, *more))
    got = retrieval.best_by_terms(spark.createDataFrame(rows, f"id long, terms {LIST}"), spark.createDataFrame(asked, f"query_id long, terms {LIST}"), "id", "query_id", "terms", 7)
    got = sorted((x.query_id, x.rank, x.id, x.score) for x in retrieval.top(got, ["query_id"], "id", 7).collect())
    want = []
    for q, a in asked:
        scores = sorted((-s, i) for i, b in rows if (s := sum(w * dict(b).get(t, 0.0) for t, w in a)) > 0)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:7])]
    assert got == sorted(want)
    assert met[0][0] <= 6 and met[0][1] <= 25


def test_few_row_groups_are_spread(spark):
    x = spark.range(10).coalesce(1)
    assert catalog.spread(x, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and catalog.spread(x, "id").count() == 10
