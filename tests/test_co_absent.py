"""All pairs of fields apart, told by a row a field."""

from itertools import combinations

from corvane.operators import scenarios as S


def test_every_pair_apart_follows_from_the_rows(spark):
    held = [(f, i) for f in range(60) for i in range(40) if (f * 7 + i * i) % 11 == 0] + [(99, 1), (1, 1), (1, 1), (None, 2), (2, None)]
    rows = {r.field: r for r in S.co_absent(spark.createDataFrame(held, "field long, id long"), least=3).collect()}
    ids = {f: {i for g, i in held if g == f and i is not None} for f in {g for g, _ in held if g is not None}}
    common = sorted(f for f, i in ids.items() if len(i) >= 3)
    apart = {(a, b) for a, b in combinations(common, 2) if not ids[a] & ids[b]}
    assert len(apart) > 300  # more than were drawn
    assert {(a, b) for a, b in combinations(sorted(rows), 2) if b not in rows[a].together} == apart
    assert sum(r.absent for r in rows.values()) == 2 * len(apart)


def test_no_common_field(spark):
    assert S.co_absent(spark.createDataFrame([(1, 1)], "field long, id long")).collect() == []
