"""Every query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

from corvane import catalog_queries, plans, request_queries  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "[" + ",".join(map(shown, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog_queries.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    df = catalog_queries.queries()[name](spark, SF)
    got = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    want = duck.execute(catalog_queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall())


def test_union_keeps_null_apart_from_zero(spark):
    from corvane.operators import fusion

    hits = spark.createDataFrame([(1, "bm25f", "Q0", 7, 0.0), (1, "dense", "Q5", 8, 1.0)], "query_id long, generator string, variant string, instance_id long, score double")
    rows = {r.instance_id: r for r in fusion.union(fusion.merge_variants(fusion.rank_hits(hits, 10)), ("bm25f", "dense")).collect()}
    assert rows[7].bm25f_score == 0.0 and rows[7].dense_score is None and rows[8].bm25f_rank is None


def test_entry_imports_without_a_session():
    import __spark_entry__

    assert set(catalog_queries.queries()) <= set(__spark_entry__.queries())
