"""Every query on tables with further columns of clashing names, on empty tables, and on a text longer than a slice."""

import pytest
from pyspark.sql import functions as F

from corvane.llm import queries, textscan

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "pages", "embeddings", "labels", "conversations")
CLASHING = ("id", "row", "key", "word", "tokens", "size", "n", "values", "component", "s", "path", "host", "payload", "position", "target", "spans", "c0", "x0", "r0", "region", "v", "d", "gaps", "cell", "conv", "lost", "fault", "k", "source_size", "rank", "good", "own", "place")
NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    wide, empty = tmp_path_factory.mktemp("wide"), tmp_path_factory.mktemp("empty")
    for name in TABLES:
        x = spark.read.parquet(f"{SMALL}/{name}.parquet")
        x.limit(0).write.parquet(f"{empty}/{name}.parquet")
        more = [c for c in CLASHING if c not in x.columns]
        x.select(*[F.lit(k).alias(c) if k % 2 else F.lit(c).alias(c) for k, c in enumerate(more)], *x.columns).write.parquet(f"{wide}/{name}.parquet")
    return str(wide), str(empty)


def shown(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_further_columns_change_nothing(spark, folders, name):
    run = queries.queries()[name]
    got, want = run(spark, folders[0]), run(spark, SMALL)
    assert got.columns == want.columns
    if name in ("op3_quality", "op9_toxicity"):  # fitted in floating point
        assert got.count() == want.count()
    else:
        assert shown(got) == shown(want)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_empty_results(spark, folders, name):
    assert queries.queries()[name](spark, folders[1]).collect() == []


def test_a_text_longer_than_a_slice(spark, texts):
    """One text over the bound of a slice takes another way through the scanner, with the same result as its words have in short texts."""
    from corvane.llm import forest, leaks

    words = [f"w{k}" for k in range(260_000)]
    long = " ".join(words)
    assert len(long) > textscan.SLICE_BYTES
    rows = [(1, long, "en", "s", None), (2, long.upper(), "en", "s", None), (3, " ".join(words[:200_000]), "en", "s", None), (4, " ".join(words[100:300]), "en", "s", None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in forest.near_duplicates(texts(rows)).collect()}
    assert got == {1: (len(words) - 4, 1), 2: (len(words) - 4, 1), 3: (200_000 - 4, 1), 4: (196, 4)}
    items = spark.createDataFrame([("a", " ".join(words[250_000:250_012])), ("b", "none of these words is there at all in any text")], "item_id string, text string")
    hit = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in leaks.report(leaks.contamination(texts(rows), items)).collect()}
    assert hit == {1: (len(words), 12, 1), 2: (len(words), 12, 1), 3: (200_000, 0, 0), 4: (200, 0, 0)}
