"""Each stage of the pipeline on its own input, by brute force in SQL or by the library; the first one on labelled documents."""

import collections
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import oracles, shared
from corvane.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def by_sql(docs, sql):
    """Rows of SQL over the given documents and the benchmark."""
    c = duckdb.connect()
    documents = docs.toArrow()  # noqa: F841  the name that the SQL reads
    c.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    return c.execute(sql).fetchall()


def with_odd_rows(spark, docs):
    odd = spark.createDataFrame([(-1, None, "en", None, None), (-2, "", "en", "s", 0), (-3, "  ", None, "s", 2), (-2, "", "en", "s", 0)], docs.schema)
    return shared.settle(docs.unionByName(odd), "odd")


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean, bad = [i for i, t in toxic.items() if t == 0], [i for i, t in toxic.items() if t == 1]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean) and sum(i not in kept for i in bad) >= 0.7 * len(bad)


def test_near_duplicates_by_sql(spark):
    docs = with_odd_rows(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    got = STAGES["near_dedup"](spark, docs, SF)
    assert got.columns == docs.columns
    want = collections.Counter(r[0] for r in by_sql(docs.where("doc_id >= 0"), f"SELECT doc_id FROM ({oracles.OP4}) WHERE kept"))
    assert collections.Counter(r.doc_id for r in got.select("doc_id").collect()) == want + collections.Counter([-1, -2, -2, -3])


def test_contaminated_documents_by_sql(spark):
    docs = with_odd_rows(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    got = STAGES["decontamination"](spark, docs, SF)
    assert got.columns == docs.columns
    want = by_sql(docs, f"SELECT doc_id FROM ({oracles.OP2}) WHERE NOT contaminated")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r[0] for r in want)


def test_mix_by_sql(spark):
    docs = with_odd_rows(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    got = STAGES["mixing"](spark, docs, SF)
    assert got.columns == docs.columns
    want = {i: int(np.floor(taken / size + 0.5)) for i, size, taken in by_sql(docs, f"SELECT doc_id, size, taken FROM ({oracles.OP7}) WHERE size > 0")}
    assert collections.Counter(r.doc_id for r in got.select("doc_id").collect()) == collections.Counter({i: n for i, n in want.items() if n})


def test_ids_by_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    docs = with_odd_rows(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in STAGES["token_ids"](spark, docs, SF).collect())
    want, at = [], 0
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id, (r.text or "").encode())):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((at, r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_an_empty_table_gives_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for stage in STAGES.values():
        assert stage(spark, docs, SF).count() == 0
