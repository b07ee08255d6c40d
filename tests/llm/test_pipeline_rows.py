"""Filters of the pipeline judge each row, with a null or repeated id as any other."""

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_rows_of_null_and_repeated_ids_are_judged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").dropDuplicates(["text"])
    labelled = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.withColumn("doc_id", F.lit(-1).cast("long")))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_contaminated):
        kept = stage(spark, labelled, SF).select("doc_id", "text").collect()
        by = [{r.text for r in kept if t(r.doc_id)} for t in (lambda i: i is not None and i >= 0, lambda i: i is None, lambda i: i == -1)]
        assert by[0] == by[1] == by[2] and 0 < len(by[0]) < docs.count()


def test_near_copies_of_null_and_repeated_ids(spark, texts):
    words = [f"w{k}" for k in range(200)]
    near = " ".join([*words[:100], "x", *words[101:]])
    other = " ".join(f"v{k}" for k in range(50))
    rows = [(3, " ".join(words), "en", "s", 0), (None, near, "en", "s", 0), (5, other, "en", "s", 0), (5, near, "en", "s", 0), (None, "alone", "en", "s", 0)]
    got = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, texts(rows), SF).collect()}
    assert got == {(3, rows[0][1]), (5, other), (None, "alone")}
