"""Small cases of rankings, expansion and judged files."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import expansion, ranking
from corvane.sources import judged
from corvane.streaming import impressions


def test_gate_and_suitability(spark):
    x = spark.sql("select * from values (cast(null as double), array('a','b'), array('a')), (0.0, array(), array('a')), (1.0, cast(null as array<string>), array('a')) as t(c, w, h)")
    got = x.select(ranking.mandatory_gate(F.col("c")), ranking.suitability({"fields": F.col("w")}, {"fields": F.col("h")})).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.5), (0.15, 0.0), (1.0, 0.0)]


def test_ambiguity_of_a_single_candidate(spark):
    x = spark.sql("select cast(null as double) as g")
    assert x.select(ranking.ambiguity(F.lit(False), F.lit(0), F.lit(1), F.col("g"))).first()[0] == pytest.approx(0.65)


def test_merge_concepts_keeps_three_evidences(spark):
    rows = [(1, "field", "Pay", e, s, 0.5 + s / 10, s) for s, e in enumerate("abcd")] + [(1, "field", "pay", "a", 9, 0.1, 0)]
    c = spark.createDataFrame(rows, "query_id long, kind string, canonical string, evidence string, start long, confidence double, requirement long")
    (r,) = expansion.merge_concepts(c).collect()
    assert (r.concept, r.confidence, r.requirement, r.evidence) == ("pay", 0.8, 3, "a; b; c")


def test_judged_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query_id": "q1", "relevant": {"R1": 2}}\n\n{"query_id": "q2", "answerable": false}\n')
    assert [r.query_id for r in judged.read_qrels(spark, str(tmp_path / "q.jsonl")).orderBy("query_id").collect()] == ["q1", "q2"]
    (tmp_path / "s.csv").write_text('Scenario ID,Edge Case Tags\nQ00002,\nQ00001,"a; b"\n')
    s = judged.read_scenarios(spark, str(tmp_path / "s.csv"))
    assert [list(r) for r in s.collect()] == [["Q00001", ["a", "b"]], ["Q00002", []]]
    for name, ids in zip(judged.SPLITS, ("Q00001", "", "Q00002", ""), strict=True):
        (tmp_path / f"{name}.txt").write_text(ids + "\n")
    assert judged.read_splits(spark, str(tmp_path), s).count() == 2
    (tmp_path / "test.txt").write_text("Q00001\n")
    with pytest.raises(ValueError, match="several splits"):
        judged.read_splits(spark, str(tmp_path), s)
    (tmp_path / "s.csv").write_text("Scenario ID,Edge Case Tags\nX1,\n")
    with pytest.raises(ValueError, match="malformed"):
        judged.read_scenarios(spark, str(tmp_path / "s.csv"))


def test_impressions_are_appended_once(spark, tmp_path):
    rows = spark.sql("select * from values ('a', timestamp'2026-01-01 00:00:00'), ('a', timestamp'2026-01-01 00:00:01'), ('b', timestamp'2026-01-01 00:00:02') as t(idempotency_key, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        impressions.append_impressions(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.idempotency_key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_impressions_of_a_late_batch_and_without_key(spark, tmp_path):
    out, cp, src = (str(tmp_path / n) for n in ("out", "cp", "in"))
    schema = "idempotency_key string, ts timestamp"
    one = lambda key, day: spark.sql(f"select {key} as idempotency_key, timestamp'2026-01-{day:02d} 00:00:00' as ts").write.mode("append").parquet(src)
    for key, day in (("'a'", 1), ("'b'", 2), ("'a'", 20), ("cast(null as string)", 21)):
        one(key, day)
        impressions.append_impressions(spark.readStream.schema(schema).parquet(src), out, cp).awaitTermination(60)
    assert sorted((r.idempotency_key, r.ts.day) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2)]
