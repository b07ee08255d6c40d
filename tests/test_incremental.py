"""A store refreshed by what changed against one build of everything; broken writes, other settings, late, repeated and replayed batches, a stream."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import training
from corvane.sources.incremental import KeyedStore, feature_passes
from corvane.sources.store import signature
from corvane.streaming.index import keep_index

SHAPE = "id long, version long, fingerprint string, deleted boolean, text string"
NAMES = ("a", "b")


def store(spark, root, sig="s", buckets=8):
    return KeyedStore(spark, str(root), "id", "n int, upper string", sig, buckets)


class Counting:
    def __init__(self):
        self.made = 0

    def __call__(self, rows):
        self.made += rows.count()
        return rows.select("id", F.length("text").alias("n"), F.upper("text").alias("upper"))


def change(i, version, text, deleted=False):
    return (i, version, None if deleted else f"h{text}", deleted, text)


def live(s):
    return {r.id: (r.n, r.upper) for r in s.read("bigint").collect()}


def test_only_changed_rows_are_made_and_only_their_buckets_written(spark, tmp_path):
    s, make = store(spark, tmp_path / "a", buckets=64), Counting()
    rows = [change(i, 1, f"text {i % 5}") for i in range(200)]
    first = s.refresh(spark.createDataFrame(rows, SHAPE), make)
    assert (first.made, first.reused) == (200, 0) == (make.made, 0)
    before = s.manifest()[1]
    again = s.refresh(spark.createDataFrame([change(3, 2, "new"), change(4, 2, "text 4"), change(5, 2, None, True), change(9999, 2, "more")], SHAPE), make)
    assert (again.made, again.reused, again.deleted, again.late) == (2, 1, 1, 0) and make.made == 202
    after = s.manifest()[1]
    assert sum(after[b] != before.get(b) for b in after) == again.buckets <= 4
    want = {i: (6, f"TEXT {i % 5}") for i in range(200) if i != 5} | {3: (3, "NEW"), 9999: (4, "MORE")}
    assert live(s) == want
    assert {r.id: r.made_in for r in s.read("bigint", marks=True).where("made_in = 2").collect()} == {3: 2, 9999: 2}
    assert {r.id for r in s.read("bigint", version=1).collect()} == set(range(200))


@pytest.mark.parametrize("seed", range(3))
def test_any_order_of_batches_gives_one_build(spark, tmp_path, seed):
    rng = random.Random(seed)
    history = [change(rng.randrange(30), v, f"t{rng.randrange(6)}", rng.random() < 0.2) for v in range(120)] + [(None, 1, "x", False, "x")]
    whole = store(spark, tmp_path / "whole")
    whole.refresh(spark.createDataFrame(history, SHAPE), Counting())
    parts = store(spark, tmp_path / "parts")
    rng.shuffle(history)
    for k in range(0, len(history), 30):
        batch = spark.createDataFrame(history[k : k + 30] + history[: k // 2], SHAPE)  # with repeats of earlier ones
        parts.refresh(batch, Counting())
    assert live(parts) == live(whole)


def test_replayed_batches_and_broken_writes_change_nothing(spark, tmp_path):
    s, make = store(spark, tmp_path / "a"), Counting()
    batch = spark.createDataFrame([change(1, 1, "a"), change(2, 1, "b")], SHAPE)
    s.refresh(batch, make, 0)
    assert s.refresh(batch, make, 0).version == 1 and make.made == 2
    # a refresh that stopped before its manifest was finished
    broken = tmp_path / "a" / "manifest" / "v-00000002"
    broken.mkdir()
    assert s.versions() == [1] and len(live(s)) == 2
    done = s.refresh(spark.createDataFrame([change(1, 2, "c")], SHAPE), make, 1)
    assert done.version == 2 and live(s) == {1: (1, "C"), 2: (1, "B")}
    assert s.refresh(spark.createDataFrame([], SHAPE), make, 2).made == 0 and len(live(s)) == 2


def test_another_builds_store_is_refused(spark, tmp_path):
    store(spark, tmp_path / "a", signature({"features": 1})).refresh(spark.createDataFrame([change(1, 1, "a")], SHAPE), Counting())
    other = store(spark, tmp_path / "a", signature({"features": 2}))
    for use in (lambda: other.read("bigint"), lambda: other.refresh(spark.createDataFrame([change(1, 2, "b")], SHAPE), Counting())):
        with pytest.raises(ValueError, match="refused"):
            use()
    assert store(spark, tmp_path / "none").read("bigint").collect() == []


def test_a_stream_with_late_and_repeated_documents(spark, tmp_path):
    rows = [change(1, 1, "one"), change(2, 1, "two"), change(1, 3, "one three"), change(3, 1, "three")], [change(1, 2, "late"), change(2, 1, "two"), change(3, 2, None, True)], [change(3, 1, "three"), change(4, 1, "four")]
    source, s, make, told = tmp_path / "in", store(spark, tmp_path / "index"), Counting(), []
    for batch in rows:
        spark.createDataFrame(batch, SHAPE).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SHAPE).parquet(str(source))
        keep_index(stream, s, make, str(tmp_path / "checkpoint"), told.append).awaitTermination()
    whole = store(spark, tmp_path / "whole")
    whole.refresh(spark.createDataFrame([r for b in rows for r in b], SHAPE), Counting())
    assert live(s) == live(whole) == {1: (9, "ONE THREE"), 2: (3, "TWO"), 4: (4, "FOUR")}
    assert [(t.made, t.late, t.deleted) for t in told] == [(3, 0, 0), (0, 2, 1), (1, 1, 0)] and make.made == 4


def test_feature_passes_are_made_once_a_text(spark, tmp_path):
    calls = []

    def described(rows):
        calls.append(rows.count())
        one = F.sequence(F.lit(1), F.length("text"))
        return rows.select("query_id", F.transform(one, lambda i: i.cast("long")).alias("ids"), F.flatten(F.transform(one, lambda i: F.array(i.cast("double"), F.lit(0.5)))).alias("x"), F.transform(one, lambda i: (i % 3).cast("double")).alias("grades"))

    sig = signature({"features": training.schema_hash(NAMES), "configuration": {"depth": 50}})
    s = KeyedStore(spark, str(tmp_path / "p"), "query_id", "ids array<bigint>, x array<double>, grades array<double>", sig, 4)
    ask = lambda rows, v: feature_passes(s, spark.createDataFrame(rows, "query_id long, text string").withColumn("version", F.lit(v).cast("long")), described)
    assert ask([(1, "abc"), (2, "de")], 1).made == 2 and ask([(1, "abc"), (2, "d")], 2) .made == 1 and calls == [2, 1]
    got = {r.query_id: r for r in s.read("bigint").collect()}
    assert len(got[1].x) == 6 and len(got[2].x) == 2
    assert len(training.fit_fusion(s.read("bigint").withColumnRenamed("query_id", "query"), NAMES, epochs=2).losses) == 2
