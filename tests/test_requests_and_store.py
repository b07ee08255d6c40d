"""Small cases of encoders, confidence, reranking, spelling and the component store."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import confidence, encoded, expansion, rerank, typos
from corvane.sources import store


def test_max_sim_padding_and_empty_documents(spark):
    x = spark.sql("select array(array(1D, 0D), cast(null as array<double>), array(0D, 2D)) as q, array(array(3D, 1D), null) as d union all select array(array(1D)), array() union all select null, array(array(1D))")
    assert [r[0] for r in x.select(encoded.max_sim(F.col("q"), F.col("d"))).collect()] == [5.0, 0.0, 0.0]


def aligned(a, b):
    """Optimal string alignment by its recurrence."""
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distance_against_the_recurrence(spark):
    r = random.Random(1)
    rows = [tuple("".join(r.choice("abc") for _ in range(r.randrange(8))) for _ in range(2)) for _ in range(3000)] + [("ab", "ba"), ("ca", "abc"), ("abcd", "badc"), ("", "")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", typos.distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [x.d for x in got] == [min(aligned(a, b), 3) for a, b in rows]


def test_corrections_against_brute_force(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcde") for _ in range(n))
    known = {word(r.choice((5, 7, 9, 10, 11, 12, 22, 23, 24, 25, 26, 27, 28, 40))): r.choice((1, 3, 30)) for _ in range(200)}

    def changed(w):
        for _ in range(r.randrange(1, 4)):
            k = r.randrange(1, len(w) - 1)
            w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice("abcde") + w[k:], w[:k] + r.choice("abcde") + w[k + 1 :], w[:k] + w[k : k + 2][::-1] + w[k + 2 :]))
        return w

    words = {changed(w) for w in known for _ in range(3)} | {"abc", "", "abcd3e", "abcdes"}
    known["abcde"] = 1
    want = {"abcdes": ("abcde", 0, None, None)}
    for w in words - set(known) - {"abcdes", "abcd3e"}:
        near = {c: aligned(w, c) for c, df in known.items() if len(w) >= 5 and c[0] == w[0] and df >= 3 and abs(len(c) - len(w)) <= 2}
        order = sorted((k, c) for c, k in near.items() if k == 1 or k == 2 and len(w) >= 10 and known[c] >= 25)
        if order and (len(order) == 1 or order[1][0] > order[0][0]):
            second = order[1] if len(order) > 1 else (None, None)
            want[w] = (order[0][1], order[0][0], second[1], second[0])
    singular = lambda x: F.when(x == "abcdes", "abcde").otherwise(x)
    rows = [(w,) for w in words] + [(None,), ("abcdes",)]
    got = typos.corrections(spark.createDataFrame(rows, "word string"), spark.createDataFrame([*known.items(), (None, 9)], "word string, df int"), singular).collect()
    assert len(want) > 50 and {x.word: (x.correction, x.distance, x.runner, x.runner_distance) for x in got} == want and len(got) == len(want)


def test_pairs_are_scored_once_and_infinite_scores_drop(spark):
    pairs = spark.sql("select * from values (1L, 1L, 'a', 'x'), (1L, 2L, 'a', 'x'), (1L, 3L, 'a', null), (2L, 1L, null, 'x') as t(query_id, instance_id, query_text, text)")
    seen = spark.sparkContext.accumulator(0)

    def scorer(q, t):
        seen.add(len(q))
        return [math.inf if not b else 1.0 if a else math.nan for a, b in zip(q, t, strict=True)]

    got = rerank.rank_finite(rerank.score_pairs(pairs, scorer)).select("query_id", "instance_id", "ce_rank").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 2, 2)] and seen.value == 3
    with pytest.raises(Exception, match="scorer gave 0 scores"):
        rerank.score_pairs(pairs, lambda q, t: []).collect()


def test_recall_risk_of_a_query_without_candidates(spark):
    q = spark.sql("select 1L as query_id, 9 as n_words, 1D as facet_coverage, false as conflicting, 0 as failed")
    u = spark.sql("select 2L as query_id, 1L as instance_id, 1 as n_sources, 1 as fused_rank, 0.1D as fused")
    (r,) = confidence.recall_risk(q, u, spark.sql("select 1L as instance_id, 'f' as family"), 3).collect()
    assert (r.reasons, r.band) == (["empty_union"], "HIGH")


def test_plan_keeps_the_first_of_equal_texts(spark):
    x = spark.sql("select 1L as id, 'a' as a, cast(null as string) as n, 'b' as b")
    got = expansion.plan(x, "id", {"Q0": F.col("a"), "Q1": F.col("a"), "Q2": F.col("n"), "Q3": F.col("b")}).orderBy("variant").collect()
    assert [(r.variant, r.text) for r in got] == [("Q0", "a"), ("Q3", "b")]


def test_components_are_reused_and_go_stale(spark, tmp_path):
    root, df = f"file://{tmp_path}/index", spark.range(3)
    h = store.corpus_hash(df)
    assert h == store.corpus_hash(spark.range(3).repartition(3)) != store.corpus_hash(spark.range(4))
    assert store.write_component(df, root, "dense", {"corpus": h, "v": 1}) and not store.write_component(df, root, "dense", {"corpus": h, "v": 1})
    assert store.read_component(spark, root, "dense").count() == 3
    wanted = spark.sql("select * from values ('dense', true, null), ('late', false, 'dense'), ('sparse', true, null) as t(component, required, fallback)")
    state = lambda c: {r.component: (r.state, r.blocks) for r in store.readiness(store.manifest(spark, root), wanted, c).collect()}
    assert state(h) == {"dense": ("READY", False), "late": ("MISSING", False), "sparse": ("MISSING", True)} and state("other")["dense"] == ("STALE", True)
    with pytest.raises(ValueError, match="no component"):
        store.read_component(spark, root, "late")


def test_label_and_judgment_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("\ufeffscenario_id,answerability\nQ00001, answerable \nQ00002,Needs Clarification\n", encoding="utf-8")
    assert {tuple(r) for r in store.read_labels_csv(spark, str(tmp_path / "l.csv")).collect()} == {("Q00001", 0), ("Q00002", 1)}
    (tmp_path / "l.csv").write_text("scenario_id,answerability\nQ00001,maybe\n")
    with pytest.raises(ValueError, match="unknown label"):
        store.read_labels_csv(spark, str(tmp_path / "l.csv"))
    spark.sql("select 'Q1' as `Scenario ID`, 3 as answerability_label").write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="unknown label code"):
        store.read_labels(spark, str(tmp_path / "p"))
    catalog = spark.sql("select 'R0001' as report_key, 'Pay ' as title")
    line = '{"Scenario ID": "Q00001", "Report Key": "R0001", "Report Title": "%s", "Synthetic Relevance Grade": %d}\n'
    for title, grade, fault in (("Pay", 2, None), ("Pays", 2, "title"), ("Pay", 4, "grade")):
        (tmp_path / "j.jsonl").write_text(line % (title, grade))
        if fault is None:
            assert store.read_seed_judgments(spark, str(tmp_path / "j.jsonl"), catalog).count() == 1
        else:
            with pytest.raises(ValueError, match=fault):
                store.read_seed_judgments(spark, str(tmp_path / "j.jsonl"), catalog)


def test_dataset_is_not_overwritten(spark, tmp_path):
    one, split = spark.sql("select 'Q00001' as id"), spark.sql("select 'Q00001' as id, 'test' as split")
    made = store.write_dataset(one, one, split, f"{tmp_path}/d")
    assert set(made) == {"schema", "scenarios", "judgments", "splits"}
    with pytest.raises(Exception, match="already exists"):
        store.write_dataset(one, one, split, f"{tmp_path}/d")
