"""Made-up requests: seeded draws against plain Python in any partitioning, noise that is no real word, what archetypes promise, and checks that see planted faults."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import scenarios as S
from corvane.plans import scenarios as plans
from tests.conftest import SF

SMALL = SF.replace("0.01", "0.001")


def drawn(seed, key, number, below):
    return int(hashlib.md5(f"{seed}:{key}:{number}".encode()).hexdigest()[:8], 16) % below


def test_negatives_equal_a_sequence_of_draws(spark):
    rng = random.Random(4)
    pool = [(i, rng.choice("aab"), f"f{rng.randrange(12)}") for i in range(200)] + [(900 + i, "c", "same") for i in range(40)] + [(990, "c", "odd")] + [(1000 + i, "d", f"f{i}") for i in range(3)]
    targets = [(i, c, f) for i, c, f in pool] + [(5000, "nothing", "f1"), (5001, "a", "new")]
    shape = "id long, category string, family string"
    got = {}
    for parts in (1, 7):
        found = S.negatives(spark.createDataFrame(targets, shape).repartition(parts), spark.createDataFrame(pool, shape).repartition(parts), 3, "s").collect()
        got[parts] = {}
        for r in sorted(found, key=lambda r: (r.id, r.turn)):
            got[parts].setdefault(r.id, []).append(r.negative)
    assert got[1] == got[7]
    for i, c, f in targets:
        mine = sorted(x[0] for x in pool if x[1] == c)
        fits = {x[0] for x in pool if x[1] == c and x[2] != f}
        seq = []
        for turn in range(10_000 if len(mine) > 12 else 0):
            x = mine[drawn("s", i, turn, len(mine))]
            if x in fits and x not in seq:
                seq.append(x)
            if len(seq) == min(3, len(fits)):
                break
        have = got[1].get(i, [])
        assert have == seq if c in "ab" else (len(have) == min(3, len(fits)) and set(have) <= fits), (i, c)


def test_co_absent_pairs_equal_a_sequence_of_draws(spark):
    rng = random.Random(5)
    holdings = [(f"f{f}", i) for f in range(30) for i in range(60) if rng.random() < (0.05 if f % 3 else 0.4)] + [("f1", 3), ("f1", 3)]
    got = [(r.a, r.b, r.turn) for r in S.co_absent_pairs(spark.createDataFrame(holdings, "field string, id long").repartition(5), 9, "s", least=3).collect()]
    held = {}
    for f, i in holdings:
        held.setdefault(f, set()).add(i)
    common, want = sorted(f for f, i in held.items() if len(i) >= 3), []
    for turn in range(1800):
        a, b = common[drawn("s", "left", turn, len(common))], common[drawn("s", "right", turn, len(common))]
        pair = (min(a, b), max(a, b))
        if a != b and pair not in [w[:2] for w in want] and not held[a] & held[b]:
            want.append((*pair, turn))
    assert got == want[:9]
    assert S.co_absent_pairs(spark.createDataFrame([("x", 1)], "field string, id long"), 5, "s", least=1).collect() == []


def test_typos_are_no_words_and_reruns_agree(spark):
    rows = [(1, "Show worker pay"), (2, "abcde"), (3, "tiny one"), (4, ""), (5, None), (6, "workers' WORKER worker"), (7, "aaaaaa")]
    df, known = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([("workre",), ("wroker",), ("WORKEER",), ("abdce",)], "word string")
    got = {r.id: (r.text, r.noise) for r in S.with_typo(df, "id", "text", known, ("show",), "s").collect()}
    assert got == {r.id: (r.text, r.noise) for r in S.with_typo(df.repartition(7), "id", "text", known, ("show",), "s").collect()}
    assert got[3] == ("tiny one", "") and got[4] == ("", "") and got[5] == (None, "") and got[7][1] == "aaaaaa->aaaaaaa"
    for i in (1, 2, 6):
        before, after = got[i][1].split("->")
        words = {r.word.lower() for r in known.collect()}
        assert after not in words and got[i][0] == dict(rows)[i].replace(before, after, 1)
        assert sorted(after) == sorted(before.lower()) or len(after) == len(before) + 1


def test_acronyms_at_most_two(spark):
    df = spark.range(300).select("id", F.lit("Alpha beta ALPHA gamma alphabet").alias("text"))
    got = S.with_acronyms(df, "id", "text", {"alpha": "A", "beta": "B", "gamma": "G"}, "s").collect()
    assert max(len(r.noise) for r in got) == 2 and {r.text for r in got if r.noise == ["alpha->A", "beta->B"]} == {"A B ALPHA gamma alphabet"}
    assert 0.7 < sum("alpha->A" in r.noise for r in got) / 300 < 0.9


def test_archetypes_keep_their_promises(spark):
    x = plans._ids(plans._archetypes(spark, SF)).collect()
    by = {}
    for r in x:
        by.setdefault(r.archetype, []).append(r)
    assert len(by) == 9 and all(0 < len(v) <= plans.BUDGET for v in by.values()) and len({r.scenario_id for r in x}) == len(x)
    parts = {r.id: r for r in plans.instances(spark, SF).collect()}
    for r in by["negation"]:
        (target, good), (peer, bad) = ((g.id, g.grade) for g in r.grades)
        field = r.text.split(" but not ")[1]
        assert (good, bad) == (2, 0) and field in parts[peer].fields and field not in parts[target].fields and parts[peer].category == parts[target].category
    assert all(r.grades == [] and r.answerability == 0 and r.text.split()[0] in S.RESERVED for r in by["no_answer_reserved"])
    assert all(r.noise and r.noise.split("->")[1] in r.text for r in by["misspelling"]) and all("->" in r.noise for r in by["acronym"])
    assert all(parts[r.grades[0].id].family != parts[r.grades[1].id].family for r in by["multi_intent_split"])
    assert sorted(map(str, x)) == sorted(map(str, plans._ids(plans._archetypes(spark, SF)).collect()))


def test_written_dataset_has_no_fault(spark, tmp_path):
    assert plans.write_dataset(spark, SF, str(tmp_path / "d")) == {}
    rows = spark.read.parquet(str(tmp_path / "d"))
    assert rows.groupBy("group_key").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = rows.where("split = 'train'").count() / rows.count()
    assert 0.6 < share < 0.8


FAULTS = {
    "identity": lambda r: r | {"scenario_id": "Q1"},
    "empty": lambda r: r | {"text": "  "},
    "unknown": lambda r: r | {"grades": [(77, 2)]},
    "grades": lambda r: r | {"grades": [(1, 3)]},
    "answers": lambda r: r | {"answerability": 0},
    "reserved": lambda r: r | {"archetype": "no_answer_reserved", "text": "submarine pay", "grades": [], "answerability": 0},
    "combinations": lambda r: r | {"archetype": "no_answer_impossible_combo", "fields": ["a", "b"], "grades": [], "answerability": 0},
    "misspellings": lambda r: r | {"archetype": "misspelling", "noise": "pay->Known"},
    "splits": lambda r: r | {"group_key": "torn"},
}


@pytest.mark.parametrize("fault", ["", *FAULTS])
def test_each_check_sees_its_fault(spark, tmp_path, fault):
    good = lambda n: {"scenario_id": f"Q{n}", "archetype": "acronym", "text": "pay", "answerability": 2, "group_key": f"g{n}", "grades": [(1, 2)], "noise": "", "fields": []}
    rows = [good(1), good(2), good(3)]
    if fault:
        rows[2] = FAULTS[fault](rows[2])
        if fault == "splits":
            rows[1]["group_key"] = "torn"
    shape = "scenario_id string, archetype string, text string, answerability int, group_key string, grades array<struct<id: long, grade: int>>, noise string, fields array<string>"
    x = spark.createDataFrame([tuple(r.values()) for r in rows], shape)
    splits = spark.createDataFrame([("Q1", "train"), ("Q2", "train"), ("Q3", "test")], "scenario_id string, split string")
    held = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "field string, id long")
    out, seen = S.checked(x, spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([("known",), ("submarine",)], "word string"), held, splits)
    out.write.parquet(str(tmp_path / "d"))
    assert set(S.faults(seen)) == ({fault} if fault else set())
