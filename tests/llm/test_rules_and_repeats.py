"""Rules from a table equal rules from a list; ids with several texts; both sides of the switches of near-duplicates."""

import random
import re

import pytest

from corvane.llm import forest, hosts

LOWER = {c: c + 32 for c in range(65, 91)}


def test_rules_as_a_table_equal_the_list(spark):
    rng = random.Random(1)
    host = lambda: ".".join(rng.choice(["a", "b", "com", "x", ""]) for _ in range(rng.randrange(1, 4)))
    path = lambda: "".join(rng.choice("/ab") for _ in range(rng.randrange(5)))
    rules = list(dict((host() + ("/" + path() if rng.random() < 0.7 else ""), rng.choice(["allow", "block"])) for _ in range(120)).items())
    urls = ["http://" + host() + "/" + path() + rng.choice(["", "?q", "#f"]) for _ in range(300)] + [None, "", "no scheme", "http://", "http://a.b:80/ab", "http://A.COM/" + "a" * 200_000]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "page_id long, good int")
    shown = lambda r: sorted((x.page_id, x.host, x.path, x.rule, x.verdict) for x in hosts.judge(pages, none, r).collect())
    key = lambda rows: [tuple(str(v) for v in r) for r in rows]
    want = key(shown(rules))
    assert key(shown(spark.createDataFrame(rules, "rule string, verdict string"))) == want and sum(r[3] != "None" for r in want) > 50
    assert key(shown(spark.createDataFrame([], "rule string, verdict string"))) == key(shown([]))


def test_more_rules_than_a_list_may_have(spark):
    pages = spark.createDataFrame([(1, "http://h7.org/a"), (2, "http://other.org/a")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good int")
    rules = [(f"h{k}.org/a", "block") for k in range(hosts.MOST_RULES + 1)]
    assert {(r.page_id, r.rule, r.verdict) for r in hosts.judge(pages, none, rules).collect()} == {(1, "h7.org/a", "block"), (2, None, "allow")}
    assert hosts.judge(pages.where("page_id > 9"), none).collect() == []


def expected(rows):
    """Ids as nodes, linked where any of their texts are."""
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    comp = {i: i for i, _ in sets if i is not None}
    for _ in range(len(comp)):
        before = dict(comp)
        for i, a in sets:
            for j, b in sets:
                if None not in (i, j) and a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    return sorted(((i, len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets), key=str)


def given():
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows, texts = [], [say(80) for _ in range(8)]
    for i in range(40):
        t = list(texts[i % 8])
        t[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(texts[0])) for i in range(30)]
    return [(i, t, "en", "s", None) for i, t in rows]


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ids_with_several_texts_keep_all_their_links(texts):
    rows = given()
    # id 500 joins two families, 501 has a text and none, 3 comes again with another family's text, nulls stay apart
    rows += [(500, rows[1][1], "en", "s", None), (500, rows[2][1], "en", "s", None), (501, None, "en", "s", None), (501, "alone and short", "en", "s", None), (3, rows[4][1], "en", "s", None), (3, rows[4][1], "en", "s", None), (None, rows[4][1], "en", "s", None), (None, "other", "en", "s", None)]
    assert shown(forest.near_duplicates(texts(rows))) == expected(rows)
    again = shown(forest.near_duplicates(texts(rows[::-1]).repartition(7)))
    assert again == expected(rows)


@pytest.mark.parametrize("switch", [{"BROADCAST_IDS": 0}, {"DENSE": 0}, {"DENSE": 10**6}, {"HOT": 2, "HOT_TEXTS": 1000}, {"HOT": 10**6}, {"CAP": 4}])
def test_both_sides_of_each_switch_give_the_same(texts, monkeypatch, switch):
    for name, value in switch.items():
        monkeypatch.setattr(forest, name, value)
    rows = given()
    assert shown(forest.near_duplicates(texts(rows), cap=switch.get("CAP", forest.CAP))) == expected(rows)
