"""Clusters, folds and splits against their sequential passes."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corvane.operators import groups
from tests.conftest import SF


def sequential(n, pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[b].add(a)
    led = []
    out = {}
    for i in range(n):
        mine = [x for x in led if x in near[i]]
        out[i] = min(mine) if mine else i
        if not mine:
            led.append(i)
    return out


@pytest.mark.parametrize("pairs", ["chain", "random", "star", "none"])
def test_leaders_equal_the_sequential_pass(spark, pairs):
    rng, n = random.Random(8), 40
    pairs = {"chain": [(i, i + 1) for i in range(n - 1)], "random": [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.08], "star": [(0, k) for k in range(1, n)] + [(3, 4)], "none": []}[pairs]
    pairs = [(min(p), max(p)) for p in pairs]
    got = groups.leaders(spark.range(n).withColumnRenamed("id", "k"), spark.createDataFrame(pairs, "a long, b long"), "k").collect()
    assert {r.k: r.leader for r in got} == sequential(n, pairs) and len(got) == n


def trigrams(text):
    return Counter(w[i : i + 3] for w in (f" {x} " for x in text.lower().replace("ß", "ss").split()) for i in range(len(w) - 2))


def test_clusters_of_all_benchmark_texts_and_variants(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    rng = random.Random(1)
    texts += [" ".join(w for w in t.split() if rng.random() > 0.02) for t in texts] + texts[:5] + ["", " ", "\t", "a", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "k long, t string")
    texts.append("")
    grams = [trigrams(t) for t in texts]
    df_of = Counter(g for c in grams for g in c)
    weights = [{g: n * (math.log((1 + len(texts)) / (1 + df_of[g])) + 1) for g, n in c.items()} for c in grams]
    norm = [math.sqrt(sum(v * v for v in w.values())) for w in weights]
    near = [(a, b) for b in range(len(texts)) for a in range(b) if norm[a] and norm[b] and round(sum(v * weights[b].get(g, 0) for g, v in weights[a].items()) / norm[a] / norm[b], 9) >= 0.95]
    got = {r.k: r.leader for r in groups.near_duplicate_clusters(df, "k", "t").collect()}
    assert got == sequential(len(texts), near) and len({v for k, v in got.items() if v != k}) > 5


def greedy(runs, folds):
    loads, out = [0] * folds, []
    for size, count in runs:
        for _ in range(count):
            f = min(range(folds), key=lambda k: (loads[k], k))
            loads[f] += size
            out.append(f)
    return out, loads


@pytest.mark.parametrize("seed", range(30))
def test_closed_form_equals_greedy_balance(seed):
    rng = random.Random(seed)
    sizes = sorted(rng.sample(range(1, 60), rng.randrange(1, 12)), reverse=True)
    runs, folds = [(s, rng.randrange(1, 50)) for s in sizes], rng.randrange(1, 8)
    phases, loads = groups.deal_runs(runs, folds)
    got, places = [], dict(runs)
    for size, count in runs:
        mine = [p for p in phases if p[0] == size]
        got += [next(c[(i - a) % len(c)] for _, a, b, c in mine if a <= i < b) for i in range(count)]
    assert (got, loads) == greedy(runs, folds) and sum(places.values()) == len(got)


def test_millions_of_groups_are_a_few_phases():
    phases, loads = groups.deal_runs([(1000, 3), (7, 2_000_000), (1, 4_000_000)], 5)
    assert len(phases) <= 15 and max(loads) - min(loads) <= 1


def test_folds_equal_the_sequential_deal(spark):
    rng = random.Random(2)
    rows = [(i, None if i % 50 == 0 else int(rng.paretovariate(0.7)) % 60) for i in range(900)]
    got = {r.k: r.fold for r in groups.group_folds(spark.createDataFrame(rows, "k long, g int"), "k", "g", 5, ranges=13).collect()}
    sizes = Counter(g for _, g in rows)
    order = sorted(sizes, key=lambda g: (-sizes[g], g is None, -(g or 0)))
    folds, _ = greedy([(sizes[g], 1) for g in order], 5)
    want = dict(zip(order, folds, strict=True))
    assert got == {k: want[g] for k, g in rows}
    assert {r.fold for r in groups.group_folds(spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "k long, g int"), "k", "g").collect()} == {0, 1}
    assert groups.group_folds(spark.createDataFrame([], "k long, g int"), "k", "g").collect() == []


def test_splits_equal_the_sequential_deal(spark):
    rng = random.Random(3)
    rows = [(i, f"g{rng.randrange(300)}", rng.choice(["x", "x", "y", None])) for i in range(1500)]
    fractions = {"train": 0.7, "validation": 0.15, "test": 0.15}
    got = groups.stratified_splits(spark.createDataFrame(rows, "k long, g string, s string"), "k", "g", "s", F.sha2("g", 256), fractions, ranges=9).collect()
    import hashlib

    members = defaultdict(list)
    for k, g, s in rows:
        members[g].append((k, s))
    strata = defaultdict(list)
    for g, m in members.items():
        count = Counter(s for _, s in m)
        strata[min(count, key=lambda s: (-count[s], min(k for k, x in m if x == s)))].append(g)
    want = {}
    for gs in strata.values():
        quota = dict.fromkeys(fractions, 0)
        for g in sorted(gs, key=lambda g: hashlib.sha256(g.encode()).hexdigest()):
            name = min(quota, key=lambda n: quota[n] / Fraction(str(fractions[n])))
            quota[name] += 1
            want[g] = name
    assert {r.k: r.split for r in got} == {k: want[g] for k, g, _ in rows}
