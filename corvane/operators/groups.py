"""Near-duplicate clusters, folds and splits of groups that must stay whole.

Each is defined by a sequential pass; here the pass is taken apart. A leader is the lexicographically first independent set, found in
rounds. Deals by greedy balance are cycles with closed forms, so a group's fold follows from its place among groups of its
size (or in its stratum), and places come from sorted ranges of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from itertools import pairwise
from math import lcm

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import meeting, prefix, retrieval
from corvane.sources.settled import settle

SHORT, BLOCK = 512, 4096  # rows of a term that meet with those of other terms, rows of a block


def near_pairs(weights: DataFrame, key: str, threshold: float, digits: int = 9) -> DataFrame:
    """(a, b, similarity) with a < b: all pairs of rows of length one whose cosine reaches the threshold.

    Terms are taken from the rarest on until what is left of a row is shorter than the threshold; a pair that reaches it shares one of these
    first terms, so only they are met, and frequent terms hardly ever are. Rows of a term meet in blocks of at most about BLOCK as matrices
    (`meeting._by_terms`), and only pairs that reach the threshold leave a task.
    """
    df = weights.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy(key).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    # what a row holds from this term on, squared
    left = 1.0 - F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(rare), F.lit(0.0))
    first = settle(weights.join(df, "term").withColumn("left", left).where(F.col("left") >= max(0.0, threshold - 10.0**-digits) ** 2 - 1e-9).select(key, "term"))
    lists = settle(first.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    buckets = -(-(lists.where(F.col("n") <= SHORT).agg(F.sum("n")).first()[0] or 0) // BLOCK) or 1
    short = F.col("n") <= SHORT
    # short lists of many terms meet together, a long one alone in as many blocks as it needs
    x = first.join(lists, "term").select(
        F.col(key).alias("k"), F.when(short, F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("string")).otherwise(F.concat(F.lit("="), "term")).alias("g"), F.when(short, 1).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int").alias("c"),
    ).distinct()
    x = x.withColumn("own", F.pmod(F.xxhash64("k"), F.col("c")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    x = x.select("k", "g", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    terms = settle(df.select("term").withColumn("t", F.monotonically_increasing_id()))
    said = weights.join(terms, "term").groupBy(F.col(key).alias("k")).agg(F.collect_list(F.struct("t", F.col("weight").alias("w"))).alias("v"))
    type_ = weights.schema[key].dataType.simpleString()

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("k").combine_chunks()
        alone = t.column("i")[0] == t.column("j")[0]
        left = t if alone else t.filter(pc.equal(t.column("own"), t.column("i")))
        right = t if alone else t.filter(pc.equal(t.column("own"), t.column("j")))
        a, b, s = [], [], []
        if left.num_rows and right.num_rows:
            scores = meeting._by_terms(left.column("v"), right.column("v"))
            for at in range(0, left.num_rows, meeting.TILE):
                m = scores(at, min(at + meeting.TILE, left.num_rows))
                p, q = np.nonzero(m >= threshold - 10.0**-digits)
                if alone:
                    p, q = p[q > p + at], q[q > p + at]
                a.append(p + at)
                b.append(q)
                s.append(m[p, q])
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return pa.table({"a": left.column("k").take(pa.array(whole(a, np.int64), pa.int64())), "b": right.column("k").take(pa.array(whole(b, np.int64), pa.int64())), "s": pa.array(whole(s, float), pa.float64())})

    met = x.join(said, "k").groupBy("g", "i", "j").applyInArrow(meet, f"a {type_}, b {type_}, s double")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("s", digits).alias("similarity")).where(F.col("similarity") >= threshold)
    return met.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def leaders(items: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, leader): in order of key, what no earlier leader is near to is a leader; all else follows its first leader.

    items: (key); pairs: (a, b) near each other, a < b. Each round decides what has no undecided earlier neighbour; chains, in which each row
    is near the next, take as many rounds as half their length, all else few.
    """
    edges = settle(pairs.select("a", "b").distinct())
    ends = lambda e: e.select(F.col("a").alias("x")).union(e.select("b")).distinct()
    open_edges, lead = edges, items.select(F.col(key).alias("x")).join(ends(edges), "x", "left_anti")
    while not open_edges.isEmpty():
        heads = open_edges.select(F.col("a").alias("x")).distinct().join(open_edges.select(F.col("b").alias("x")).distinct(), "x", "left_anti").withColumn("leads", F.lit(True))
        followers = open_edges.join(heads.select(F.col("x").alias("a")), "a", "left_semi").select(F.col("b").alias("x")).distinct().withColumn("leads", F.lit(False))
        gone = settle(heads.unionByName(followers))
        rest = settle(open_edges.join(gone.select(F.col("x").alias("a")), "a", "left_anti").join(gone.select(F.col("x").alias("b")), "b", "left_anti"))
        # whose earlier neighbours all turned out to follow, and who has no other left
        freed = ends(open_edges).join(gone, "x", "left_anti").join(ends(rest), "x", "left_anti")
        lead = settle(lead.union(gone.where("leads").select("x")).union(freed))
        open_edges = rest
    near = edges.join(lead.withColumnRenamed("x", "a"), "a").groupBy(F.col("b").alias(key)).agg(F.min("a").alias("near"))
    own = lead.select(F.col("x").alias(key), F.col("x").alias("own"))
    return items.select(key).join(own, key, "left").join(near, key, "left").select(key, F.coalesce("own", "near").alias("leader"))


def near_duplicate_clusters(texts: DataFrame, key: str, text: str, threshold: float = 0.95) -> DataFrame:
    """(key, leader): texts in order of key, each led by the first leader that is near it by trigrams. Equal texts are one until the end; texts without trigrams are alone, null ones too."""
    x = texts.select(key, F.coalesce(text, F.lit("")).alias("t"))
    first = settle(x.groupBy(F.sha2("t", 256).alias("h"), (F.size(retrieval.char_grams(F.col("t"), 3, 3)) == 0).alias("bare")).agg(F.min(key).alias("one"), F.min("t").alias("t")))
    pairs = near_pairs(settle(_weights_of_all(x, first)), "one", threshold)
    led = leaders(first.select("one"), pairs, "one").join(first.select("one", "h", "bare"), "one")
    y = x.select(key, F.sha2("t", 256).alias("h")).join(led.select("h", "leader", "bare"), "h")
    return y.select(key, F.when(F.col("bare"), F.col(key)).otherwise(F.col("leader")).alias("leader"))


def _weights_of_all(x: DataFrame, first: DataFrame) -> DataFrame:
    """Trigram weights of each distinct text, with document frequencies that count its copies."""
    n = x.count()
    copies = x.groupBy(F.sha2("t", 256).alias("h")).agg(F.count(F.lit(1)).alias("copies"))
    tf = first.join(copies, "h").select("one", "copies", F.explode(retrieval.char_grams(F.col("t"), 3, 3)).alias("term")).groupBy("one", "copies", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("term").agg((F.log((1 + n) / (1 + F.sum("copies"))) + 1).alias("idf"))
    y = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    return y.join(y.groupBy("one").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "one").select("one", "term", (F.col("w") / F.col("norm")).alias("weight"))


def deal_runs(runs: Sequence[tuple[int, int]], folds: int) -> tuple[list[tuple[int, int, int, list[int]]], list[int]]:
    """(phases, loads) of greedy balance: groups, the largest first, each to the lightest fold, ties to the first.

    runs: (size, number of groups), sizes falling. A phase is (size, first place, end place, cycle): within it, the group at a place of its
    size goes to cycle[(place - first) % len(cycle)]. At each level of loads, as wide as the size, every fold that has come up to it
    takes one group, in order of what it stands above the level's start.
    """
    loads, phases = [0] * folds, []
    for size, count in runs:
        if size <= 0:
            phases.append((size, 0, count, [min(range(folds), key=lambda f: (loads[f], f))]))
            continue
        base = min(loads)
        level, above = [(x - base) // size for x in loads], [(x - base) % size for x in loads]
        steps, at = sorted(set(level)), 0
        for low, high in pairwise([*steps, None]):
            cycle = sorted((f for f in range(folds) if level[f] <= low), key=lambda f: (above[f], f))
            end = count if high is None else min(count, at + (high - low) * len(cycle))
            if end > at:
                phases.append((size, at, end, cycle))
                for k, f in enumerate(cycle):
                    loads[f] += size * (-(-(end - at - k) // len(cycle)) if end - at > k else 0)
                at = end
            if at == count:
                break
    return phases, loads


def group_folds(rows: DataFrame, key: str, group: str, folds: int = 5, ranges: int | None = None) -> DataFrame:
    """(key, fold): rows of a group share a fold, and folds are as even as the greedy pass makes them; of groups of one size the last by name is dealt first.

    The driver sees (size, number of groups) only: sizes that differ are at most the square root of twice the rows.
    """
    sizes = settle(rows.groupBy(group).agg(F.count(F.lit(1)).alias("size")))
    runs = [(r["size"], r.n) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("size").desc()).collect()]
    folds = max(1, min(folds, sum(n for _, n in runs)))
    phases, _ = deal_runs(runs, folds)
    spark = rows.sparkSession
    table = spark.createDataFrame(phases, "size long, first long, end long, cycle array<int>")
    placed = prefix.numbered(sizes, ["size"], [F.col(group).desc_nulls_last()], "place", ranges)
    dealt = placed.join(table, "size").where("place >= first and place < end")
    dealt = dealt.select(group, F.get("cycle", ((F.col("place") - F.col("first")) % F.size("cycle")).cast("int")).alias("fold"))
    return prefix.join_on(rows.select(key, group), dealt, [group]).select(key, "fold")


def deal_pattern(fractions: dict[str, float]) -> list[str]:
    """One period of dealing to whoever has least of its fraction, ties to the first named."""
    exact = {n: Fraction(f).limit_denominator(1000) for n, f in fractions.items()}
    total = sum(exact.values())
    share = {n: f / total for n, f in exact.items()}
    period, quota, out = lcm(*(s.denominator for s in share.values())), dict.fromkeys(share, 0), []
    for _ in range(period):
        name = min(share, key=lambda n: quota[n] / share[n])
        quota[name] += 1
        out.append(name)
    return out


def stratified_splits(rows: DataFrame, key: str, group: str, stratum: str, order: Column, fractions: dict[str, float], ranges: int | None = None) -> DataFrame:
    """(key, group, stratum, split): groups whole, dealt within their stratum to the split that is furthest behind its fraction.

    A group's stratum is its rows' most common one, ties to that of its least key. order arranges a stratum's groups (a seeded hash of group, say).
    The deal depends on a group's place in its stratum alone, and repeats.
    """
    counts = rows.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
    own = counts.groupBy(group).agg(F.min_by(F.col(stratum), F.struct(-F.col("n"), "first")).alias("_stratum"))
    placed = prefix.numbered(own.withColumn("_order", order), ["_stratum"], [F.col("_order"), F.col(group)], "_place", ranges)
    pattern = deal_pattern(fractions)
    split = F.get(F.array(*map(F.lit, pattern)), (F.col("_place") % len(pattern)).cast("int")).alias("split")
    return prefix.join_on(rows.select(key, group), placed.select(group, F.col("_stratum").alias(stratum), split), [group])
