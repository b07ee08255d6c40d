"""Made-up requests with known answers: seeded draws, noise, archetypes from a catalog, quotas, and checks in the pass that writes.

A draw is a hash of seed, key and number, so that it depends on nothing else: reruns and other partitionings give the same rows, and a new
archetype changes no other. Sampling without replacement goes in rounds of draws, which join what they hit by its place; neither pools nor
pairs are ever made.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import prefix
from corvane.sources.settled import settle

#: Words that no catalog has, and grades.
RESERVED = ("quantum", "submarine", "telemetry")
ANSWERABLE, CLARIFY, NO_ANSWER = 2, 1, 0
NOISED, LEAST_LETTERS, POSITIONS = 0.8, 5, 4
DRAWS = 16  # of a round


def draw(seed: str, key: Column, number: Column | int, below: Column | int) -> Column:
    """A number from 0 to below, from MD5 of seed:key:number; null where below isn't positive."""
    n = F.lit(below) if isinstance(below, int) else below
    h = F.md5(F.encode(F.concat_ws(":", F.lit(seed), key.cast("string"), (F.lit(number) if isinstance(number, int) else number).cast("string")), "UTF-8"))
    return F.when(n > 0, F.conv(F.left(h, F.lit(8)), 16, 10).cast("long") % n)


def chance(seed: str, key: Column, number: Column | int, share: float) -> Column:
    return draw(seed, key, number, 1 << 20) < int(share * (1 << 20))


def negatives(targets: DataFrame, pool: DataFrame, k: int, seed: str, rounds: int = 8) -> DataFrame:
    """(id, negative, turn): for each target, the first k different rows of its category and of another family that its endless sequence of draws hits; all there are, if fewer.

    targets: (id, category, family); pool: (id, category, family). Rounds of DRAWS draws until all have enough; a pool that still hides some after the last
    round, or that has no more than k, is small or nearly all of one family, and is met whole.
    """
    numbered = settle(prefix.numbered(pool.select("id", "category", "family"), ["category"], [F.col("id")], "place").select(F.col("id").alias("negative"), "category", F.col("family").alias("other"), "place"))
    sizes = numbered.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    own = numbered.groupBy("category", F.col("other").alias("family")).agg(F.count(F.lit(1)).alias("own"))
    t = settle(targets.select("id", "category", "family").join(sizes, "category").join(own, ["category", "family"], "left").withColumn("most", F.least(F.lit(k).cast("long"), F.col("n") - F.coalesce("own", F.lit(0)))).where("most > 0"))
    found, left = None, t.where("n > {0}".format(4 * k))
    for turn in range(rounds):
        numbers = F.explode(F.sequence(F.lit(turn * DRAWS), F.lit(turn * DRAWS + DRAWS - 1)))
        hits = left.withColumn("turn", numbers).withColumn("place", draw(seed, F.col("id"), F.col("turn"), F.col("n"))).join(numbered, ["category", "place"]).where("family <> other")
        hits = hits.groupBy("id", "negative").agg(F.min("turn").alias("turn"))
        found = settle(hits if found is None else found.unionByName(hits).groupBy("id", "negative").agg(F.min("turn").alias("turn")))
        enough = found.groupBy("id").agg(F.count(F.lit(1)).alias("got"))
        left = settle(left.drop("got").join(enough, "id", "left").where(F.coalesce("got", F.lit(0)) < F.col("most")))
        if left.isEmpty():
            break
    # the rest in order of a draw for each row of the pool
    rest = t.where("n <= {0}".format(4 * k)).select("id", "category", "family").unionByName(left.select("id", "category", "family"))
    whole = rest.join(numbered, "category").where("family <> other").select("id", "negative", draw(seed, F.concat_ws("/", F.col("id").cast("string"), F.col("negative").cast("string")), 0, 1 << 30).alias("turn"))
    found = found.join(rest.select("id"), "id", "left_anti").unionByName(whole)
    w = Window.partitionBy("id").orderBy("turn", "negative")
    return found.withColumn("turn", (F.row_number().over(w) - 1).cast("int")).where(F.col("turn") < k)


def co_absent(holdings: DataFrame, least: int = 20) -> DataFrame:
    """(field, absent, together): every field of at least so many instances, the number of other such fields that no instance has beside it, and those that some has, in order.

    holdings: (field, id). Pairs apart are nearly all there are, so those together are counted and listed: work is that of pairs within instances.
    """
    held = holdings.where("field is not null and id is not null").select("field", "id").distinct()
    common = settle(held.groupBy("field").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least).select("field"))
    n = common.count()
    held = settle(held.join(common, "field", "left_semi"))
    beside = held.join(held.withColumnRenamed("field", "other"), "id").where("field <> other").groupBy("field").agg(F.sort_array(F.collect_set("other")).alias("together"))
    none = F.array().cast(f"array<{holdings.schema['field'].dataType.simpleString()}>")
    x = common.join(beside, "field", "left").withColumn("together", F.coalesce("together", none))
    return x.select("field", (F.lit(n - 1) - F.size("together")).cast("long").alias("absent"), "together")


def co_absent_pairs(holdings: DataFrame, limit: int, seed: str, least: int = 20, attempts: int = 200) -> DataFrame:
    """(a, b, turn): the first `limit` different pairs of fields of at least so many instances, in a sequence of draws, that no instance has together; at most attempts * limit draws.

    holdings: (field, id). Only drawn pairs are looked up, and the limit is applied last.
    """
    held = settle(holdings.select("field", "id").distinct())
    common = held.groupBy("field").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least).select("field")
    placed = settle(prefix.numbered(common, [], [F.col("field")], "place"))
    n, spark = placed.count(), holdings.sparkSession
    found, tried, size = None, 0, max(4 * limit, 64)
    while n > 1 and tried < attempts * limit:
        turns = spark.range(tried, min(tried + size, attempts * limit)).select(F.col("id").alias("turn"))
        pick = lambda side: draw(seed, F.lit(side), F.col("turn"), n)
        drawn = turns.select("turn", pick("left").alias("p"), pick("right").alias("q")).where("p <> q")
        drawn = drawn.join(placed.select(F.col("place").alias("p"), F.col("field").alias("x")), "p").join(placed.select(F.col("place").alias("q"), F.col("field").alias("y")), "q")
        drawn = drawn.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("turn").alias("turn"))
        together = drawn.join(held.select(F.col("field").alias("a"), "id"), "a").join(held.select(F.col("field").alias("b"), "id"), ["b", "id"], "left_semi").select("a", "b").distinct()
        apart = drawn.join(together, ["a", "b"], "left_anti")
        found = settle(apart if found is None else found.unionByName(apart.select("a", "b", "turn")).groupBy("a", "b").agg(F.min("turn").alias("turn")))
        tried += size
        if found.count() >= limit:
            break
    if found is None:
        return common.select(F.col("field").alias("a"), F.col("field").alias("b"), F.lit(0).cast("long").alias("turn")).where(F.lit(False))
    return found.orderBy("turn", "a").limit(limit)


def with_acronyms(x: DataFrame, key: str, text: str, acronyms: dict[str, str], seed: str, most: int = 2) -> DataFrame:
    """x with text shortened and what was: each long form, in order, at its first place, by chance, `most` at most."""
    x = x.withColumn("noise", F.array().cast("array<string>"))
    for k, (long, short) in enumerate(sorted(acronyms.items())):
        x = x.withColumn("_p", F.split(F.col(text), rf"(?i)\b{long}\b", 2))
        x = x.withColumn("_use", (F.size("_p") == 2) & (F.size("noise") < most) & chance(seed, F.col(key), k, NOISED))
        x = x.withColumns({text: F.when(F.col("_use"), F.concat_ws(short, "_p")).otherwise(F.col(text)), "noise": F.when(F.col("_use"), F.concat("noise", F.array(F.lit(f"{long}->{short}")))).otherwise(F.col("noise"))})
    return x.drop("_p", "_use")


def with_typo(x: DataFrame, key: str, text: str, vocabulary: DataFrame, stop: Sequence[str], seed: str) -> DataFrame:
    """x with one word of five letters or more misspelled at its first place and what was ("" where no safe edit is there): neighbours exchanged or a letter doubled, never into a known word.

    vocabulary: (word). Words in order, each at up to four inner places in a drawn order; the first edit that isn't a known word is made, by an anti-join of all edits.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z][A-Za-z0-9]*"), 0), lambda w: (F.length(w) >= LEAST_LETTERS) & ~F.lower(w).isin(*stop))))

    def edits(word: Column) -> Column:
        low = F.lower(word)
        inner = F.sequence(F.lit(1), F.length(word) - 2)
        places = F.transform(F.slice(F.array_sort(F.transform(inner, lambda i: F.struct(F.md5(F.encode(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), low, i.cast("string")), "UTF-8")).alias("h"), i.alias("i")))), 1, POSITIONS), lambda s: s.i)
        cut = lambda a, n: F.substring(low, a, n)
        rest = lambda a: F.substring(low, a, F.length(word))
        made = F.flatten(F.transform(places, lambda i: F.array(F.concat(cut(F.lit(1), i), cut(i + 2, F.lit(1)), cut(i + 1, F.lit(1)), rest(i + 3)), F.concat(cut(F.lit(1), i + 1), rest(i + 1)))))
        return F.transform(F.filter(made, lambda e: (e != low) & (e != word)), lambda e: F.struct(word.alias("word"), e.alias("edit")))

    # edits are numbered in order and made again where one is taken: only numbers are gathered by row, in no sort of all edits
    tries = F.flatten(F.transform(words, edits))
    tried = x.select(key, F.posexplode(F.transform(tries, lambda s: s.edit)).alias("_at", "edit"))
    safe = tried.join(vocabulary.select(F.lower("word").alias("edit")).distinct(), "edit", "left_anti")
    first = safe.groupBy(key).agg(F.min("_at").alias("_at"))
    parts = F.split(F.col(text), F.concat(F.lit(r"\b"), F.col("_c.word"), F.lit(r"\b")), 2)
    y = x.join(first, key, "left").withColumn("_c", F.get(tries, F.col("_at")))
    return y.withColumn(text, F.when(F.col("_c").isNotNull(), F.concat(F.get(parts, F.lit(0)), F.col("_c.edit"), F.get(parts, F.lit(1)))).otherwise(F.col(text))).withColumn("noise", F.coalesce(F.concat_ws("->", "_c.word", "_c.edit"), F.lit(""))).drop("_c", "_at")


def quota(x: DataFrame, by: str, key: str, seed: str, budget: int) -> DataFrame:
    """At most `budget` rows a value of by, in an order drawn by key. Each partition sends no more than that."""
    w = Window.partitionBy(by).orderBy(F.md5(F.encode(F.concat_ws(":", F.lit(seed), F.col(by), F.col(key).cast("string")), "UTF-8")), key)
    return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= budget).drop("_r")


CHECKS = ("identity", "empty", "unknown", "grades", "answers", "reserved", "combinations", "misspellings", "splits")


def checked(scenarios: DataFrame, known: DataFrame, vocabulary: DataFrame, holdings: DataFrame, splits: DataFrame) -> tuple[DataFrame, Observation]:
    """(scenarios, observation): the rows to write, whose faults are counted in the pass that writes them; `faults(observation)` names them after.

    scenarios: (scenario_id, archetype, text, answerability, group_key, grades array<(id, grade)>, noise, fields); known: (id); vocabulary: (word); holdings: (field, id); splits: (scenario_id, split).
    """
    per = Window.partitionBy("scenario_id")
    x = scenarios.withColumn("f_identity", F.count(F.lit(1)).over(per) > 1)
    graded = scenarios.select("scenario_id", F.explode("grades").alias("g")).select("scenario_id", F.col("g.id").alias("id"))
    strange = graded.join(known.select("id").distinct(), "id", "left_anti").select("scenario_id").distinct().withColumn("f_unknown", F.lit(True))
    wrong = scenarios.where("archetype = 'misspelling'").select("scenario_id", F.lower(F.element_at(F.split("noise", "->"), -1)).alias("word")).join(vocabulary.select(F.lower("word").alias("word")).distinct(), "word", "left_semi").select("scenario_id").distinct().withColumn("f_misspellings", F.lit(True))
    words = scenarios.where("archetype = 'no_answer_reserved'").select("scenario_id", F.explode(F.array_intersect(T.tokens(F.col("text")), F.array(*map(F.lit, RESERVED)))).alias("word"))
    grounded = words.join(vocabulary.select("word").distinct(), "word", "left_semi").select("scenario_id").distinct().withColumn("f_reserved", F.lit(True))
    pairs = scenarios.where("archetype = 'no_answer_impossible_combo'").select("scenario_id", F.col("fields")[0].alias("a"), F.col("fields")[1].alias("b"))
    met = pairs.join(holdings.select(F.col("field").alias("a"), "id"), "a").join(holdings.select(F.col("field").alias("b"), "id"), ["b", "id"], "left_semi").select("scenario_id").distinct().withColumn("f_combinations", F.lit(True))
    parts = splits.groupBy("scenario_id").agg(F.count_distinct("split").alias("n"), F.min("split").alias("split"))
    of_group = scenarios.select("scenario_id", "group_key").join(parts, "scenario_id", "left").groupBy("group_key").agg((F.count_distinct("split") != 1).alias("torn"))
    for other in (strange, wrong, grounded, met):
        x = x.join(other, "scenario_id", "left")
    x = x.join(parts, "scenario_id", "left").join(of_group, "group_key", "left")
    grades = F.transform("grades", lambda g: g.grade)
    best = F.coalesce(F.array_max(grades), F.lit(NO_ANSWER))
    x = x.withColumns({"f_empty": F.trim(F.coalesce("text", F.lit(""))) == "", "f_grades": F.exists(grades, lambda g: g.isNull() | ~g.isin(0, 1, 2)), "f_answers": (F.col("answerability") == NO_ANSWER) == (best > 0), "f_splits": F.coalesce(F.col("n") != 1, F.lit(True)) | F.coalesce("torn", F.lit(True))})
    seen = Observation("scenario checks")
    bad = lambda c: F.sum(F.coalesce(F.col(f"f_{c}"), F.lit(False)).cast("long"))
    x = x.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(bad(c), F.lit(0)).alias(c) for c in CHECKS])
    return x.select(*scenarios.columns, "split"), seen


def faults(seen: Observation) -> dict[str, int]:
    """Checks that some row failed, with the numbers of rows; after the observed rows were written."""
    return {c: seen.get[c] for c in CHECKS if seen.get[c]}


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), frames)

