"""Inverted and dense indexes as tables, and scoring of whole batches of queries against them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import meeting
from corvane.sources.settled import settle


def zone_terms(docs: DataFrame, key: str, zones: dict[str, Column]) -> DataFrame:
    """(key, zone, term, tf): counts per zone, before any weighting."""
    parts = F.array(*[F.struct(F.lit(z).alias("zone"), T.tokens(c).alias("terms")) for z, c in zones.items()])
    return docs.select(key, F.explode(parts).alias("z")).select(key, "z.zone", F.explode("z.terms").alias("term")).groupBy(key, "zone", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(terms: DataFrame, key: str, n: int) -> DataFrame:
    """(term, df, idf): idf = ln(1 + (n - df + 0.5) / (df + 0.5))."""
    return terms.select("term", key).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def zone_lengths(terms: DataFrame, n: int) -> DataFrame:
    """(zone, average): mean words of a zone over all documents, 1 at least."""
    return terms.groupBy("zone").agg(F.greatest(F.sum("tf") / n, F.lit(1.0)).alias("average"))


def bm25f_postings(docs: DataFrame, key: str, zones: dict[str, Column], weights: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(term, key, part): each document's saturated share of a term's score, with its idf.

    Zone counts are normalized by length and weighted, summed over zones, then saturated once.
    One shuffle by (document, zone) for lengths, one by term for document frequencies.
    """
    n = docs.count()
    terms = zone_terms(docs, key, zones)
    length = terms.groupBy(key, "zone").agg(F.sum("tf").alias("length"))
    weight = F.create_map(*[F.lit(x) for z, w in weights.items() for x in (z, float(w))])
    x = terms.join(length, [key, "zone"]).join(zone_lengths(terms, n), "zone")
    x = x.withColumn("w", weight[F.col("zone")] * F.col("tf") / (1 - b + b * F.col("length") / F.col("average")))
    x = x.groupBy("term", key).agg(F.sum("w").alias("wtf"))
    df = x.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return x.join(df, "term").select("term", key, (idf * (k1 + 1) * F.col("wtf") / (k1 + F.col("wtf"))).alias("part"))


MOST_BROADCAST = 200_000  # words of requests, beyond which their table is not sent to every task


def bm25f_search(docs: DataFrame, key: str, zones: dict[str, Column], weights: dict[str, float], queries: DataFrame, query: str, text: str, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """(query, key, score), as scores over all postings are, of documents with a word of a query; only words that some query has are counted.

    A word's occurrence adds its zone's weight over the zone's relative length, so one sum by (document, word) has all zones; it is combined
    before the exchange. Lengths are sizes, in a scan of their own.
    """
    words = {z: T.tokens(c) for z, c in zones.items()}
    facts = docs.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.size(w)).alias(z) for z, w in words.items()]).first()
    n = facts.n
    average = {z: max((facts[z] or 0) / n, 1.0) if n else 1.0 for z in zones}
    asked = queries.select(query, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term"))
    known = asked.select("term").distinct()
    known = F.broadcast(known) if known.count() <= MOST_BROADCAST else known
    part = lambda z, w: F.struct((F.lit(float(weights[z])) / (1 - b + b * F.size(w) / average[z])).alias("w"), w.alias("terms"))
    said = docs.select(key, F.explode(F.array(*[part(z, w) for z, w in words.items()])).alias("z")).select(key, "z.w", F.explode("z.terms").alias("term"))
    wtf = said.join(known, "term", "left_semi").groupBy(key, "term").agg(F.sum("w").alias("wtf"))
    df = wtf.groupBy("term").agg(F.log(1 + (n - F.count(F.lit(1)) + 0.5) / (F.count(F.lit(1)) + 0.5)).alias("idf"))
    x = wtf.join(df, "term").select(key, "term", (F.col("idf") * (k1 + 1) * F.col("wtf") / (k1 + F.col("wtf"))).alias("part"))
    return x.join(asked, "term").groupBy(query, key).agg(F.round(F.sum("part"), digits).alias("score"))


def score_terms(postings: DataFrame, queries: DataFrame, key: str, query: str, text: str, digits: int = 6) -> DataFrame:
    """(query, key, score): sums over the query's distinct terms; only documents with a term appear."""
    terms = queries.select(query, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term"))
    return postings.join(terms, "term").groupBy(query, key).agg(F.round(F.sum("part"), digits).alias("score"))


def top(scored: DataFrame, by: list[str], key: str, k: int, score: str = "score", rank: str = "rank") -> DataFrame:
    """The k best rows of each group, ties to the smaller key, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), key)
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def char_grams(x: Column, least: int = 3, most: int = 5) -> Column:
    """Character grams inside space-padded words; a padded word shorter than a size gives itself once and no larger size."""
    words = F.filter(F.split(T.fold(x), r"\s+"), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        n = F.length(padded)

        def grams(k: int) -> Column:
            cut = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(k)))
            return F.when((n >= k) | F.lit(k == least), cut).otherwise(F.array().cast("array<string>"))

        return F.concat(*[grams(k) for k in range(least, most + 1)])

    return F.flatten(F.transform(words, of))


def tfidf(docs: DataFrame, key: str, grams: Column) -> DataFrame:
    """(key, term, weight): sublinear tf, smoothed idf, rows of length one."""
    n = docs.count()
    tf = docs.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    df = tf.groupBy("term").agg((F.log((1 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    x = tf.join(df, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return x.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def field_scores(requests: DataFrame, postings: DataFrame, n: int) -> DataFrame:
    """(request, id, score): rarity-weighted share of requested fields; weight ln(1 + n / df) / ln(1 + n), optional ones half.

    requests: (request, field, required); postings: (field, id). Unknown fields count in the total with df 1... 0 hits.
    """
    df = postings.groupBy("field").agg(F.count(F.lit(1)).alias("df"))
    x = requests.join(df, "field", "left").withColumn("w", F.when(F.col("required"), 1.0).otherwise(0.5) * F.log(1 + n / F.greatest(F.coalesce("df", F.lit(1)), F.lit(1))) / F.log(F.lit(1.0 + n)))
    total = x.groupBy("request").agg(F.sum("w").alias("total"))
    return x.join(postings, "field").groupBy("request", "id").agg(F.sum("w").alias("s")).join(total, "request").select("request", "id", F.round(F.col("s") / F.col("total"), 6).alias("score"))


def with_all_fields(requests: DataFrame, postings: DataFrame) -> DataFrame:
    """(request, id) of instances that have every field of a request. requests: (request, field); postings: (field, id)."""
    wanted = requests.select("request", "field").distinct()
    need = wanted.groupBy("request").agg(F.count(F.lit(1)).alias("need"))
    met = wanted.join(postings.select("field", "id").distinct(), "field").groupBy("request", "id").agg(F.count(F.lit(1)).alias("met"))
    return met.join(need, "request").where("met = need").select("request", "id")


def tfidf_search(docs: DataFrame, key: str, grams: Column, queries: DataFrame, query: str, query_grams: Column, digits: int = 6) -> DataFrame:
    """(query, key, score): cosines of tf-idf rows; a query's terms that no document has don't count. Only pairs with a common term appear."""
    n = docs.count()
    counts = lambda x, k, g: x.select(k, F.explode(g).alias("term")).groupBy(k, "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    asked = counts(queries, query, query_grams)
    idf = counts(docs, key, grams).groupBy("term").agg((F.log((1 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))

    def unit(tf: DataFrame, k: str, name: str) -> DataFrame:
        x = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
        return x.join(x.groupBy(k).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), k).select(k, "term", (F.col("w") / F.col("norm")).alias(name))

    # only terms that some query has are weighted and met; norms need all of a document's
    x = unit(counts(docs, key, grams), key, "weight").join(asked.select("term").distinct(), "term", "left_semi")
    return x.join(unit(asked, query, "qw"), "term").groupBy(query, key).agg(F.round(F.sum(F.col("qw") * F.col("weight")), digits).alias("score"))


def _listed(x: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): a row's terms by number and weight."""
    return x.groupBy(key).agg(F.collect_list(F.struct("t", "w")).alias(name))


def _numbered(terms: DataFrame) -> DataFrame:
    """terms with a number t, written, so that all readers see the same."""
    return settle(terms.withColumn("t", F.monotonically_increasing_id()))


def bm25f_lists(docs: DataFrame, key: str, zones: dict[str, Column], weights: dict[str, float], queries: DataFrame, query: str, text: str, name: str = "bm25", k1: float = 1.2, b: float = 0.75, cut: Callable[[Column], Column] = T.tokens) -> tuple[DataFrame, DataFrame]:
    """(key, name) and (query, name), array<struct<t, w>>: lists whose inner products are the scores of `bm25f_search`. cut gives a zone's words."""
    words = {z: cut(c) for z, c in zones.items()}
    facts = docs.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.size(w)).alias(z) for z, w in words.items()]).first()
    n = facts.n
    average = {z: max((facts[z] or 0) / n, 1.0) if n else 1.0 for z in zones}
    asked = queries.select(query, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term"))
    part = lambda z, w: F.struct((F.lit(float(weights[z])) / (1 - b + b * F.size(w) / average[z])).alias("w"), w.alias("terms"))
    said = docs.select(key, F.explode(F.array(*[part(z, w) for z, w in words.items()])).alias("z")).select(key, "z.w", F.explode("z.terms").alias("term"))
    wtf = settle(said.join(asked.select("term").distinct(), "term", "left_semi").groupBy(key, "term").agg(F.sum("w").alias("wtf")))  # two readers, and words are cut once
    df = _numbered(wtf.groupBy("term").agg(F.log(1 + (n - F.count(F.lit(1)) + 0.5) / (F.count(F.lit(1)) + 0.5)).alias("idf")))
    rows = wtf.join(df, "term").select(key, "t", (F.col("idf") * (k1 + 1) * F.col("wtf") / (k1 + F.col("wtf"))).alias("w"))
    return _listed(rows, key, name), _listed(asked.join(df, "term").select(query, "t", F.lit(1.0).alias("w")), query, name)


def tfidf_lists(docs: DataFrame, key: str, grams: Column, queries: DataFrame, query: str, query_grams: Column, name: str = "char") -> tuple[DataFrame, DataFrame]:
    """(key, name) and (query, name), array<struct<t, w>>: lists whose inner products are the cosines of `tfidf_search`."""
    n = docs.count()
    counts = lambda x, k, g: x.select(k, F.explode(g).alias("term")).groupBy(k, "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    asked = counts(queries, query, query_grams)
    wanted = asked.select("term").distinct().withColumn("wanted", F.lit(True))
    idf = counts(docs, key, grams).groupBy("term").agg((F.log((1 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    idf = _numbered(idf.join(wanted, "term", "left"))

    def lists(tf: DataFrame, k: str) -> DataFrame:
        # only terms that some query has are listed; norms need all of a document's
        x = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
        x = x.groupBy(k).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("wanted"), F.struct("t", "w"))).alias(name))
        return x.select(k, F.transform(name, lambda e: F.struct(e["t"].alias("t"), (e["w"] / F.col("norm")).alias("w"))).alias(name))

    return lists(counts(docs, key, grams), key), lists(asked, query)


def field_lists(requests: DataFrame, postings: DataFrame, n: int, name: str = "exact_field") -> tuple[DataFrame, DataFrame]:
    """(id, name) and (request, name), array<struct<t, w>>: lists whose inner products are the scores of `field_scores`. A posting is there once."""
    df = _numbered(postings.groupBy("field").agg(F.count(F.lit(1)).alias("df")))
    x = requests.join(df, "field", "left").withColumn("w", F.when(F.col("required"), 1.0).otherwise(0.5) * F.log(1 + n / F.greatest(F.coalesce("df", F.lit(1)), F.lit(1))) / F.log(F.lit(1.0 + n)))
    total = x.groupBy("request").agg(F.sum("w").alias("total"))
    known = x.where("t is not null").join(total, "request").select("request", "t", (F.col("w") / F.col("total")).alias("w"))
    return _listed(postings.join(df, "field").select("id", "t", F.lit(1.0).alias("w")), "id", name), _listed(known, "request", name)


LONG = 4096  # long texts that a task meets at a time


def best_by_terms(rows: DataFrame, asked: DataFrame, key: str, query: str, name: str, k: int) -> DataFrame:
    """(query, key, score): sums of products over common terms, rounded; the k best rows of each query, with others in some cases.

    rows (key, name), asked (query, name), array<struct<t, w>> with positive weights. Rows of equal lists are scored once, as that of the smallest key, and so are
    queries of equal lists: the k best rows are among the first k of the k best classes, and a class below k better rows isn't opened.
    """

    def classes(x: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
        """(id, class) of all, and one list a class."""
        x = settle(x.select(F.col(by).alias("id"), F.sort_array(name).alias(name), F.md5(F.to_json(F.sort_array(name))).alias("same")))
        first = x.groupBy("same").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))
        return x.select("id", "same").join(first, "same").select("id", "class", "n"), x.join(first, F.col("id") == F.col("class"), "left_semi").select("id", name)

    all_rows, lists = classes(rows, key)
    all_asked, forms = classes(asked, query)
    forms = forms.select(F.col("id").alias("query_id"), F.lit(0).alias("form"), F.lit("original").alias("kind"), F.lit(1.0).alias("weight"), name)
    x = top(meeting.nearest(forms, lists.withColumnRenamed("id", "instance_id"), name, k, LONG), ["query_id"], "instance_id", k)
    # rows of better classes, without those of equal scores
    x = x.join(all_rows.where("id = class").select(F.col("id").alias("instance_id"), "n"), "instance_id")
    before = Window.partitionBy("query_id").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("query_id", "score")
    x = x.withColumn("better", F.sum("n").over(before) - F.sum("n").over(level)).where(F.col("better") < k).select("query_id", F.col("instance_id").alias("class"), "score")
    members = all_rows.withColumn("at", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("at") <= k).select("class", F.col("id").alias(key))
    opened = settle(x.join(members, "class").select(F.col("query_id").alias("class"), key, "score"))
    return all_asked.select("class", F.col("id").alias(query)).join(opened, "class").select(query, key, "score")


BLOCK, ASKED = 512, 8192  # vectors of queries multiplied at a time, and that a task meets where only the best leave it


def _dealt(vectors: DataFrame, key: str, queries: DataFrame, query: str, own: Callable[[Column], Column], block: int = BLOCK) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, queries, types of both keys): vectors v and queries' vectors v by part and block."""
    asked, parts = -(-queries.count() // block) or 1, -(-vectors.count() // 16384) or 1
    parts = max(parts, vectors.sparkSession.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    once = lambda x, k, name: x.select(F.col(k).alias(name), own(F.col("v").cast("array<double>")).alias("v"))  # noqa: E731  below the copies, so that a vector is made once
    left = once(vectors, key, "k").select("k", "v", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int").alias("part"), every(asked).alias("block"))
    right = once(queries, query, "q").select("q", "v", every(parts).alias("part"), F.pmod(F.xxhash64("q"), F.lit(asked)).cast("int").alias("block"))
    return left, right, [queries.schema[query].dataType.simpleString(), vectors.schema[key].dataType.simpleString()]


def _by_length(t: pa.Table) -> dict[int, tuple[pa.Table, np.ndarray]]:
    t = t.combine_chunks()
    sizes = np.array(pc.fill_null(pc.list_value_length(t.column("v")), 0))
    return {int(n): ((some := t.filter(pa.array(sizes == n))), some.column("v").combine_chunks().flatten().to_numpy().reshape(some.num_rows, -1)) for n in np.unique(sizes) if n}


def gathered(vectors: DataFrame, key: str, queries: DataFrame, query: str, names: tuple[str, ...], sums: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(query, names): what `sums` tells of a matrix of queries against one of vectors, a number a name and query, added over all vectors. Blocks are those of `similar`, and no pair leaves a task."""
    left, right, types = _dealt(vectors, key, queries, query, lambda v: v)

    def meet(_, rows: pa.Table, asking: pa.Table) -> pa.Table:
        out = [pa.table({"q": asking.column("q").slice(0, 0), **{n: pa.array([], pa.float64()) for n in names}})]
        theirs = _by_length(rows)
        for n, (q, m) in _by_length(asking).items():
            if n in theirs:
                out.append(pa.table({"q": q.column("q"), **dict(zip(names, map(pa.array, sums(m, theirs[n][1])), strict=True))}))
        return pa.concat_tables(out)

    told = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, ", ".join([f"q {types[0]}", *[f"{n} double" for n in names]]))
    return told.groupBy(F.col("q").alias(query)).agg(*[F.sum(n).alias(n) for n in names])


def similar(vectors: DataFrame, key: str, queries: DataFrame, query: str, digits: int = 6, measure: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, most: int | None = None) -> DataFrame:
    """(query, key, score): cosines of all queries' vectors v with all vectors v of their length, block by block. Queries are a stated, bounded set.

    measure, where given, scores a matrix of queries against one of vectors, as they are, in place of the cosine. With most, only so many best
    rows of each query, ties to the smaller key, leave each part of the vectors: the best of all are among them. Blocks are of ASKED queries then.

    Vectors are dealt by a hash into parts, queries into blocks of about BLOCK; a part meets each block once, so a task holds a part and a block.
    """
    left, right, types = _dealt(vectors, key, queries, query, T.normalized if measure is None else lambda v: v, BLOCK if most is None else ASKED)

    def meet(_, rows: pa.Table, asking: pa.Table) -> pa.Table:
        out = [pa.table({"q": asking.column("q").slice(0, 0), "k": rows.column("k").slice(0, 0), "s": pa.array([], pa.float64())})]
        theirs = _by_length(rows if most is None else rows.sort_by("k"))
        for n, (q, m) in _by_length(asking).items():
            if n in theirs:
                k, v = theirs[n]
                for at in range(0, len(m), BLOCK):
                    tile = m[at : at + BLOCK]
                    s = tile @ v.T if measure is None else measure(tile, v)
                    if most is None:
                        ids = (np.repeat(np.arange(len(tile)), len(v)), np.tile(np.arange(len(v)), len(tile)))
                    else:
                        near = np.round(np.where(np.isnan(s), np.inf, s), digits)  # Spark has NaN above all numbers
                        best = [meeting.firsts(x, most) for x in near]
                        ids = (np.repeat(np.arange(len(tile)), [len(b) for b in best]), np.concatenate(best))
                    out.append(pa.table({"q": q.column("q").slice(at, len(tile)).take(ids[0]), "k": k.column("k").take(ids[1]), "s": s[ids]}))
        return pa.concat_tables(out)

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, f"q {types[0]}, k {types[1]}, s double")
    return found.select(F.col("q").alias(query), F.col("k").alias(key), F.round("s", digits).alias("score"))


def cosine(vectors: DataFrame, queries: DataFrame, key: str, vector: str, most: int | None = None) -> DataFrame:
    """(query_id, key, score) of every pair of a stated, bounded query set and all other vectors: exact by design. With most, the best are enough: so many of each query are among the rows."""
    v = vectors.select(key, F.col(vector).alias("v"))
    return similar(v, key, queries.select(F.col(key).alias("query_id"), F.col(vector).alias("v")), "query_id", most=None if most is None else most + 1).where(F.col(key) != F.col("query_id")).select("query_id", key, "score")
