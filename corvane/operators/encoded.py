"""Learned-sparse and late-interaction retrieval, with the encoder as a column expression that a model's UDF may replace."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import retrieval

TERMS = 1 << 20
LEAST_WEIGHT = 0.01


def hashed_term(word: Column, terms: int = TERMS) -> Column:
    """Stand-in for a vocabulary: the first eight hexadecimal digits of SHA-256, modulo terms."""
    return F.conv(F.left(F.sha2(word, 256), F.lit(8)), 16, 10).cast("long") % terms


def encode_sparse(docs: DataFrame, key: str, words: Column, logit: Column | None = None, least: float = LEAST_WEIGHT) -> DataFrame:
    """(key, term_id, weight): log1p of the positive part of the greatest logit of a term; weights below `least` go.

    logit may refer to the column tf, a word's count in its text, which it is by default. Texts without words have no rows.
    """
    tf = docs.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))
    x = tf.select(key, hashed_term(F.col("word")).alias("term_id"), (F.col("tf") if logit is None else logit).cast("double").alias("logit"))
    weight = F.round(F.log1p(F.greatest(F.max("logit"), F.lit(0.0))), 6)
    return x.groupBy(key, "term_id").agg(weight.alias("weight")).where(F.col("weight") >= least)


def search_sparse(queries: DataFrame, postings: DataFrame, query: str, key: str) -> DataFrame:
    """(query, key, score) of documents with a score above zero; both sides from encode_sparse."""
    q = queries.select(query, "term_id", F.col("weight").alias("qw"))
    return postings.join(q, "term_id").groupBy(query, key).agg(F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score")).where("score > 0")


def best_sparse(queries: DataFrame, postings: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, key, score) of documents with a common term: the k best of each query are among them; both sides from encode_sparse."""
    listed = lambda x, by: x.groupBy(by).agg(F.collect_list(F.struct(F.col("term_id").alias("t"), F.col("weight").alias("w"))).alias("terms"))
    met = postings.join(queries.select("term_id").distinct(), "term_id", "left_semi")
    return retrieval.best_by_terms(listed(met, key), listed(queries, query), key, query, "terms", k)


def strongest_terms(encoded: DataFrame, key: str, n: int = 12) -> DataFrame:
    """(key, evidence): the ids of the n heaviest terms, ties to smaller ids."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("term_id"))))
    return encoded.groupBy(key).agg(F.transform(F.slice(order, 1, n), lambda v: v["term_id"]).alias("evidence"))


def max_sim(query: Column, doc: Column) -> Column:
    """Sum over query tokens of the best dot product with a document token; arrays of vectors. Null tokens (padding) take no part; no tokens give 0."""
    real = lambda x: F.filter(F.coalesce(x, F.array().cast("array<array<double>>")), lambda v: v.isNotNull())
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    d = real(doc)
    best = F.transform(real(query), lambda a: F.array_max(F.transform(d, lambda b: dot(a, b))))
    return F.when(F.size(d) == 0, 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, x: s + x))


def max_sim_all(vectors: DataFrame, queries: DataFrame, key: str, query: str, width: int, digits: int = 6) -> DataFrame:
    """(query, key, score) of every vector v with every query's but the one of its own id: `max_sim` of their tokens of the given width.

    Whole vectors of the greatest length meet in blocks of products; the few others, with nulls or of other lengths, meet by `max_sim` itself.
    """
    n = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    whole = F.coalesce((F.size("v") == n) & ~F.exists("v", lambda x: x.isNull()), F.lit(False)) & F.lit(n > 0 and n % width == 0)
    v, q = vectors.select(key, "v", whole.alias("whole")), queries.select(query, "v", whole.alias("whole"))

    def measure(m: np.ndarray, d: np.ndarray) -> np.ndarray:
        out, rows = np.zeros((len(m), len(d))), max(1, (1 << 22) // max(1, len(m) * (n // width)))
        for at in range(0, len(d), rows):
            tokens = d[at : at + rows].reshape(-1, width)
            for i in range(0, n, width):
                out[:, at : at + rows] += (m[:, i : i + width] @ tokens.T).reshape(len(m), -1, n // width).max(axis=2)
        return out

    near = retrieval.similar(v.where("whole"), key, q.where("whole"), query, digits, measure).where(F.col(key) != F.col(query)).select(query, key, "score")
    tokens = lambda x, name: x.withColumn(name, vector_tokens(F.col("v"), width)).drop("v")
    odd = lambda a, b: tokens(a, "_t").drop("whole").join(tokens(b, "_q").drop("whole"), F.col(key) != F.col(query)).select(query, key, F.round(max_sim(F.col("_q"), F.col("_t")), digits).alias("score"))
    return near.unionByName(odd(v.where("not whole"), q)).unionByName(odd(v.where("whole"), q.where("not whole")))


def vector_tokens(v: Column, width: int) -> Column:
    """A vector cut into tokens of the given width, as doubles."""
    v = v.cast("array<double>")
    tokens = F.transform(F.sequence(F.lit(1), F.size(v), F.lit(width)), lambda i: F.slice(v, i, F.lit(width)))
    return F.when(F.size(v) == 0, F.array().cast("array<array<double>>")).otherwise(tokens)
