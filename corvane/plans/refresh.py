"""An index of documents in a store that is refreshed by what changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog_queries import TOK, query
from corvane.functions import text as T
from corvane.sources.catalog import table
from corvane.sources.incremental import KeyedStore
from corvane.sources.settled import new_folder
from corvane.sources.store import signature


def _changes(docs, version, text):
    return docs.select("doc_id", F.lit(version).cast("long").alias("version"), T.content_hash(F.coalesce(text, F.lit(""))).alias("fingerprint"), F.lit(False).alias("deleted"), text.alias("text"))


def _words(rows):
    return rows.select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_words"), F.size(F.array_distinct(T.tokens(F.col("text")))).alias("n_terms"))


@query(f"SELECT doc_id, left(sha256(text || chr(31)), 16) AS fingerprint, len({TOK.format('text')})::INT AS n_words, len(list_distinct({TOK.format('text')}))::INT AS n_terms, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS made_in FROM documents WHERE doc_id % 11 > 0")
def i1_incremental_refresh(spark, d):
    """A build of all documents, every third of them with an older text, then a refresh with all texts as they are and without every eleventh: only what changed is made again."""
    docs = table(spark, d, "documents")
    store = KeyedStore(spark, new_folder(spark, "index"), "doc_id", "n_words int, n_terms int", signature({"tokens": 1}), 32)
    store.refresh(_changes(docs, 1, F.when(F.col("doc_id") % 3 == 0, "stale").otherwise(F.col("text"))), _words)
    store.refresh(_changes(docs, 2, F.col("text")).withColumn("deleted", F.col("doc_id") % 11 == 0), _words)
    return store.read("bigint", marks=True).select("doc_id", "fingerprint", "n_words", "n_terms", "made_in")
