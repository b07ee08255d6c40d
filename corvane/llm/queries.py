"""The queries of this subpackage, over the tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import ann, credentials, forest, hardneg, hosts, leaks, mixing, repair, shared, tokens, toxicity, warc, weaklabels

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a WARC record, written to archives in the shared folder and read back with all checks; a null html is an empty payload."""
    folder = shared.new_folder(spark, "warc")
    archives = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(archives, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document within windows of the benchmark; a null text has no words."""
    return leaks.report(leaks.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of the labellers and score of the fitted scorer for each document; a null text counts as one of no words."""
    return weaklabels.quality(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of each document; one without words is alone."""
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's url by the listed rules, else by its host's posterior; a null url has an empty host and path."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return hosts.judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact length histogram of all documents, with the end id; a null text has length 1."""
    return tokens.length_histogram(tokens.encoded_lengths(table(spark, sf_dir, "documents"), vocabulary()))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is taken of each document and the time of its first word, from the training order: a table in the shared folder, a row for each copy.

    A document of which nothing is taken has no position.
    """
    order = mixing.in_training_order(mixing.mix(table(spark, sf_dir, "documents")), parts=True, untaken=True)
    return shared.settle(order, "training-order").where("round <= 1").select("doc_id", "size", "source_size", "target", "taken", "position")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document from the files they were written to; a null text has the end id only."""
    folder = shared.new_folder(spark, "ids")
    return tokens.read_ids(tokens.write_ids(table(spark, sf_dir, "documents"), vocabulary(), folder), folder)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain for each document; a null text has those of no feature."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of each hundredth vector; null, zero and non-finite vectors take no part."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each fiftieth vector; every seventh row's label is first moved on by one, as a known noise of labels."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")))
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0)


def op12_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each text and the weak parts that only together make one; a null text has none."""
    found = credentials.find(table(spark, sf_dir, "documents"))
    base = F.col("spans")
    return found.select("doc_id", *[credentials.count(base, k).alias(f"n_{k}") for k in credentials.KINDS[: credentials.BASE]], F.sha2(credentials.listed(base), 256).alias("base_sha256"), credentials.listed(F.col("all_spans")).alias("spans"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of each conversation after known damage; one that lost all its rows has zeros and an empty audit."""
    return repair.report(repair.damaged(table(spark, sf_dir, "conversations")), F.col("lost"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_decontamination, op3_quality, op4_near_dedup, op5_url_filter, op6_token_counts, op7_mixing, op8_token_ids, op9_toxicity, op10_nearest, op11_hard_negatives, op12_credentials, op13_repair)}
