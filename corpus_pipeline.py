"""A training-data pipeline over `documents`: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import forest, leaks, mixing, shared, tokens, toxicity
from corvane.llm.queries import table, vocabulary


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows of docs with a number of their own that never changes: verdicts are a row's, whatever its doc_id.

    It is the row's place in its file beside the file's number; the list of files is small. Rows
    that don't come straight from files are written first.
    """
    name = "row" + "_" * sum(c.startswith("row") for c in docs.columns)
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(name + "_file"), F.col("_metadata.row_index").alias(name + "_place"))
    except AnalysisException:
        return shared.settle(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    files = sorted(r[0] for r in placed.select(name + "_file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame([(f, k) for k, f in enumerate(files)], f"{name}_file string, {name}_number long")
    return placed.join(F.broadcast(numbers), name + "_file").select(*docs.columns, (F.shiftleft(name + "_number", 40) + F.col(name + "_place")).alias(name))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject; a null or empty text has no sign of toxicity and stays, repeated rows are judged alike."""
    since = shared.mark(spark)
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.categories())
    rows, found = toxicity.scored(docs, chain)
    return shared.clear(spark, since, rows.where(~(F.col(found[-1]) >= 0.5)).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group; a null id is the largest, of equal ids the first row stays. Rows without words are groups of their own and stay."""
    rows = _numbered(docs)
    row = rows.columns[-1]
    found = forest.near_duplicates(rows, key=row).select(F.col("doc_id").alias("row_of"), "component_id")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row_of")))["row_of"]
    kept = rows.select(F.col(row).alias("row_of"), F.col("doc_id").alias("id")).join(found, "row_of").groupBy("component_id").agg(first.alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; a null text has none. An empty benchmark removes nothing."""
    rows, (_, n_hit, _) = leaks.judged(docs, table(spark, sf_dir, "benchmark"))
    return rows.where(F.col(n_hit) == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it; a part of one half or more counts as one.

    Documents without words take no place in the mix and leave it here. A null source is a source of its own.
    """
    mixed = mixing.mix(docs, keep=[c for c in docs.columns if c != "doc_id"])
    return mixing.in_training_order(mixed).select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, read back: one row per document and repetition, in ascending order of ids, null first."""
    folder = shared.new_folder(spark, "ids")
    return tokens.read_ids(tokens.write_ids(docs, vocabulary(), folder), folder)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("token_ids", write_token_ids)]

#: No SQL: the first stage is a trained model. tests/llm/test_pipeline_stages.py checks it on labelled documents and each later stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents: (doc_id, start, n_tokens, ids_crc32) of each row that the last stage wrote. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.settle(docs, name)
    return docs
