"""Catalog-shaped views of the tables in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENERATORS = ("bm25f", "dense", "splade")
LINES = 250_000  # order lines that a task gathers by part


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(x: DataFrame, key: str) -> DataFrame:
    """The same rows in as many tasks as shuffles have, however few row groups a file has: words are cut more slowly than texts are moved."""
    return x.repartition(max(x.sparkSession.sparkContext.defaultParallelism, int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: id, title, family, category, data_source, fields, prompts, runs, last_run; unused parts have nulls and empty lists."""
    used = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")
    # lists are gathered in as many tasks as there are lines for, so that a task's memory doesn't grow with the table
    tasks = -(-used.count() // LINES)
    used = used.repartition(tasks, "l_partkey") if tasks > 1 else used
    use = used.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("runs"), F.max("l_shipdate").alias("last_run"),
        F.sort_array(F.collect_set(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))).alias("fields"),
        F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("prompts"),
    )
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "part").join(use, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lower("p_name").alias("family"), F.col("p_brand").alias("category"), F.col("p_type").alias("data_source"),
        F.coalesce("fields", none).alias("fields"), F.coalesce("prompts", none).alias("prompts"), "runs", "last_run",
    )


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored hits of three generators under six query variants: suppliers as queries, parts as instances."""
    x = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("instance_id"),
        F.when(F.col("l_returnflag") == "A", "bm25f").when(F.col("l_returnflag") == "N", "dense").otherwise("splade").alias("generator"),
        F.concat(F.lit("Q"), ((F.col("l_linenumber") - 1) % 6).cast("string")).alias("variant"), F.col("l_extendedprice").alias("score"),
    )
    # placed once for both readers of the same rows, the greatest score and the rank within (query, generator, variant)
    return x.repartition("query_id", "generator", "variant").groupBy("query_id", "generator", "variant", "instance_id").agg(F.max("score").alias("score"))
