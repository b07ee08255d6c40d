"""Judged data in files: JSON lines, CSV and lists of ids, checked on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QRELS = "query_id string, query string, relevant map<string,int>, answerable boolean, slice string, label_source string, required_fields array<string>, title_terms_any array<string>, title_terms_all array<string>, categories array<string>, excluded_fields array<string>"
SPLITS = ("train", "validation", "calibration", "test")


def _refuse(bad: DataFrame, what: str) -> None:
    if first := bad.take(1):
        raise ValueError(f"{what}: {first[0].asDict()}")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON lines file; blank lines are passed over, a malformed line fails."""
    return spark.read.schema(QRELS).option("mode", "FAILFAST").json(path)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios of a CSV file with a header, by id; ids must be unique and like Q00001. Tags become a list."""
    x = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    _refuse(x.where("`Scenario ID` is null or not rlike(`Scenario ID`, '^Q[0-9]{5}$')"), "malformed scenario id")
    _refuse(x.groupBy("Scenario ID").count().where("count > 1"), "repeated scenario id")
    tags = F.filter(F.transform(F.split("Edge Case Tags", ";"), lambda v: F.trim(v)), lambda v: v != "")
    return x.withColumn("Edge Case Tags", F.coalesce(tags, F.array().cast("array<string>"))).orderBy("Scenario ID")


def read_splits(spark: SparkSession, folder: str, scenarios: DataFrame) -> DataFrame:
    """(id, split) from files of one id a line; splits must be disjoint and cover exactly the scenarios' ids."""
    parts = [spark.read.text(f"{folder}/{name}.txt").select(F.trim("value").alias("id"), F.lit(name).alias("split")) for name in SPLITS]
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    x = x.where("id <> ''").distinct()
    _refuse(x.groupBy("id").count().where("count > 1"), "id in several splits")
    known = scenarios.select(F.col("Scenario ID").alias("id"))
    _refuse(known.join(x, "id", "left_anti").unionByName(x.select("id").join(known, "id", "left_anti")), "splits and scenarios differ in")
    return x
