"""Components of an index as Parquet folders with a manifest: reuse, staleness, readiness; labels and judgments in files."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.judged import _refuse

SCHEMA_VERSION = 1
LABELS = ("ANSWERABLE", "NEEDS_CLARIFICATION", "NO_SATISFACTORY_REPORT")


def signature(inputs: dict) -> str:
    """SHA-256 of settings, versions and input hashes, by sorted keys."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True).encode()).hexdigest()


def corpus_hash(df: DataFrame) -> str:
    """A hash of all rows that doesn't depend on their order: sums of two row hashes, and the number of rows."""
    names = sorted(df.columns)
    row = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).cast("string")
    return signature({"columns": names, "sums": [str(v) for v in df.agg(total(1), total(2), F.count(F.lit(1))).first()]})


def write_component(df: DataFrame, root: str, name: str, inputs: dict) -> bool:
    """Writes a component unless one of this signature is there; True where it was written. The manifest comes last, so a broken write isn't taken for a component."""
    spark, sig = df.sparkSession, signature(inputs)
    held = manifest(spark, root).where((F.col("component") == name) & (F.col("signature") == sig))
    if held.take(1):
        return False
    path = f"{root}/components/{name}/{sig[:16]}"
    df.write.mode("overwrite").parquet(path)
    row = [(name, sig, SCHEMA_VERSION, path, inputs.get("corpus", ""))]
    spark.createDataFrame(row, "component string, signature string, schema_version int, path string, corpus string").withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return True


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(component, signature, schema_version, path, corpus, written); no rows where nothing was written yet."""
    form = "component string, signature string, schema_version int, path string, corpus string, written timestamp"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], form)
    return spark.read.schema(form).parquet(f"{root}/manifest")


def read_component(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The component written last; an unknown one or another schema version raises ValueError."""
    last = manifest(spark, root).where(F.col("component") == name).orderBy(F.col("written").desc(), "signature").take(1)
    if not last:
        raise ValueError(f"no component {name}")
    if last[0].schema_version != SCHEMA_VERSION:
        raise ValueError(f"component {name} has schema version {last[0].schema_version}")
    return spark.read.parquet(last[0].path)


def readiness(components: DataFrame, wanted: DataFrame, corpus: str) -> DataFrame:
    """(component, state, blocks): READY, STALE where made from another corpus, MISSING; required ones that aren't ready block, as do optional ones without a fallback.

    components: a manifest; wanted: (component, required, fallback).
    """
    last = components.groupBy("component").agg(F.max_by("corpus", "written").alias("made_from"))
    x = wanted.join(last, "component", "left")
    state = F.when(F.col("made_from").isNull(), "MISSING").when(F.col("made_from") == corpus, "READY").otherwise("STALE")
    x = x.withColumn("state", state)
    return x.select("component", "state", ((F.col("state") != "READY") & (F.col("required") | F.col("fallback").isNull())).alias("blocks"))


def read_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, label 0..2) of a CSV file, with or without a byte order mark; case and space in labels don't matter, unknown ones fail."""
    x = spark.read.option("header", True).csv(path)
    x = x.toDF(*[c.lstrip("\ufeff").strip() for c in x.columns])
    key = next((c for c in ("scenario_id", "Scenario ID") if c in x.columns), None)
    if key is None or not {"answerability", "Answerability"} & set(x.columns):
        raise ValueError("columns of scenario id and answerability are needed")
    label = next(c for c in ("answerability", "Answerability") if c in x.columns)
    named = F.upper(F.regexp_replace(F.trim(label), r"[\s-]+", "_"))
    code = F.create_map(*[F.lit(v) for k, name in enumerate(LABELS) for v in (name, k)])
    x = x.select(F.trim(key).alias("scenario_id"), F.col(label).alias("given"), F.try_element_at(code, named).alias("label"))
    _refuse(x.where("label is null"), "unknown label")
    return x.drop("given")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, label) of a Parquet file with either spelling of the id; codes outside 0..2 fail."""
    x = spark.read.parquet(path)
    key = "scenario_id" if "scenario_id" in x.columns else "Scenario ID"
    x = x.select(F.col(key).cast("string").alias("scenario_id"), F.col("answerability_label").cast("int").alias("label"))
    _refuse(x.where("label is null or label not between 0 and 2"), "unknown label code")
    return x


def read_seed_judgments(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """(scenario_id, report_key, title, grade) of JSON lines; ids, grades, uniqueness and the catalog's titles are checked. catalog: (report_key, title)."""
    form = "`Scenario ID` string, `Report Key` string, `Report Title` string, `Synthetic Relevance Grade` int"
    x = spark.read.schema(form).option("mode", "FAILFAST").json(path).toDF("scenario_id", "report_key", "title", "grade")
    _refuse(x.where("scenario_id is null or report_key is null or not rlike(scenario_id, '^Q[0-9]{5}$') or not rlike(report_key, '^R[0-9]{4}$')"), "malformed id")
    _refuse(x.where("grade is null or grade not between 0 and 3"), "grade outside 0..3")
    _refuse(x.groupBy("scenario_id", "report_key").count().where("count > 1"), "judged twice")
    known = catalog.select("report_key", F.trim("title").alias("known"))
    _refuse(x.join(known, "report_key", "left").where("known is null or not trim(title) <=> known"), "title differs from the catalog")
    return x


def write_dataset(scenarios: DataFrame, judgments: DataFrame, splits: DataFrame, root: str) -> dict:
    """Scenarios as CSV, judgments as JSON lines, splits as lists of ids; a manifest with a content hash of each. Nothing is overwritten."""
    scenarios.write.option("header", True).csv(f"{root}/scenarios")
    judgments.write.json(f"{root}/judgments")
    for name in [r.split for r in splits.select("split").distinct().orderBy("split").collect()]:
        splits.where(F.col("split") == name).select("id").orderBy("id").write.text(f"{root}/splits/{name}")
    made = {"schema": SCHEMA_VERSION, "scenarios": corpus_hash(scenarios), "judgments": corpus_hash(judgments), "splits": corpus_hash(splits)}
    scenarios.sparkSession.createDataFrame([(json.dumps(made, sort_keys=True),)], "value string").coalesce(1).write.text(f"{root}/manifest")
    return made


def write_revision(annotations: DataFrame, root: str) -> int:
    """Writes annotations as the next revision and returns its number. No revision is ever overwritten: where another writer was faster, this one fails."""
    spark = annotations.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = [int(s.getPath().getName().split("-")[1]) for s in files.listStatus(path) if s.getPath().getName().startswith("revision-")] if files.exists(path) else []
    number = max(known, default=0) + 1
    annotations.write.mode("errorifexists").parquet(f"{root}/revision-{number:05d}")
    return number
