"""From an exported catalog to a corpus: headers by alias, rows checked and numbered, fields split, families collapsed, a summary.

A workbook is read as its CSV or Parquet export; Spark has no reader of workbooks.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

#: Logical columns and the headers that name them.
ALIASES = {
    "report_name": ("Custom Report", "Report Name", "Report"),
    "report_tags": ("Report Tag(s)", "Report Tags", "Tags"),
    "category": ("Category",),
    "worklet_landing_pages": ("Worklet Landing Pages",),
    "owner": ("Owner",),
    "created_by": ("Created by", "Created By"),
    "description": ("Description",),
    "created_date": ("Created Date",),
    "available_usage": ("Available Usage",),
    "number_of_times": ("Number of Times", "Number of Times Executed", "Number of Times Run", "Run Count"),
    "last_updated_date": ("Last Updated Date",),
    "last_run_date": ("Last Run Date",),
    "last_run_by": ("Last Run By",),
    "data_source": ("Data Source",),
    "report_type": ("Report Type",),
    "worklet": ("Worklet",),
    "chart_type": ("Chart Type",),
    "shared": ("Shared",),
    "landing_page": ("Landing Page",),
    "report_prompts": ("Report Prompts", "Prompts"),
    "area_where_used": ("Area Where Used",),
    "fields": ("Fields",),
}
REQUIRED = ("report_name",)
#: The header is the third physical row, so data start at the fourth.
FIRST_DATA_ROW = 4
FIELD = "struct<business_object:string,field_name:string,description:string,field_key:string,match_confidence:double,ambiguity_status:string>"
#: Columns that never reach a search view.
SENSITIVE = ("available_usage", "owner", "created_by", "last_run_by")


def header_key(name: object) -> str:
    """Same rule as `text.normalize_header`, for the few names of a table's columns."""
    s = unicodedata.normalize("NFKC", "" if name is None else str(name))
    return "" if s.strip().lower() in T.BLANKS else re.sub("[^0-9a-zA-Z]+", " ", s).strip().lower()


def resolve(columns: list[str], aliases: dict[str, tuple[str, ...]] = ALIASES, required: tuple[str, ...] = REQUIRED) -> dict[str, str]:
    """Logical name to the first column that one of its headers names; a missing required column fails."""
    by_key: dict[str, str] = {}
    for c in columns:
        by_key.setdefault(header_key(c), c)
    hits = {k: [by_key[header_key(h)] for h in names if header_key(h) in by_key] for k, names in aliases.items()}
    found = {k: v[0] for k, v in hits.items() if v}
    if missing := [k for k in required if k not in found]:
        raise ValueError(f"required columns are missing: {missing}; found {columns}")
    return found


def load_raw(spark: SparkSession, path: str, header_row: int = 3, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A CSV export whose header is a given physical row: stripped headers, rows without a title dropped, physical rows numbered.

    Only the few lines up to the header come to the driver. Values in quotes may not hold line ends.
    """
    lines = spark.read.text(path)
    head = lines.limit(header_row).collect()
    if len(head) < header_row:
        raise ValueError(f"{path} has {len(head)} rows; the header is row {header_row}")
    names = [c.strip() for c in spark.read.csv(spark.sparkContext.parallelize([head[-1]["value"]], 1)).first()]
    resolved = resolve(names, required=required)
    numbered = numbered_rows(lines, "source_row", 1).where(F.col("source_row") > header_row)
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    cells = numbered.select("source_row", F.from_csv("value", schema).alias("r"))
    out = cells.select("source_row", *[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    return out.where(T.display(F.col(f"`{resolved['report_name']}`")) != "")


def numbered_rows(x: DataFrame, name: str, first: int = 0) -> DataFrame:
    """Rows with consecutive numbers in the order they are read: a count a partition, then numbers within, no sort over all rows.

    Of a file source, whose partitions are the same each time they are read.
    """
    y = x.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    # one row a partition: bounded by the number of input splits
    counts = y.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_s", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_s")
    # monotonically_increasing_id counts up from partition * 2^33
    place = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    return y.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + place + first).drop("_p", "_m", "_s")


def records(raw: DataFrame, order: str) -> DataFrame:
    """Catalog records of a table with any headers: display cells under logical names, title-less rows passed over.

    `order` numbers the physical rows from 0, gaps allowed. report_key is R and the physical row, row_index counts the rows
    kept; repeated keys fail. Columns that a table lacks are empty.
    """
    at = resolve(raw.columns)
    cell = lambda k: T.display(F.col(f"`{at[k]}`").cast("string")) if k in at else F.lit("")
    x = raw.select(F.col(order).cast("long").alias("position"), *[cell(k).alias(k) for k in ALIASES]).where("report_name <> ''")
    x = x.withColumn("source_row", F.col("position") + FIRST_DATA_ROW)
    key = F.concat(F.lit("R"), F.when(F.length(F.col("source_row").cast("string")) >= 4, F.col("source_row").cast("string")).otherwise(F.lpad(F.col("source_row").cast("string"), 4, "0")))
    x = x.withColumn("report_key", key).withColumn("title_key", T.match_key(F.col("report_name"))).withColumn("data_source_key", T.match_key(F.col("data_source")))
    return row_index(x)


def row_index(x: DataFrame, buckets: int = 4096) -> DataFrame:
    """Dense numbers in order of position: counts of position buckets first, then numbers within a bucket, so no task orders all rows."""
    bucket = x.withColumn("_b", F.floor(F.col("position") / buckets))
    starts = bucket.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_s", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).select("_b", "_s")
    within = F.row_number().over(Window.partitionBy("_b").orderBy("position"))
    return bucket.withColumn("_w", within).join(starts, "_b").withColumn("row_index", F.col("_s") + F.col("_w") - 1).drop("_b", "_w", "_s")


def refuse_repeated_keys(x: DataFrame) -> None:
    if bad := x.groupBy("report_key").count().where("count > 1").take(10):
        raise ValueError(f"repeated report_key: {sorted(r.report_key for r in bad)}")


def field_meta(fields: Column) -> Column:
    """Fields of a cell, each once by its match key, as structs with confidence 1 and a key of the form |name."""
    one = lambda v: F.struct(F.lit("").alias("business_object"), v.alias("field_name"), F.lit("").alias("description"), F.concat(F.lit("|"), T.match_key(v)).alias("field_key"), F.lit(1.0).alias("match_confidence"), F.lit("RESOLVED").alias("ambiguity_status"))
    return F.transform(T.split_multi(fields), one)


def link_quality(meta: str = "field_meta") -> list:
    """Columns of a row's links: mean confidence, ambiguous ones and their share; rows without fields have zeros."""
    m, n = F.col(meta), F.size(meta)
    unclear = F.size(F.filter(m, lambda f: f["ambiguity_status"] == "AMBIGUOUS"))
    mean = F.aggregate(m, F.lit(0.0), lambda s, f: s + f["match_confidence"])
    return [
        F.when(n > 0, mean / n).otherwise(0.0).alias("field_link_confidence"), unclear.cast("long").alias("ambiguous_field_count"),
        F.when(n > 0, unclear / n).otherwise(0.0).alias("ambiguous_link_fraction"), (unclear > 0).alias("has_ambiguous_fields"),
    ]


def row_corpus(raw: DataFrame, order: str) -> DataFrame:
    """Row granularity: records with their fields and link quality."""
    x = records(raw, order).withColumn("field_meta", field_meta(F.col("fields")))
    return x.select("*", *link_quality())


def family_corpus(raw: DataFrame, order: str) -> DataFrame:
    """Family granularity: of each title key the most run row (then the most recently run, then the first), with the columns of the other form, empty."""
    x = records(raw, order).withColumn("runs", F.coalesce(F.expr("try_cast(number_of_times as double)"), F.lit(0.0))).withColumn("ran", F.expr("try_cast(last_run_date as timestamp)"))
    best = F.max_by(F.struct(*[c for c in x.columns if c not in ("runs", "ran", "title_key")]), F.struct("runs", F.coalesce("ran", F.lit("0001-01-01").cast("timestamp")), (-F.col("position")).alias("p")))
    g = x.groupBy("title_key").agg(best.alias("r"), F.sum("runs").alias("runs_total"), F.count(F.lit(1)).alias("members"))
    y = g.select("title_key", "runs_total", "members", "r.*").withColumn("field_meta", F.array().cast(f"array<{FIELD}>"))
    return y.select("*", *link_quality())


def build_corpus(raw: DataFrame, order: str, granularity: str = "row") -> tuple[DataFrame, DataFrame]:
    """(corpus, one-row summary). In the summary null says that the path doesn't measure a count, zero that it found none."""
    if granularity not in ("row", "family"):
        raise ValueError(f"unknown granularity: {granularity}")
    corpus = row_corpus(raw, order) if granularity == "row" else family_corpus(raw, order)
    return corpus, summary(raw, corpus, granularity)


def summary(raw: DataFrame, corpus: DataFrame, granularity: str) -> DataFrame:
    read = raw.agg(F.count(F.lit(1)).alias("report_rows_read"))
    if granularity == "family":
        kept = corpus.agg(F.coalesce(F.sum("members"), F.lit(0)).alias("valid_reports_loaded"), F.count(F.lit(1)).alias("families"), *[F.lit(None).cast("long").alias(c) for c in ("duplicate_identities", "duplicate_rows", "links", "without_fields")])
    else:
        by_title = corpus.groupBy("title_key", "data_source_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("field_meta")).alias("links"), F.count_if(F.size("field_meta") == 0).alias("none"))
        kept = by_title.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("valid_reports_loaded"), F.count_distinct("title_key").alias("families"), F.count_if(F.col("n") > 1).alias("duplicate_identities"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.coalesce(F.sum("none"), F.lit(0)).alias("without_fields"),
        )
    return read.crossJoin(kept)  # one row each


def searchable(x: DataFrame) -> DataFrame:
    """Without the columns that no view or answer may show."""
    return x.drop(*SENSITIVE)


def source_version(spark: SparkSession, path: str) -> str:
    """16 hexadecimal digits of the SHA-256 of all files' digests in order of name; `absent` where there is none."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return "absent"
    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("h")).groupBy().agg(F.sort_array(F.collect_list(F.struct("name", "h"))).alias("f"))
    got = files.select(F.when(F.size("f") == 1, F.col("f")[0]["h"]).otherwise(F.sha2(F.array_join(F.col("f.h"), ","), 256)).alias("v")).first()["v"]
    return got[:16]
