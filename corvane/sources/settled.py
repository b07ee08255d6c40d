"""Cutting the lineage of tables that loops or several stages read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of this machine's, and only if Spark runs on it alone."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def files(uri: str):
    """(Arrow file system, path) of a folder that settled files are in; s3a:// is read as s3://."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("/"):
        uri = uri.replace("file:", "", 1)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
