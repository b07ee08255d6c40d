"""An append-only sink of shown results that holds every idempotency key once, however late it comes again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256


def append_impressions(stream: DataFrame, path: str, checkpoint: str, key: str = "idempotency_key", time: str = "ts", buckets: int = BUCKETS):
    """Starts a query that appends a stream's new keys as Parquet and ends when it has taken what is there.

    A batch keeps each key's earliest row and leaves out keys that are stored; rows without a key are left out. The store is
    partitioned by a hash of the key, and a batch's join reads the key column of its own keys' buckets only. A batch that runs again after a failure
    finds its own rows stored, so it appends only what was missing. One query at a time may append to a path.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rest = F.struct(*[c for c in batch.columns if c not in (key, time)]) if len(batch.columns) > 2 else F.struct(F.lit(0))
        first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.struct(F.col(time), F.xxhash64(rest))).alias("r")).select("r.*")
        new = first.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if _stored(spark, path):
            new = new.persist()
            # only folders of the batch's buckets are read
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]
            held = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select("bucket", key)
            new.join(held, ["bucket", key], "left_anti").write.mode("append").partitionBy("bucket").parquet(path)
            new.unpersist()
            return
        new.write.mode("append").partitionBy("bucket").parquet(path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark, path: str) -> bool:
    """Whether the path holds rows' files; an empty first batch leaves none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(p) and any(s.isDirectory() for s in files.listStatus(p))
