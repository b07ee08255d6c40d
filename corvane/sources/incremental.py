"""A keyed store that is refreshed by what changed: rows by fingerprint, buckets copied on write, versions by manifest.

A row has a key, a version of its own (a source's time or counter), a fingerprint of what it is made from, and what was made. Keys are
dealt into buckets by hash. A refresh reads only the buckets of its keys, makes anew only rows whose fingerprint changed, writes those
buckets beside the old ones, and last a manifest that names each bucket's folder; readers see the whole old version or the whole new one.
Of several rows of a key the one of the greatest version counts, whenever it comes, so late, repeated and replayed batches give
what one batch of everything gives. Deleted keys stay as marks. One refresh at a time.

The signature names settings, schemas and whatever else rows are made from: a store of another signature is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.settled import settle

BUCKETS = 256
MARKS = "version long, fingerprint string, deleted boolean, made_in long"


@dataclass(frozen=True)
class Refreshed:
    version: int
    made: int
    reused: int
    late: int
    deleted: int
    buckets: int


@dataclass(frozen=True)
class KeyedStore:
    spark: SparkSession
    root: str
    key: str
    columns: str  # of what is made, as a schema
    signature: str
    buckets: int = BUCKETS

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Finished versions, ascending; a folder without its success mark isn't one."""
        files, path = self._files()
        if not files.exists(path):
            return []
        done = [s.getPath() for s in files.listStatus(path) if s.isDirectory()]
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().split("-")[1]) for p in done if files.exists(at(p, "_SUCCESS")))

    def manifest(self, version: int | None = None) -> tuple[int, dict[int, str], int]:
        """(version, folder of each bucket, the last batch that was applied); (0, {}, -1) where nothing is stored."""
        known = self.versions()
        if not known:
            return 0, {}, -1
        version = known[-1] if version is None else version
        rows = self.spark.read.schema("bucket int, path string, signature string, batch long").parquet(f"{self.root}/manifest/v-{version:08d}").collect()  # a row a bucket
        if any(r.signature != self.signature for r in rows):
            raise ValueError("the store was made with other settings or schemas; it is refused")
        return version, {r.bucket: r.path for r in rows if r.path}, max((r.batch for r in rows), default=-1)

    def _schema(self, df: DataFrame | None = None, kind: str = "") -> str:
        kind = kind or df.schema[self.key].dataType.simpleString()
        return f"`{self.key}` {kind}, {MARKS}, {self.columns}"

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, kind: str, version: int | None = None, marks: bool = False) -> DataFrame:
        """Rows of a version (the last, if none is named); kind is the key's type. marks adds version, fingerprint and the refresh that made each row."""
        _, paths, _ = self.manifest(version)
        x = self._read(sorted(paths.values()), self._schema(kind=kind)).where(~F.col("deleted"))
        return x.drop("deleted") if marks else x.drop("version", "fingerprint", "deleted", "made_in")

    def refresh(self, changes: DataFrame, make: Callable[[DataFrame], DataFrame], batch: int = -1) -> Refreshed:
        """Takes in changes (key, version, fingerprint, deleted, and whatever make needs); make gives (key, columns) of the rows it is handed, one for each.

        A batch number that was applied before changes nothing. Null keys are left out.
        """
        at, paths, applied = self.manifest()
        if 0 <= batch <= applied:
            return Refreshed(at, 0, 0, 0, 0, 0)
        k, schema = F.col(self.key), self._schema(changes)
        best = F.max_by(F.struct(*changes.columns), F.struct("version", F.coalesce("deleted", F.lit(False)), F.coalesce("fingerprint", F.lit(""))))
        new = changes.where(k.isNotNull()).groupBy(self.key).agg(best.alias("r")).select("r.*").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
        new = settle(new.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        held = self._read([paths[b] for b in touched if b in paths], schema).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        old = held.select(self.key, F.col("version").alias("_v"), F.col("fingerprint").alias("_f"), F.col("deleted").alias("_d"))
        late = F.col("_v") >= F.col("version")
        same = ~F.col("deleted") & ~F.col("_d") & (F.col("_f") == F.col("fingerprint"))
        what = F.when(late, "late").when(F.col("deleted"), "deleted").when(same, "reused").otherwise("made")
        x = settle(new.join(old, self.key, "left").withColumn("what", F.coalesce(what, F.when(F.col("deleted"), "deleted").otherwise("made"))))
        counts = {r.what: r.n for r in x.groupBy("what").agg(F.count(F.lit(1)).alias("n")).collect()}
        version = at + 1
        names = [f.split()[0] for f in self.columns.split(", ")]
        changed = x.where("what = 'made'")
        fresh = make(changed.select(*changes.columns)).select(self.key, *names)
        fresh = changed.select(self.key, "version", "fingerprint", "deleted", "bucket").join(fresh, self.key).withColumn("made_in", F.lit(version).cast("long"))
        gone = x.where("what = 'deleted'").select(self.key, "version", "fingerprint", "deleted", "bucket", *[F.lit(None).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in self.columns.split(", "))]).withColumn("made_in", F.lit(version).cast("long"))
        moved = x.where("what = 'reused'").select(self.key, F.col("version").alias("_new"))
        kept = held.join(x.where("what in ('made', 'deleted')").select(self.key), self.key, "left_anti").join(moved, self.key, "left").withColumn("version", F.coalesce("_new", "version")).drop("_new")
        rows = kept.unionByName(fresh).unionByName(gone)
        folder = f"{self.root}/data/v-{version:08d}"
        if counts.get("made") or counts.get("reused") or counts.get("deleted"):
            rows.repartition(min(len(touched), self.buckets) or 1, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
            paths = paths | {b: f"{folder}/bucket={b}" for b in touched}
        listed = [(b, p, self.signature, batch if batch >= 0 else applied) for b, p in sorted(paths.items())] or [(-1, "", self.signature, batch)]
        self.spark.createDataFrame(listed, "bucket int, path string, signature string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v-{version:08d}")
        return Refreshed(version, counts.get("made", 0), counts.get("reused", 0), counts.get("late", 0), counts.get("deleted", 0), len(touched))


def feature_passes(store: KeyedStore, requests: DataFrame, described: Callable[[DataFrame], DataFrame]) -> Refreshed:
    """Candidates' features of each request as arrays of their own length, made anew only for requests whose text changed.

    requests: (query_id, text, version); described gives (query_id, ids, x, grades) of those it is handed. The store's signature should name the features and the configuration.
    """
    changes = requests.select("query_id", "version", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"), F.lit(False).alias("deleted"), "text")
    return store.refresh(changes, described)
