"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of this machine's, and only if Spark runs on it alone."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", "") or _local.get(sc.applicationId, "")
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_settled: dict[str, list[str]] = {}


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    _settled.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """How many tables have been settled so far."""
    return len(_settled.get(spark.sparkContext.applicationId, []))


def clear(spark: SparkSession, since: int, result: DataFrame) -> DataFrame:
    """The result, after removing all tables settled since the mark that it doesn't read.

    The driver collects its garbage then: what Spark holds of the finished plans (shuffles, broadcasts, generated
    code) goes only with them, and would add up over the many plans of a loop.
    """
    paths = _settled.get(spark.sparkContext.applicationId, [])
    read = {name.rsplit("/", 2)[-2] for name in result.inputFiles()}
    files = spark._jvm.org.apache.hadoop.fs
    kept = []
    for path in paths[since:]:
        if path.rsplit("/", 1)[-1] in read:
            kept.append(path)
        else:
            place = files.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths[since:] = kept
    spark._jvm.System.gc()
    return result


def lean(judge):
    """The same function over batches; at its end the worker, which serves further tasks, gives unused memory back."""

    @functools.wraps(judge)
    def run(batches, *rest):
        try:
            yield from judge(batches, *rest)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return run


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carry(docs: DataFrame, needs: Sequence[tuple[str, str]], judge: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], result: str, drop: int = 0) -> tuple[DataFrame, list[str]]:
    """All columns of docs beside those that judge finds for each row, and the names of the latter.

    judge takes batches of the needed columns (name, type) and gives as many rows in the same
    order; its first columns, drop in number, are left out. No row leaves its partition.
    """
    types = {f.name: f.dataType for f in docs.schema.fields}
    own = [F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns)]
    extra, place = [], []
    for name, kind in needs:
        if types[name].simpleString() == ("bigint" if kind == "long" else kind):
            place.append(docs.columns.index(name))
        else:
            place.append(len(own) + len(extra))
            extra.append(F.col(quoted(name)).cast(kind).alias(f"x{len(extra)}"))
    fields = T._parse_datatype_string(result).fields[drop:]
    n = len(own)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in judge(iter([pa.RecordBatch.from_arrays([batch.column(k) for k in place], [name for name, _ in needs])])):
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, rows) for k in range(n)), *part.columns[drop:]], [*(f"c{k}" for k in range(n)), *(f"r{k}" for k in range(len(fields)))])
                at += rows
            if at != batch.num_rows:
                raise ValueError("a row has no result")

    shape = T.StructType([*(T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)), *(T.StructField(f"r{k}", f.dataType) for k, f in enumerate(fields))])
    names = [f.name + "_" * sum(c.startswith(f.name) for c in docs.columns) for f in fields]
    found = docs.select(*own, *extra).mapInArrow(run, shape)
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], *[F.col(f"r{k}").alias(c) for k, c in enumerate(names)]), names


def file_system(uri: str):
    """(Arrow file system, path) of a URI; s3a:// is read as s3://."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("/"):
        uri = uri.replace("file:", "", 1)
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_file(folder: str, name: str, chunks) -> int:
    """Write a whole file under a private name, then move it to its own: a repeated task replaces it by the same bytes."""
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    private = f"{path}/.{name}.{uuid.uuid4().hex}"
    size = 0
    with files.open_output_stream(private) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    files.move(private, f"{path}/{name}")
    return size


def open_file(folder: str, name: str):
    files, path = file_system(folder)
    return files.open_input_file(f"{path}/{name}")
