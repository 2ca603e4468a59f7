"""What the operators share: durable intermediate tables, table access, Arrow helpers."""

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/loomgraph-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused folder below shared_dir; all of it goes when the driver ends."""
    base = shared_dir(spark)
    known = worker_cache("shared_dirs", set)
    if base not in known:
        known.add(base)
        atexit.register(remove_path, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system; one that is gone, or a stopped session, is no error."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have ended before
        pass


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch where rows hold whole texts, or two of them.
TEXT_ROWS = 1000


def durable(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and lost executors lose nothing.

    texts: Python functions on the way get whole texts, so batches are kept to TEXT_ROWS rows."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    rows = spark.conf.get(BATCH)
    if texts:
        spark.conf.set(BATCH, min(int(rows), TEXT_ROWS))
    try:
        df.write.parquet(path)
    finally:
        if texts:
            spark.conf.set(BATCH, rows)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """The driver's Python and JVM let go of plans that nothing uses any more, and executors of the shuffle files of
    finished steps, which otherwise stay until the driver's heap happens to be full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*frames: DataFrame) -> None:
    """Deletes the tables of durable frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.startswith(shared_dir(spark)):
                remove_path(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(key, make):
    """An object that lives as long as this Python process, made once by make()."""
    held = sys.__dict__.setdefault("_loomgraph_held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def settle() -> None:
    """Hands what a task has freed back to the system; a Python worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def settled(function):
    """An iterator function for mapInArrow that settles when its partition is done."""

    def run(it):
        yield from function(it)
        settle()

    return run


def as_bytes(column) -> list:
    """A string or binary Arrow column as bytes; null gives b''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    column = column if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(kind)
    return [x or b"" for x in column.to_pylist()]


def batches(rows: list, names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """Tuples to one record batch."""
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=schema.field(n).type) for n, c in zip(names, columns)], schema=schema)


def ascii_lower(c):
    """Lower-cases A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
