"""Driver loops over DataFrames: rounds are cut apart by written tables in the folder that all executors share."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KNOWN: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir; a temporary one where that is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(where)
    base = f"{where.rstrip('/')}/loomgraph-rounds-{spark.sparkContext.applicationId}"
    if base not in _KNOWN:
        _KNOWN.add(base)
        atexit.register(_remove, spark, base)
    return base


def _remove(spark: SparkSession, base: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may have ended before
        pass


def cut(df: DataFrame) -> DataFrame:
    """df, written and read back: its lineage ends, and an executor that is lost takes nothing with it."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rounds(state: DataFrame, step, count: int, every: int = 5, done=None) -> tuple[DataFrame, int, bool]:
    """Applies step up to count times. The state is cut after every `every` rounds, or after each if done(old, new)
    has to be asked. Returns the state, the rounds made and whether done held."""
    for k in range(count):
        new = step(state)
        if done:
            new = cut(new)
            if done(state, new):
                return new, k + 1, True
        elif (k + 1) % every == 0 and k + 1 < count:
            new = cut(new)
        state = new
    return state, count, False
