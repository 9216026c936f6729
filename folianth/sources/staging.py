"""Tables that cut lineage, written to the folder every machine of the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset a temporary one is made, if all work is done on this machine; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="folianth-"))
        path = _own[0]
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so later plans start there.

    The files outlive a lost executor, unlike cached blocks or shuffle files. They stay until ``release``, as results that
    aren't consumed yet read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals rows out over all cores (by ``keys``), for row-wise Python work on tables of few bytes, which would else be one task."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *keys)


def few_bytes(df: DataFrame) -> bool:
    """Whether a table that is read from files is too small to have a partition of some size for each core."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size < df.sparkSession.sparkContext.defaultParallelism * (16 << 20)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """With scheme and authority, as Spark names the files that it lists."""
    fs, at = _file_system(spark, path)
    return fs.makeQualified(at).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to))


def release(spark: SparkSession) -> int:
    """Delete the tables that this process has staged, once their results have been written: how many."""
    n = len(_made)
    while _made:
        fs, at = _file_system(spark, _made.pop())
        fs.delete(at, True)
    return n
