"""Tables between the steps of a job, as files in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_stored: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under ``spark.checkpoint.dir`` and read it back. Texts take a third less room in zstd than in Spark's default.

    Where that is unset a temporary folder serves if everything runs in one JVM, as in tests; else it is an error.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lexforge/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(keep_until_release(path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan that has fewer splits than the cluster has cores, dealt out to all of them; any other as it is.

    A small table in one file would otherwise be worked on by one core up to the first
    exchange. A table of many files is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def keep_until_release(path: str) -> str:
    """The path of something stored by a job, noted for ``release``."""
    _stored.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what this session's jobs have stored; call it when their results are written or collected."""
    jvm = spark.sparkContext._jvm
    while _stored:
        path = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and every executor can read."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-lexforge-"))
        base = _own[0]
    return base
