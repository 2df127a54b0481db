"""What the operators share: tables in the folder all executors see, file systems, partition counts."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.tables import new_path, shared_dir, write_scratch

__all__ = ["file_system", "narrow_batches", "new_path", "partitions_for", "release", "shared_dir", "write_table"]

write_table = write_scratch


def release(spark: SparkSession) -> None:
    """Delete everything that this application has written into the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}")
    path.getFileSystem(conf).delete(path, True)


#: Hadoop's names of file systems that Arrow knows by another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss", "viewfs": "hdfs"}


def arrow_uri(uri: str) -> str:
    """A URI of a Hadoop file system, or a plain path, as Arrow names it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return "file://" + uri
    return f"{_SCHEMES.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or plain path, and the path in it.

    Known are file, hdfs and viewfs, s3 (s3a, s3n), gs and abfs(s) (wasb(s)), as far as Arrow was built with them.
    """
    try:
        return pafs.FileSystem.from_uri(arrow_uri(uri))
    except pa.ArrowInvalid as e:
        raise ValueError(f"binary files can't be kept at {uri}: Arrow has no such file system") from e


def partitions_for(df: DataFrame, target_bytes: int) -> int:
    """How many partitions of about ``target_bytes`` of stored input each there are.

    By Spark's estimates of the sources' sizes; where one has none, as many as the input has partitions.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= 1 << 60:
        return df.rdd.getNumPartitions()
    return max(1, -(-size // target_bytes))


def narrow_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Arrow batches of whole texts with few rows, so that a Python worker holds little at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
