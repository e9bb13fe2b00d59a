"""Tables that cut lineage: written once to a folder that all executors share, then read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark, "_seamline_scratch", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="seamline-")
        spark._seamline_scratch = at
    return f"{at.rstrip('/')}/seamline/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a temporary one of a local session."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table, read back: what follows sees one and the same result of steps that may differ from run to run."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def discard(spark: SparkSession, path: str | None = None) -> None:
    """Deletes one folder, or all that this application has stored; results that still read it must be stored before."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or _root(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Tables up to this size are dealt out before work on each row that is much more than reading it.
SMALL_BYTES = 256 << 20


def dealt_out(df: DataFrame) -> DataFrame:
    """df over all cores if it is small: a file with one row group is read by one task, whatever its size.

    Larger tables have row groups enough, and are left as they are: no text is shuffled for this.
    """
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
