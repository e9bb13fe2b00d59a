"""What the operators of this subpackage share: table access, the shared folder and cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one of our own where it is unset (tests)."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or getattr(spark, "_seamline_dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="seamline-")
        spark._seamline_dir = at
    return at


def _written_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/seamline-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: later steps don't depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{_written_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_written(spark: SparkSession) -> None:
    """Deletes what written() has stored for this application; results that still read it must be stored before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_written_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole(text: str = "text") -> Column:
    """The text column; a null text counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def fold_of(doc_id: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; a null id reads as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod
