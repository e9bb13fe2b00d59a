"""Ingestion that goes on where it stopped: rows in numbered batches, each a folder of its own, and a manifest of counts.

A batch is written first and listed afterwards. A batch counts as done if the manifest has it with the count and the
digest that the source has now; all others are written anew, each over what may be left of it. So a run after a failure
adds nothing twice, wherever the failure was, and a run with nothing new writes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.storage import exists

MANIFEST = "batch int, n long, digest long"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(batch, n, digest) as last listed; a row for each batch."""
    path = f"{root.rstrip('/')}/manifest"
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema("batch int, n long, digest long, listed timestamp").parquet(path)
    return rows.groupBy("batch").agg(F.max_by(F.struct("n", "digest"), "listed").alias("x")).select("batch", "x.*")


def ingest(rows: DataFrame, root: str, key: str, batches: int = 16, at_once: int = 8, stop_after: int | None = None) -> list[int]:
    """Stores the batches of rows that aren't stored yet, or not as they are now; the numbers of those that were.

    A row's batch hangs on its key alone. One pass over the rows counts them all, and another one stores `at_once` batches,
    which are what a failure can undo. stop_after leaves off after so many, for budgets of time and for tests.
    """
    spark = rows.sparkSession
    mark: Column = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
    # sums of hashes by 32 bits each, so that no order matters and nothing overflows
    now = dealt.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(mark, F.lit(1 << 31))).alias("digest"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("batch", "n", "digest")]
    wanted = now.alias("a").join(manifest(spark, root).alias("b"), same, "left_anti").orderBy("batch").collect()  # a row for each batch
    todo, path = wanted[:stop_after], root.rstrip("/")
    for low in range(0, len(todo), at_once):
        part = todo[low : low + at_once]
        mine = dealt.filter(F.col("batch").isin([r.batch for r in part]))
        mine.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/rows")
        listed = spark.createDataFrame([tuple(r) for r in part], MANIFEST).withColumn("listed", F.current_timestamp())
        listed.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return [r.batch for r in todo]


def ingested(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of all batches that the manifest lists, with batch."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(f"{root.rstrip('/')}/rows")
    return rows.join(F.broadcast(manifest(spark, root).select("batch")), "batch", "left_semi")


def ingest_stream(stream: DataFrame, root: str, checkpoint: str) -> None:
    """What a stream has now, a folder for each micro-batch: one that runs again after a failure takes its own folder's place."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/rows/batch={batch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
