"""A confusion matrix of a stream of predictions: cells are the stream's state, and each batch leaves a whole matrix.

The matrix after a batch is a table of its own, named for the batch; a batch that runs again after a failure writes the
same table again. A run that starts from the checkpoint goes on with the cells as they were. Matrices of parts that were
counted apart add up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators.evaluation import confusion
from seamline.storage import exists

CELLS = "label int, pred int, n long"


def count_predictions(predictions: DataFrame, root: str, checkpoint: str) -> int:
    """Counts what the stream of (label, pred) rows has now into the matrix at root; the number of batches that were run."""

    def keep(cells: DataFrame, batch: int) -> None:
        # one row for each cell, classes x classes at most; an exchange, as coalesce(1) would go through all partitions of the state in one task
        cells.select("label", "pred", "n").repartition(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch:012d}")

    run = confusion(predictions).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(1 for p in run.recentProgress if p["numInputRows"])


def counted(spark: SparkSession, root: str) -> DataFrame:
    """(label, pred, n) after the last batch that was finished; none before the first."""
    if not exists(spark, root):
        return spark.createDataFrame([], CELLS)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs_path)]
    done = [n for n in sorted(names) if exists(spark, f"{root.rstrip('/')}/{n}/_SUCCESS")]
    return spark.read.schema(CELLS).parquet(f"{root.rstrip('/')}/{done[-1]}") if done else spark.createDataFrame([], CELLS)


def added_up(*parts: DataFrame) -> DataFrame:
    """One matrix from matrices of parts."""
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("label", "pred").agg(F.sum("n").alias("n"))
