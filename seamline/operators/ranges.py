"""Orders over whole tables without a task that reads them whole: sorted ranges of rows, stored before they are counted.

The bounds of ranges come from a sample that Spark draws for each exchange, so two branches of one plan may cut a table
at different rows. The ranges are therefore written once, with their numbers, and every later step reads these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions.numbers import permuted
from seamline.storage import stored


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """df, stored, with _p and _in: the number of a row's range in the order, and its place in the range from 0."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    return stored(ranged.withColumn("_in", F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)).drop("_m"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with row = 0, 1, ... over the order: each range's size gives the next one's first number."""
    ranged = in_ranges(df, *order)
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    firsts = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_first"))
    return ranged.join(F.broadcast(firsts), "_p").withColumn("row", F.col("_first") + F.col("_in")).drop("_p", "_in", "_first")


def running_sums(df: DataFrame, group: str, order: str, **values: Column) -> DataFrame:
    """df with each value's sum over the rows of its group that come before the row, and <name>_all over the whole group.

    A row for each range and group carries the sums on; no task reads a whole group. Rows that share group and order
    keep the order in which they were stored.
    """
    ranged = in_ranges(df.withColumns({f"_v{k}": v for k, v in enumerate(values.values())}), group, order)
    sums = ranged.groupBy("_p", group).agg(*[F.sum(f"_v{k}").alias(f"_t{k}") for k in range(len(values))])
    before = W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(group)
    carried = sums.select("_p", group, *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in range(len(values))], *[F.sum(f"_t{k}").over(whole).alias(f"{n}_all") for k, n in enumerate(values)])
    inside = W.partitionBy("_p", group).orderBy("_in").rowsBetween(W.unboundedPreceding, -1)
    out = ranged.withColumns({n: F.coalesce(F.sum(f"_v{k}").over(inside), F.lit(0)) for k, n in enumerate(values)}).join(carried, ["_p", group])
    out = out.withColumns({n: F.col(n) + F.col(f"_b{k}") for k, n in enumerate(values)})
    return out.drop("_p", "_in", *[f"_{c}{k}" for c in "vb" for k in range(len(values))])


def epoch_batches(rows: DataFrame, slots: DataFrame, seed: int, *order: str) -> DataFrame:
    """slots with the row of their source that stands there: each pass over a source is a new shuffle of all its rows.

    slots: (source, place, ...). rows are numbered once; a pass takes the numbers in the order of a permutation that seed,
    source and pass decide, so no pass sorts anything, and the end of one is the beginning of the next. rows has a column source.
    """
    placed = numbered(rows, "source", *order)
    sizes = placed.groupBy("source").agg(F.count(F.lit(1)).alias("_n"), F.min("row").alias("_low"))  # a row for each source
    found = slots.join(F.broadcast(sizes), "source").withColumn("epoch", F.floor(F.col("place") / F.col("_n")))
    number = permuted(F.col("place") % F.col("_n"), F.col("_n"), F.lit(seed), F.col("source"), F.col("epoch"))
    return found.withColumn("row", F.col("_low") + number).drop("_n", "_low").join(placed.drop("source"), "row").drop("row")
