"""Vector functions as columns over arrays, and class means as a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Length 1; a zero vector gives NaN."""
    length = norm(v)
    return F.transform(v, lambda x: F.when(length == 0, F.lit(float("nan"))).otherwise(x.cast("double") / F.nullif(length, F.lit(0.0))))


def scaled(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * factor)


def blended(a: Column, b: Column, share: float) -> Column:
    """(1 - share) * a + share * b."""
    return F.zip_with(a, b, lambda x, y: x * F.lit(1 - share) + y * F.lit(share))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.ln(F.aggregate(F.transform(v, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0)))


def class_means(features: DataFrame, label: str = "label", vector: str = "embedding", unit: bool = True) -> DataFrame:
    """(label, vec): the mean vector of each class, of length 1 if unit. Sums are combined before the shuffle."""
    parts = features.select(label, F.posexplode(vector).alias("pos", "v")).groupBy(label, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"])
    out = parts.groupBy(label).agg(vec.alias("vec"))
    return out.withColumn("vec", normalised(F.col("vec"))) if unit else out
