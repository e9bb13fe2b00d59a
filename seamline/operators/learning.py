"""Learned heads over stored features: linear probes, and the steps around them."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.operators.curation import uniform


def fit_probe(rows: DataFrame, label: str = "label", vector: str = "embedding", steps: int = 30, penalty: float = 1e-3) -> LogisticRegressionModel:
    """A multinomial linear probe."""
    data = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    return LogisticRegression(family="multinomial", maxIter=steps, regParam=penalty).fit(data)


def probe(model: LogisticRegressionModel, rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """rows with pred, the probe's class."""
    data = rows.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return model.transform(data).withColumn("pred", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def cross_modal(rows: DataFrame, image: str = "embedding", text: str = "caption") -> DataFrame:
    """Image and text vectors of each row as rows of their own, to train one probe on both."""
    pick = lambda c: rows.select("label", F.col(c).alias("embedding"))
    return pick(image).unionByName(pick(text))


#: Rows of a hash group within which rows are mixed, on average.
GROUP_ROWS = 4096


def shares(ident: Column, alpha: float = 1.0, probability: float = 0.5, seed: int = 0) -> Column:
    """A row's share of itself: drawn from Beta(alpha, alpha) with a probability, else 1. Fixed by the id and the seed.

    For alpha 1 a uniform number is the draw. Otherwise up to 16 tries from uniform numbers, by rejection: Joehnk's method
    below 1 and Cheng's above; if none is accepted, with a chance below 1e-4, the share is a half.
    """
    u = lambda k: uniform(F.lit(seed), F.lit(k), ident)
    drawn = u(1) if alpha == 1 else F.lit(0.5)
    for k in reversed(range(16 if alpha != 1 else 0)):
        if alpha < 1:
            x, y = (F.pow(u(2 * k + j), F.lit(1.0 / alpha)) for j in (1, 2))
            accepted, value = (x + y <= 1) & (x + y > 0), x / (x + y)
        else:
            b = math.sqrt((2 * alpha - 2) / (2 * alpha * alpha - 2 * alpha))
            v = b * F.ln(u(2 * k + 1) / (1 - u(2 * k + 1)))
            w = alpha * F.exp(v)
            r = (alpha + 1 / b) * v - math.log(4)
            accepted = r + 2 * alpha * F.ln(2 * alpha / (alpha + w)) >= F.ln(u(2 * k + 1) * u(2 * k + 1) * u(2 * k + 2))
            value = w / (alpha + w)
        drawn = F.when(accepted, value).otherwise(drawn)
    return F.when(uniform(F.lit(seed), F.lit(0), ident) <= probability, drawn).otherwise(F.lit(1.0))


def mixed_pairs(rows: DataFrame, share: float | Column, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Mix-up of each row with another one: vectors blended, both labels and the share kept.

    Rows meet within groups dealt by a hash of the id, as many as the rows need; the last of a group meets its first.
    """
    groups = max(1, rows.count() // GROUP_ROWS)
    part = W.partitionBy(F.floor(uniform(F.lit("group"), F.col(ident)) * groups))
    order, own = part.orderBy(F.md5(F.col(ident).cast("string")), ident), F.struct(F.col(vector).alias("v"), "label")
    other = F.coalesce(F.lead(own).over(order), F.first(own).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    paired = rows.withColumn("_o", other).withColumn("_s", share if isinstance(share, Column) else F.lit(float(share)))
    blend = F.zip_with(vector, "_o.v", lambda x, y: x.cast("double") * F.col("_s") + y.cast("double") * (1 - F.col("_s")))
    return paired.select(ident, "label", F.col("_o.label").alias("other_label"), blend.alias(vector), F.col("_s").alias("share"))
