"""Numbers and running sums over tables that are larger than what range bounds are sampled from."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.operators import curation as C
from seamline.operators.ranges import numbered, running_sums

ROWS = 400_000


@pytest.fixture(scope="module")
def large(spark):
    # a hot group, extra columns that only one branch of a plan needs, and many partitions to sample from
    rows = spark.range(0, ROWS, 1, 8).withColumn("k", F.xxhash64("id")).withColumn("label", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11))
    return rows.withColumn("extra", F.concat(F.lit("x"), F.col("k"))).withColumn("vec", F.array("id", "k"))


@pytest.mark.parametrize("parts", [8, 64])
def test_numbers_equal_a_window(spark, large, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = numbered(large, "k")
        want = large.select("id", (F.row_number().over(W.orderBy("k")) - 1).alias("want"))
        assert got.columns == [*large.columns, "row"]
        assert got.join(want, "id").filter("row = want").count() == ROWS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", [8, 64])
def test_running_sums_equal_a_window(spark, large, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = running_sums(large, "label", "k", s=F.col("id"), n=F.lit(1))
        w = W.partitionBy("label")
        earlier = w.orderBy("k").rowsBetween(W.unboundedPreceding, -1)
        want = large.select("id", F.coalesce(F.sum("id").over(earlier), F.lit(0)).alias("ws"), F.sum("id").over(w).alias("wa"), (F.row_number().over(w.orderBy("k")) - 1).alias("wn"))
        assert got.join(want, "id").filter("s = ws and s_all = wa and n = wn").count() == ROWS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_draws_from_a_long_line(spark, large):
    weight = F.pmod("k", F.lit(5))
    drawn = C.weighted_draws(large, weight, 50_000, 3, "id").toPandas()
    assert len(drawn) == drawn["draw"].nunique() == 50_000
    line = large.select("id", weight.alias("w")).filter("w > 0").orderBy("id").toPandas()
    high = line["w"].cumsum().to_numpy()
    at = spark.range(50_000).select(F.col("id").alias("draw"), F.floor(C.uniform(F.lit(3), F.col("id")) * int(high[-1])).alias("at")).toPandas()
    want = dict(zip(at["draw"], line["id"].to_numpy()[np.searchsorted(high, at["at"].to_numpy(), "right")]))
    assert all(want[d] == i for d, i in zip(drawn["draw"], drawn["id"]))


def test_mean_cross_entropy_of_a_large_class(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 3))
    df = spark.createDataFrame([(k, 0, v.tolist(), "pad" * 5) for k, v in enumerate(x)], "vec_id long, label int, embedding array<double>, extra string").repartition(16)
    got = {r.vec_id: r.ce for r in C.mean_cross_entropy(df).select("vec_id", "ce").collect()}
    lse, sums = np.log(np.exp(x).sum(1)), x.sum(1)
    after = sums.sum() - np.cumsum(sums)
    before = np.cumsum(lse) - lse
    want = (lse * after + sums * before - (x @ x.sum(0) - (x * x).sum(1))) / (len(x) - 1)
    assert max(abs(got[k] - want[k]) for k in range(len(x))) < 1e-6


def test_soft_filter_keeps_places(spark):
    rows = spark.createDataFrame([(0, k, 1.0 - k / 10) for k in range(6)] + [(1, 10 + k, 0.3 - k / 10) for k in range(2)], "label int, vec_id long, sim double")
    gone = spark.createDataFrame([(0, 0), (1, 99)], "label int, vec_id long")
    got = sorted((r.label, r.vec_id, r["rank"]) for r in C.soft_filtered(rows, 3, "sim", 0.25, gone).collect())
    # the first place is a duplicate and stays empty; the class below the cap needs the score
    assert got == [(0, 1, 2), (0, 2, 3), (1, 10, 1)]
