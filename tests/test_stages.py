"""Rounding, permutations, streams, ingestion and stored stages against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions.numbers import exact_round, permuted
from seamline.functions.text import shown_number
from seamline.operators import experiments as X
from seamline.operators.ranges import epoch_batches
from seamline.sources.ingest import ingest, ingest_stream, ingested, manifest
from seamline.streaming.confusion import added_up, count_predictions, counted


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(1)
    xs = [2.675, 1.005, 0.5, 1.5, 2.5, -0.5, -0.2, 1e300, 2.0**52 + 0.5, 2.0**45 + 0.3, 0.0, -0.0, 5e-324, 1e-5, 4.5e15, 1e16]
    xs += [rng.uniform(-10, 10) for _ in range(300_000)] + [rng.randint(-(10**7), 10**7) / 10 ** rng.randint(1, 7) for _ in range(400_000)]
    xs += [(2 * rng.randint(-(10**6), 10**6) + 1) / 2 / 10**k for k in (0, 1, 3, 4, 6) for _ in range(40_000)] + [rng.randint(1, 2**20) / 2 ** rng.randint(1, 20) for _ in range(100_000)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double")
    got = df.select("k", *[exact_round(F.col("x"), n).alias(f"r{n}") for n in (0, 1, 3, 4, 6)]).toPandas().set_index("k").sort_index()
    for n in (0, 1, 3, 4, 6):
        want = [float(round(x, n)) if n else math.copysign(float(round(x)), x) for x in xs]
        assert all(a == b and math.copysign(1, a) == math.copysign(1, b) for a, b in zip(got[f"r{n}"], want)), n
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(exact_round(F.col("x"), 2)).collect()
    assert math.isnan(odd[0][0]) and odd[1][0] == math.inf and odd[2][0] is None


def test_numbers_are_shown_as_python_shows_them(spark):
    xs = [0.25, 0.12345, 1e-5, 0.00012, 3.0, -0.00001, 12.5, 2.675, 0.00005, 0.000049, 123456.7891, 0.1 + 0.2]
    for n in (4, 6):
        got = [r[0] for r in spark.createDataFrame([(v,) for v in xs], "x double").select(shown_number(F.col("x"), n)).collect()]
        assert got == [str(round(v, n)) for v in xs]


def test_permutations(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        orders = [tuple(r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(e)).alias("p")).collect()) for e in range(3)]
        assert all(sorted(o) == list(range(n)) for o in orders)
        assert n < 10 or len(set(orders)) == 3
    # neighbours part: no trace of the order that went in
    assert abs(np.corrcoef(np.arange(1000), orders[0])[0, 1]) < 0.15


def test_epochs_take_every_row_once(spark):
    rows = spark.createDataFrame([(s, f"{s}/{k}") for s, n in ((1, 10), (0, 33)) for k in range(n)], "source int, path string")
    got = epoch_batches(rows, X.epoch_slots(spark, 25, {1: 2, 0: 4}), 7, "path").collect()
    assert len(got) == 25 * 6
    for s, n in ((1, 10), (0, 33)):
        passes = {}
        for r in got:
            if r.source == s:
                passes.setdefault(r.epoch, []).append((r.place, r.path))
        full = [[p for _, p in sorted(v)] for e, v in sorted(passes.items()) if len(v) == n]
        assert len(full) == 25 * {1: 2, 0: 4}[s] // n and all(len(set(p)) == n for p in full) and full[0] != full[1]


def test_a_matrix_goes_on_from_its_checkpoint(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(4), rng.randrange(4)) for _ in range(500)]
    at, total = str(tmp_path), {}
    assert counted(spark, f"{at}/matrix").count() == 0
    for part in (rows[:200], rows[200:201], rows[201:]):
        spark.createDataFrame(part, "label int, pred int").write.mode("append").parquet(f"{at}/in")
        assert count_predictions(spark.readStream.schema("label int, pred int").parquet(f"{at}/in"), f"{at}/matrix", f"{at}/state") >= 1
        for x in part:
            total[x] = total.get(x, 0) + 1
        assert {(r.label, r.pred): r.n for r in counted(spark, f"{at}/matrix").collect()} == total
    # nothing new: nothing changes; an unfinished batch's folder doesn't count
    assert count_predictions(spark.readStream.schema("label int, pred int").parquet(f"{at}/in"), f"{at}/matrix", f"{at}/state") == 0
    (tmp_path / "matrix" / "batch=000000000099").mkdir()
    whole = counted(spark, f"{at}/matrix")
    assert {(r.label, r.pred): r.n for r in whole.collect()} == total
    assert {(r.label, r.pred): r.n for r in added_up(whole, whole).collect()} == {k: 2 * n for k, n in total.items()}


def test_ingestion_goes_on_where_it_stopped(spark, tmp_path):
    at = str(tmp_path / "in")
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(300)], "id long, v string")
    first = ingest(rows, at, "id", 6, stop_after=2)
    assert len(first) == 2 and manifest(spark, at).count() == 2
    # a batch that was written but not listed, as by a run that failed between: it is no row yet, and is written over
    rows.limit(7).write.parquet(f"{at}/rows/batch=5", mode="overwrite")
    seen = ingested(spark, at, "id long, v string")
    assert {r.batch for r in seen.collect()} == set(first)
    rest = ingest(rows, at, "id", 6)
    assert sorted(first + rest) == list(range(6)) and ingest(rows, at, "id", 6) == []
    assert sorted(r.id for r in ingested(spark, at, "id long, v string").collect()) == list(range(300))
    # one changed row: its batch alone is written anew, whatever the order of rows
    changed = rows.withColumn("v", F.when(F.col("id") == 17, "other").otherwise(F.col("v"))).repartition(3)
    assert len(ingest(changed, at, "id", 6)) == 1
    again = {r.id: r.v for r in ingested(spark, at, "id long, v string").collect()}
    assert len(again) == 300 and again[17] == "other"


def test_streams_are_stored_once(spark, tmp_path):
    at = str(tmp_path)
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(f"{at}/in")
        for _ in range(2):
            ingest_stream(spark.readStream.schema("id long").parquet(f"{at}/in"), f"{at}/out", f"{at}/state")
    assert sorted(r.id for r in spark.read.parquet(f"{at}/out/rows").collect()) == list(range(20))


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 8)) * 1.5
    rows = [(k, k % 4, (centres[k % 4] + rng.normal(size=8)).tolist()) for k in range(400)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "label int, vec array<double>")


def test_stages_are_made_once_and_the_best_is_reported(spark, clusters, tmp_path):
    rows, prompts = clusters
    parts = [rows.filter(F.col("vec_id") % 20 < 8), rows.filter("vec_id < 40"), rows.filter(F.col("vec_id") % 20 >= 14), rows.filter((F.col("vec_id") % 20 >= 8) & (F.col("vec_id") % 20 < 14))]
    stages = X.Stages(spark, str(tmp_path / "s"))
    how = dict(taus=(0.0, 1.0), alphas=(0.0, 0.5, 1.0))
    got = {(r.stage, r.sweep): r for r in X.two_stages(stages, *parts, prompts, {"seed": 1}, **how).collect()}
    assert set(got) == {("stage1", "tau"), ("stage2", "tau"), ("stage2", "first"), ("stage2", "prompts")} and len(stages.made) == 6
    assert all(r.val_acc > 80 for r in got.values())
    # mixes hold both ends, so the best of a sweep is no worse than either head alone
    assert got["stage2", "first"].val_acc >= got["stage2", "tau"].val_acc or got["stage2", "tau"].setting != "0"
    again = X.Stages(spark, stages.root)
    X.two_stages(again, *parts, prompts, {"seed": 1}, **how).collect()
    assert again.made == []
    other = X.Stages(spark, stages.root)
    X.two_stages(other, *parts, prompts, {"seed": 2}, **how).collect()
    assert len(other.made) == 6


def test_heads_mix_and_shorten(spark):
    a = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], X.HEADS)
    b = spark.createDataFrame([(0, [1.0, 0.0]), (2, [5.0, 5.0])], X.HEADS)
    assert {r.label: r.vec for r in X.shortened(a, 1.0).collect()} == {0: [0.6, 0.8], 1: [0.0, 0.0]}
    assert {r.label: r.vec for r in X.mixed(a, b, 0.5).collect()} == {0: [2.0, 2.0], 1: [0.0, 0.0], 2: [5.0, 5.0]}


def test_self_training_settles_and_goes_on(spark, clusters, tmp_path):
    rows, _ = clusters
    known, rest = rows.filter("vec_id < 12"), rows.filter("vec_id >= 12")
    found, log = X.self_trained(known, rest, str(tmp_path / "r"), rounds=6, threshold=0.7)
    truth = {r.vec_id: r.label for r in rest.collect()}
    got = {r.vec_id: r.pred for r in found.collect()}
    assert got.keys() == truth.keys() and np.mean([got[k] == truth[k] for k in truth]) > 0.8
    assert log[0][1] > 0 and (log[-1][2] <= 0.001 * len(truth) or len(log) == 6)
    again, same = X.self_trained(known, rest, str(tmp_path / "r"), rounds=6, threshold=0.7)
    assert same == log and {r.vec_id: r.pred for r in again.collect()} == got
    none, log = X.self_trained(known, rest.limit(0), str(tmp_path / "e"), rounds=3)
    assert none.count() == 0 and log == [(0, 0, 0)]
