"""Curation operators, learned heads and sinks against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import text as X
from seamline.operators import curation as C
from seamline.operators import evaluation as E
from seamline.operators import learning as L
from seamline.operators import sampling as S
from seamline.sources import files


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((4, 6))
    rows = [(i, i % 4 if i < 120 else 0, (centres[i % 4] + 0.4 * rng.standard_normal(6)).tolist()) for i in range(160)]
    return rows, spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)


def test_running_sums_of_a_hot_group(vectors):
    rows, df = vectors
    got = {r.vec_id: (r.a, r.a_all) for r in C.running_sums(df, "label", "vec_id", a=F.col("vec_id")).collect()}
    for i, label, _ in rows:
        own = [j for j, k, _ in rows if k == label]
        assert got[i] == (sum(j for j in own if j < i), sum(own))
    assert C.running_sums(df.limit(0), "label", "vec_id", a=F.col("vec_id")).count() == 0


def test_mean_cross_entropy(vectors):
    rows, df = vectors
    got = {r.vec_id: r.ce for r in C.mean_cross_entropy(df.union(df.limit(1).withColumn("label", F.lit(9)).withColumn("vec_id", F.lit(999).cast("long")))).collect()}
    ce = lambda x, y: np.log(np.exp(x).sum()) * np.sum(y) - np.dot(x, y)
    for i, label, x in rows[::7]:
        mine = [ce(np.array(x), np.array(y)) if i < j else ce(np.array(y), np.array(x)) for j, k, y in rows if k == label and j != i]
        assert abs(got[i] - np.mean(mine)) < 1e-9
    assert got[999] is None


def test_weighted_draws(vectors):
    _, df = vectors
    found = [r.vec_id for r in C.weighted_draws(df, F.when(F.col("vec_id") < 10, 90).when(F.col("vec_id") < 100, 1).otherwise(0), 2000, 1).collect()]
    assert len(found) == 2000 and max(found) < 100 and 0.85 < np.mean(np.array(found) < 10) < 0.95
    assert C.weighted_draws(df.limit(0), F.lit(1), 50).count() == 0


def test_shares_and_mixes(vectors):
    rows, df = vectors
    for alpha, spread in ((1.0, 1 / 12), (0.4, 1 / (4 * 1.8)), (4.0, 1 / 36)):
        drawn = np.array([r.s for r in df.sparkSession.range(4000).select(L.shares(F.col("id"), alpha, 1.0).alias("s")).collect()])
        assert abs(drawn.mean() - 0.5) < 0.02 and abs(drawn.var() - spread) < 0.02, alpha
    assert 0.4 < np.mean([r.s == 1 for r in df.select(L.shares(F.col("vec_id"), 0.4, 0.5).alias("s")).collect()]) < 0.65
    got = L.mixed_pairs(df, 0.7).collect()
    assert sorted(r.vec_id for r in got) == [i for i, *_ in rows]
    vector = {i: (label, np.array(x)) for i, label, x in rows}
    for r in got:
        other = [(np.array(r.embedding) - 0.7 * vector[r.vec_id][1]) / 0.3]
        near = min(vector, key=lambda j: np.abs(vector[j][1] - other[0]).max())
        assert near != r.vec_id and np.abs(vector[near][1] - other[0]).max() < 1e-9 and vector[near][0] == r.other_label
    assert L.mixed_pairs(df.limit(0), 0.5).count() == 0


def optimum(x, y, classes, penalty):
    """The multinomial logistic regression by plain gradient descent on standardised features, as the probe scales its penalty."""
    scale = x.std(axis=0, ddof=1)
    z, w, b = x / scale, np.zeros((classes, x.shape[1])), np.zeros(classes)
    for _ in range(4000):
        p = np.exp(z @ w.T + b)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        w -= 0.5 * (p.T @ z / len(y) + penalty * w)
        b -= 0.5 * p.mean(0)
    return w / scale, b


def test_probes(vectors, spark):
    rows, df = vectors
    few = S.few_shot(df, 16, 1).collect()
    x, y = np.array([r.embedding for r in few]), np.array([r.label for r in few])
    w, b = optimum(x, y, 4, 1e-3)
    every = np.array([v for *_, v in rows])
    want = (every @ w.T + b).argmax(1)
    got = {r.vec_id: r.pred for r in L.probe(L.fit_probe(S.few_shot(df, 16, 1)), df).collect()}
    assert np.mean([got[i] == p for (i, *_), p in zip(rows, want)]) > 0.98
    both = L.cross_modal(df.withColumn("caption", F.col("embedding")))
    assert both.count() == 2 * len(rows) and both.columns == ["label", "embedding"]


def test_logits_in_blocks(vectors, monkeypatch):
    _, df = vectors
    weights = df.filter("vec_id < 60").select(F.col("vec_id").cast("int").alias("label"), F.col("embedding").alias("vec"))
    pick = lambda x: {r.vec_id: [(v.c, v.logit) for v in r.logits] for r in x.select("vec_id", "logits").collect()}
    whole = pick(E.logits(df, weights))
    monkeypatch.setattr(E, "MAX_GATHERED_CLASSES", 16)
    assert pick(E.logits(df, weights)) == whole and [c for c, _ in whole[0]] == list(range(60))
    assert E.long_logits(df, weights).count() == 160 * 60


def test_audited_stops_at_the_kth(vectors):
    _, df = vectors
    scored = df.select("vec_id", "label", (F.col("vec_id") % 7).cast("double").alias("sim"))
    got = {r.vec_id: r.status for r in S.audited(scored, 4, "sim", F.col("vec_id") % 3 > 0).collect()}
    want = {}
    for label in range(4):
        taken = 0
        for r in sorted((r for r in scored.collect() if r.label == label), key=lambda r: (-r.sim, r.vec_id)):
            if taken < 4:
                want[r.vec_id] = "sampled" if r.vec_id % 3 else "filtered"
                taken += r.vec_id % 3 > 0
    assert got == want


def test_unknown_names_and_parts_are_errors(spark):
    names = spark.createDataFrame([(0, "a")], "label int, name string")
    with pytest.raises(Exception, match="unknown label name: b"):
        C.label_ids(spark.createDataFrame([("b",)], "name string"), names).collect()
    with pytest.raises(Exception, match="unknown part: x"):
        spark.range(1).select(X.regrouped_path(F.lit("x/n1/a_2.JPEG"), {"train": "t"})).collect()


def test_sinks(spark, tmp_path):
    (tmp_path / "config.yml").write_text("# paths\ndataset_path: '/a/b'\nretrieved_path:  /c:d\n\n")
    assert files.read_config(spark, str(tmp_path / "config.yml")) == {"dataset_path": "/a/b", "retrieved_path": "/c:d"}
    assert files.metrics_file("data/", "dtd", "query") == "data/dtd/dtd_metrics_query.json"
    log = str(tmp_path / "log")
    for epoch in (1, 2):
        files.append_log(spark.createDataFrame([(epoch, 10, 0.5, 0.25, 0.75, 0.125)], files.TRAINING_LOG), log)
    assert sorted(r.Epoch for r in files.read_log(spark, log).collect()) == [1, 2]
    results = str(tmp_path / "results")
    files.append_log(spark.createDataFrame([("dtd", "m", "few", "i", 4, 1, "T2T", 1.5, 2.5)], files.RESULTS), results)
    assert files.read_results(spark, results).first().Stage2Acc == 2.5
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    at = str(tmp_path / "cache")
    assert [files.cached(spark, at, make, again).count() for again in (False, False, True)] == [3, 3, 3] and len(calls) == 2


def test_numbers_in_lines(spark):
    shown = lambda v: spark.range(1).select(X.shown_number(F.lit(v)).alias("s")).first().s
    assert [shown(v) for v in (0.5, 1.0, 0.12345, 0.1001, -0.25, 10.0)] == ["0.5", "1.0", "0.1235", "0.1001", "-0.25", "10.0"]
