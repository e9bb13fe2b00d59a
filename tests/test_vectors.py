import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import vectors as V
from seamline.operators import evaluation as E
from seamline.operators import sampling as S


def embeddings(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 4))
    v[1], v[2] = v[0] * 1.01, v[0] + 0.02
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, x.astype("float32").tolist(), int(i >= 30)) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), v.astype("float32")


def test_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>").select(
        V.norm(F.col("a")), V.normalised(F.col("a")), V.normalised(F.col("z")), V.softmax(F.col("a")), V.entropy(V.softmax(F.col("z")))
    ).first()
    assert row[0] == 5 and np.allclose(row[1], [0.6, 0.8]) and all(math.isnan(x) for x in row[2])
    assert abs(sum(row[3]) - 1) < 1e-12 and abs(row[4] - math.log(2)) < 1e-12


def test_sampler_boundaries(spark):
    df, _ = embeddings(spark)
    scored = df.withColumn("sim", F.col("embedding")[0])
    for k in (0, 5, 1000):
        got = S.sample(scored, k, [F.desc("sim")], F.col("sim") >= 0)
        want = df.filter(F.col("embedding")[0] >= 0).groupBy("label").count().collect()
        assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {r.label: min(k, r["count"]) for r in want if min(k, r["count"])}


def test_audit_equals_a_scan(spark):
    df, v = embeddings(spark)
    rows = S.audited(df.withColumn("sim", F.round(F.col("embedding")[0].cast("double"), 6)), 5, "sim", F.col("embedding")[1] >= 0).collect()
    got = {(r.vec_id, r.status) for r in rows}
    want = set()
    for label in (0, 1):
        taken = 0
        for i in sorted((i for i in range(60) if int(i >= 30) == label), key=lambda i: (-round(float(v[i][0]), 6), i)):
            if taken == 5:
                break
            ok = v[i][1] >= 0
            taken += ok
            want.add((i, "sampled" if ok else "filtered"))
    assert got == want


def test_near_duplicates_have_no_rescue(spark, monkeypatch):
    df, v = embeddings(spark)
    want = {j for j in range(60) for i in range(j) if (i < 30) == (j < 30) and round(float(v[i].astype(float) @ v[j].astype(float)), 9) > 0.9}
    for size in (512, 7):
        monkeypatch.setattr(S, "BLOCK_ROWS", size)
        assert {r.vec_id for r in S.near_duplicates(df).collect()} == want
    assert 1 in want and 0 not in want


def plain_later(rows, threshold):
    out = set()
    for label in {r[1] for r in rows}:
        mine = sorted((i, np.array(v)) for i, k, v in rows if k == label)
        v = np.array([x for _, x in mine])
        near = np.round(v @ v.T, 9) > threshold
        out |= {mine[j][0] for j in range(len(mine)) if near[:j, j].any()}
    return out


def test_rows_go_only_to_cells_in_reach(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 12))
    v = centres[rng.integers(0, 30, 1500)] + 0.12 * rng.normal(size=(1500, 12))
    v[::40] = v[7]  # a hot vector
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, i % 2 if i < 1400 else 2, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    found = S.near_duplicates(df)
    assert sorted(r.vec_id for r in found.collect()) == sorted(plain_later(rows, 0.9))
    copies = _sent_rows(spark, found)
    assert copies < 0.35 * sum(n * -(-n // 16) for n in (700, 700, 100)), copies  # each row to each block of its class


def _sent_rows(spark, found):
    """Rows that are dealt to pairs of blocks."""
    plan = found._jdf.queryExecution().optimizedPlan()
    node = plan
    while "MapInArrow" not in node.nodeName():
        node = node.children().head()
    return spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node).count()


@pytest.mark.parametrize("scale", [1.0, 3.0])
def test_near_duplicates_of_vectors_of_any_length(spark, monkeypatch, scale):
    monkeypatch.setattr(S, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 4)) * rng.uniform(0.1, scale, size=(400, 1))
    rows = [(i, i % 3, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    for threshold in (0.9, 0.2, -0.1):
        assert {r.vec_id for r in S.near_duplicates(df, threshold).collect()} == plain_later(rows, threshold)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_scores(spark):
    cm = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 1, 2), (2, 0, 2)], "label int, pred int, n long")
    got = {r.class_id: (r.recall, r.precision, r.f1) for r in E.class_scores(cm).collect()}
    assert got[0] == (0.75, 0.6, round(6 / 9, 6)) and got[2] == (0.0, 0.0, 0.0)
    acc = E.summary(cm, 3).first()
    assert acc.acc == 62.5 and abs(acc.avg_class_accuracy - 100 * (0.75 + 1 + 0) / 3) < 1e-4
    assert math.isnan(E.summary(cm, 4).first().avg_class_accuracy)


def test_first_class_wins_ties(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    w = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "label int, vec array<double>")
    assert E.predicted(E.logits(df, w)).first().pred == 1
