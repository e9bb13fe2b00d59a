"""Experiments as stored stages: each stage's table lies under a key of its settings and inputs, and is made only once.

two_stages() is the run of a classifier over frozen vectors: a head fitted on few-shot and retrieved rows, then one fitted
on the few-shot rows alone; for both a sweep over powers of the weights' lengths, and for the second one over mixes with
the first head's and the prompts' weights. What is best on validation rows is reported with its test accuracy.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions.vectors import dot
from seamline.operators.evaluation import logits, predicted
from seamline.operators.learning import fit_probe
from seamline.storage import exists

HEADS = "label int, vec array<double>"


class Stages:
    """Named stages below a root. A stage's key is a digest of its settings and of the keys of the stages that it reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.made: list[str] = []

    @staticmethod
    def key(name: str, settings: dict, inputs: list[str]) -> str:
        return f"{name}-{hashlib.sha256(json.dumps([name, settings, inputs], sort_keys=True).encode()).hexdigest()[:16]}"

    def table(self, name: str, make: Callable[[], DataFrame], settings: dict | None = None, inputs: list[str] | None = None) -> tuple[DataFrame, str]:
        """The stage's stored table and its key; made and stored if it isn't there whole."""
        key = self.key(name, settings or {}, inputs or [])
        path = f"{self.root}/{key}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path), key


def head_of(model: LogisticRegressionModel, spark: SparkSession) -> DataFrame:
    """(label, vec) of a probe; the intercept is the last component."""
    rows = [(k, [*map(float, w), float(b)]) for k, (w, b) in enumerate(zip(model.coefficientMatrix.toArray(), model.interceptVector.toArray()))]
    return spark.createDataFrame(rows, HEADS)


def with_one(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows whose vectors have a 1 behind them, for heads with intercepts."""
    return rows.withColumn(vector, F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(F.lit(1.0))))


def shortened(head: DataFrame, tau: float) -> DataFrame:
    """head with each class's weights divided by their length to the power tau; 0 leaves them as they are."""
    norm = F.sqrt(dot(F.col("vec"), F.col("vec")))
    return head.withColumn("vec", F.when(norm > 0, F.transform("vec", lambda x: x / F.pow(norm, F.lit(float(tau))))).otherwise(F.col("vec")))


def mixed(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """share of head a and the rest of head b, class by class; a class that one of them lacks is the other's alone."""
    both = a.join(b.withColumnRenamed("vec", "_o"), "label", "full")
    blend = F.zip_with("vec", "_o", lambda x, y: share * x + (1 - share) * y)
    return both.select("label", F.coalesce(F.when(F.col("vec").isNotNull() & F.col("_o").isNotNull(), blend), "vec", "_o").alias("vec"))


def accuracies(rows: DataFrame, heads: dict[str, DataFrame]) -> DataFrame:
    """(head, acc): percent of rows of which each head finds the label, all from one pass over the rows."""
    out = rows
    for k, head in enumerate(heads.values()):
        hit = predicted(logits(out, head, digits=9)).withColumn(f"_hit{k}", (F.col("pred") == F.col("label")).cast("double"))
        out = hit.drop("pred", "max_logit", "logits")
    means = out.agg(*[F.avg(f"_hit{k}").alias(f"m{k}") for k in range(len(heads))])
    pairs = F.array(*[F.struct(F.lit(n).alias("head"), (100 * F.col(f"m{k}")).alias("acc")) for k, n in enumerate(heads)])
    return means.select(F.explode(pairs).alias("x")).select("x.head", F.coalesce("x.acc", F.lit(0.0)).alias("acc"))


def best_of(scores: DataFrame) -> DataFrame:
    """The row with the largest val_acc; the setting that is listed first wins a tie. A row for each setting comes in."""
    return scores.groupBy("stage", "sweep").agg(F.max_by(F.struct("setting", "val_acc", "test_acc"), F.struct("val_acc", -F.col("place"))).alias("x")).select("stage", "sweep", "x.*")


def two_stages(
    stages: Stages,
    mixed_rows: DataFrame,
    fewshot: DataFrame,
    val: DataFrame,
    test: DataFrame,
    prompts: DataFrame,
    settings: dict,
    taus: tuple[float, ...] = tuple(k / 10 for k in range(0, 21, 2)),
    alphas: tuple[float, ...] = tuple(k / 10 for k in range(11)),
) -> DataFrame:
    """(stage, sweep, setting, val_acc, test_acc): the best setting of each stage and sweep. settings must tell the inputs apart."""
    spark = stages.spark
    zero = prompts.select("label", F.concat(F.transform("vec", lambda x: x.cast("double")), F.array(F.lit(0.0))).alias("vec"))
    first, key1 = stages.table("stage1-head", lambda: head_of(fit_probe(mixed_rows), spark), settings)
    second, key2 = stages.table("stage2-head", lambda: head_of(fit_probe(fewshot), spark), settings, [key1])

    def swept(name: str, heads: dict[str, DataFrame], keys: list[str]) -> DataFrame:
        def make() -> DataFrame:
            by = [accuracies(with_one(rows), heads).withColumnRenamed("acc", n) for rows, n in ((val, "val_acc"), (test, "test_acc"))]
            places = spark.createDataFrame([(n, k) for k, n in enumerate(heads)], "head string, place int")
            return by[0].join(by[1], "head").join(places, "head").select(F.lit(name.split("-")[0]).alias("stage"), F.lit(name.split("-")[1]).alias("sweep"), F.col("head").alias("setting"), "place", "val_acc", "test_acc")

        return stages.table(name, make, settings, keys)[0]

    parts = [
        swept("stage1-tau", {f"{t:g}": shortened(first, t) for t in taus}, [key1]),
        swept("stage2-tau", {f"{t:g}": shortened(second, t) for t in taus}, [key2]),
        swept("stage2-first", {f"{a:g}": mixed(second, first, a) for a in alphas}, [key1, key2]),
        swept("stage2-prompts", {f"{a:g}": mixed(second, zero, a) for a in alphas}, [key2]),
    ]
    return best_of(reduce(lambda a, b: a.unionByName(b), parts))


def self_trained(
    labelled: DataFrame, unlabelled: DataFrame, root: str, rounds: int = 8, threshold: float = 0.8, settled: float = 0.001, ident: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(id, pred, confidence) of the unlabelled rows in the last round, and (round, accepted, changed) of each round.

    A probe is fitted on the labelled rows and on those rows that the round before accepted, with its labels: those whose
    largest class probability reaches the threshold. It ends when no more than a share of the rows changed, or after the last round.
    Each round is stored and the next reads it; a run that stopped goes on with the first round that isn't there whole.
    """
    spark, known, log = labelled.sparkSession, labelled.select("label", vector), []
    total = max(unlabelled.count(), 1)
    before = unlabelled.select(ident).withColumns({"pred": F.lit(None).cast("int"), "confidence": F.lit(None).cast("double")})

    def taken(x: DataFrame) -> DataFrame:
        return x.filter(F.col("confidence") >= threshold).select(ident, F.col("pred").alias("label"))

    for k in range(rounds):
        path = f"{root.rstrip('/')}/round={k:03d}"
        if not exists(spark, f"{path}/_SUCCESS"):
            extra = unlabelled.select(ident, vector).join(taken(before), ident).select("label", vector)
            head = head_of(fit_probe(known.unionByName(extra)), spark)
            scored = predicted(logits(with_one(unlabelled.select(ident, vector)), head, digits=9))
            confidence: Column = 1 / F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x["logit"] - F.col("max_logit")))
            scored.select(ident, "pred", confidence.alias("confidence")).write.mode("overwrite").parquet(path)
        now = spark.read.schema(before.schema).parquet(path)
        accepted = taken(now).count()
        a, b = taken(now).alias("a"), taken(before).alias("b")
        same = a.join(b, [F.col(f"a.{ident}") == F.col(f"b.{ident}"), F.col("a.label") == F.col("b.label")]).count()
        changed = accepted + taken(before).count() - 2 * same
        log.append((k, accepted, changed))
        before = now
        if changed <= settled * total:
            break
    return before, log


def epoch_slots(spark: SparkSession, batches: int, quotas: dict[int, int]) -> DataFrame:
    """(batch, slot, source, place): the places of all batches; place counts a source's own from 0 on, over all epochs."""
    size, before = sum(quotas.values()), 0
    slots = spark.range(batches * size).select(F.floor(F.col("id") / size).alias("batch"), (F.col("id") % size).cast("int").alias("slot"))
    source, place = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s, q in reversed(list(quotas.items())):
        before = sum(v for k, v in list(quotas.items())[: list(quotas).index(s)])
        mine = (F.col("slot") >= before) & (F.col("slot") < before + q)
        source, place = F.when(mine, F.lit(s)).otherwise(source), F.when(mine, F.col("batch") * q + F.col("slot") - before).otherwise(place)
    return slots.withColumn("source", source).withColumn("place", place)
