"""Evaluation: logits, predictions, confusion, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions.vectors import dot

#: Class weights are gathered into arrays of about so many at most.
MAX_GATHERED_CLASSES = 4096


def logits(features: DataFrame, weights: DataFrame, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """features with logits: an array of (logit, class) in the order of classes. weights: (label, vec), a class dimension.

    Weights meet the rows as one array for each block of MAX_GATHERED_CLASSES classes, a single row that is broadcast.
    """
    n = weights.count()
    block = F.lit(0) if n <= MAX_GATHERED_CLASSES else F.pmod(F.xxhash64("label"), F.lit(-(-2 * n // MAX_GATHERED_CLASSES)))
    heads = weights.withColumn("_b", block.cast("int"))
    out = features.withColumn("logits", F.array().cast("array<struct<logit:double,c:int>>"))
    for b in range(1 if n <= MAX_GATHERED_CLASSES else -(-2 * n // MAX_GATHERED_CLASSES)):
        one = heads.filter(F.col("_b") == b).agg(F.collect_list(F.struct(F.col("label").alias("c"), F.col("vec").alias("w"))).alias("_w"))
        found = F.transform("_w", lambda h: F.struct(F.round(dot(F.col(vector), h["w"]), digits).alias("logit"), h["c"].cast("int").alias("c")))
        out = out.crossJoin(F.broadcast(one)).withColumn("logits", F.concat("logits", found)).drop("_w")  # one row on the right
    return out.withColumn("logits", F.array_sort("logits", lambda a, b: a["c"] - b["c"]))


def long_logits(features: DataFrame, weights: DataFrame, ident: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(id, label, c, logit): a row for each class; where classes are to be grouped."""
    rows = logits(features, weights, vector, digits).select(ident, "label", F.explode("logits").alias("_x"))
    return rows.select(ident, "label", F.col("_x.c").alias("c"), F.col("_x.logit").alias("logit"))


def predicted(with_logits: DataFrame) -> DataFrame:
    """pred (the first class with the largest logit) and max_logit."""
    best = F.array_max(F.transform("logits", lambda x: F.struct(x["logit"], (-x["c"]).alias("neg"))))
    return with_logits.withColumn("_b", best).withColumn("pred", (-F.col("_b.neg")).cast("int")).withColumn("max_logit", F.col("_b.logit")).drop("_b")


def confusion(predictions: DataFrame) -> DataFrame:
    """(label, pred, n), sparse; rows are truth."""
    return predictions.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(cm: DataFrame) -> DataFrame:
    """(class_id, recall, precision, f1); 0 where nothing divides, F1 0 without hits."""
    truth = cm.select(F.col("label").alias("class_id"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("t"))
    guess = cm.select(F.col("pred").alias("class_id"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t"))
    g = truth.union(guess).groupBy("class_id").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("t").alias("t"))

    def part(a: str, b: Column) -> Column:
        return F.when(b > 0, F.col(a) / b).otherwise(F.lit(0.0))

    f1 = F.when(F.col("t") > 0, 2.0 * F.col("t") / (F.col("s") + F.col("p"))).otherwise(F.lit(0.0))
    return g.select("class_id", F.round(part("t", F.col("s")), 6).alias("recall"), F.round(part("t", F.col("p")), 6).alias("precision"), F.round(f1, 6).alias("f1"))


def summary(cm: DataFrame, classes: int | None = None) -> DataFrame:
    """(acc, avg_class_accuracy) in percent; the second is NaN if one of `classes` has no truth rows."""
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    per = cm.groupBy("label").agg(F.sum("n").alias("n"), F.sum(hit).alias("t"))
    mean = F.avg(F.col("t") / F.col("n"))
    if classes is not None:
        mean = F.when(F.count(F.lit(1)) < classes, F.lit(float("nan"))).otherwise(mean)
    return per.agg(F.round(100 * F.sum("t") / F.sum("n"), 6).alias("acc"), F.round(100 * mean, 6).alias("avg_class_accuracy"))


def top_confusions(cm: DataFrame, k: int = 20) -> DataFrame:
    """The k largest cells of each truth row, larger first, then the smaller class."""
    order = W.partitionBy("label").orderBy(F.desc("n"), "pred")
    return cm.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def head_and_tail(counts: DataFrame, share: float = 0.9, label: str = "label", n: str = "n") -> DataFrame:
    """counts with is_head: the first int(share * classes) by count. One row for each class, so the sort is small."""
    order = W.orderBy(F.desc(n), label)
    total = counts.agg(F.count(F.lit(1)).alias("_c"))
    ranked = counts.withColumn("_rn", F.row_number().over(order)).crossJoin(F.broadcast(total))
    return ranked.withColumn("is_head", F.col("_rn") <= F.floor(F.col("_c") * share)).drop("_rn", "_c")


def cross_entropy(logit_array: Column, label: Column) -> Column:
    """-log softmax at the label, from an array of (logit, c)."""
    top = F.array_max(F.transform(logit_array, lambda x: x["logit"]))
    total = F.aggregate(logit_array, F.lit(0.0), lambda s, x: s + F.exp(x["logit"] - top))
    own = F.element_at(F.filter(logit_array, lambda x: x["c"] == label), 1)["logit"]
    return top + F.ln(total) - own


def focal(ce: Column, alpha: float = 1.0, gamma: float = 2.0) -> Column:
    ce = F.greatest(ce, F.lit(1e-8))
    return alpha * F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce


def best_by(rows: DataFrame, group: list[str], value: str, tie: Column, *keep: str) -> DataFrame:
    """The row of each group with the largest value; the larger tie wins."""
    return rows.groupBy(*group).agg(F.max_by(F.struct(*keep), F.struct(F.col(value), tie)).alias("_r")).select(*group, "_r.*")


def shifted_accuracy(sets: dict[str, tuple[DataFrame, DataFrame | None]], weights: DataFrame) -> DataFrame:
    """(set_name, acc), and the plain mean of all sets as "mean": percent of each set's rows whose label has the largest logit.

    sets: a table of rows of its own for each name, and the classes (label) that it has, or None for all. Only a set's own
    classes compete in it.
    """
    parts = []
    for name, (rows, classes) in sets.items():
        heads = weights if classes is None else weights.join(F.broadcast(classes.select("label").distinct()), "label", "left_semi")
        hit = (F.col("pred") == F.col("label")).cast("double")
        parts.append(predicted(logits(rows, heads)).agg((100 * F.avg(hit)).alias("acc")).select(F.lit(name).alias("set_name"), "acc"))
    each = parts[0]
    for part in parts[1:]:
        each = each.unionByName(part)
    return each.unionByName(each.agg(F.lit("mean").alias("set_name"), F.avg("acc").alias("acc")))
