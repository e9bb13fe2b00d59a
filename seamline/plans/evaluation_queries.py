"""Queries that score classifiers, and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.functions import vectors as V
from seamline.functions.numbers import exact_round
from seamline.operators import evaluation as E
from seamline.plans.common import table
from seamline.plans.vector_queries import DOT, PROMPTS, prompts

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LOGITS = (
    PROMPTS
    + f""", lg AS (SELECT e.vec_id, e.label, p.label AS c, round({DOT.format(a="e.embedding", b="p.vec")}, 6) AS logit FROM embeddings e, prompts p),
pr AS (SELECT vec_id, label, c AS pred, logit AS max_logit FROM lg QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, c) = 1),
cm AS (SELECT label, pred, count(*) AS n FROM pr GROUP BY ALL),
sm AS (SELECT vec_id, any_value(label) AS label, max(logit) + ln(sum(exp(logit - m))) AS lse, max(CASE WHEN c = label THEN logit END) AS own FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS m FROM lg) GROUP BY vec_id),
ce AS (SELECT vec_id, label, lse - own AS ce FROM sm),
sc AS (SELECT c AS class_id, coalesce(t / nullif(s, 0), 0.0) AS recall, coalesce(t / nullif(p, 0), 0.0) AS precision, CASE WHEN t > 0 THEN 2.0 * t / (s + p) ELSE 0.0 END AS f1
  FROM (SELECT c, sum(CASE WHEN label = c THEN n ELSE 0 END) AS s, sum(CASE WHEN pred = c THEN n ELSE 0 END) AS p, sum(CASE WHEN label = c AND pred = c THEN n ELSE 0 END) AS t
    FROM cm, (SELECT label AS c FROM cm UNION SELECT pred FROM cm) GROUP BY c))
"""
)


def with_logits(spark, sf_dir):
    return E.logits(table(spark, sf_dir, "embeddings"), prompts(spark, sf_dir))


def predictions(spark, sf_dir):
    return E.predicted(with_logits(spark, sf_dir)).select("vec_id", "label", "pred", "max_logit", "logits")


def cm(spark, sf_dir):
    return E.confusion(predictions(spark, sf_dir))


@query(LOGITS + "SELECT vec_id, label, pred, max_logit FROM pr")
def zero_shot_predict(spark, sf_dir):
    return predictions(spark, sf_dir).drop("logits")


@query(LOGITS + "SELECT label, pred, n FROM cm")
def confusion_matrix(spark, sf_dir):
    return cm(spark, sf_dir)


@query(LOGITS + "SELECT a.label, b.label AS pred, coalesce(n, 0) AS n FROM (SELECT DISTINCT label FROM embeddings) a CROSS JOIN (SELECT DISTINCT label FROM embeddings) b LEFT JOIN cm ON cm.label = a.label AND cm.pred = b.label")
def confusion_matrix_dense(spark, sf_dir):
    """Every cell, from the class dimension on both sides (classes x classes rows by definition)."""
    classes = table(spark, sf_dir, "embeddings").select("label").distinct()
    cells = classes.crossJoin(F.broadcast(classes.withColumnRenamed("label", "pred")))
    return cells.join(cm(spark, sf_dir), ["label", "pred"], "left").select("label", "pred", F.coalesce("n", F.lit(0)).alias("n"))


@query(LOGITS + "SELECT class_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM sc")
def per_class_scores(spark, sf_dir):
    return E.class_scores(cm(spark, sf_dir))


@query(LOGITS + "SELECT round(100.0 * sum(t) / sum(n), 6) AS acc, round(100 * avg(t / n), 6) AS avg_class_accuracy FROM (SELECT label, sum(n) AS n, sum(CASE WHEN label = pred THEN n ELSE 0 END) AS t FROM cm GROUP BY label)")
def accuracy_summary(spark, sf_dir):
    return E.summary(cm(spark, sf_dir), 10)


@query(LOGITS + "SELECT label, pred, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, pred) AS rank FROM cm QUALIFY rank <= 5")
def topk_confusions(spark, sf_dir):
    return E.top_confusions(cm(spark, sf_dir), 5).withColumn("rank", F.col("rank").cast("long"))


@query(LOGITS + "SELECT class_id, round(recall, 6) AS recall FROM sc ORDER BY round(recall, 6), class_id LIMIT 3")
def worst_classes(spark, sf_dir):
    return E.class_scores(cm(spark, sf_dir)).orderBy("recall", "class_id").limit(3).select("class_id", "recall")


@query(LOGITS + "SELECT count(*) AS n, round(100 * avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS acc FROM (SELECT vec_id, label, c AS pred FROM lg WHERE c IN (1, 3, 5, 7) AND label IN (1, 3, 5, 7) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, c) = 1)")
def subset_accuracy(spark, sf_dir):
    """Accuracy where only some classes may be predicted."""
    rows = with_logits(spark, sf_dir).filter(F.col("label").isin(1, 3, 5, 7))
    rows = rows.withColumn("logits", F.filter("logits", lambda x: x["c"].isin(1, 3, 5, 7)))
    return E.predicted(rows).agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("acc"))


@query(
    PROMPTS
    + """, s AS (SELECT f.vec_id, f.label, list_reverse_sort(list(s)) AS sims FROM exi f GROUP BY ALL)
SELECT vec_id, label, round((sims[1] + sims[2] + sims[3]) / 3, 6) AS top3 FROM s"""
)
def topk_prompt_mean(spark, sf_dir):
    """The mean of the three largest similarities to the class's exemplars."""
    from seamline.operators.sampling import exemplars

    e = table(spark, sf_dir, "embeddings")
    gathered = exemplars(e, 4).groupBy("label").agg(F.collect_list("ex").alias("exs"))
    sims = F.sort_array(F.transform("exs", lambda x: F.round(V.dot(F.col("embedding"), x), 9)), False)
    top = F.slice(sims, 1, 3)
    return e.join(gathered, "label").select("vec_id", "label", F.round(F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top), 6).alias("top3"))


@query(
    PROMPTS
    + f""", tw AS (SELECT CAST(t AS INTEGER) AS tau10, label, list_transform(vec, lambda x: x / power(sqrt({DOT.format(a="vec", b="vec")}), t / 10.0)) AS vec FROM raw, (SELECT unnest(range(0, 21, 2)) AS t)),
tl AS (SELECT tau10, e.vec_id, e.label, w.label AS c, round({DOT.format(a="e.embedding", b="w.vec")}, 6) AS logit FROM embeddings e, tw w),
tp AS (SELECT tau10, label, c AS pred FROM tl QUALIFY row_number() OVER (PARTITION BY tau10, vec_id ORDER BY logit DESC, c) = 1)
SELECT tau10, round(100 * avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS acc FROM tp GROUP BY tau10"""
)
def tau_sweep(spark, sf_dir):
    """Accuracy with class weights divided by their length to the power tau = 0, 0.2, ... 2."""
    e = table(spark, sf_dir, "embeddings")
    raw = V.class_means(e, unit=False).withColumn("tau10", F.explode(F.sequence(F.lit(0), F.lit(20), F.lit(2))))
    w = raw.select("tau10", F.col("label").alias("c"), V.scaled(F.col("vec"), F.pow(V.norm(F.col("vec")), -F.col("tau10") / 10.0)).alias("w"))
    heads = w.groupBy("tau10").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("heads"))
    rows = e.crossJoin(F.broadcast(heads))  # a row for each tau
    rows = rows.withColumn("logits", F.transform("heads", lambda h: F.struct(F.round(V.dot(F.col("embedding"), h["w"]), 6).alias("logit"), h["c"].alias("c"))))
    hit = (F.col("pred") == F.col("label")).cast("double")
    return E.predicted(rows).groupBy("tau10").agg(F.round(100 * F.avg(hit), 6).alias("acc"))


@query(
    PROMPTS
    + f""", ew AS (SELECT label, ex FROM ex WHERE ex_id = (SELECT min(ex_id) FROM ex e2 WHERE e2.label = ex.label)),
mix AS (SELECT p.label, list_transform(list_zip(p.vec, ew.ex::DOUBLE[]), lambda z: 0.5 * z[1] + 0.5 * z[2]) AS vec FROM prompts p JOIN ew USING (label)),
ml AS (SELECT e.vec_id, e.label, m.label AS c, round({DOT.format(a="e.embedding", b="m.vec")}, 6) AS logit FROM embeddings e, mix m)
SELECT vec_id, label, c AS pred FROM ml QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, c) = 1"""
)
def weight_ensemble(spark, sf_dir):
    """Predictions with the mean of two sets of class weights."""
    from seamline.operators.sampling import exemplars

    e = table(spark, sf_dir, "embeddings")
    keyed = exemplars(e.withColumn("embedding", F.struct("vec_id", "embedding")), 4)
    first = keyed.groupBy("label").agg(F.min_by("ex", "ex.vec_id").alias("m")).select("label", F.col("m.embedding").alias("other"))
    w = prompts(spark, sf_dir).join(first, "label").select("label", V.blended(F.col("vec"), F.transform("other", lambda x: x.cast("double")), 0.5).alias("vec"))
    return E.predicted(E.logits(e, w)).select("vec_id", "label", "pred")


@query("SELECT user_id % 10 AS run, event_id AS epoch, round(value, 4) AS val_acc FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 10 ORDER BY round(value, 4) DESC, event_id DESC) = 1")
def best_record(spark, sf_dir):
    """The best validation value of each run; the later epoch wins ties."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("run"), F.col("event_id").alias("epoch"), F.round("value", 4).alias("val_acc"))
    return E.best_by(rows, ["run"], "val_acc", F.col("epoch"), "epoch", "val_acc")


def losses(spark, sf_dir):
    rows = with_logits(spark, sf_dir)
    return rows.select("vec_id", "label", "logits", E.cross_entropy(F.col("logits"), F.col("label")).alias("ce"))


@query(LOGITS + "SELECT vec_id, label, round(ce, 6) AS ce FROM ce")
def ce_loss(spark, sf_dir):
    return losses(spark, sf_dir).select("vec_id", "label", F.round("ce", 6).alias("ce"))


@query(LOGITS + "SELECT round(avg(power(1 - exp(-greatest(ce, 1e-8)), 2) * greatest(ce, 1e-8)), 6) AS focal FROM ce")
def focal_loss(spark, sf_dir):
    return losses(spark, sf_dir).agg(F.round(F.avg(E.focal(F.col("ce"))), 6).alias("focal"))


@query(LOGITS + "SELECT round(avg(ce * CASE WHEN vec_id % 5 = 0 THEN 2.0 ELSE 1.0 END), 6) AS few_shot, round(avg(ce * CASE WHEN label IN (2, 5) THEN 3.0 ELSE 1.0 END), 6) AS hard FROM ce")
def weighted_ce(spark, sf_dir):
    few, hard = F.when(F.col("vec_id") % 5 == 0, 2.0).otherwise(1.0), F.when(F.col("label").isin(2, 5), 3.0).otherwise(1.0)
    return losses(spark, sf_dir).agg(F.round(F.avg(F.col("ce") * few), 6).alias("few_shot"), F.round(F.avg(F.col("ce") * hard), 6).alias("hard"))


@query(
    LOGITS
    + """, pri AS (SELECT label AS c, ln(count(*) / (SELECT count(*) FROM embeddings)) AS lp FROM embeddings GROUP BY label),
b AS (SELECT vec_id, label, c, logit + lp AS z FROM lg JOIN pri USING (c)),
bs AS (SELECT vec_id, any_value(label) AS label, ln(sum(exp(z))) - max(CASE WHEN c = label THEN z END) AS ce FROM b GROUP BY vec_id)
SELECT vec_id, label, round(ce, 6) AS ce FROM bs"""
)
def balanced_softmax(spark, sf_dir):
    """Cross-entropy with the logarithms of the class shares added to the logits."""
    e = table(spark, sf_dir, "embeddings")
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    priors = n.agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"), F.sum("n").alias("all"))  # a row for each class
    rows = with_logits(spark, sf_dir).crossJoin(F.broadcast(priors))
    shifted = F.transform("logits", lambda x: F.struct((x["logit"] + F.ln(F.element_at("m", x["c"]) / F.col("all"))).alias("logit"), x["c"].alias("c")))
    return rows.withColumn("logits", shifted).select("vec_id", "label", F.round(E.cross_entropy(F.col("logits"), F.col("label")), 6).alias("ce"))


@query("SELECT label, round((1.0 / n) / sum(1.0 / n) OVER (), 6) AS weight, round(ln(n / sum(n) OVER ()), 6) AS log_prior FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def inverse_freq_weights(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum(1 / F.col("n")).alias("inv"), F.sum("n").alias("all"))
    return n.crossJoin(F.broadcast(total)).select("label", F.round(1 / F.col("n") / F.col("inv"), 6).alias("weight"), F.round(F.ln(F.col("n") / F.col("all")), 6).alias("log_prior"))


@query("SELECT event_id AS step, round(CASE WHEN t = 0 THEN 1e-5 WHEN t <= 50 THEN 0.001 * t / 50 ELSE 1e-9 + (0.001 - 1e-9) * 0.5 * (1 + cos(pi() * (t - 50) / (n - 50))) END, 9) AS lr FROM (SELECT event_id, event_id - min(event_id) OVER () AS t, CAST(count(*) OVER () AS DOUBLE) AS n FROM events)")
def lr_schedule(spark, sf_dir):
    """The rate of each logged step: a linear warm-up over 50 steps from a least rate, then a cosine down to almost nothing."""
    log = table(spark, sf_dir, "events").select("event_id")
    size = log.agg(F.count(F.lit(1)).cast("double").alias("n"), F.min("event_id").alias("low"))  # one row
    rows = log.crossJoin(F.broadcast(size)).withColumn("t", F.col("event_id") - F.col("low"))
    t = F.col("t")
    cosine = 1e-9 + (0.001 - 1e-9) * 0.5 * (1 + F.cos(F.pi() * (t - 50) / (F.col("n") - 50)))
    return rows.select(F.col("event_id").alias("step"), F.round(F.when(t == 0, 1e-5).when(t <= 50, 0.001 * t / 50).otherwise(cosine), 9).alias("lr"))


@query("SELECT event_id, " + ", ".join(f"CAST(printf('%.{n}f', {x}) AS DOUBLE) AS {name}{n}" for name, x, n in (("eighth", "value / 8", 0), ("eighth", "value / 8", 3), ("share", "value / 1000", 4), ("cents", "value - 1000.005", 2))) + " FROM events")
def binary_rounding(spark, sf_dir):
    """Values rounded from their binary value, ties to even: eighths have true ties, and most decimal ties are none."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 8).alias("eighth"), (F.col("value") / 1000).alias("share"), (F.col("value") - 1000.005).alias("cents"))
    return rows.select("event_id", *[exact_round(F.col(name), n).alias(f"{name}{n}") for name, n in (("eighth", 0), ("eighth", 3), ("share", 4), ("cents", 2))])


@query(LOGITS + "SELECT vec_id, label, round(entropy, 6) AS entropy FROM (SELECT vec_id, any_value(label) AS label, -sum(p * ln(p)) AS entropy FROM (SELECT lg.vec_id, lg.label, exp(logit - lse) AS p FROM lg JOIN sm USING (vec_id)) GROUP BY vec_id)")
def entropy_rank(spark, sf_dir):
    p = V.softmax(F.transform("logits", lambda x: x["logit"]))
    return with_logits(spark, sf_dir).select("vec_id", "label", F.round(V.entropy(p), 6).alias("entropy"))


@query(LOGITS + "SELECT vec_id, label, pred FROM pr WHERE pred = label")
def zero_shot_filter(spark, sf_dir):
    return predictions(spark, sf_dir).filter("pred = label").select("vec_id", "label", "pred")


@query(LOGITS + "SELECT vec_id, label, pred, round(exp(max_logit * 10 - l), 6) AS confidence FROM (SELECT pr.*, (SELECT ln(sum(exp(logit * 10))) FROM lg WHERE lg.vec_id = pr.vec_id) AS l FROM pr) WHERE round(exp(max_logit * 10 - l), 6) >= 0.5")
def confidence_mask(spark, sf_dir):
    """Rows whose largest class probability, at temperature 0.1, reaches a threshold: pseudo labels."""
    scaled = F.transform("logits", lambda x: x["logit"] * 10)
    p = F.round(F.exp(F.col("max_logit") * 10 - V.log_sum_exp(scaled)), 6)
    return predictions(spark, sf_dir).withColumn("confidence", p).filter("confidence >= 0.5").select("vec_id", "label", "pred", "confidence")


@query(LOGITS + "SELECT vec_id, label, c AS best FROM lg WHERE vec_id IN (SELECT ex_id FROM ex) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, c) = 1 AND c = label")
def self_classify_synonyms(spark, sf_dir):
    """Names kept because their own class is the most similar one; exemplars play the names' part."""
    from seamline.operators.sampling import exemplars

    e = table(spark, sf_dir, "embeddings")
    names = exemplars(e.withColumn("embedding", F.struct("vec_id", "embedding")), 4).select("label", "ex.vec_id", "ex.embedding")
    return E.predicted(E.logits(names, prompts(spark, sf_dir))).filter("pred = label").select("vec_id", "label", F.col("pred").alias("best"))


@query(
    LOGITS
    + """, ct AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), hd AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) <= floor(0.9 * (SELECT count(*) FROM ct)) AS is_head FROM ct)
SELECT is_head, count(*) AS classes, round(avg(round(recall, 6)), 6) AS recall FROM hd JOIN sc ON class_id = label GROUP BY is_head"""
)
def head_tail_accuracy(spark, sf_dir):
    counts = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    scores = E.class_scores(cm(spark, sf_dir))
    rows = E.head_and_tail(counts).join(scores, F.col("label") == F.col("class_id"))
    return rows.groupBy("is_head").agg(F.count(F.lit(1)).alias("classes"), F.round(F.avg("recall"), 6).alias("recall"))


@query("SELECT n_name, coalesce(n, 0) AS n, round(100.0 * row_number() OVER (ORDER BY coalesce(n, 0) DESC, n_name) / (SELECT count(*) FROM nation), 6) AS x FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY ALL) ON c_nationkey = n_nationkey")
def imbalance_curve(spark, sf_dir):
    """Counts of all classes, largest first, with their place in percent of the classes."""
    n = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    dim = table(spark, sf_dir, "nation")
    total = dim.agg(F.count(F.lit(1)).alias("c"))
    rows = dim.join(F.broadcast(n), "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(F.broadcast(total))
    return rows.select("n_name", "n", F.round(100.0 * F.row_number().over(W.orderBy(F.desc("n"), "n_name")) / F.col("c"), 6).alias("x"))


@query("SELECT event_type, user_id % 7 AS epoch, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY ALL")
def group_mean_std(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 7).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


@query("SELECT round(avg(a), 6) AS mean_of_rounded FROM (SELECT source, round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 3) AS a FROM documents GROUP BY source)")
def dataset_mean_rounded(spark, sf_dir):
    """The mean over sets of values that were rounded before."""
    share = F.round(100.0 * F.count_if(F.col("lang") == "en") / F.count(F.lit(1)), 3)
    return table(spark, sf_dir, "documents").groupBy("source").agg(share.alias("a")).agg(F.round(F.avg("a"), 6).alias("mean_of_rounded"))


@query(LOGITS + "SELECT round(avg(CASE WHEN class_id IN (2, 5, 8) THEN round(recall, 6) END), 6) AS hard, round(avg(CASE WHEN class_id NOT IN (2, 5, 8) THEN round(recall, 6) END), 6) AS easy FROM sc")
def hard_easy_accuracy(spark, sf_dir):
    hard = F.col("class_id").isin(2, 5, 8)
    return E.class_scores(cm(spark, sf_dir)).agg(F.round(F.avg(F.when(hard, F.col("recall"))), 6).alias("hard"), F.round(F.avg(F.when(~hard, F.col("recall"))), 6).alias("easy"))


@query("SELECT d.source, count(*) AS matched, count(l.doc_id) AS downloaded, sum(count(*)) OVER ()::BIGINT AS all_matched FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def match_vs_download(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("got"))
    n = docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("matched"), F.count("got").alias("downloaded"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("matched").alias("all_matched"))))


@query("SELECT l_orderkey, l_linenumber, p_name, s_name, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 45")
def three_way_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    rows = items.join(part, items.l_partkey == part.p_partkey).join(supplier, items.l_suppkey == supplier.s_suppkey)
    return rows.select("l_orderkey", "l_linenumber", "p_name", "s_name", "l_quantity")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def taxonomy_lookup(spark, sf_dir):
    """Leaf rows with the names of the levels above them."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return rows.select("c_custkey", "n_name", "r_name")


@query("SELECT label, round(100.0 * count(*) FILTER (WHERE quality = 1 AND toxic = 0) / count(*), 6) AS relative, round(100.0 * count(*) FILTER (WHERE quality = 1 AND toxic = 0) / (SELECT count(*) FROM labels), 6) AS absolute FROM labels JOIN (SELECT doc_id, lang AS label FROM documents) USING (doc_id) GROUP BY label")
def pair_precision(spark, sf_dir):
    """Matched among the shared keys, and among all obtained."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"))
    good = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0))
    per = labels.join(docs, "doc_id").groupBy("label").agg(good.alias("g"), F.count(F.lit(1)).alias("n"))
    total = labels.agg(F.count(F.lit(1)).alias("all"))
    return per.crossJoin(F.broadcast(total)).select("label", F.round(100.0 * F.col("g") / F.col("n"), 6).alias("relative"), F.round(100.0 * F.col("g") / F.col("all"), 6).alias("absolute"))
