"""Queries with trained heads, streams and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import experiments as X
from seamline.operators import learning as L
from seamline.operators import matching as M
from seamline.operators.ranges import epoch_batches
from seamline.operators.sampling import few_shot
from seamline.plans.common import scratch, table
from seamline.plans.evaluation_queries import LOGITS, predictions
from seamline.plans.text_queries import phrase_sql, synonyms
from seamline.plans.vector_queries import SPLIT_SQL, features, prompts

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def linear_probe(spark, sf_dir):
    """Predictions for all rows of a probe trained on 16 rows of each class."""
    e = table(spark, sf_dir, "embeddings")
    return L.probe(L.fit_probe(few_shot(e, 16, 1)), e).select("vec_id", "label", "pred")


@query
def cross_modal_probe(spark, sf_dir):
    rows = features(spark, sf_dir)
    return L.probe(L.fit_probe(L.cross_modal(few_shot(rows, 16, 1))), rows).select("vec_id", "label", "pred")


@query
def source_classifier(spark, sf_dir):
    """Few-shot rows told from retrieved ones."""
    rows = features(spark, sf_dir).withColumn("source", (F.col("vec_id") % 2).cast("int"))
    return L.probe(L.fit_probe(rows, label="source"), rows).select("vec_id", "source", "pred")


@query
def incremental_mining(spark, sf_dir):
    """Documents mined as a stream, to a table; the same rows as the batch form without attribution."""
    from seamline.streaming.incremental import mined_stream, run_once

    at = scratch(spark)
    docs = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    timed = docs.withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(secs=F.pmod("doc_id", F.lit(60))))
    run_once(mined_stream(timed, M.phrases_of(synonyms(spark)), ["doc_id"], "ts"), f"{at}/mined", f"{at}/state")
    return spark.read.schema("doc_id long, text string, class_id int, synonym string").parquet(f"{at}/mined").select("doc_id", "class_id", "synonym")


@query
def event_windows(spark, sf_dir):
    from seamline.streaming.incremental import event_windows as windows

    return windows(table(spark, sf_dir, "events"), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query
def split_round_trip(spark, sf_dir):
    """A split written as lines and read back with a prefix."""
    from seamline.plans.vector_queries import split
    from seamline.sources.files import read_split, write_split

    at = scratch(spark)
    write_split(split(spark, sf_dir), f"{at}/split")
    return read_split(spark, [(f"{at}/split", "images")])


@query
def confusion_incremental(spark, sf_dir):
    """A confusion matrix of predictions that come as files, counted by a stream in two runs with one checkpoint."""
    from seamline.streaming.confusion import count_predictions, counted

    at, rows = scratch(spark), predictions(spark, sf_dir).select("vec_id", "label", "pred")
    for k in range(2):
        rows.filter(F.col("vec_id") % 2 == k).select("label", "pred").write.mode("append").parquet(f"{at}/predictions")
        count_predictions(spark.readStream.schema("label int, pred int").parquet(f"{at}/predictions"), f"{at}/matrix", f"{at}/state")
    return counted(spark, f"{at}/matrix")


@query
def resumable_ingestion(spark, sf_dir):
    """Events stored in batches: a run that leaves off, one that goes on, and one that finds nothing to do."""
    from seamline.sources.ingest import ingest, ingested

    at, rows = scratch(spark), table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    runs = [ingest(rows, at, "event_id", 6, stop_after=stop) for stop in (2, None, None)]
    return ingested(spark, at, "event_id long, event_type string, user_id long, value double").select("event_id", "event_type", "user_id", "value", F.lit(len(runs[2])).alias("left"))


@query
def two_stage_driver(spark, sf_dir):
    """The best setting of each stage and sweep; the stages are stored, and a second run would make none of them."""
    rows = features(spark, sf_dir).select("vec_id", "label", "embedding")
    part = F.col("vec_id") % 4
    train = rows.filter(part < 2)
    stages = X.Stages(spark, scratch(spark))
    return X.two_stages(stages, train, few_shot(train, 16, 1).drop("pick"), rows.filter(part == 2), rows.filter(part == 3), prompts(spark, sf_dir), {"table": sf_dir}, taus=(0.0, 0.5, 1.0), alphas=(0.0, 0.5, 1.0))


@query
def self_training(spark, sf_dir):
    """Labels of a probe that is fitted again on what it was sure of, until its labels settle."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    known = few_shot(rows, 16, 1).drop("pick")
    found, _ = X.self_trained(known, rows.join(known.select("vec_id"), "vec_id", "left_anti"), scratch(spark), rounds=3, threshold=0.6)
    return found.select("vec_id", "pred", F.round("confidence", 6).alias("confidence"))


PERMUTED = """list_reduce(list_prepend({x}, range(1, 25)), lambda v, k: CASE WHEN ('0x' || substr(md5({key} || '|' || k || '|' || greatest(v, {partner})), 1, 8))::BIGINT % 2 = 1 THEN {partner} ELSE v END)"""
_KEY = "'4|' || s.source || '|' || epoch"
_PARTNER = f"((('0x' || substr(md5({_KEY} || '|k|' || k), 1, 8))::BIGINT - v) % n + n) % n"


@query
def epoch_batches_mixed(spark, sf_dir):
    """Batches of 8 few-shot and 24 retrieved rows over several passes; each pass over a part is shuffled anew."""
    from seamline.plans.vector_queries import split

    slots = X.epoch_slots(spark, 60, {1: 8, 0: 24})
    return epoch_batches(split(spark, sf_dir), slots, 4, "path").select(F.col("batch").cast("int").alias("batch"), "slot", "source", "epoch", "path")


ORACLES["confusion_incremental"] = LOGITS + "SELECT label, pred, n FROM cm"
ORACLES["resumable_ingestion"] = "SELECT event_id, event_type, user_id, value, CAST(0 AS INTEGER) AS left FROM events"
ORACLES["epoch_batches_mixed"] = (
    SPLIT_SQL
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM both_),
sl AS (SELECT b, s, CASE WHEN s < 8 THEN 1 ELSE 0 END AS source, CASE WHEN s < 8 THEN b * 8 + s ELSE b * 24 + s - 8 END AS t FROM range(60) x(b), range(32) y(s)),
s AS (SELECT sl.*, n, t // n AS epoch FROM sl JOIN (SELECT DISTINCT source, n FROM r) USING (source)),
p AS (SELECT s.*, {PERMUTED.format(x="t % n", key=_KEY, partner=_PARTNER)} AS place FROM s)
SELECT CAST(b AS INTEGER) AS batch, CAST(s AS INTEGER) AS slot, source, epoch, path FROM p JOIN r USING (source, place)"""
)
ORACLES["incremental_mining"] = phrase_sql() + "SELECT doc_id, class_id, synonym FROM found"
ORACLES["event_windows"] = "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"
ORACLES["split_round_trip"] = SPLIT_SQL + "SELECT 'images/' || path AS path, label, source FROM both_"
