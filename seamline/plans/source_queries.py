"""Queries over sources and sinks: tables written in the formats of the mining and evaluation stages, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import evaluation as E
from seamline.operators import matching as M
from seamline.plans.common import scratch, table
from seamline.plans.curation_queries import METRICS_SQL, metrics
from seamline.plans.text_queries import MINED, found_in_documents, phrase_sql
from seamline.plans.vector_queries import DOT, PROMPTS, SPLIT_SQL, prompts, split
from seamline.sources import files

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def mined(spark, sf_dir):
    return M.attributed(found_in_documents(spark, sf_dir)[0], ["doc_id"]).select("class_id", "synonym", "doc_id", F.md5("text").alias("digest"))


@query(phrase_sql() + f", {MINED} SELECT class_id, synonym, doc_id, md5(text) AS digest FROM mined WHERE class_id IN (1, 3)")
def mined_folders(spark, sf_dir):
    """Mined rows in a folder for each class; two of the folders are read."""
    at = scratch(spark)
    files.write_mined(mined(spark, sf_dir), f"{at}/mined")
    rows = spark.read.schema("synonym string, doc_id long, digest string, class_id int").parquet(f"{at}/mined")
    return rows.filter(F.col("class_id").isin(1, 3)).select("class_id", "synonym", "doc_id", "digest")


@query("SELECT page_id AS row, url FROM pages WHERE page_id % 2 = 0")
def url_list_once(spark, sf_dir):
    """A list of urls that is stored once: a second write of other rows changes nothing."""
    at, pages = scratch(spark), table(spark, sf_dir, "pages").select(F.col("page_id").alias("row"), "url")
    files.write_once(pages.filter("row % 2 = 0"), f"{at}/urls")
    files.write_once(pages, f"{at}/urls")
    return spark.read.schema("row long, url string").parquet(f"{at}/urls")


@query("SELECT page_id AS row, url, CASE WHEN d.doc_id IS NOT NULL THEN page_id END AS file_index FROM pages LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) d ON d.doc_id = page_id")
def downloads_in_meta(spark, sf_dir):
    """A table of rows to fetch, and its next version with the number of each file that was saved."""
    at, pages = scratch(spark), table(spark, sf_dir, "pages").select(F.col("page_id").alias("row"), "url")
    files.write_version(pages, at, 1)
    saved = table(spark, sf_dir, "labels").filter("quality = 1").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("img_id"))
    files.write_version(files.with_downloads(files.read_version(spark, at, 1, "row long, url string"), saved), at, 2)
    return files.read_version(spark, at, 2, "row long, url string, file_index long")


@query(f"WITH {METRICS_SQL} SELECT CAST(replace(class_id, 'Brand#', '') AS INTEGER) AS class_id, name, alternate, CAST(n AS BIGINT) AS n FROM al JOIN nm USING (class_id)")
def metrics_files(spark, sf_dir):
    """Metrics as a JSON object in a file by the set's name, read back by that name."""
    at = scratch(spark)
    rows = metrics(spark, sf_dir).withColumn("class_id", F.replace("class_id", F.lit("Brand#"), F.lit("")))
    path = files.metrics_file(at, "parts", "query")
    files.metrics_json(rows).write.text(path)
    return files.read_metrics(spark, path).select("class_id", "name", F.explode("alternates").alias("alternate", "n"))


@query(SPLIT_SQL + "SELECT 'val/' || path AS path, label FROM both_ WHERE source = 0")
def split_json(spark, sf_dir):
    """A JSON object of the parts of a split, a bounded number of rows for each class, of which one part is read with a prefix."""
    at = scratch(spark)
    rows = split(spark, sf_dir).select(F.when(F.col("source") == 1, "train").otherwise("val").alias("part"), F.array("path", F.col("label").cast("string"), F.lit("name")).alias("r"))
    parts = rows.groupBy("part").agg(F.collect_list("r").alias("rs"))
    parts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("part", "rs")))).alias("value")).write.text(f"{at}/split.json")
    return files.read_split_json(spark, f"{at}/split.json", "val", "val/")


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS id, n_name AS name FROM nation")
def label_lines(spark, sf_dir):
    """Names numbered by their lines."""
    at = scratch(spark)
    files.write_lines(table(spark, sf_dir, "nation").coalesce(1), f"{at}/names", "n_nationkey", line="n_name")
    return files.read_names(spark, f"{at}/names")


@query("SELECT c_nationkey AS class_id, count(*) AS n FROM customer GROUP BY ALL")
def count_lines(spark, sf_dir):
    """Counts of classes as lines of a report."""
    at = scratch(spark)
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    files.write_lines(n.withColumn("line", F.format_string("Class %d - %d images.", "c_nationkey", "n")), f"{at}/counts", "c_nationkey")
    return files.read_counts(spark, f"{at}/counts")


@query("SELECT CAST(user_id % 50 AS INTEGER) AS Epoch, CAST(event_id AS INTEGER) AS Iter, value AS Train_loss, round(value / 2, 6) AS Val_loss, CAST(0 AS DOUBLE) AS Val_acc, CAST(1 AS DOUBLE) AS Test_acc FROM events")
def training_log(spark, sf_dir):
    """A log that grows by appended rows, read with its header."""
    at = scratch(spark)
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("Epoch"), F.col("event_id").alias("Iter"), F.col("value").alias("Train_loss"), F.round(F.col("value") / 2, 6).alias("Val_loss"), F.lit(0.0).alias("Val_acc"), F.lit(1.0).alias("Test_acc"))
    for k in range(2):
        files.append_log(rows.filter(F.col("Iter") % 2 == k), f"{at}/log")
    return files.read_log(spark, f"{at}/log")


@query("SELECT n_name AS Dataset, 'probing' AS Method, 'fewshot' AS DataSource, 'text' AS Init, CAST(n_regionkey AS INTEGER) AS Shots, CAST(n_nationkey AS INTEGER) AS Seed, 'T2T' AS Retrieve, round(avg(c_acctbal), 1) AS Stage1Acc, round(max(c_acctbal), 1) AS Stage2Acc FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def results_table(spark, sf_dir):
    """One line of results for each run, appended run by run."""
    at = scratch(spark)
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "n_regionkey", "n_nationkey")
    rows = rows.agg(F.round(F.avg("c_acctbal"), 1).alias("a"), F.round(F.max("c_acctbal"), 1).alias("b"))
    out = rows.select(F.col("n_name").alias("Dataset"), F.lit("probing").alias("Method"), F.lit("fewshot").alias("DataSource"), F.lit("text").alias("Init"), F.col("n_regionkey").alias("Shots"), F.col("n_nationkey").alias("Seed"), F.lit("T2T").alias("Retrieve"), F.col("a").alias("Stage1Acc"), F.col("b").alias("Stage2Acc"))
    for k in range(2):
        files.append_log(out.filter(F.col("Seed") % 2 == k), f"{at}/results")
    return files.read_results(spark, f"{at}/results")


@query("SELECT 'brands' AS set_name, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS label, p_brand AS name, NULL::VARCHAR AS key FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'nations', CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER), n_name, CAST(n_nationkey AS VARCHAR) FROM nation")
def class_lists(spark, sf_dir):
    """Class lists of two kinds, plain and keyed, from one file."""
    at = scratch(spark)
    brands = table(spark, sf_dir, "part").select("p_brand").distinct().agg(F.to_json(F.array_sort(F.collect_list("p_brand"))).alias("a"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))))
    nations = table(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["k"].cast("string").alias("key"), x["v"].alias("value"))))).alias("b"))
    both = brands.crossJoin(nations)  # one row each
    both.select(F.concat(F.lit('{"brands": '), "a", F.lit(', "nations": '), "b", F.lit("}")).alias("value")).write.text(f"{at}/lists.json")
    return files.read_class_lists(spark, f"{at}/lists.json")


SHIFTED = f"""sets(set_name, vec_id, label, x) AS (SELECT 'plain', vec_id, label, embedding FROM embeddings UNION ALL SELECT 'coarse', vec_id, label, list_transform(embedding, lambda v: CAST(floor(v * 8) / 8 AS FLOAT)) FROM embeddings
  UNION ALL SELECT 'flipped', vec_id, label, list_reverse(embedding) FROM embeddings UNION ALL SELECT 'part', vec_id, label, embedding FROM embeddings WHERE label IN (1, 3, 4, 8)),
lg AS (SELECT set_name, s.vec_id, s.label, p.label AS c, round({DOT.format(a="s.x", b="p.vec")}, 6) AS logit FROM sets s, prompts p WHERE set_name <> 'part' OR p.label IN (1, 3, 4, 8)),
pr AS (SELECT set_name, label, c FROM lg QUALIFY row_number() OVER (PARTITION BY set_name, vec_id ORDER BY logit DESC, c) = 1),
ac AS (SELECT set_name, 100.0 * avg(CASE WHEN c = label THEN 1.0 ELSE 0.0 END) AS acc FROM pr GROUP BY set_name)
SELECT set_name, round(acc, 6) AS acc FROM ac UNION ALL SELECT 'mean', round(avg(acc), 6) FROM ac"""


@query(PROMPTS + ", " + SHIFTED)
def shifted_sets(spark, sf_dir):
    """Accuracy on shifted sets, each a stored table of its own; one of them has four classes, and only these compete."""
    at, e = scratch(spark), table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    made = {
        "plain": e,
        "coarse": e.withColumn("embedding", F.transform("embedding", lambda v: (F.floor(v * 8) / 8).cast("float"))),
        "flipped": e.withColumn("embedding", F.reverse("embedding")),
        "part": e.filter(F.col("label").isin(1, 3, 4, 8)),
    }
    sets = {}
    for name, rows in made.items():
        rows.write.parquet(f"{at}/{name}")
        stored = spark.read.schema(e.schema).parquet(f"{at}/{name}")
        sets[name] = stored, stored.select("label").distinct() if name == "part" else None
    return E.shifted_accuracy(sets, prompts(spark, sf_dir)).withColumn("acc", F.round("acc", 6))
