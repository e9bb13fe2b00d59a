"""Sources and sinks of the mining and evaluation stages, with stated schemas."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPTIONS = T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("nsfw", T.StringType())])
METRICS = "map<string, struct<name: string, alternates: map<string, bigint>, most_common_name: string, actual_freq: bigint, relevant_total: bigint, llama_relevance_ratio: double, changed_name: string>>"
TRAINING_LOG = "Epoch int, Iter int, Train_loss double, Val_loss double, Val_acc double, Test_acc double"
RESULTS = "Dataset string, Method string, DataSource string, Init string, Shots int, Seed int, Retrieve string, Stage1Acc double, Stage2Acc double"


def read_captions(spark: SparkSession, pattern: str, schema: T.StructType = CAPTIONS) -> DataFrame:
    """Caption shards; the shard's number is the first run of digits in the file's name."""
    rows = spark.read.schema(schema).parquet(pattern)
    return rows.withColumn("shard", F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"(\d+)", 1).cast("int"))


def write_mined(mined: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Mined rows, a folder for each class."""
    mined.write.mode(mode).partitionBy("class_id").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """A Parquet table, unless it is there already."""
    df.write.mode("ignore").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name, alternates, ...) of a JSON object keyed by class."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", METRICS).alias("m"))
    rows = whole.select(F.explode("m").alias("class_id", "v"))
    return rows.select(F.col("class_id").cast("int").alias("class_id"), "v.*")


def metrics_json(classes: DataFrame) -> DataFrame:
    """One row with the JSON object keyed by class, in the order of ids; a class dimension, so it fits one row."""
    entry = F.struct(F.col("class_id").cast("int").alias("i"), F.struct(*[c for c in classes.columns if c != "class_id"]).alias("v"))
    rows = F.transform(F.array_sort(F.collect_list(entry), lambda a, b: a["i"] - b["i"]), lambda e: F.struct(e["i"].cast("string").alias("key"), e["v"].alias("value")))
    return classes.agg(F.to_json(F.map_from_entries(rows), {"pretty": "true"}).alias("json"))


def read_split(spark: SparkSession, parts: list[tuple[str, str]]) -> DataFrame:
    """(path, label, source) from files of "path label source" lines, each with a prefix for its paths."""

    def one(file: str, prefix: str) -> DataFrame:
        fields = F.split("value", " ")
        rows = spark.read.text(file).filter(F.size(fields) == 3)
        path = F.concat(F.lit(prefix.rstrip("/") + "/"), fields[0]) if prefix else fields[0]
        return rows.select(path.alias("path"), fields[1].cast("int").alias("label"), fields[2].cast("int").alias("source"))

    return reduce(lambda a, b: a.unionByName(b), [one(*p) for p in parts])


def write_split(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Split lines in the order of labels; rows of a label in the order of paths."""
    lines = rows.sort("label", "path").select(F.concat_ws(" ", "path", F.col("label").cast("string"), F.col("source").cast("string")).alias("value"))
    lines.write.mode(mode).text(path)


def read_split_json(spark: SparkSession, path: str, part: str, prefix: str = "") -> DataFrame:
    """(path, label) of one part of a JSON object {part: [[path, label, name], ...]}."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<array<string>>>").alias("m"))
    rows = whole.select(F.explode(F.element_at("m", part)).alias("r"))
    return rows.select(F.concat(F.lit(prefix), F.col("r")[0]).alias("path"), F.col("r")[1].cast("int").alias("label"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name): the lines of a file, numbered from 0. A class list, so one task reads it."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("id", "name"))
    return rows.filter("name <> ''")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING_LOG).option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS).option("header", True).csv(path)


def read_images(spark: SparkSession, root: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, class_name, img_id, length) of image files in folders named for their class; contents are left unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("class_name"), F.split(F.element_at(parts, -1), r"\.")[0].alias("img_id"), "length")


def read_keyed_triple(spark: SparkSession, images: str, labels: str, flags: str) -> DataFrame:
    """Three space-separated files that share img_id, joined."""
    read = lambda path, schema: spark.read.schema(schema).option("sep", " ").csv(path)
    a = read(images, "img_id int, filepath string")
    return a.join(read(labels, "img_id int, target int"), "img_id").join(read(flags, "img_id int, is_training_img int"), "img_id")


def with_downloads(urls: DataFrame, files: DataFrame, order: str = "row") -> DataFrame:
    """urls with file_index: the row's number where a file named by it, padded to 12 digits, was saved."""
    have = files.select(F.col("img_id").cast("long").alias("file_index")).distinct()
    return urls.join(have, urls[order] == F.col("file_index"), "left")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, n) of lines "Class X - N images."."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[1].cast("int").alias("class_id"), parts[3].cast("long").alias("n"))


RUN_KEYS = ("dataset", "method", "datasource", "shots", "seed")


def metrics_file(folder: str, dataset: str, kind: str | None = None) -> str:
    """The path of a dataset's metrics; kind: a variant such as "query" or "coarse"."""
    return f"{folder.rstrip('/')}/{dataset}/{dataset}_metrics{'_' + kind if kind else ''}.json"


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    """The "key: value" lines of a small settings file."""
    pair = F.split("value", r":\s*", 2)
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^\s*[\w-]+\s*:") & ~F.col("value").rlike(r"^\s*#")).limit(1000)
    return {r.k: r.v for r in rows.select(F.trim(pair[0]).alias("k"), F.regexp_replace(F.trim(pair[1]), r"^['\"]|['\"]$", "").alias("v")).collect()}


def write_ordered_split(rows: DataFrame, path: str, place: str, mode: str = "errorifexists") -> None:
    """"path label source" lines by label; rows of a label stay in the order of their place in the input."""
    lines = rows.sort("label", place).select(F.concat_ws(" ", "path", F.col("label").cast("string"), F.col("source").cast("string")).alias("value"))
    lines.write.mode(mode).text(path)


def tagged_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(path, label) of "path label" lines whose paths may have spaces: the label is the last word, and a path ends at ".JPG " if it has that."""
    cut = F.regexp_extract(F.trim(value), r"^(.*\.JPG)\s+(-?\d+)$", 1)
    path = F.when(cut != "", cut).otherwise(F.regexp_extract(F.trim(value), r"^(.*?)\s+(-?\d+)$", 1))
    return lines.select(path.alias("path"), F.regexp_extract(F.trim(value), r"\s(-?\d+)$", 1).cast("int").alias("label"))


def with_pseudo_labels(labelled: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Labelled rows, then rows with labels that a model gave; is_pseudo tells them apart."""
    return labelled.select("path", "label", F.lit(False).alias("is_pseudo")).unionByName(pseudo.select("path", "label", F.lit(True).alias("is_pseudo")))


def write_lines(rows: DataFrame, path: str, *order: str, line: str = "line", mode: str = "errorifexists") -> None:
    """Text lines in an order."""
    rows.sort(*order).select(F.col(line).alias("value")).write.mode(mode).text(path)


def write_audit(rows: DataFrame, folder: str, prefix: str, *order: str) -> None:
    """Two lists of lines: what a sampler took, and what it passed over on the way."""
    for status in ("sampled", "filtered"):
        write_lines(rows.filter(F.col("status") == status), f"{folder.rstrip('/')}/{prefix}_{status}_list", *order)


def write_counts_json(counts: DataFrame, path: str, label: str = "label", n: str = "n", mode: str = "errorifexists") -> None:
    """One JSON object of counts by class, classes in order; a class dimension, so one row."""
    counts_json(counts, label, n).select("json").write.mode(mode).text(path)


def counts_json(counts: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct(F.col(label).cast("int").alias("k"), F.col(n).cast("long").alias("v"))))
    return counts.agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"].cast("string").alias("key"), e["v"].alias("value"))))).alias("json"))


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a CSV log with a header in each of its files."""
    rows.write.mode("append").option("header", True).csv(path)


def write_scores(scores: DataFrame, root: str, run: dict[str, object], mode: str = "errorifexists") -> None:
    """Scores of a run as JSON lines, in folders named for the run's keys."""
    keyed = scores.withColumns({k: F.lit(run[k]) for k in RUN_KEYS})
    keyed.write.mode(mode).partitionBy(*RUN_KEYS).json(root)


def read_scores(spark: SparkSession, root: str, **run: object) -> DataFrame:
    """Scores of the runs with these keys; only their folders are read."""
    schema = "class_id int, recall double, precision double, f1 double, dataset string, method string, datasource string, shots int, seed int"
    rows = spark.read.schema(schema).json(root)
    return rows.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in run.items()], F.lit(True)))


def write_confusion(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A sparse confusion table (label, pred, n)."""
    cells.select("label", "pred", "n").write.mode(mode).parquet(path)


def write_predictions(rows: DataFrame, path: str, *order: str, mode: str = "errorifexists") -> None:
    """"pred max_logit" lines in the order of the rows that they are for."""
    rows.sort(*order).select("pred", "max_logit").write.mode(mode).option("sep", " ").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pred int, max_logit double").option("sep", " ").csv(path)


def write_caption_map(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(class_id, img_id, caption), a folder for each class."""
    rows.select("class_id", "img_id", "caption").write.mode(mode).partitionBy("class_id").parquet(path)


def append_features(rows: DataFrame, path: str) -> None:
    """A chunk of stored vectors (path, label, image_vec, caption_vec), added to those that are there."""
    rows.select("path", "label", "image_vec", "caption_vec").write.mode("append").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, label int, image_vec array<float>, caption_vec array<float>").parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table stored at a path; made and stored first if it isn't there, or again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    done = at.suffix("/_SUCCESS")
    if again or not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_class_lists(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, label, name, key) of a JSON object of class lists: {set: [name, ...]} or {set: {key: name, ...}}, labels in the order
    listed from 0. A dimension of public class lists, so one task reads it."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
    sets = whole.select(F.explode("m").alias("set_name", "body"))
    keyed = F.from_json("body", "map<string, string>")
    plain = F.transform(F.from_json("body", "array<string>"), lambda n: F.struct(F.lit(None).cast("string").alias("key"), n.alias("name")))
    pairs = F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("name")))
    rows = sets.select("set_name", F.posexplode(F.when(F.trim("body").startswith("["), plain).otherwise(pairs)).alias("label", "e"))
    return rows.select("set_name", "label", "e.name", "e.key")


def write_version(rows: DataFrame, root: str, version: int) -> None:
    """A table's next version, a folder of its own; those before it stay."""
    rows.write.mode("overwrite").parquet(f"{root.rstrip('/')}/version={version:06d}")


def read_version(spark: SparkSession, root: str, version: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/version={version:06d}")
