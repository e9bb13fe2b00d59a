from pyspark.sql import functions as F

from seamline.functions import text as X
from seamline.operators import matching as M


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_clean_name(spark):
    rows = [("  F/A-18\n",), ("it's  \"so\"",), ("a   b",), ("Snow_White",), (None,), ("",)]
    assert values(spark, rows, X.clean_name(F.col("x"))) == ["f/a 18", "its so", "a  b", "snow white", None, ""]


def test_caption_and_tokens(spark):
    assert values(spark, [(None,), ("",), ("Red_dog's-Bone",)], X.caption(F.col("x"))) == ["N.A.", "N.A.", "Red dogs Bone"]
    assert values(spark, [("Café, 707-320!",), ("...",)], X.tokens(F.col("x"))) == [["cafe", "707", "320"], []]


def test_numbered_entries(spark):
    got = values(spark, [("1. Red fox (Vulpes)\n2.  Grey-fox [x]",)], X.numbered_entries(F.col("x")))[0]
    assert [(e.place, e.entry) for e in got] == [(1, "red fox"), (2, "grey fox")]


def test_template(spark):
    rows = [("a {} of {}.", "x", "y"), ("a {}.", "x", "y"), ("none", "x", "y")]
    got = values(spark, rows, X.from_template(F.col("t"), F.col("a"), F.col("b")), "t string, a string, b string")
    assert got == ["a x of y.", "a x.", "none"]


def synonyms(spark, rows):
    return spark.createDataFrame(rows, "class_id int, synonym string, cnt int, ord int")


def found(spark, texts, names, prefix=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    phrases = M.phrases_of(synonyms(spark, [(0, n, 10 - k, k) for k, n in enumerate(names)]), prefix)
    return {(r.id, r.synonym) for r in M.matches(docs, phrases, ["id"]).collect()}


def test_phrases(spark):
    texts = ["boeing  707-320 jet", "707 Boeing", "annual crop", "annual crops", "a café", None]
    assert found(spark, texts, ["boeing 707", "crop", "cafe"]) == {(0, "boeing 707"), (2, "crop"), (4, "cafe")}


def test_prefix(spark):
    texts = ["annual crop by satellite", "satellite f a 18", "f a 18 satellite"]
    assert found(spark, texts, ["annual crop", "F/A-18"], "satellite") == {(0, "annual crop"), (1, "F/A-18")}


def test_equal_synonyms_count_once(spark):
    assert found(spark, ["boeing 707 320"], ["707-320", "707 320"]) == {(0, "707-320")}


def test_attribution_and_counts(spark):
    phrases = M.phrases_of(synonyms(spark, [(0, "red", 5, 0), (0, "red fox", 9, 1), (0, "fox", 5, 2)]))
    docs = spark.createDataFrame([(1, "a red fox"), (2, "a fox"), (3, "red")], "id long, text string")
    hits = M.matches(docs, phrases, ["id"])
    assert {(r.id, r.synonym) for r in M.attributed(hits, ["id"]).collect()} == {(1, "red fox"), (2, "fox"), (3, "red")}
    assert {r.synonym: r.cnt for r in M.synonym_counts(hits, phrases).collect()} == {"red": 2, "red fox": 1, "fox": 2}


def test_most_common_name(spark):
    counts = synonyms(spark, [(0, "707-320", 33, 0), (0, "boeing 707", 1091, 1), (1, "snow bear", 3, 0), (1, "bear", 9, 1)])
    names = spark.createDataFrame([(0, "707-320"), (1, "snow bear")], "class_id int, name string")
    relaxed = {r.class_id: r.most_common_name for r in M.most_common_name(names, counts).collect()}
    strict = {r.class_id: r.most_common_name for r in M.most_common_name(names, counts, True).collect()}
    assert relaxed == {0: "boeing 707", 1: "snow bear"}
    assert strict == {0: "boeing 707", 1: "bear"}
