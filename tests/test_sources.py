import json

from seamline.operators.ranges import numbered
from seamline.sources import files as S


def test_split_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b.jpg", 1, 1), ("a.jpg", 0, 0)], "path string, label int, source int")
    S.write_split(rows, str(tmp_path / "s"))
    got = S.read_split(spark, [(str(tmp_path / "s"), "root"), (str(tmp_path / "s"), "")]).collect()
    assert {tuple(r) for r in got} == {("root/b.jpg", 1, 1), ("root/a.jpg", 0, 0), ("b.jpg", 1, 1), ("a.jpg", 0, 0)}


def test_metrics_round_trip(spark, tmp_path):
    known = {"1": {"name": "b", "alternates": {"b": 2}, "most_common_name": "b", "actual_freq": 2}, "0": {"name": "a", "alternates": {"x": 1, "a": 0}}}
    (tmp_path / "m.json").write_text(json.dumps(known))
    rows = S.read_metrics(spark, str(tmp_path / "m.json"))
    assert {r.class_id: r.alternates for r in rows.collect()} == {0: {"x": 1, "a": 0}, 1: {"b": 2}}
    again = json.loads(S.metrics_json(rows).first()[0])
    assert list(again) == ["0", "1"] and again["1"]["actual_freq"] == 2


def test_numbered(spark):
    got = numbered(spark.range(0, 1000, 1, 7).selectExpr("id * 7 % 1000 AS v"), "v").orderBy("v").collect()
    assert [r.row for r in got] == list(range(1000))


def test_small_files(spark, tmp_path):
    (tmp_path / "n.txt").write_text("cat\ndog\n")
    (tmp_path / "c.txt").write_text("Class 3 - 12 images.\n")
    (tmp_path / "l.csv").write_text("Epoch,Iter,Train_loss,Val_loss,Val_acc,Test_acc\n1,10,0.5,0.6,70.0,71.5\n")
    (tmp_path / "j.json").write_text(json.dumps({"train": [["x.jpg", 4, "n"]], "val": []}))
    assert [tuple(r) for r in S.read_names(spark, str(tmp_path / "n.txt")).collect()] == [(0, "cat"), (1, "dog")]
    assert [tuple(r) for r in S.read_counts(spark, str(tmp_path / "c.txt")).collect()] == [(3, 12)]
    assert S.read_log(spark, str(tmp_path / "l.csv")).first().Test_acc == 71.5
    assert [tuple(r) for r in S.read_split_json(spark, str(tmp_path / "j.json"), "train", "p/").collect()] == [("p/x.jpg", 4)]


def test_images(spark, tmp_path):
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "12.jpg").write_bytes(b"123")
    got = S.read_images(spark, str(tmp_path)).collect()
    assert [(r.class_name, r.img_id, r.length) for r in got] == [("cat", "12", 3)]
