"""The stored index against scans of the texts, and its ranking against sqlite3's."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from seamline.operators import matching as M
from seamline.operators import positional_index as I


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = "of the and crop annual salt pepper f a 18 st bernard café crops annually".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(3000)] + [None, "", "...", "the " * 3000, "N.A."]
    rows = [(k % 3, 10 * k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "shard int, row long, text string")
    root = str(tmp_path_factory.mktemp("index") / "i")
    I.add_shards(df.filter("shard = 0"), root)
    I.add_shards(df.filter("shard > 0"), root)
    return rows, df, root


NAMES = ["of the", "the of the", "crop", "cro*", "annual crop*", "^salt", "F/A-18", "st. bernard", "cafe", "salt & pepper", "the the the the", "nowhere", "the and*", "—", "^the of", "n.a.", "cro* of", "^cro* an*"]


def names(spark, prefix=None):
    return M.phrases_of(spark.createDataFrame([(0, n, 50 - k, k) for k, n in enumerate(NAMES)], "class_id int, synonym string, cnt int, ord int"), prefix)


@pytest.mark.parametrize("prefix", [None, "salt"])
def test_the_index_finds_what_a_scan_finds(spark, corpus, prefix):
    _, df, root = corpus
    phrases = names(spark, prefix)
    want = {(r.shard, r.row, r.synonym) for r in M.matches(df, phrases, ["shard", "row"]).collect()}
    rows = [(r.shard, r.row, r.synonym) for r in I.indexed_matches(spark, root, phrases).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len({n for *_, n in want}) > 8


def test_a_shard_is_replaced_alone(spark, corpus, tmp_path):
    _, df, _ = corpus
    root = str(tmp_path / "i")
    I.add_shards(df, root)
    I.add_shards(spark.createDataFrame([(1, 5, "annual crop"), (1, 6, "crop")], "shard int, row long, text string"), root)
    got = {(r.shard, r.row) for r in I.indexed_matches(spark, root, names(spark)).filter("synonym = 'crop'").collect()}
    assert {x for x in got if x[0] == 1} == {(1, 5), (1, 6)} and any(s == 0 for s, _ in got)
    assert I.lengths(spark, root).filter("shard = 1").count() == 2


def test_a_lookup_opens_only_its_tokens_buckets(spark, corpus):
    _, _, root = corpus
    phrases = names(spark).filter("synonym = 'of the'")
    plan = I.phrase_hits(spark, root, phrases)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "bucket IN" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert "PushedFilters: [In(token" in plan or "PushedFilters: [IsNotNull(token), In(token" in plan


def test_ranks_are_those_of_a_full_text_search(spark, corpus):
    rows, _, root = corpus
    got = {}
    for r in I.ranked(spark, root, names(spark, "salt")).collect():
        got[r.synonym, r.shard, r.row] = r.score
    c = sqlite3.connect(":memory:")
    try:
        c.execute("create virtual table t0 using fts5(text)")
    except sqlite3.OperationalError:
        pytest.skip("sqlite3 without full-text search")
    for shard in range(3):
        if shard:
            c.execute(f"create virtual table t{shard} using fts5(text)")
        c.executemany(f"insert into t{shard}(rowid, text) values (?, ?)", [(i, t or "N.A.") for s, i, t in rows if s == shard])
        for name, asked in (("of the", "salt of + the"), ("crop", "salt crop"), ("cro*", "salt cro*"), ("st. bernard", '"salt st. + bernard"'), ("annual crop*", "salt annual + crop*")):
            want = {r[0]: -r[1] for r in c.execute(f"select rowid, rank from t{shard} where t{shard} match ?", (asked,))}
            mine = {row: x for (n, s, row), x in got.items() if n == name and s == shard}
            assert mine.keys() == want.keys()
            assert all(abs(mine[i] - want[i]) < 1e-9 for i in want), name
