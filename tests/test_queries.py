"""Every query that has SQL, held against DuckDB over the smallest tables; and plans of the hot ones."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(k for k in entry.oracle_sql() if not k.startswith("op"))
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    assert sorted(d[0] for d in cursor.description) == columns
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted(repr(tuple(row[k] for k in order)) for row in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found.collect()) == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.entry(spark))


@pytest.mark.parametrize("name", ["t2t_rank_topk", "phrase_match", "near_duplicates", "three_way_join"])
def test_no_cross_product_and_no_row_udf(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)" in plan(entry.queries()["three_way_join"](spark, DATA))
