"""Every registered query with SQL against DuckDB on the smallest tables."""

import collections
import os

import pandas as pd
import pytest

import __spark_entry__
from gleaner.plans import choices, corpus, details, events, files, graphs, matches, retrievals, rows, studies, trails

DATA = "/root/testdata/sf0.001"
MODULES = (files, rows, corpus, graphs, events, studies, choices, matches, trails, retrievals, details)
NAMES = [n for m in MODULES for n in m.registry.sql]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def counted(df):
    text = lambda v: "NULL" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return collections.Counter(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    want = duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert counted(got) == counted(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't here")
def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).columns == ["source", "category", "n", "files", "priority"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_story_coverage_moves_each_item_once(spark, tmp_path):
    """Distinct counts of two kinds over four axes do not multiply the items before the shuffle; null ids and flags count for nothing."""
    from gleaner.plans import studies

    rows = [(1, 5, 7, 1, 3.0, "A"), (1, 5, 8, 2, 3.0, "R"), (1, None, 8, 3, 4.0, None), (2, None, 1, 1, 1.0, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = studies.story_coverage(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, "part", 1, 1), (1, "supplier", 2, 1), (1, "line", 3, 1), (1, "quantity", 2, 1), (2, "part", 0, 0), (2, "supplier", 1, 0), (2, "line", 1, 0), (2, "quantity", 1, 0)}
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
