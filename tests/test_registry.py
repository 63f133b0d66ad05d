"""Every registered query against its SQL, and plan checks for all of them."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare
from workloads.oracle import oracle_queries
from workloads.queries import QUERIES

from conftest import SF

SQL = oracle_queries()
# Not expressible in SQL; covered by test_html.py.
ROWS_ONLY = {"sanitized_pages"}
# Streams have their own plans; running them is checked in the comparison.
STREAMS = {name for name in QUERIES if name.startswith("stream_")}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]).startswith("ok")


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 20 and "score" in df.columns


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_plan_scales(spark, name):
    """No pairing without a key, and no window that gathers a table in one task."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line:
            below = "\n".join(lines[i : i + 4])
            assert "Exchange SinglePartition" not in below
