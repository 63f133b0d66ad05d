import glob
import os

import duckdb
import pytest

from check import compare
from feedspan.llm.oracle import SQL
from feedspan.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[: -len('.parquet')]} AS SELECT * FROM '{path}'")
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]).startswith("ok")
