"""The queries of this subpackage that SQL can say, against DuckDB."""

import os

import duckdb
import pytest

from palimpsest.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, root, name):
    con = duckdb.connect()
    for f in os.listdir(root):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{root}/{f}'")
    mine, theirs = QUERIES[name](spark, root).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(tuple, mine[columns].values.tolist())) == sorted(map(tuple, theirs[columns].values.tolist()))
