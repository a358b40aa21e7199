"""Every query with SQL against DuckDB on the smallest tables, and on empty ones."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from palimpsest.plans import catalogue


def canonical(df: pd.DataFrame) -> list[str]:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float | np.floating) and np.isnan(v)):
            return "-"
        if isinstance(v, bool | np.bool_):
            return str(bool(v))
        if isinstance(v, int | np.integer):
            return str(int(v))
        if isinstance(v, float | np.floating):
            return f"{v:.6g}"
        return str(list(v) if isinstance(v, np.ndarray) else v)

    return sorted("|".join(map(text, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(root):
    con = duckdb.connect()
    for f in os.listdir(root):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{root}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, root, duck, name):
    mine, theirs = catalogue.QUERIES[name](spark, root).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


@pytest.fixture(scope="module")
def empty_root(spark, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for f in os.listdir(root):
        df = spark.read.parquet(f"{root}/{f}").limit(0)
        # a further column whose name clashes with an intermediate one
        df.selectExpr("*", "1 AS n", "'x' AS _r").write.parquet(f"{out}/{f}")
    return str(out)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_on_empty_tables(spark, empty_root, name):
    rows = catalogue.QUERIES[name](spark, empty_root).collect()
    assert all(not any(v for v in r if isinstance(v, int)) for r in rows)  # nothing, or zeros of a total


def test_import_without_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 60 and e.oracle_sql()"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_on_nulls_repeats_and_long_texts(spark, dirty_root, name):
    rows = catalogue.QUERIES[name](spark, dirty_root).collect()
    assert rows is not None
