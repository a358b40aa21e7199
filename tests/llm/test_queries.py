"""The registered queries on the smallest tables and on empty ones."""

import os

import pytest

from palimpsest.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, root, name):
    df = QUERIES[name](spark, root)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


@pytest.fixture(scope="module")
def empty_root(spark, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for f in os.listdir(root):
        spark.read.parquet(f"{root}/{f}").limit(0).write.parquet(f"{out}/{f}")
    return str(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_on_empty_tables(spark, empty_root, name):
    assert QUERIES[name](spark, empty_root).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_on_nulls_repeats_and_long_texts(spark, dirty_root, name):
    rows = [tuple(r) for r in QUERIES[name](spark, dirty_root).collect()]
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) and all(v is not None for r in rows for v in r)
