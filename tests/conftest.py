import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def root():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


#: The columns that name a row, which a row with a null elsewhere keeps unlike all others.
NAMES = {"segments": "id", "translations": "id", "documents": "doc_id", "manuals": "doc_id", "document_versions": "version_id", "benchmark": "item_id", "events": "event_id"}


@pytest.fixture(scope="session")
def dirty_root(spark, root, tmp_path_factory):
    """The tables with rows that are null in one column each, all-null rows, repeated rows and very long and empty texts."""
    from pyspark.sql import functions as F

    out = tmp_path_factory.mktemp("dirty")
    for f in os.listdir(root):
        name = f.split(".")[0]
        df = spark.read.parquet(f"{root}/{f}")
        one = df.limit(1)
        made = df
        for k, c in enumerate(df.columns):
            row = one
            if name in NAMES:
                row = row.withColumn(NAMES[name], F.lit(10_000_000 + k).cast("bigint"))
            made = made.unionByName(row.withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
        made = made.unionByName(one.select(*(F.lit(None).cast(x.dataType).alias(x.name) for x in df.schema))).unionByName(df.limit(3))
        if "text" in df.columns and name in NAMES:
            for k, t in enumerate(("", "  \n", "x" * 300_000, "word " * 60_000, "，" * 5000, "{" * 4000, "a-\n" * 3000)):
                made = made.unionByName(one.withColumn(NAMES[name], F.lit(20_000_000 + k).cast("bigint")).withColumn("text", F.lit(t)))
        made.write.parquet(f"{out}/{f}")
    return str(out)
