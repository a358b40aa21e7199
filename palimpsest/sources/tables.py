"""Readers for the table catalogue, and the staging area that cuts lineage.

A catalogue is a directory of parquet tables.  Every reader only names the
table; column pruning and filters reach the scan through Catalyst.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of staged tables with what opens their file system.
_STAGED: list[tuple[object, object]] = []
_OWN_DIR: list[str] = []


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows delivered twice count once.  Copies are equal in all columns, so any one of them stands."""
    return df.dropDuplicates([key])


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a folder of our own only in one process (tests).

    On a cluster without a shared folder executors would write to disks of
    their own and readers would see part of a table, so that is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="palimpsest-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return "file://" + _OWN_DIR[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Unlike ``checkpoint()`` this computes the plan once, keeps it columnar and
    compressed, and lets later readers prune columns; it survives the loss of
    executors as the folder is shared.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/palimpsest/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    if not _STAGED:
        atexit.register(_drop_at_exit)
    _STAGED.append((folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder))
    return spark.read.schema(df.schema).parquet(path)


def drop_staged() -> None:
    """Delete every staged table of this process, as the end of the process does.  Call earlier only when no result built on them is still to be read."""
    while _STAGED:
        files, folder = _STAGED.pop()
        files.delete(folder, True)


def _drop_at_exit() -> None:
    try:
        drop_staged()
    except Exception:  # the JVM may be gone before us; the folder then stays for whoever cleans the shared folder
        _STAGED.clear()


def parallelism(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def current_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of highest ``order`` per key, by a partial aggregate (no sort, no window)."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")
