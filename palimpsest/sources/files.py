"""Files beside the parquet tables: glossary and backup in JSON, landed originals, paths and settings."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GLOSSARY = "en STRING, zh STRING, case_sensitive BOOLEAN, note STRING"


def read_glossary(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame:
    """Glossary terms of a JSON file; rows without a term on either side are dropped.

    A missing file gives ``fallback`` (else no rows); bad records are null and
    fall out with the rest.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return fallback if fallback is not None else spark.createDataFrame([], GLOSSARY)
    rows = spark.read.option("multiLine", True).schema(GLOSSARY).json(path)
    return rows.filter((F.trim("en") != "") & (F.trim("zh") != "")).withColumn("case_sensitive", F.coalesce("case_sensitive", F.lit(False)))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per line in a folder that readers see whole or not at all: written beside it, then renamed."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").json(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(hadoop(path), True)
    files.rename(hadoop(staged), hadoop(path))


BACKUP = (
    "version_id BIGINT, page INT, order_index INT, fingerprint STRING, canonical_text STRING, text STRING, status STRING, provider STRING, model STRING, confidence DOUBLE, revision INT, reviewed_by STRING"
)


def backup_rows(segments: DataFrame, answers: DataFrame) -> DataFrame:
    """What a backup keeps of each non-blank answer: enough of its segment to find it again."""
    s = segments.select(F.col("id").alias("segment_id"), "version_id", "page", "order_index", "fingerprint", "canonical_text")
    columns = [c.strip().split(" ")[0] for c in BACKUP.split(",")]
    return answers.filter(F.trim("text") != "").join(s, "segment_id").select(*columns)


def read_backup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BACKUP).json(path)


def landed_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, n_bytes, sha256, modified) of landed originals, the content key of an idempotent ingest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def new_files(landed: DataFrame, versions: DataFrame) -> DataFrame:
    """Landed files whose content no version has; of equal files the first path counts."""
    first = landed.groupBy("sha256").agg(F.min_by(F.struct("path", "n_bytes"), "path").alias("f")).select("sha256", "f.*")
    return first.join(versions.select("sha256").distinct(), "sha256", "left_anti")


def relative_path(path: Column, root: str) -> Column:
    """Paths under ``root`` relative to it, with forward slashes; others stay."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(F.lower(p), F.lit(r.lower())), F.substring(p, F.lit(len(r) + 1), F.length(p))).otherwise(p)


def absolute_path(path: Column, root: str) -> Column:
    is_absolute = path.rlike("^(/|[A-Za-z]:/|[a-z]+://)")
    return F.when(is_absolute, path).otherwise(F.concat(F.lit(str(PurePosixPath(root)) + "/"), path))


def settings(defaults: Mapping[str, object], file: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "PALIMPSEST_") -> dict[str, object]:
    """Defaults, then a JSON file, then environment variables of the prefix; values take the type of their default."""
    out = dict(defaults)
    if file and os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            out |= json.load(f)
    for name, default in defaults.items():
        raw = (os.environ if environment is None else environment).get(prefix + name.upper())
        if raw is not None:
            out[name] = raw.lower() in ("1", "true", "on", "yes") if isinstance(default, bool) else type(default)(raw) if default is not None else raw
    return out
