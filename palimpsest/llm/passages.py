"""Live passages: the body texts of current versions that are long enough to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.tables import table

LEAST_WORDS = 16


def current_versions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "document_versions").filter("is_current").select("version_id").distinct()


def live_rows(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Body rows of current versions that may reach ``LEAST_WORDS`` words.

    Rows without a stored normal form pass, as theirs is derived later; rows
    delivered twice are still twice.
    """
    blanks = F.length("normalized") - F.length(F.replace("normalized", F.lit(" "), F.lit("")))
    segments = (
        table(spark, root, "segments")
        .filter((F.col("role") == "body") & (F.col("normalized").isNull() | (blanks >= LEAST_WORDS - 1)))
        .select("version_id", *columns)
    )
    return segments.join(current_versions(spark, root), "version_id", "left_semi").select(*columns)
