"""Version landing as a stream (an extension): files of segments arrive, versions become consecutive snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def segment_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of segments as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def land(stream: DataFrame, target: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Append each batch's rows that the target has not, once each; a batch that is run again adds nothing.

    The target is partitioned by version, and a batch only looks at the
    versions it brings.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.schema(batch.schema).parquet(target)
            mine = known.join(rows.select("version_id").distinct(), "version_id", "left_semi")
            rows = rows.join(mine.select(key), key, "left_anti")
        rows.write.mode("append").partitionBy("version_id").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(events: DataFrame, key: str, at: str, order: str, delay: str = "1 hour") -> DataFrame:
    """Per window of an hour and key the latest row, late ones up to ``delay`` included; works on streams and tables."""
    rest = [c for c in events.columns if c not in (key, at)]
    return (
        events.withWatermark(at, delay)
        .groupBy(F.window(at, "1 hour").alias("window"), key)
        .agg(F.max_by(F.struct(at, *rest), F.struct(at, order)).alias("last"), F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("hour"), key, "last.*", "n")
    )


def newest(states: DataFrame, key: str, at: str) -> DataFrame:
    """The newest state per key of a table of states."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return states.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
