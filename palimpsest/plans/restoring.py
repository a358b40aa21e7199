"""Queries that find old rows' places again, sum changes up, and read text line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.textdiff import char_diffs_col, ratio_col, word_diff_col
from palimpsest.operators import relational as R
from palimpsest.operators import restore as O
from palimpsest.operators.alignment import change_counts
from palimpsest.operators.hyphens import decisions, vocabulary
from palimpsest.plans.changes import version_steps
from palimpsest.plans.memory import _aligned
from palimpsest.plans.store import S, body, current, segments
from palimpsest.sources.files import backup_rows
from palimpsest.sources.tables import table
from palimpsest.streaming.landing import job_states

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def hyphen_decisions(spark: SparkSession, root: str) -> DataFrame:
    """How lines that end in a hyphen go on, with the reason."""
    texts = body(spark, root, "text")
    return decisions(texts, vocabulary(texts, "text"))


@query()
def modified_texts(spark: SparkSession, root: str) -> DataFrame:
    """Similarity and differences of every modified segment."""
    texts = segments(spark, root, "canonical_text")
    m = _aligned(spark, root).filter("change_kind = 'modified'").select(F.col("old_ids")[0].alias("old_id"), F.col("new_ids")[0].alias("new_id"))
    both = m.join(texts.select(F.col("id").alias("old_id"), F.col("canonical_text").alias("a")), "old_id").join(texts.select(F.col("id").alias("new_id"), F.col("canonical_text").alias("b")), "new_id")
    return both.select("old_id", "new_id", F.round(ratio_col("a", "b"), 6).alias("ratio"), F.size(char_diffs_col("a", "b")).alias("n_char_runs"), F.size(word_diff_col("a", "b")).alias("n_word_runs"))


@query()
def restored_translations(spark: SparkSession, root: str) -> DataFrame:
    """A backup of each version's current answers put back onto its next version, all rows."""
    s = segments(spark, root, "version_id", "page", "order_index", "fingerprint", "canonical_text", "text", derive=True)
    steps = version_steps(spark, root).select(F.col("from_version").alias("version_id"), "to_version")
    before = s.join(steps, "version_id").withColumn("version_id", F.col("to_version")).drop("to_version")
    saved = backup_rows(before, current(spark, root, "text", "status", "provider", "model", "confidence", "reviewed_by"))
    return O.restore(saved, s).select("version_id", "segment_id", "tier", "status", "revision")


@query()
def change_report(spark: SparkSession, root: str) -> DataFrame:
    """A line of Markdown per kind of change and step, from the exact alignment."""
    counts = change_counts(_aligned(spark, root)).select("step", "change_kind", "n")
    kinds = ("unchanged", "modified", "added", "removed", "moved", "reordered", "split", "merged")
    return O.summary_text(R.zero_filled(counts, ["step"], "change_kind", kinds))


@query()
def change_markers(spark: SparkSession, root: str) -> DataFrame:
    """Segments of each newer version with their change kind."""
    done = _aligned(spark, root)
    marks = done.filter("change_kind <> 'unchanged'").select(F.explode("new_ids").alias("segment_id"), "change_kind")
    newer = version_steps(spark, root).select(F.col("to_version").alias("version_id"))
    return O.with_kind(body(spark, root, "version_id", "page").join(newer, "version_id", "left_semi"), marks)


@query("""SELECT date_trunc('hour', ts) AS hour, user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY ALL""")
def hourly_states(spark: SparkSession, root: str) -> DataFrame:
    """The latest log row of each job and hour: the stream's operator on a table (an extension)."""
    e = table(spark, root, "events").select("user_id", "ts", "event_id").withColumn("ts", F.col("ts").cast("timestamp"))
    return job_states(e, "user_id", "ts", "event_id").select(F.col("hour").cast("timestamp_ntz").alias("hour"), "user_id", "event_id", "n")


@query(f"""WITH {S}, p AS (SELECT id AS point_id, version_id, page, (bbox.y0 + bbox.y1) / 2 AS y FROM s WHERE kind = 'heading'), h AS (SELECT p.point_id, s.id, s.bbox.y0 AS a, s.bbox.y1 AS b, p.y FROM p JOIN s ON s.version_id = p.version_id AND s.page = p.page AND p.y BETWEEN s.bbox.y0 AND s.bbox.y1)
SELECT point_id, id, round((y - a) / greatest(1e-9, b - a), 6) AS fraction FROM h QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY a, id) = 1""")
def scroll_anchors(spark: SparkSession, root: str) -> DataFrame:
    """The box that a height on a page falls into, and how far down."""
    s = segments(spark, root, "version_id", "page", "kind", "bbox")
    points = s.filter("kind = 'heading'").select(F.col("id").alias("point_id"), "version_id", "page", ((F.col("bbox.y0") + F.col("bbox.y1")) / 2).alias("y"))
    return O.at_position(points, s)
