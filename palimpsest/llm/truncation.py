"""Which paragraphs and answers of the manuals were cut, and how often each source cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.cuts import analysed, continued, judged, value_cut, values_of
from palimpsest.sources.tables import once, stage, table

SEGMENTS, TRANSLATIONS = "segments", "translations"
#: Statuses of translation rows that hold no answer.
NO_ANSWER = ("missing", "failed")


def answer_texts(spark: SparkSession, root: str) -> DataFrame:
    """(column, row_id, source, text) of every answer, of whatever revision."""
    return table(spark, root, "translations").filter(~F.coalesce(F.col("status").isin(*NO_ANSWER), F.lit(False))).select(
        F.lit(TRANSLATIONS).alias("column"), F.col("id").alias("row_id"), F.col("provider").alias("source"), "text"
    )


def _texts(spark: SparkSession, root: str) -> DataFrame:
    """(column, row_id, source, text) of every paragraph of role body and every answer, rows maybe twice.

    The source of a paragraph is its manual; ``_sourced`` puts the manual's
    directory there once few rows are left.
    """
    paragraphs = table(spark, root, "segments").filter("role = 'body' AND kind = 'paragraph'").select(
        F.lit(SEGMENTS).alias("column"), F.col("id").alias("row_id"), F.col("doc_id").cast("string").alias("source"), "text"
    )
    return paragraphs.unionAll(answer_texts(spark, root))


def _directories(spark: SparkSession, root: str) -> DataFrame:
    return once(table(spark, root, "manuals"), "doc_id").select(F.col("doc_id").cast("string").alias("doc"), "source_dir")


def _sourced(df: DataFrame, directories: DataFrame) -> DataFrame:
    """The manual's directory in place of the manual; providers stay, null among them."""
    of_manual = F.col("column") == SEGMENTS
    joined = df.join(directories, of_manual & (F.col("source") == F.col("doc")), "left")
    return joined.withColumn("source", F.when(of_manual, F.col("source_dir")).otherwise(F.col("source"))).drop("doc", "source_dir")


def endings(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(staged analysis with sources, every text that ends without a stop with the judgement of its ending)."""
    staged = analysed(_texts(spark, root))
    directories = _directories(spark, root)
    open_ = _sourced(staged.filter("stat IS NULL"), directories)
    stats = staged.filter("stat IS NOT NULL")
    return staged, stage(judged(open_.select(*stats.columns).unionAll(stats)), "judged")


def answer_endings(spark: SparkSession, root: str) -> DataFrame:
    """Every answer that ends without a stop with the judgement of its ending, from the answers alone."""
    return stage(judged(analysed(answer_texts(spark, root))), "judged")


def _visible(text: str):
    return F.regexp_replace(text, "[\\s\\u00AD\\u200B-\\u200F\\u2060\\uFEFF\\u00A0\\u2000-\\u200A\\u202F\\u3000]+", " ")


def _letters(c):
    return F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "")


def open_answers(spark: SparkSession, root: str, ends: DataFrame) -> DataFrame:
    """(row_id, segment_id, source, at_spike, cut, source_stops) of every answer that ends without a stop.

    An answer at a spike was cut, unless it gives the whole source back or ends in the
    comma that its source ends in.  Any other leaves open what its source leaves open: one that ends in a comma
    as its source does, one that gives the source back, and one of a heading,
    cell or label, which has no sentence to cut.
    """
    answers = table(spark, root, "translations").select(F.col("id").alias("row_id"), "segment_id", F.col("text").alias("answer"))
    sources = table(spark, root, "segments").select(F.col("id").alias("segment_id"), "kind", F.col("text").alias("source_text"))
    bare = ends.filter(F.col("column") == TRANSLATIONS).join(answers, "row_id").dropDuplicates(["row_id"])
    held = bare.join(sources, "segment_id", "left").dropDuplicates(["row_id"])
    tail = F.rtrim(_visible("source_text"))
    stops = F.coalesce(tail.rlike("[.!?。！？…][\"'”’)\\]]*$"), F.lit(False))
    sentence = stops | (F.coalesce(F.col("kind"), F.lit("paragraph")) == "paragraph")
    also_open = F.col("comma") & F.coalesce(tail.rlike("[,;，；]$"), F.lit(False))
    given_back = F.coalesce(_letters(F.col("answer")) == _letters(F.regexp_replace("source_text", "-\\n", "")), F.lit(False))
    given = values_of(F.col("source_text"))
    cut = ~given_back & ((F.col("at_spike") & ~also_open) | (sentence & ((~F.col("complete") & ~also_open) | value_cut(F.col("tail_value"), given))))
    return held.select(F.col("column"), "row_id", "segment_id", "source", "at_spike", cut.alias("cut"), stops.alias("source_stops"))


def cut_rows(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """((table_name, row_id, source, at_spike) of cut rows, (table_name, source, n) of all rows that might be)."""
    staged, ends = endings(spark, root)
    # paragraphs: not continued by the next body segment
    body = table(spark, root, "segments").filter("role = 'body'")
    suspects = ends.filter((F.col("column") == SEGMENTS) & ~F.col("complete")).select(F.col("row_id").alias("suspect"), F.lit(True).alias("asks"))
    rows = body.select(
        F.coalesce("version_id", F.lit(-1)).alias("version_id"),
        F.col("id").alias("row_id"),
        F.coalesce("order_index", F.lit(-1)).alias("position"),
        (F.coalesce(F.col("kind") == "paragraph", F.lit(False)) & F.coalesce(F.ltrim(_visible("text")).rlike("^[\"'“(]?\\p{Ll}"), F.lit(False))).alias("continues"),
    )
    asked = rows.join(suspects, F.col("row_id") == F.col("suspect"), "left").select("version_id", "row_id", "position", F.coalesce("asks", F.lit(False)).alias("asks"), "continues")
    goes_on = continued(asked)
    paragraphs = ends.filter((F.col("column") == SEGMENTS) & ~F.col("complete")).join(goes_on, "row_id", "left").filter(~F.coalesce("continued", F.lit(False)))
    cut_answers = open_answers(spark, root, ends).filter("cut")
    out = (F.col("column").alias("table_name"), "row_id", "source", "at_spike")
    cut = paragraphs.select(*out).unionAll(cut_answers.select(*out))
    candidates = _sourced(_texts(spark, root).filter(F.length("text") > 0).select("column", "row_id", "source").dropDuplicates(["column", "row_id"]), _directories(spark, root))
    return cut, candidates.groupBy(F.col("column").alias("table_name"), "source").agg(F.count(F.lit(1)).alias("n_rows"))


def truncation_rates(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, source, n_rows, n_cut, n_at_limit, share) per directory and per provider; null is a source of its own.

    ``n_at_limit`` of the cut rows stand at a spike of their source's lengths; the others come from broken transfers.
    """
    cut, total = cut_rows(spark, root)
    n = cut.groupBy("table_name", "source").agg(F.count(F.lit(1)).alias("n_cut"), F.count_if("at_spike").alias("n_at_limit"))
    t, c = total.alias("t"), n.alias("c")
    return t.join(c, (F.col("t.table_name") == F.col("c.table_name")) & F.col("t.source").eqNullSafe(F.col("c.source")), "left").select(
        "t.table_name", "t.source", "n_rows", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.coalesce("n_at_limit", F.lit(0)).alias("n_at_limit"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_rows")).alias("share")
    )
