"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.confusables import consistent_forms, look_alike_pairs, look_groups
from palimpsest.llm.leaks import leaks
from palimpsest.llm.near_duplicates import linked_pairs, membership, near_duplicates
from palimpsest.llm.packing import pack_sequences
from palimpsest.llm.pairs import LEAST_RECURRING_CHARS, answer_name, defects, main_defect, recurring_names, voted
from palimpsest.llm.passages import LEAST_WORDS, live_rows
from palimpsest.llm.residue import classed_messages, recurring, residue
from palimpsest.llm.tokens import encode_column
from palimpsest.llm.truncation import NO_ANSWER, answer_endings, cut_rows, open_answers, truncation_rates
from palimpsest.plans.store import normal, word_runs
from palimpsest.sources.tables import current_rows, once, table

P1_LIKENESS = 0.5
BATCH_CHARS = 1800
LEAK_WORDS = 10


def _live_duplicates(spark: SparkSession, root: str):
    return near_duplicates(live_rows(spark, root, "id", "normalized", "canonical_text"), P1_LIKENESS, k=3, least_words=LEAST_WORDS)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of different live passages of likeness 0.5 or more, equal texts included."""
    return linked_pairs(_live_duplicates(spark, root))


def p1_classes(spark: SparkSession, root: str) -> DataFrame:
    """One row per live passage: its class of equal texts and that class's number of links."""
    return membership(_live_duplicates(spark, root))


def p2_batches(spark: SparkSession, root: str) -> DataFrame:
    """Translation batches of at most 1,800 characters from each version's body."""
    body = table(spark, root, "segments").filter("role = 'body'").select("version_id", "id", "order_index", F.char_length("text").alias("n"))
    packed = pack_sequences(body, "version_id", "id", "order_index", "n", BATCH_CHARS)
    return packed.withColumnsRenamed({"seq": "version_id", "item_ids": "segment_ids", "n_items": "n_segments"})


def pair_rows(spark: SparkSession, root: str) -> DataFrame:
    """(pair_id, source_text, answer, cut, at_limit, recurs, source_stops): each body segment with its current translation.

    Texts are shuffled by segment once; what is known of answers comes to them in narrow rows.
    """
    answered = ~F.coalesce(F.col("status").isin(*NO_ANSWER), F.lit(False))

    def current(*columns) -> DataFrame:
        rows = table(spark, root, "translations").select("segment_id", F.col("id").alias("row_id"), "status", "revision", *columns)
        return current_rows(rows, "segment_id", "revision", "row_id").filter(answered).drop("status", "revision")

    segments = once(table(spark, root, "segments").filter("role = 'body'").select("id", "text"))
    sources = segments.select(F.col("id").alias("segment_id"), F.col("text").alias("source_text"))
    cuts = open_answers(spark, root, answer_endings(spark, root)).select(F.col("segment_id").alias("of"), F.col("row_id").alias("cut_id"), "cut", "at_spike")
    names = current(F.when(F.length("text") >= LEAST_RECURRING_CHARS, answer_name("text")).alias("answer_name")).filter("answer_name IS NOT NULL")
    given = segments.select(F.col("id").alias("segment_id"), F.xxhash64("text").alias("source_name"))
    recurs = names.join(recurring_names(names.join(given, "segment_id")), "answer_name").select("segment_id", "recurs")
    tail = F.rtrim(F.regexp_replace("source_text", "[\\u00AD\\u200B-\\u200F\\u2060\\uFEFF]+", ""))
    joined = current(F.col("text").alias("answer")).join(sources, "segment_id").join(recurs, "segment_id", "left")
    # rows are told apart beside the key of the join, which keeps the layout by segment
    joined = joined.join(cuts, (F.col("of") == F.col("segment_id")) & (F.col("cut_id") - F.col("row_id") == 0), "left")
    return joined.select(
        F.col("segment_id").alias("pair_id"),
        "source_text",
        "answer",
        F.coalesce("cut", F.lit(False)).alias("cut"),
        F.coalesce("at_spike", F.lit(False)).alias("at_limit"),
        F.coalesce("recurs", F.lit(1)).alias("recurs"),
        F.coalesce(tail.rlike("[.!?\u3002\uff01\uff1f][\"'\u201d\u2019)\\]]*\\s*$"), F.lit(False)).alias("source_stops"),
    )


def _votes(spark: SparkSession, root: str) -> DataFrame:
    return voted(pair_rows(spark, root))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Body segments whose current translation is defective, with the likeliest defect."""
    return main_defect(defects(_votes(spark, root))).withColumnRenamed("pair_id", "segment_id")


def p3_labels(spark: SparkSession, root: str) -> DataFrame:
    """Every defect of every body segment's current translation whose posterior reaches its cutoff."""
    return defects(_votes(spark, root)).withColumnRenamed("pair_id", "segment_id")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Paragraphs and answers whose text was cut inside a sentence or word."""
    return cut_rows(spark, root)[0].select("table_name", "row_id")


def p4_rates(spark: SparkSession, root: str) -> DataFrame:
    """The share of cut rows of each source directory and provider."""
    return truncation_rates(spark, root)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of live passages whose canonical texts differ in characters but look the same."""
    return look_alike_pairs(live_rows(spark, root, "id", "normalized", "canonical_text"), LEAST_WORDS)


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    """One row per live passage: its group of equal looks."""
    return look_groups(live_rows(spark, root, "id", "normalized", "canonical_text"), LEAST_WORDS)


def p5_forms(spark: SparkSession, root: str) -> DataFrame:
    """The consistent form of both text fields of every segment."""
    forms = consistent_forms(table(spark, root, "segments").select("id", "canonical_text", "text"), "canonical_text", "text")
    return once(forms.select("id", "canonical_text_form", "text_form"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    """The token ids of every document."""
    return encode_column(table(spark, root, "documents"), "doc_id", "text")


def p7_offsets(spark: SparkSession, root: str) -> DataFrame:
    """The token ids of every document with the byte of its text after each token."""
    return encode_column(table(spark, root, "documents"), "doc_id", "text", offsets=True)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold at least ten consecutive words of a benchmark item."""
    docs, items = table(spark, root, "documents"), table(spark, root, "benchmark")
    return leaks(docs, "doc_id", "text", items, "item_id", "text", LEAK_WORDS)


def p8_near(spark: SparkSession, root: str) -> DataFrame:
    """The same with one word added, left out or changed in the ten."""
    docs, items = table(spark, root, "documents"), table(spark, root, "benchmark")
    return leaks(docs, "doc_id", "text", items, "item_id", "text", LEAK_WORDS, max_edits=1)


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with residue where content should be."""
    return residue(table(spark, root, "documents"), "doc_id", "text", "source").select("doc_id").distinct()


def p9_messages(spark: SparkSession, root: str) -> DataFrame:
    """Every residual message by the hash of its normalised form, with its documents and sources."""
    found = classed_messages(table(spark, root, "documents"), "doc_id", "text", "source")
    return recurring(found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_batches": p2_batches,
    "p3_found": p3_found,
    "p3_labels": p3_labels,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p5_forms": p5_forms,
    "p7_ids": p7_ids,
    "p7_offsets": p7_offsets,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p9_found": p9_found,
    "p9_messages": p9_messages,
}
_CUT = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_TENS = f"array_to_string(a[i:i + {LEAK_WORDS - 1}], ' ') AS k"
_LIVE = f"""(SELECT DISTINCT ON (id) *, lower(coalesce(normalized, {normal("coalesce(canonical_text, '')")})) AS t FROM segments WHERE role = 'body' AND version_id IN (SELECT version_id FROM document_versions WHERE is_current))"""
SQL: dict[str, str] = {
    "p1_found": f"""WITH x AS (SELECT id, t, {word_runs("string_split(t, ' ')")} AS r FROM {_LIVE} WHERE length(t) - length(replace(t, ' ', '')) >= {LEAST_WORDS - 1}),
u AS (SELECT DISTINCT id, unnest(r) AS k FROM x), n AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM u a JOIN u b ON a.k = b.k AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM n JOIN x a ON a.id = id_a JOIN x b ON b.id = id_b WHERE n >= {P1_LIKENESS} * (len(a.r) + len(b.r) - n)""",
    "p8_found": f"""WITH d AS (SELECT doc_id, a, unnest(range(1, len(a) - {LEAK_WORDS - 2})) AS i FROM (SELECT doc_id, {_CUT} AS a FROM documents)),
b AS (SELECT item_id, a, unnest(range(1, len(a) - {LEAK_WORDS - 2})) AS i FROM (SELECT item_id, {_CUT} AS a FROM benchmark))
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, {_TENS} FROM d) JOIN (SELECT item_id, {_TENS} FROM b) USING (k)""",
}
