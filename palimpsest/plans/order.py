"""Queries whose result depends on order: neighbours, ranks, islands, folds and limits."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as X
from palimpsest.operators import relational as R
from palimpsest.plans.changes import version_steps
from palimpsest.plans.store import B, S, V, body, current, segments, versions, keyed
from palimpsest.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def in_version():
    return Window.partitionBy("version_id").orderBy("order_index", "id")


TERMINATED = "[.!?:;\"')]$"
STEPS = "p AS (SELECT version_id AS old_v, lead(version_id) OVER (PARTITION BY doc_id ORDER BY version_no, version_id) AS new_v FROM v WHERE version_id IN (SELECT version_id FROM segments))"


@query(f"""WITH {B}, w AS (SELECT version_id, id, page, kind, rtrim(text) AS a, lead(id) OVER o AS next_id, lead(page) OVER o AS next_page, lead(kind) OVER o AS next_kind, ltrim(lead(text) OVER o) AS b
FROM s WINDOW o AS (PARTITION BY version_id ORDER BY order_index, id))
SELECT version_id, id, next_id, page = next_page AS same_page FROM w WHERE next_page - page IN (0, 1) AND next_kind = kind AND NOT regexp_matches(a, '[.!?:;"'')]$') AND regexp_matches(b, '^[a-z]')
AND NOT regexp_matches(a, '[.]{{4,}}')""")
def split_sentences(spark: SparkSession, root: str) -> DataFrame:
    """Neighbours of one kind that look like one sentence: no end in the first, a small letter first in the second."""
    rows = body(spark, root, "version_id", "order_index", "page", "kind", "text")
    after = {c: F.lead(c).over(in_version()).alias(f"next_{c}") for c in ("id", "page", "kind", "text")}
    w = rows.select("version_id", "id", "page", "kind", F.rtrim("text").alias("a"), *after.values())
    goes_on = (F.col("next_page") - F.col("page")).isin(0, 1) & (F.col("next_kind") == F.col("kind")) & ~F.col("a").rlike(TERMINATED) & F.ltrim("next_text").rlike("^[a-z]")
    return w.filter(goes_on & ~F.col("a").rlike("[.]{4,}")).select("version_id", "id", "next_id", (F.col("page") == F.col("next_page")).alias("same_page"))


@query(f"""WITH {B}, c AS (SELECT segment_id, text AS zh FROM translations QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY revision DESC, id DESC) = 1),
w AS (SELECT version_id, id, rtrim(text) AS a, lead(id) OVER o AS next_id, lead(text) OVER o AS b FROM s WINDOW o AS (PARTITION BY version_id ORDER BY order_index, id))
SELECT w.version_id, w.id, w.next_id, length(w.b) AS n_en, length(c.zh) AS n_zh FROM w JOIN c ON c.segment_id = w.next_id
WHERE length(w.b) >= 30 AND length(c.zh) < 20 AND NOT regexp_matches(w.a, '[.!?:;"'')]$') AND NOT regexp_matches(w.b, '^[0-9]')""")
def corruption_signature(spark: SparkSession, root: str) -> DataFrame:
    """A long segment after an open end whose translation is far too short."""
    rows = body(spark, root, "version_id", "order_index", "text")
    w = rows.select("version_id", "id", F.rtrim("text").alias("a"), F.lead("id").over(in_version()).alias("next_id"), F.lead("text").over(in_version()).alias("b"))
    zh = current(spark, root, "text").select(F.col("segment_id").alias("next_id"), F.col("text").alias("zh"))
    hit = (F.char_length("b") >= 30) & ~F.col("a").rlike(TERMINATED) & ~F.col("b").rlike("^[0-9]")
    found = w.filter(hit).join(zh.filter(F.char_length("zh") < 20), "next_id")
    return found.select("version_id", "id", "next_id", F.char_length("b").cast("bigint").alias("n_en"), F.char_length("zh").cast("bigint").alias("n_zh"))


@query(f"WITH {B} SELECT version_id, id, style.size AS size, dense_rank() OVER (PARTITION BY version_id ORDER BY style.size DESC)::INTEGER AS depth FROM s WHERE kind = 'heading' QUALIFY depth <= 3")
def outline(spark: SparkSession, root: str) -> DataFrame:
    """Headings with their depth, the rank of their font size."""
    rows = body(spark, root, "version_id", "kind", "style").filter("kind = 'heading'").select("version_id", "id", F.col("style.size").alias("size"))
    return rows.withColumn("depth", F.dense_rank().over(Window.partitionBy("version_id").orderBy(F.desc("size")))).filter("depth <= 3")


_ANCHORS = f"""WITH {B}, {V}, {STEPS},
o AS (SELECT new_v AS step, fingerprint, id, page, order_index, row_number() OVER (PARTITION BY new_v, fingerprint ORDER BY order_index, id) AS k FROM p JOIN s ON s.version_id = old_v WHERE new_v IS NOT NULL AND fingerprint IS NOT NULL),
n AS (SELECT new_v AS step, fingerprint, id, page, order_index, row_number() OVER (PARTITION BY new_v, fingerprint ORDER BY order_index, id) AS k FROM p JOIN s ON s.version_id = new_v WHERE fingerprint IS NOT NULL),
a AS (SELECT coalesce(o.step, n.step) AS step, o.id AS old_id, n.id AS new_id, o.page AS old_page, n.page AS new_page, o.order_index AS old_order, n.order_index AS new_order FROM o FULL JOIN n ON o.step = n.step AND o.fingerprint = n.fingerprint AND o.k = n.k)"""


def _anchored(spark: SparkSession, root: str, derive: bool = False) -> DataFrame:
    steps = version_steps(spark, root)
    rows = body(spark, root, "version_id", "fingerprint", "page", "order_index", derive=derive).filter("fingerprint IS NOT NULL")
    side = lambda c: steps.select(F.col(c).alias("version_id"), F.col("to_version").alias("step")).join(rows, "version_id").drop("version_id")
    return R.occurrence_anchors(side("from_version"), side("to_version"), "step", "fingerprint", ["order_index", "id"])


@query(f"""{_ANCHORS}, r AS (SELECT *, row_number() OVER (PARTITION BY step, old_page ORDER BY old_order, old_id) AS was, row_number() OVER (PARTITION BY step, old_page ORDER BY new_order, new_id) AS now FROM a WHERE old_page = new_page),
k AS (SELECT step, 'reordered' AS change_kind FROM r WHERE now < was UNION ALL SELECT step, 'unchanged' FROM r WHERE now >= was UNION ALL SELECT step, 'moved' FROM a WHERE old_page <> new_page
UNION ALL SELECT step, 'removed' FROM a WHERE new_id IS NULL UNION ALL SELECT step, 'added' FROM a WHERE old_id IS NULL) SELECT step AS to_version, change_kind, count(*) AS n FROM k GROUP BY ALL""")
def diff_counts_relational(spark: SparkSession, root: str, derive: bool = False) -> DataFrame:
    """Changes by equal text and occurrence alone: the relational tier of the alignment."""
    a = _anchored(spark, root, derive)
    paired = a.filter("old_page = new_page")
    rank = lambda *by: F.row_number().over(Window.partitionBy("step", "old_page").orderBy(*by))
    same_page = paired.withColumns({"was": rank("old_order_index", "old_id"), "now": rank("new_order_index", "new_id")}).select("step", F.when(F.col("now") < F.col("was"), "reordered").otherwise("unchanged").alias("change_kind"))
    other = a.filter("NOT coalesce(old_page = new_page, false)").select("step", F.when(F.col("new_id").isNull(), "removed").when(F.col("old_id").isNull(), "added").otherwise("moved").alias("change_kind"))
    return same_page.unionAll(other).groupBy(F.col("step").alias("to_version"), "change_kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_ANCHORS}, x AS (SELECT step, old_id, old_order, new_id, new_order FROM a WHERE old_id IS NOT NULL)
SELECT step AS to_version, old_id, coalesce(next_order - 0.5, 1000000000.0)::DOUBLE AS slot FROM (SELECT *, first_value(new_order IGNORE NULLS) OVER (PARTITION BY step ORDER BY old_order, old_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_order FROM x) WHERE new_id IS NULL""")
def removed_slots(spark: SparkSession, root: str, derive: bool = False) -> DataFrame:
    """Where a removed row would stand: just before the next surviving one."""
    a = _anchored(spark, root, derive).filter("old_id IS NOT NULL")
    after = Window.partitionBy("step").orderBy("old_order_index", "old_id").rowsBetween(1, Window.unboundedFollowing)
    w = a.withColumn("next_order", F.first("new_order_index", ignorenulls=True).over(after)).filter("new_id IS NULL")
    return w.select(F.col("step").alias("to_version"), "old_id", F.coalesce(F.col("next_order") - 0.5, F.lit(1000000000.0)).cast("double").alias("slot"))


@query(f"""WITH {S}, w AS (SELECT version_id, id, page, text, list(struct_pack(page := page, id := id, text := text)) OVER (PARTITION BY version_id ORDER BY order_index, id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS ahead FROM s WHERE role = 'body')
SELECT version_id, id, list_filter(ahead, lambda x: x.page = w.page AND regexp_matches(x.text, '^[A-Z][a-z]'))[1].id AS title_id FROM w WHERE regexp_matches(text, '^[0-9]+$') OR regexp_matches(text, '^[A-Z]+-[0-9]+$')""")
def section_titles(spark: SparkSession, root: str) -> DataFrame:
    """A bare number or code looks up to four rows ahead on its page for a title."""
    rows = body(spark, root, "version_id", "order_index", "page", "text")
    ahead = F.collect_list(F.struct("page", "id", "text")).over(in_version().rowsBetween(1, 4))
    w = rows.withColumn("ahead", ahead).filter("text rlike '^[0-9]+$' OR text rlike '^[A-Z]+-[0-9]+$'")
    title = F.filter("ahead", lambda x: (x["page"] == F.col("page")) & x["text"].rlike("^[A-Z][a-z]"))
    return w.select("version_id", "id", F.try_element_at(title, F.lit(1))["id"].alias("title_id"))


@query(f"""WITH {B}, w AS (SELECT version_id, page, bbox.y0 AS y0, bbox.y1 AS y1, id FROM s), f AS (SELECT *, max(y1) OVER (PARTITION BY version_id, page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR y0 > reach + 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY version_id, page ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS island FROM f),
g AS (SELECT version_id, page, island, min(y0) AS y0, max(y1) AS y1 FROM i GROUP BY ALL), b AS (SELECT *, lead(y0) OVER (PARTITION BY version_id, page ORDER BY y0) AS next_y0 FROM g)
SELECT version_id, page, round(y1, 3) AS y0, round(next_y0, 3) AS y1 FROM b WHERE next_y0 - y1 >= 12.0""")
def free_bands(spark: SparkSession, root: str) -> DataFrame:
    """Free bands of at least 12 points between merged boxes of a page."""
    boxes = body(spark, root, "version_id", "page", "bbox").select("version_id", "page", F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"))
    merged = R.islands(boxes, ["version_id", "page"], "y0", "y1", 1.0)
    after = F.lead("y0").over(Window.partitionBy("version_id", "page").orderBy("y0"))
    return merged.withColumn("next_y0", after).filter("next_y0 - y1 >= 12.0").select("version_id", "page", F.round("y1", 3).alias("y0"), F.round("next_y0", 3).alias("y1"))


@query(f"""WITH {B}, w AS (SELECT version_id, order_index - row_number() OVER (PARTITION BY version_id ORDER BY order_index) AS run, order_index FROM s WHERE kind = 'table_cell')
SELECT version_id, min(order_index) AS "first", max(order_index) AS "last", count(*) AS n FROM w GROUP BY version_id, run HAVING count(*) >= 2""")
def table_zones(spark: SparkSession, root: str) -> DataFrame:
    """Stretches of consecutive table cells."""
    cells = body(spark, root, "version_id", "order_index", "kind").filter("kind = 'table_cell'")
    return R.consecutive_runs(cells, ["version_id"], "order_index").filter("n >= 2")


@query(f"""WITH {B}, w AS (SELECT version_id, page, id, bbox.x0 AS x0, bbox.y0 AS y0, max(bbox.x1) OVER (PARTITION BY version_id, page, round(bbox.y0, 0) ORDER BY bbox.x0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE kind = 'table_cell')
SELECT version_id, page, round(y0, 0) AS line, sum(CASE WHEN reach IS NULL OR x0 - reach > 12.0 THEN 1 ELSE 0 END)::BIGINT AS n_runs, count(*) AS n_cells FROM w GROUP BY ALL""")
def cell_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs of cells on a line, split where a gap exceeds 12 points."""
    cells = body(spark, root, "version_id", "page", "kind", "bbox").filter("kind = 'table_cell'").select("version_id", "page", "id", F.col("bbox.x0").alias("x0"), F.col("bbox.x1").alias("x1"), F.round("bbox.y0", 0).alias("line"))
    reach = F.max("x1").over(Window.partitionBy("version_id", "page", "line").orderBy("x0", "id").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("x0") - reach > 12.0), 1).otherwise(0)
    return cells.withColumn("fresh", fresh).groupBy("version_id", "page", "line").agg(F.sum("fresh").alias("n_runs"), F.count(F.lit(1)).alias("n_cells"))


@query(f"""WITH {B}, h AS (SELECT version_id, list(least(9, 1 + length(text) - length(replace(text, '.', '')))::INTEGER ORDER BY order_index, id) AS raw FROM s WHERE kind = 'heading' GROUP BY version_id)
SELECT version_id, list_reduce(list_transform(raw, lambda x: x::VARCHAR), lambda acc, x: acc || ',' || CASE WHEN x::INTEGER > string_split(acc, ',')[-1]::INTEGER + 1 THEN (string_split(acc, ',')[-1]::INTEGER + 1)::VARCHAR ELSE x END, '0') AS levels FROM h""")
def toc_levels(spark: SparkSession, root: str) -> DataFrame:
    """Contents levels repaired by a fold: they begin at one and rise by at most one (W15).  The first entry, 0, is the root."""
    rows = body(spark, root, "version_id", "order_index", "kind", "text").filter("kind = 'heading'")
    level = F.least(F.lit(9), 1 + F.char_length("text") - F.char_length(F.replace("text", F.lit("."), F.lit("")))).cast("int")
    listed = rows.groupBy("version_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("order_index", "id", level.alias("level")))), lambda x: x["level"]).alias("raw"))
    fold = F.aggregate("raw", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.least(x, F.element_at(acc, F.lit(-1)) + 1))))
    return listed.select("version_id", F.array_join(fold, ",").alias("levels"))


@query("""SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_job_state(spark: SparkSession, root: str) -> DataFrame:
    """The latest row of each job and kind of an append-only log."""
    return R.latest(table(spark, root, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "ts", "value")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_jobs(spark: SparkSession, root: str) -> DataFrame:
    """The fifty newest log rows."""
    return table(spark, root, "events").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "user_id", "event_type").limit(50)


@query(f"WITH {S} SELECT id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END AS shown FROM s")
def capped_payload(spark: SparkSession, root: str) -> DataFrame:
    """Texts as the read interface shows them, at most 500 characters."""
    t = F.col("text")
    return segments(spark, root, "text").select("id", F.when(F.char_length(t) > 500, F.concat(F.substring(t, 1, 500), F.lit("…"))).otherwise(t).alias("shown"))


@query("SELECT en, zh, row_number() OVER (ORDER BY length(en) DESC, en)::INTEGER AS place FROM glossary WHERE trim(en) <> '' AND trim(zh) <> ''")
def glossary_longest_first(spark: SparkSession, root: str) -> DataFrame:
    """Glossary terms, longest first (O07, T27, X22); the glossary is a table of some dozen rows."""
    g = table(spark, root, "glossary").filter("trim(en) <> '' AND trim(zh) <> ''")
    return g.select("en", "zh", F.row_number().over(Window.orderBy(F.desc(F.char_length("en")), "en")).alias("place"))


@query(f"WITH {V} SELECT doc_id, version_id, version_id = first_value(version_id) OVER (PARTITION BY doc_id ORDER BY version_no DESC, version_id DESC) AS is_current FROM v")
def set_current_version(spark: SparkSession, root: str) -> DataFrame:
    """Exactly one current version per manual: its latest."""
    v = versions(spark, root).select("doc_id", "version_id", "version_no")
    last = v.groupBy("doc_id").agg(F.max_by("version_id", F.struct("version_no", "version_id")).alias("last"))
    return v.join(last, "doc_id").select("doc_id", "version_id", (F.col("version_id") == F.col("last")).alias("is_current"))


@query(f"""WITH {S} SELECT version_id, page, string_agg(id::VARCHAR, ',' ORDER BY order_index, id) AS ids, count(*) AS n FROM s GROUP BY version_id, page""")
def version_bundle(spark: SparkSession, root: str) -> DataFrame:
    """Segments of each page in order."""
    rows = segments(spark, root, "version_id", "page", "order_index")
    pages = rows.groupBy("version_id", "page").agg(F.sort_array(F.collect_list(F.struct("order_index", "id"))).alias("r"), F.count(F.lit(1)).alias("n"))
    return pages.select("version_id", "page", F.array_join(F.transform("r", lambda x: x["id"].cast("string")), ",").alias("ids"), "n")


# The same over all rows, without SQL: where the stored fingerprint is null the derived one stands for it.
for _f in (diff_counts_relational, removed_slots):
    QUERIES[f"{_f.__name__}_whole"] = partial(_f, derive=True)

# where no fingerprint comes out, the derived ones count under the plain name too; SQL names texts by their folded normal form
for _name in ("diff_counts_relational", "removed_slots"):
    QUERIES[_name] = QUERIES[f"{_name}_whole"]
    SQL[_name] = keyed(SQL[_name])
