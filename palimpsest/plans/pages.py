"""Queries over page geometry and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import geometry as G
from palimpsest.operators.extraction import extract
from palimpsest.plans.store import B, S, body, current, segments
from palimpsest.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {S} SELECT version_id, page, min(bbox.y0) FILTER (WHERE role = 'body') AS top, max(bbox.y1) FILTER (WHERE role = 'body') AS bottom, min(bbox.x0) FILTER (WHERE role = 'body') AS "left", max(bbox.x1) FILTER (WHERE role = 'body') AS "right",
round(sum(greatest(0.0, bbox.x1 - bbox.x0) * greatest(0.0, bbox.y1 - bbox.y0)) FILTER (WHERE role = 'body'), 3) AS taken, count(*) FILTER (WHERE role <> 'body') AS n_outside FROM s GROUP BY version_id, page""")
def page_bands(spark: SparkSession, root: str) -> DataFrame:
    """The band of the body on each page."""
    return G.page_geometry(segments(spark, root, "version_id", "page", "role", "bbox"))


@query(f"""WITH {B} SELECT a.id, min(b.bbox.y0) AS next_y FROM s a LEFT JOIN s b ON a.version_id = b.version_id AND a.page = b.page AND b.bbox.y0 >= a.bbox.y1 AND b.bbox.x0 < a.bbox.x1 AND b.bbox.x1 > a.bbox.x0 GROUP BY a.id""")
def next_in_column(spark: SparkSession, root: str) -> DataFrame:
    """Where the next box below begins."""
    return G.next_below(body(spark, root, "version_id", "page", "bbox"))


@query(f"""WITH {S} SELECT DISTINCT a.id FROM s a JOIN s h ON a.version_id = h.version_id AND a.page = h.page AND a.id <> h.id
WHERE (h.bbox.x1 - h.bbox.x0) * (h.bbox.y1 - h.bbox.y0) > 4.0 * (a.bbox.x1 - a.bbox.x0) * (a.bbox.y1 - a.bbox.y0) AND (a.bbox.x1 - a.bbox.x0) * (a.bbox.y1 - a.bbox.y0) > 0
AND greatest(0.0, least(a.bbox.x1, h.bbox.x1) - greatest(a.bbox.x0, h.bbox.x0)) * greatest(0.0, least(a.bbox.y1, h.bbox.y1) - greatest(a.bbox.y0, h.bbox.y0)) / ((a.bbox.x1 - a.bbox.x0) * (a.bbox.y1 - a.bbox.y0)) >= 0.8""")
def fragments(spark: SparkSession, root: str) -> DataFrame:
    """Segments within much larger ones."""
    return G.fragments_in_hosts(segments(spark, root, "version_id", "page", "bbox"))


@query(f"""WITH {S}, l AS (SELECT id AS label_id, version_id, page, text, struct_pack(x0 := bbox.x0 + 1.0, y0 := bbox.y0, x1 := bbox.x1, y1 := bbox.y1) AS box FROM s WHERE kind IN ('table_cell', 'header')),
k AS (SELECT DISTINCT label_id FROM l JOIN s ON s.version_id = l.version_id AND s.page = l.page WHERE s.kind = 'paragraph' AND (regexp_replace(upper(l.text), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(s.text), '[^A-Z0-9]', '', 'g')
OR (length(regexp_replace(upper(l.text), '[^A-Z0-9]', '', 'g')) >= 4 AND contains(regexp_replace(upper(s.text), '[^A-Z0-9]', '', 'g'), regexp_replace(upper(l.text), '[^A-Z0-9]', '', 'g')))
OR (length(s.text) >= 25 AND (l.box.x1 - l.box.x0) * (l.box.y1 - l.box.y0) > 0 AND greatest(0.0, least(l.box.x1, s.bbox.x1) - greatest(l.box.x0, s.bbox.x0)) * greatest(0.0, least(l.box.y1, s.bbox.y1) - greatest(l.box.y0, s.bbox.y0)) / ((l.box.x1 - l.box.x0) * (l.box.y1 - l.box.y0)) > 0.75)))
SELECT label_id FROM l WHERE label_id NOT IN (SELECT label_id FROM k)""")
def unknown_labels(spark: SparkSession, root: str) -> DataFrame:
    """Short labels that no paragraph of their page says or covers."""
    s = segments(spark, root, "version_id", "page", "kind", "text", "bbox")
    b = F.col("bbox")
    box = F.struct((b["x0"] + 1.0).alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))
    labels = s.filter("kind IN ('table_cell', 'header')").select(F.col("id").alias("label_id"), "version_id", "page", "text", box.alias("box"))
    return G.without_known_labels(labels, s.filter("kind = 'paragraph'").select("version_id", "page", "text", "bbox")).select("label_id")


@query()
def translated_layout(spark: SparkSession, root: str) -> DataFrame:
    """Current translations set into their segments' boxes."""
    boxes = body(spark, root, "bbox", "style").select(
        F.col("id").alias("segment_id"), F.col("style.size").alias("size"), (F.col("bbox.x1") - F.col("bbox.x0")).alias("width"), (F.col("bbox.y1") - F.col("bbox.y0")).alias("height")
    )
    return G.layout(current(spark, root, "text").filter("text IS NOT NULL").select("segment_id", "text").join(boxes, "segment_id"))


def spans(spark: SparkSession, root: str) -> DataFrame:
    """The spans of every page, a line of a segment each, from the text lines and boxes of the segments table.

    Rows are brought together by page, and copies dropped there, before texts are divided: they are shuffled once.
    """
    font = F.try_element_at("fonts", F.lit(1))
    rows = table(spark, root, "segments").filter("version_id IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL").select(
        "id", "version_id", "doc_id", "page", F.coalesce("order_index", F.lit(0)).alias("block"), "text", "line_boxes", "bbox", F.coalesce(font["size"], F.col("style.size"), F.lit(10.0)).alias("size"),
        F.coalesce(font["font"], F.lit("")).alias("font"), F.coalesce(font["color"], F.lit(0)).alias("color"), F.coalesce(font["flags"], F.lit(0)).alias("flags"),
    )
    lines = rows.repartition("version_id", "page").dropDuplicates(["version_id", "page", "id"]).select("*", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    box = F.coalesce(F.try_element_at("line_boxes", F.col("line") + 1), F.col("bbox"))
    corner = lambda c: F.coalesce(box[c], F.lit(0.0)).alias(c)
    return lines.select(
        "version_id", "doc_id", "page", "block", "line", F.lit(0).alias("span"), F.col("t").alias("text"), *map(corner, ("x0", "y0", "x1", "y1")),
        F.coalesce(box["x0"], F.lit(0.0)).alias("origin_x"), F.coalesce(box["y1"], F.lit(0.0)).alias("origin_y"), "size", "font", "color", "flags", F.lit(PAGE_WIDTH).alias("width"),
    )


#: Points; pages of the table have no size of their own.
PAGE_WIDTH = 595.0


@query()
def extracted_segments(spark: SparkSession, root: str) -> DataFrame:
    """Segments made anew from the spans of every page: kinds, roles and order."""
    made = extract(spans(spark, root), by_page=True, columns=("kind", "role", "canonical_text", "fingerprint", "n_lines"))
    return made.select("version_id", "page", "order_index", "kind", "role", "canonical_text", "fingerprint", "n_lines")
