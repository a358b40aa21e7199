"""Queries over consecutive versions of the manuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import stored_or_fingerprint, stored_or_normalized
from palimpsest.operators.snapshots import changes, column_changes, consecutive
from palimpsest.plans.store import B, V, normal, word_runs
from palimpsest.sources.tables import table

MODIFIED_LIKENESS = 0.3


def version_steps(spark: SparkSession, root: str) -> DataFrame:
    segments = table(spark, root, "segments")
    return consecutive(table(spark, root, "document_versions"), "doc_id", "version_id", "version_no", segments)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """What was added, removed or modified in the body of each manual from one version to the next."""
    body = table(spark, root, "segments").filter("role = 'body'")
    rows = body.select("version_id", "id", stored_or_fingerprint().alias("key"), stored_or_normalized().alias("words"))
    found = changes(rows, version_steps(spark, root), MODIFIED_LIKENESS)
    return found.select(
        F.col("to_version").alias("to_version_id"), "change_kind", F.col("old_id").alias("old_segment_id"), F.col("new_id").alias("new_segment_id")
    )


COMPARED = ("page", "kind", "role", "text")


def p6_columns(spark: SparkSession, root: str) -> DataFrame:
    """Places of each manual's body that came, went or changed from one version to the next, with the columns that differ."""
    body = table(spark, root, "segments").filter("role = 'body'").select("version_id", "order_index", *COMPARED)
    found = column_changes(body, version_steps(spark, root), "order_index", list(COMPARED))
    return found.select(F.col("to_version").alias("to_version_id"), F.col("key").alias("place"), "change_kind", F.array_join("changed", ",").alias("changed"))


QUERIES = {"p6_found": p6_found, "p6_columns": p6_columns}
# a fingerprint names the case-folded normal form, which stands for it here
SQL = {
    "p6_found": f"""WITH {V}, s AS (SELECT *, lower(coalesce(normalized, {normal("coalesce(canonical_text, '')")})) AS t FROM (SELECT DISTINCT ON (id) * FROM segments WHERE role = 'body')),
p AS (SELECT version_id AS old_v, lead(version_id) OVER (PARTITION BY doc_id ORDER BY version_no, version_id) AS new_v FROM v WHERE version_id IN (SELECT version_id FROM segments)),
o AS (SELECT new_v, id, t, {word_runs("string_split(t, ' ')")} AS r FROM p JOIN s ON s.version_id = old_v WHERE new_v IS NOT NULL AND NOT EXISTS (FROM s AS z WHERE z.version_id = new_v AND z.t = s.t)),
n AS (SELECT new_v, id, t, {word_runs("string_split(t, ' ')")} AS r FROM p JOIN s ON s.version_id = new_v WHERE NOT EXISTS (FROM s AS z WHERE z.version_id = old_v AND z.t = s.t)),
m AS (SELECT new_v, o.id AS old_id, n.id AS new_id FROM o JOIN n USING (new_v) WHERE len(list_intersect(o.r, n.r)) >= {MODIFIED_LIKENESS} * (len(o.r) + len(n.r) - len(list_intersect(o.r, n.r))))
SELECT new_v AS to_version_id, 'modified' AS change_kind, old_id AS old_segment_id, new_id AS new_segment_id FROM m
UNION ALL SELECT new_v, 'removed', id, 0 FROM o WHERE id NOT IN (SELECT old_id FROM m WHERE m.new_v = o.new_v) UNION ALL SELECT new_v, 'added', 0, id FROM n WHERE id NOT IN (SELECT new_id FROM m WHERE m.new_v = n.new_v)""",
    "p6_columns": f"""WITH {B}, {V}, p AS (SELECT version_id AS old_v, lead(version_id) OVER (PARTITION BY doc_id ORDER BY version_no, version_id) AS new_v FROM v WHERE version_id IN (SELECT version_id FROM segments)),
o AS (SELECT new_v, order_index, page, kind, role, text FROM p JOIN s ON s.version_id = old_v WHERE new_v IS NOT NULL), n AS (SELECT new_v, order_index, page, kind, role, text FROM p JOIN s ON s.version_id = new_v)
SELECT coalesce(o.new_v, n.new_v) AS to_version_id, coalesce(o.order_index, n.order_index)::VARCHAR AS place, CASE WHEN o.new_v IS NULL THEN 'added' WHEN n.new_v IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
CASE WHEN o.new_v IS NULL OR n.new_v IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.page IS DISTINCT FROM n.page THEN 'page' END, CASE WHEN o.kind IS DISTINCT FROM n.kind THEN 'kind' END, CASE WHEN o.role IS DISTINCT FROM n.role THEN 'role' END, CASE WHEN o.text IS DISTINCT FROM n.text THEN 'text' END) END AS changed
FROM o FULL JOIN n ON o.new_v = n.new_v AND o.order_index IS NOT DISTINCT FROM n.order_index WHERE o.new_v IS NULL OR n.new_v IS NULL OR (o.page, o.kind, o.role, o.text) IS DISTINCT FROM (n.page, n.kind, n.role, n.text)""",
}
