"""Queries that answer requests: page ranges, names, views of changes, states, banners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scalars as X
from palimpsest.operators import relational as R
from palimpsest.operators import serving as O
from palimpsest.plans.memory import _aligned
from palimpsest.plans.order import in_version
from palimpsest.plans.store import S, T, V, body, current, segments, translations, versions
from palimpsest.sources.tables import once, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {S}, {V} SELECT s.id, s.version_id, s.page FROM s JOIN v USING (version_id) WHERE s.role = 'body' AND s.page >= 2 AND (coalesce(v.page_count, 0) // 2 = 0 OR s.page <= v.page_count // 2)""")
def segments_of_page_range(spark: SparkSession, root: str) -> DataFrame:
    """Body segments from page 2 to the middle of each version; where that page is 0 it is not given."""
    asked = versions(spark, root).select("version_id", F.lit(2).alias("page_from"), F.floor(F.col("page_count") / 2).cast("int").alias("page_to"), F.lit("body").alias("role"))
    return O.in_page_ranges(segments(spark, root, "version_id", "page", "role"), asked).select("id", "version_id", "page")


@query(f"""WITH {V}, m AS (SELECT DISTINCT ON (doc_id) * FROM manuals), q AS (SELECT 'i' || doc_id AS request_id, doc_id::VARCHAR AS wanted FROM m UNION ALL SELECT 's' || doc_id, slug FROM m UNION ALL SELECT 'n' || doc_id, slug || ' ' || doc_id FROM m)
SELECT request_id, (SELECT min(doc_id) FROM m WHERE doc_id::VARCHAR = trim(wanted, ' ') OR slug = trim(wanted, ' ')) AS doc_id FROM q""")
def resolved_manuals(spark: SparkSession, root: str) -> DataFrame:
    """Manuals named by id, by slug, and by something that is neither."""
    m = once(table(spark, root, "manuals"), "doc_id").select("doc_id", "slug")
    ask = lambda p, wanted: m.select(F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("request_id"), wanted.alias("wanted"))
    asked = ask("i", F.col("doc_id").cast("string")).unionAll(ask("s", F.col("slug"))).unionAll(ask("n", F.concat("slug", F.lit(" "), F.col("doc_id").cast("string"))))
    return O.resolved(asked, m, "doc_id", ["doc_id", "slug"], [])


@query(f"""WITH {V} SELECT q.version_id AS request_id, arg_min(v.version_id, (coalesce(v.version_no, -1), v.version_id)) AS version_id FROM v q LEFT JOIN v ON v.doc_id = q.doc_id
AND (v.version_id::VARCHAR = q.version_no::VARCHAR OR v.version_no = q.version_no OR v.label = q.version_no::VARCHAR) GROUP BY q.version_id""")
def resolved_versions(spark: SparkSession, root: str) -> DataFrame:
    """Versions named within their manual by a number, which may also be an id or a label."""
    v = versions(spark, root).select("doc_id", "version_id", "version_no", "label")
    asked = v.select(F.col("version_id").alias("request_id"), F.col("doc_id").alias("within"), F.col("version_no").cast("string").alias("wanted"))
    rows = v.withColumnRenamed("doc_id", "within").withColumn("version_no", F.coalesce("version_no", F.lit(-1)))
    return O.resolved(asked, rows, "version_id", ["version_id", "version_no", "label"], ["version_no"])


@query()
def change_view(spark: SparkSession, root: str) -> DataFrame:
    """Changes of every step as a reader sees them, unchanged ones left out."""
    return O.change_view(_aligned(spark, root), segments(spark, root, "text"))


@query(f"""WITH {S}, c AS (SELECT * FROM translations QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY revision DESC, id DESC) = 1), q AS (SELECT id AS segment_id FROM s WHERE kind = 'heading')
SELECT coalesce(c.segment_id, q.segment_id) AS segment_id, CASE WHEN c.revision IS NULL AND q.segment_id IS NOT NULL THEN '' ELSE c.text END AS text, CASE WHEN q.segment_id IS NOT NULL THEN 'reviewed' ELSE c.status END AS status,
CASE WHEN c.revision IS NULL AND q.segment_id IS NOT NULL THEN 1 ELSE c.revision END AS revision, CASE WHEN q.segment_id IS NOT NULL THEN 'desk' ELSE c.reviewed_by END AS reviewed_by FROM c FULL JOIN q ON c.segment_id = q.segment_id""")
def reviewed_headings(spark: SparkSession, root: str) -> DataFrame:
    """Current translations after all headings were reviewed."""
    s = segments(spark, root, "kind")
    asked = s.filter("kind = 'heading'").select(F.col("id").alias("segment_id"), F.lit("reviewed").alias("status"), F.lit("desk").alias("reviewed_by"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"))
    held = current(spark, root, "text", "status", "reviewed_by", "reviewed_at")
    return O.set_statuses(held, asked, s).select("segment_id", "text", "status", "revision", "reviewed_by")


@query(f"""WITH {V}, {S}, {T}, n AS (SELECT version_id, count(*) AS n FROM s GROUP BY ALL), told AS (SELECT DISTINCT s.version_id FROM s JOIN t ON t.segment_id = s.id WHERE t.text <> ''),
p AS (SELECT doc_id, sha256, min(version_id) AS version_id FROM v WHERE sha256 IS NOT NULL GROUP BY ALL), k AS (SELECT doc_id, count(DISTINCT version_id) AS n FROM v GROUP BY ALL),
a AS (SELECT 'same-' || version_id AS arrival_id, doc_id, sha256, false AS again FROM v UNION ALL SELECT 'again-' || version_id, doc_id, sha256, true FROM v UNION ALL SELECT 'new-' || version_id, doc_id, 'f' || sha256, false FROM v)
SELECT arrival_id, CASE WHEN p.version_id IS NULL THEN 'new' WHEN coalesce(n.n, 0) = 0 THEN 'extracted' WHEN NOT again THEN 'reused' WHEN told.version_id IS NOT NULL THEN 'refused' ELSE 'replaced' END AS decision, p.version_id,
CASE WHEN p.version_id IS NULL THEN 'v' || (coalesce(k.n, 0) + 1) END AS label FROM a LEFT JOIN p ON p.doc_id = a.doc_id AND p.sha256 = a.sha256 LEFT JOIN n ON n.version_id = p.version_id LEFT JOIN told ON told.version_id = p.version_id LEFT JOIN k ON k.doc_id = a.doc_id""")
def arrival_decisions(spark: SparkSession, root: str) -> DataFrame:
    """What an importer does with every version's file delivered once more, to be read again, and changed (X11)."""
    v = versions(spark, root).select("version_id", "doc_id", "sha256")
    ask = lambda p, sha, again: v.select(F.concat(F.lit(p), F.col("version_id").cast("string")).alias("arrival_id"), "doc_id", sha.alias("sha256"), F.lit(again).alias("reingest"), F.lit(False).alias("allow_loss"))
    asked = ask("same-", F.col("sha256"), False).unionAll(ask("again-", F.col("sha256"), True)).unionAll(ask("new-", F.concat(F.lit("f"), "sha256"), False))
    return O.arrival_decisions(asked, v, segments(spark, root, "version_id"), translations(spark, root).select("segment_id", "text"))


@query(f"""WITH {S} SELECT version_id, count(*) AS n, count(*) FILTER (WHERE bbox.x1 - bbox.x0 > 0 AND bbox.y1 - bbox.y0 >= 18 AND bbox.x1 - bbox.x0 >= 0.88 * 595.0 AND (bbox.y0 <= 6 OR bbox.y1 >= 836) AND (bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0) >= 0.02 * 595.0 * 842.0) AS n_banners FROM s GROUP BY version_id""")
def banner_boxes(spark: SparkSession, root: str) -> DataFrame:
    """Boxes shaped like a banner, by version."""
    hit = O.is_banner(F.col("bbox"), F.lit(595.0), F.lit(842.0))
    return segments(spark, root, "version_id", "bbox").groupBy("version_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_banners"))


@query()
def divided_translations(spark: SparkSession, root: str) -> DataFrame:
    """The translation of a sentence that goes on in the next segment, divided over both."""
    w = body(spark, root, "version_id", "order_index", "text").select("id", "text", F.lead("id").over(in_version()).alias("next_id"), F.lead("text").over(in_version()).alias("next_text"))
    open_ = w.filter(F.col("next_text").rlike("^\\p{Ll}") & ~F.coalesce(F.col("text").rlike("[.!?:;。！？：；][\"'”’)\\]]*\\s*$"), F.lit(True)))
    both = open_.join(current(spark, root, "text").select(F.col("segment_id").alias("id"), F.col("text").alias("zh")), "id")
    parts = both.withColumn("p", O.split_by_ratio_col("zh", "text", "next_text"))
    return parts.select("id", "next_id", F.col("p.first").alias("first"), F.col("p.second").alias("second"))


@query("""WITH d AS (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day, event_id, ts FROM events), x AS (SELECT user_id AS version_id, event_type AS kind, event_id, ts FROM d QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT version_id, kind, 'file-' || event_id AS path FROM x""")
def newest_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The newest file of each job and kind of event out of a register filled from the log."""
    e = table(spark, root, "events").select(F.col("user_id").alias("version_id"), F.col("event_type").alias("kind"), F.lit("").alias("params_hash"), F.concat(F.lit("file-"), F.col("event_id").cast("string")).alias("path"), F.lit(0).alias("stale"), F.lit(0).alias("bytes"), F.col("ts").alias("created_at"), "event_id").distinct()
    last = R.latest(e, ["version_id", "kind"], "created_at", "event_id").drop("event_id")
    none = last.limit(0).withColumn("snapshot_id", F.lit(0).cast("bigint"))
    return O.latest_snapshots(O.put_snapshots(none, last)).select("version_id", "kind", "path")


@query(f"""WITH {S}, a AS (SELECT DISTINCT segment_id FROM translations WHERE text <> ''), m AS (SELECT id, fingerprint, normalized FROM s WHERE role = 'body' AND id NOT IN (SELECT segment_id FROM a WHERE segment_id IS NOT NULL)),
b AS (SELECT id, fingerprint, normalized FROM s WHERE id IN (SELECT segment_id FROM a)), f AS (SELECT fingerprint, min(id) AS by_print FROM b WHERE fingerprint IS NOT NULL GROUP BY ALL), n AS (SELECT lower(normalized) AS form, min(id) AS by_form FROM b WHERE normalized IS NOT NULL GROUP BY ALL)
SELECT m.id, coalesce(by_print, by_form) AS backup_id, CASE WHEN by_print IS NOT NULL THEN 'fingerprint' ELSE 'normal form' END AS how FROM m LEFT JOIN f USING (fingerprint) LEFT JOIN n ON n.form = lower(m.normalized) WHERE coalesce(by_print, by_form) IS NOT NULL""")
def filled_gaps(spark: SparkSession, root: str) -> DataFrame:
    """Body segments never answered, with a segment whose answer fits."""
    told = table(spark, root, "translations").filter("text <> ''").select(F.col("segment_id").alias("id")).distinct()
    s = segments(spark, root, "role", "fingerprint", "normalized")
    return O.filled(s.filter("role = 'body'").join(told, "id", "left_anti"), s.join(told, "id", "left_semi"))


@query()
def synthetic_edits(spark: SparkSession, root: str) -> DataFrame:
    """What body segments become by the edits that make a test version, where one applies."""
    t = F.col("text")
    sentence = F.lit("In this revision the step is new: set the switch as the placard says and wait.")
    made = body(spark, root, "text").select("id", X.rewrite_quantity(t).alias("quantity"), X.rewrite_words(t).alias("words"), X.rewrite_sentence(t, sentence).alias("sentence"), F.array_join(X.contents_entries(t), "|").alias("entries"))
    return made.filter("quantity IS NOT NULL OR words IS NOT NULL OR sentence IS NOT NULL OR entries <> ''")
