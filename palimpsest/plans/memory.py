"""Queries over the translation memory and the quality of translations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.glossary import enforce_col, pseudo_translate_col
from palimpsest.operators import memory as M
from palimpsest.operators import relational as R
from palimpsest.operators.alignment import align, align_stored, change_counts, links
from palimpsest.plans.changes import version_steps
from palimpsest.plans.store import B, C, S, SEEN, V, body, cache, current, segments, translations, versions
from palimpsest.plans.store import M as CACHE
from palimpsest.sources.tables import staging_root, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _links(spark: SparkSession, root: str) -> DataFrame:
    """Counterparts by reuse: each segment's translation that reuses an older one, with that one's text."""
    t = translations(spark, root).select("id", "segment_id", "text", "reuse_of", "confidence", "revision")
    latest = R.latest(t.filter("reuse_of IS NOT NULL"), ["segment_id"], "revision", "id")
    old = t.select(F.col("id").alias("reuse_of"), F.col("segment_id").alias("old_id"), F.col("text").alias("old_text"))
    return latest.select(F.col("segment_id").alias("id"), "reuse_of", F.coalesce("confidence", F.lit(0.0)).alias("ratio")).join(old, "reuse_of").drop("reuse_of")


_PLAN = f"""WITH {S}, {C}, {CACHE}, r AS (SELECT * FROM (SELECT DISTINCT ON (id) * FROM translations) WHERE reuse_of IS NOT NULL QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY revision DESC, id DESC) = 1),
l AS (SELECT r.segment_id AS id, o.segment_id AS old_id, coalesce(r.confidence, 0.0) AS ratio, o.text AS old_text FROM r JOIN (SELECT DISTINCT ON (id) * FROM translations) o ON o.id = r.reuse_of),
x AS (SELECT s.id, s.version_id, s.text, s.role, c.text IS NOT NULL AND {SEEN('c.text')} AND NOT regexp_matches(c.text, '[一-鿿]_[A-Za-z0-9]|[A-Za-z0-9]_[一-鿿]') AS own,
k.text IS NOT NULL AND {SEEN('k.text')} AND NOT regexp_matches(k.text, '[一-鿿]_[A-Za-z0-9]|[A-Za-z0-9]_[一-鿿]') AS held,
length(trim(coalesce(s.text, ''), ' ')) < 2 OR NOT regexp_matches(coalesce(s.text, ''), '[A-Za-z㐀-鿿]') AS trivial, l.ratio >= 0.72 AND {SEEN('l.old_text')} AS seed, l.old_id
FROM s LEFT JOIN c ON c.segment_id = s.id LEFT JOIN k ON k.fingerprint = s.fingerprint LEFT JOIN l ON l.id = s.id),
p AS (SELECT id, version_id, text, old_id, CASE WHEN coalesce(own, false) THEN 'cached' WHEN role <> 'body' OR trivial THEN 'carried_verbatim' WHEN coalesce(held, false) THEN 'carried' WHEN coalesce(seed, false) THEN 'seeded' ELSE 'machine' END AS action FROM x)"""


def _plan(spark: SparkSession, root: str, derive: bool = False) -> DataFrame:
    s = segments(spark, root, "version_id", "role", "text", "fingerprint", derive=derive)
    return M.plan(s, current(spark, root, "text").select(F.col("segment_id").alias("id"), "text"), cache(spark, root).select("fingerprint", "text"), _links(spark, root))


@query(f"{_PLAN} SELECT id, version_id, action, CASE WHEN action = 'seeded' THEN old_id END AS reuse_of FROM p")
def translation_plan(spark: SparkSession, root: str) -> DataFrame:
    """What to do with each segment."""
    return _plan(spark, root).select("id", "version_id", "action", "reuse_of")


@query(
    f"""{_PLAN}, e AS (SELECT version_id, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(4 + (floor(length(regexp_replace(coalesce(text, ''), '[^\\x{{3400}}-\\x{{9fff}}\\x{{3000}}-\\x{{30ff}}]', '', 'g'))
+ (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[^\\x{{3400}}-\\x{{9fff}}\\x{{3000}}-\\x{{30ff}}]', '', 'g'))) / 3.6 + 0.5))::BIGINT)::BIGINT AS prompt_tokens FROM p WHERE action IN ('seeded', 'machine') GROUP BY version_id)
SELECT version_id, n, chars, prompt_tokens, floor(chars * 0.6 + 0.5)::BIGINT AS completion_tokens, round((prompt_tokens * 0.66 + floor(chars * 0.6 + 0.5) * 1.98) / 1e6, 6)::DOUBLE AS cost FROM e"""
)
def translation_cost(spark: SparkSession, root: str) -> DataFrame:
    """Tokens and cost of what is left to translate."""
    return M.estimate(_plan(spark, root), 0.66, 1.98)


_FOLD = _PLAN.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"""{_FOLD}, q AS (SELECT version_id, id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY version_id ORDER BY id) AS k FROM p WHERE action IN ('seeded', 'machine')),
f AS (SELECT version_id, id, n, k, 0 AS batch_no, n AS size, 1 AS m FROM q WHERE k = 1 UNION ALL SELECT q.version_id, q.id, q.n, q.k, CASE WHEN f.m >= 12 OR f.size + q.n > 1800 THEN f.batch_no + 1 ELSE f.batch_no END,
CASE WHEN f.m >= 12 OR f.size + q.n > 1800 THEN q.n ELSE f.size + q.n END, CASE WHEN f.m >= 12 OR f.size + q.n > 1800 THEN 1 ELSE f.m + 1 END FROM f JOIN q ON q.version_id IS NOT DISTINCT FROM f.version_id AND q.k = f.k + 1)
SELECT version_id, batch_no, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, count(*) AS n, sum(n)::BIGINT AS chars FROM f GROUP BY version_id, batch_no""")
def translation_batches(spark: SparkSession, root: str) -> DataFrame:
    """Greedy batches of what is left to translate, at most 12 segments and 1,800 characters."""
    todo = _plan(spark, root).filter(F.col("action").isin("seeded", "machine"))
    return M.greedy_batches(todo, "version_id", "id", F.char_length("text")).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query()
def prompt_records(spark: SparkSession, root: str) -> DataFrame:
    """Prompt records of all segments left to translate, seeded ones with the old pair, whatever their texts hold."""
    return M.prompts(_plan(spark, root, derive=True))


@query()
def translation_plan_whole(spark: SparkSession, root: str) -> DataFrame:
    """The plan with derived fingerprints where none is stored."""
    return _plan(spark, root, derive=True).select("id", "version_id", "action", "reuse_of")


@query(f"""WITH {V}, o AS (SELECT segment_id, text, status, revision FROM translations QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY revision, id) = 1),
n AS (SELECT segment_id, text, status FROM translations QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY revision DESC, id DESC) = 1)
SELECT segment_id, coalesce(n.text, '') AS text, n.status, CASE WHEN coalesce(n.text, '') <> coalesce(o.text, '') THEN coalesce(o.revision, 1) + 1 ELSE o.revision END::INTEGER AS revision FROM o JOIN n USING (segment_id)""")
def upserted_translations(spark: SparkSession, root: str) -> DataFrame:
    """The first revisions with the last written over them."""
    t = table(spark, root, "translations").select("segment_id", "id", "text", "status", "provider", "model", "revision", "reuse_of")
    rest = F.struct("text", "status", "provider", "model", "revision", "reuse_of")
    ends = t.groupBy("segment_id").agg(F.min_by(rest, F.struct("revision", "id")).alias("a"), F.max_by(rest, F.struct("revision", "id")).alias("b"))
    done = M.upsert_translations(ends.select("segment_id", "a.*"), ends.select("segment_id", "b.*").drop("revision"))
    return done.select("segment_id", "text", "status", "revision")


@query(f"""WITH {CACHE}, n AS (SELECT s.fingerprint, c.text, c.provider, c.model, c.created_at FROM (SELECT * FROM translations QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY revision DESC, id DESC) = 1) c
JOIN (SELECT DISTINCT ON (id) * FROM segments) s ON s.id = c.segment_id WHERE c.status = 'reviewed' AND s.fingerprint IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s.fingerprint ORDER BY c.created_at DESC NULLS LAST, c.text DESC NULLS LAST) = 1)
SELECT coalesce(k.fingerprint, n.fingerprint) AS fingerprint, CASE WHEN n.fingerprint IS NOT NULL THEN n.text ELSE k.text END AS text, coalesce(k.hits, 0)::BIGINT AS hits FROM k FULL JOIN n ON k.fingerprint = n.fingerprint""")
def refreshed_cache(spark: SparkSession, root: str) -> DataFrame:
    """The memory with reviewed answers written over it."""
    c = current(spark, root, "text", "provider", "model", "created_at", "status").filter("status = 'reviewed'")
    s = segments(spark, root, "fingerprint").filter("fingerprint IS NOT NULL").withColumnRenamed("id", "segment_id")
    new = c.join(s, "segment_id").select("fingerprint", "text", "provider", "model", "created_at")
    return M.put_cache(cache(spark, root), new).select("fingerprint", "text", "hits")


@query(f"""WITH {V}, g AS (SELECT version_id FROM v WHERE NOT is_current), s AS (SELECT DISTINCT ON (id) * FROM segments WHERE version_id NOT IN (SELECT version_id FROM g))
SELECT 'segments' AS what, count(*) AS n FROM s UNION ALL SELECT 'translations', count(*) FROM (SELECT DISTINCT ON (id) * FROM translations) WHERE segment_id NOT IN (SELECT id FROM segments WHERE version_id IN (SELECT version_id FROM g))""")
def cascade_wipe(spark: SparkSession, root: str) -> DataFrame:
    """What is left after superseded versions are deleted with all that hangs on them."""
    gone = versions(spark, root).filter("NOT is_current").select("version_id")
    s = segments(spark, root, "version_id")
    lost = s.join(gone, "version_id", "left_semi")
    kept_s = R.cascade_delete(gone, "version_id", s, "version_id")
    kept_t = R.cascade_delete(lost, "id", translations(spark, root), "segment_id")
    n = F.count(F.lit(1)).alias("n")
    return kept_s.agg(n).select(F.lit("segments").alias("what"), "n").unionAll(kept_t.agg(n).select(F.lit("translations"), "n"))


@query("""SELECT doc_id, slug, coalesce(nullif(trim(n.title), ''), m.title) AS title, coalesce(n.source_dir, m.source_dir) AS source_dir FROM manuals m
LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE upper(title) END AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source_dir END AS source_dir FROM manuals) n USING (doc_id)""")
def upserted_documents(spark: SparkSession, root: str) -> DataFrame:
    """Manuals upserted by slug with rows whose blanks must not overwrite."""
    m = table(spark, root, "manuals").select("doc_id", "slug", "title", "source_dir")
    new = m.select("slug", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.upper("title")).alias("title"), F.when(F.col("doc_id") % 3 != 0, F.col("source_dir")).alias("source_dir"))
    return R.upsert(m, new.withColumn("doc_id", F.lit(None).cast("bigint")), ["slug"], blanks_keep=["title", "source_dir", "doc_id"]).withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query(f"""WITH {V} SELECT version_id, map_keys(m) AS k, m['segments'] AS n_segments, m['checked'] AS checked FROM (SELECT version_id, map_concat(stats, MAP {{'checked': 1::BIGINT}}) AS m FROM v)""".replace("map_keys(m) AS k, ", ""))
def merged_stats(spark: SparkSession, root: str) -> DataFrame:
    """Version statistics with a key merged in, the others kept."""
    m = F.map_concat(F.map_filter("stats", lambda k, _: k != "checked"), F.create_map(F.lit("checked"), F.lit(1).cast("bigint")))
    return versions(spark, root).withColumn("m", m).select("version_id", F.col("m")["segments"].alias("n_segments"), F.col("m")["checked"].alias("checked"))


@query(f"""WITH {B}, {C}, w AS (SELECT version_id, id, page, text AS en, lead(text) OVER o AS b, lead(page) OVER o AS p FROM s WINDOW o AS (PARTITION BY version_id ORDER BY order_index, id)),
j AS (SELECT w.*, regexp_replace(w.en, '\\s+$', '') AS e, regexp_replace(c.text, '^\\s+|\\s+$', '', 'g') AS z FROM w JOIN c ON c.segment_id = w.id WHERE c.status = 'machine'),
q AS (SELECT *, CASE WHEN regexp_matches(z, '^[\\s\\x{{3002}}\\x{{ff0c}}\\x{{3001}}\\x{{ff1b}}\\x{{ff1a}}\\x{{ff01}}\\x{{ff1f}},.!?;:\\x{{2026}}\\x{{2014}}\\x{{2013}}"''\\x{{201c}}\\x{{201d}}\\x{{2018}}\\x{{2019}}()\\x{{ff08}}\\x{{ff09}}\\x{{3010}}\\x{{3011}}\\[\\]\\x{{3000}}\\x{{00a0}}-]*$') THEN 0 ELSE length(z) END AS sub FROM j),
y AS (SELECT *, CASE WHEN e = '' OR z = '' OR regexp_matches(z, '^[\\x{{3000}}\\x{{00a0}}\\s]*$') THEN NULL WHEN length(e) >= 30 AND sub <= 2 THEN 'punctuation_only' WHEN length(e) >= 60 AND length(z) / length(e) < 0.06 THEN 'too_short' WHEN length(e) >= 50 AND regexp_matches(z, '[,;，、]$') THEN 'ends_with_comma' END AS why FROM q)
SELECT version_id, id, why FROM y WHERE why IS NOT NULL AND NOT (sub >= 3 AND b IS NOT NULL AND coalesce(p - page IN (0, 1), false) AND NOT regexp_matches(e, '[.!?。！？:;"''”’)]$') AND (coalesce(regexp_matches(ltrim(b), '^[\\p{{Ll}}0-9]'), false) OR regexp_matches(e, '[,;，、–—-]$')))""")
def audit_suspects(spark: SparkSession, root: str) -> DataFrame:
    """Machine translations that look wrong, legitimate continuations apart."""
    return M.audit(body(spark, root, "version_id", "page", "order_index", "text"), current(spark, root, "text", "status").select(F.col("segment_id").alias("id"), "text", "status"))


@query(f"WITH {B}, {C} SELECT count(*) FILTER (WHERE length(c.text) > 3 * length(s.text) + 40) AS n_over, count(*) AS n FROM s JOIN c ON c.segment_id = s.id WHERE s.kind = 'table_cell'")
def cell_red_line(spark: SparkSession, root: str) -> DataFrame:
    """Table cells whose translation exceeds the red line (Q03)."""
    c = current(spark, root, "text").select(F.col("segment_id").alias("id"), F.col("text").alias("zh"))
    j = body(spark, root, "kind", "text").filter("kind = 'table_cell'").join(c, "id")
    return j.agg(F.count_if(F.char_length("zh") > 3 * F.char_length("text") + 40).alias("n_over"), F.count(F.lit(1)).alias("n"))


@query()
def glossary_applied(spark: SparkSession, root: str) -> DataFrame:
    """Current translations with glossary terms enforced."""
    c = current(spark, root, "text").filter("text IS NOT NULL")
    return c.select("segment_id", enforce_col(table(spark, root, "glossary"), F.col("text")).alias("enforced"))


@query()
def pseudo_translations(spark: SparkSession, root: str) -> DataFrame:
    """The offline stand-in's translations, once per distinct body text."""
    texts = body(spark, root, "text").filter("text IS NOT NULL").groupBy("text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return texts.select("id", "n", pseudo_translate_col(table(spark, root, "glossary"), F.col("text")).alias("answer"))


def _body_texts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "segments").filter("role = 'body'").select("version_id", "id", "page", "order_index", F.coalesce(F.nullif("canonical_text", F.lit("")), "text").alias("text"))
    return rows


def _aligned(spark: SparkSession, root: str) -> DataFrame:
    return align(_body_texts(spark, root), version_steps(spark, root))


@query()
def diff_exact(spark: SparkSession, root: str) -> DataFrame:
    """Every change of every pair of consecutive versions."""
    return _aligned(spark, root)


@query()
def diff_counts(spark: SparkSession, root: str) -> DataFrame:
    """Changes by kind with the segments their groups hold."""
    return change_counts(_aligned(spark, root))


@query()
def diff_links(spark: SparkSession, root: str) -> DataFrame:
    """Edges from old to new segments."""
    return links(_aligned(spark, root))


@query()
def diff_reused(spark: SparkSession, root: str) -> DataFrame:
    """Changes by kind out of a store that is filled by a first call and only read by a second."""
    rows, steps = _body_texts(spark, root), version_steps(spark, root)
    path = f"{staging_root(spark)}/palimpsest/{uuid.uuid4().hex}/changes"
    align_stored(rows, steps, path)
    return change_counts(align_stored(rows, steps, path))


#: Former name.
QUERIES["prompt_records_whole"] = prompt_records
