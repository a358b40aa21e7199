"""Queries over the manuals' store: scans, joins and roll-ups, each with the SQL that says the same."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as X
from palimpsest.functions.glossary import presence
from palimpsest.functions.text import stored_or_fingerprint
from palimpsest.operators import relational as R
from palimpsest.sources.tables import current_rows, once, table

STATUSES = ("machine", "carried", "seeded", "reviewed", "missing", "failed")


def _derived(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", stored_or_fingerprint())


def segments(spark: SparkSession, root: str, *columns: str, derive: bool = False) -> DataFrame:
    """Segments, each once; with ``derive`` a null fingerprint is derived from the text."""
    df = table(spark, root, "segments")
    return once((_derived(df) if derive else df).select("id", *(c for c in columns if c != "id")))


def body(spark: SparkSession, root: str, *columns: str, derive: bool = False) -> DataFrame:
    df = table(spark, root, "segments").filter("role = 'body'")
    return once((_derived(df) if derive else df).select("id", *(c for c in columns if c != "id")))


def versions(spark: SparkSession, root: str) -> DataFrame:
    return once(table(spark, root, "document_versions"), "version_id")


def translations(spark: SparkSession, root: str) -> DataFrame:
    return once(table(spark, root, "translations"))


def current(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The current translation of each segment."""
    keep = {"segment_id", "id", "revision", *columns}
    return current_rows(table(spark, root, "translations").select(*sorted(keep)), "segment_id", "revision", "id")


def cache(spark: SparkSession, root: str) -> DataFrame:
    """The latest entry of each fingerprint."""
    return R.latest(table(spark, root, "translation_cache"), ["fingerprint"], "created_at", "text")


S = "s AS (SELECT DISTINCT ON (id) * FROM segments)"
B = "s AS (SELECT DISTINCT ON (id) * FROM segments WHERE role = 'body')"
V = "v AS (SELECT DISTINCT ON (version_id) * FROM document_versions)"
T = "t AS (SELECT DISTINCT ON (id) * FROM translations)"
C = "c AS (SELECT * FROM translations QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY revision DESC, id DESC) = 1)"
M = "k AS (SELECT * FROM translation_cache QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY created_at DESC NULLS LAST, text DESC NULLS LAST) = 1)"

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def normal(c: str) -> str:
    """The normal form of a text in SQL: widths, ligatures, composition, quotes, dashes, blanks; NFKC's other forms are not there."""
    wide = f"translate({c}, '{_WIDE}', '{_NARROW}')"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "..."), ("²", "2"), ("³", "3")):
        wide = f"replace({wide}, '{a}', '{b}')"
    marks = f"translate({wide}, '‘’‚‛`′“”„‟″‐‑‒–—―−', '\"\"\"\"\"-------')"
    shown = rf"regexp_replace(nfc_normalize({marks}), '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g')"
    return rf"trim(regexp_replace({shown}, '[\s\x{{000b}}\x{{001c}}-\x{{001f}}\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


def keyed(sql: str) -> str:
    """A query's SQL with the case-folded normal form, derived where none is stored, in place of every fingerprint."""
    key = f"""* REPLACE (lower(coalesce(normalized, {normal("coalesce(canonical_text, '')")})) AS fingerprint)"""
    for rows in (B, S):
        sql = sql.replace(rows, rows.replace("*", key, 1))
    return sql


def word_runs(words: str, k: int = 3) -> str:
    """The different runs of ``k`` words of a list in SQL; a shorter list is its only run."""
    return f"CASE WHEN len({words}) < {k} THEN [array_to_string({words}, ' ')] ELSE list_distinct(list_transform(range(1, len({words}) - {k - 2}), lambda i: array_to_string({words}[i:i + {k - 1}], ' '))) END"


#: Text with something besides Unicode white space, in SQL.
SEEN = r"regexp_matches({}, '[^\s\x{{000b}}\x{{001c}}-\x{{001f}}\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]')".format

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- scans, filters, lookups ---------------------------------------------------------------------------------


@query(f"""WITH {B} SELECT fingerprint, count(*) AS n, min(id) AS first_id, count(DISTINCT version_id) AS n_versions
FROM s WHERE fingerprint IS NOT NULL GROUP BY fingerprint HAVING count(*) > 1""")
def fingerprint_dups(spark: SparkSession, root: str, derive: bool = False) -> DataFrame:
    """Body fingerprints that recur."""
    rows = body(spark, root, "fingerprint", "version_id", derive=derive).filter("fingerprint IS NOT NULL")
    per_version = rows.groupBy("fingerprint", "version_id").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("lo"))
    return per_version.groupBy("fingerprint").agg(F.sum("m").alias("n"), F.min("lo").alias("first_id"), F.count(F.lit(1)).alias("n_versions")).filter("n > 1")


@query(f"""WITH {S} SELECT version_id, id, page, kind, CAST(row_number() OVER (PARTITION BY version_id ORDER BY order_index, id) AS INTEGER) AS place
FROM s WHERE role = 'body' AND kind IN ('paragraph', 'heading')""")
def segments_of_version(spark: SparkSession, root: str) -> DataFrame:
    """Body paragraphs and headings in stable order per version."""
    rows = segments(spark, root, "version_id", "page", "kind", "role", "order_index").filter("role = 'body' AND kind IN ('paragraph', 'heading')")
    place = F.row_number().over(Window.partitionBy("version_id").orderBy("order_index", "id"))
    return rows.select("version_id", "id", "page", "kind", place.alias("place"))


@query(f"WITH {S}, w AS (SELECT DISTINCT segment_id FROM translations WHERE provider = 'desk') SELECT s.id, s.version_id, s.kind FROM s WHERE id IN (SELECT segment_id FROM w)")
def segments_by_ids(spark: SparkSession, root: str) -> DataFrame:
    """Segments named by an id list, here those one provider worked on."""
    wanted = table(spark, root, "translations").filter("provider = 'desk'").select(F.col("segment_id").alias("id"))
    return segments(spark, root, "version_id", "kind").join(wanted, "id", "left_semi")


@query(f"WITH {S} SELECT version_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id, sum(CASE WHEN role = 'body' THEN 1 ELSE 0 END)::BIGINT AS n_body FROM s GROUP BY version_id")
def segment_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows and id range per version."""
    return segments(spark, root, "version_id", "role").groupBy("version_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_if(F.col("role") == "body").alias("n_body")
    )


@query(f"WITH {V} SELECT doc_id, version_id, version_no, row_number() OVER (PARTITION BY doc_id ORDER BY version_no, version_id)::INTEGER AS place FROM v")
def list_versions(spark: SparkSession, root: str) -> DataFrame:
    """Versions of each manual in order."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("version_no", "version_id"))
    return versions(spark, root).select("doc_id", "version_id", "version_no", place.alias("place"))


@query(f"""WITH {V} SELECT doc_id, version_id, version_no, is_current FROM v
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY is_current DESC, version_no DESC, version_id DESC) = 1""")
def current_version(spark: SparkSession, root: str) -> DataFrame:
    """The current version of each manual, else its latest."""
    rows = versions(spark, root).select("doc_id", "version_id", "version_no", "is_current")
    return R.latest(rows, ["doc_id"], "is_current", "version_no", "version_id").select("doc_id", "version_id", "version_no", "is_current")


@query(f"""WITH {B} SELECT kind, count(*) AS n, count(*) FILTER (WHERE length(trim(text)) < 2 OR NOT regexp_matches(text, '[A-Za-z㐀-鿿]')) AS n_trivial,
count(*) FILTER (WHERE regexp_matches(text, '[一-龥]')) AS n_han, count(*) FILTER (WHERE lower(trim(text)) IN ('th', 'st', 'nd', 'rd')) AS n_ordinal FROM s GROUP BY kind""")
def text_predicates(spark: SparkSession, root: str) -> DataFrame:
    """How many body texts are trivial, hold Han or are ordinal fragments."""
    t = F.col("text")
    return body(spark, root, "kind", "text").groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(X.is_trivial(t)).alias("n_trivial"), F.count_if(X.has_han(t)).alias("n_han"), F.count_if(X.is_ordinal_fragment(t)).alias("n_ordinal")
    )


# --- joins ----------------------------------------------------------------------------------------------------


@query(f"WITH {B}, {C} SELECT s.version_id, c.segment_id, c.id AS translation_id, c.status, length(c.text) AS n_chars FROM c JOIN s ON s.id = c.segment_id")
def translations_of_version(spark: SparkSession, root: str) -> DataFrame:
    """Current translations of body segments."""
    t = current(spark, root, "status", "text").select("segment_id", F.col("id").alias("translation_id"), "status", F.char_length("text").cast("bigint").alias("n_chars"))
    return t.join(body(spark, root, "version_id").withColumnRenamed("id", "segment_id"), "segment_id").select("version_id", "segment_id", "translation_id", "status", "n_chars")


@query(f"WITH {B}, {C} SELECT s.version_id, s.id, s.kind FROM s LEFT JOIN c ON c.segment_id = s.id WHERE c.id IS NULL OR c.text IS NULL OR NOT {SEEN('c.text')}")
def missing_work(spark: SparkSession, root: str) -> DataFrame:
    """Body segments without a translated text."""
    t = current(spark, root, "text").select(F.col("segment_id").alias("id"), F.col("text").alias("answer"))
    done = t.filter(~X.is_blank(F.col("answer")))
    return body(spark, root, "version_id", "kind").join(done, "id", "left_anti").select("version_id", "id", "kind")


@query(f"WITH {B} SELECT s.version_id, s.id FROM s WHERE NOT EXISTS (SELECT 1 FROM translations x WHERE x.segment_id = s.id)")
def never_translated(spark: SparkSession, root: str) -> DataFrame:
    """Body segments without any translation row (J02, anti)."""
    return body(spark, root, "version_id").join(table(spark, root, "translations").select(F.col("segment_id").alias("id")), "id", "left_anti").select("version_id", "id")


@query(f"""WITH {S}, {T}, r AS (SELECT t.id AS link_id, t.segment_id AS new_id, o.segment_id AS old_id FROM t LEFT JOIN t o ON o.id = t.reuse_of WHERE t.reuse_of IS NOT NULL)
SELECT link_id, n.version_id AS to_version, p.version_id AS from_version, coalesce(n.order_index, 1000000000) AS place FROM r LEFT JOIN s n ON n.id = r.new_id LEFT JOIN s p ON p.id = r.old_id
WHERE n.role = 'body' OR (n.id IS NULL AND p.role = 'body')""")
def links_disjunctive(spark: SparkSession, root: str) -> DataFrame:
    """Reuse links with their new and old segments, either side missing."""
    t = translations(spark, root).select("id", "segment_id", "reuse_of")
    links = t.filter("reuse_of IS NOT NULL").select(F.col("id").alias("link_id"), F.col("segment_id").alias("new_id"), "reuse_of")
    links = links.join(t.select(F.col("id").alias("reuse_of"), F.col("segment_id").alias("old_id")), "reuse_of", "left")
    s = segments(spark, root, "version_id", "order_index", "role")
    side = lambda p: s.select(F.col("id").alias(f"{p}_id"), F.col("version_id").alias(f"{p}_version"), F.col("role").alias(f"{p}_role"), F.col("order_index").alias(f"{p}_place"))
    both = links.join(side("new"), "new_id", "left").join(side("old"), "old_id", "left")
    kept = both.filter((F.col("new_role") == "body") | (F.col("new_version").isNull() & (F.col("old_role") == "body")))
    return kept.select("link_id", F.col("new_version").alias("to_version"), F.col("old_version").alias("from_version"), F.coalesce("new_place", F.lit(1000000000)).alias("place"))


@query(f"WITH {B}, {M} SELECT s.id, k.provider, k.created_at FROM s JOIN k USING (fingerprint) WHERE {SEEN('k.text')}")
def cache_lookup(spark: SparkSession, root: str, derive: bool = False) -> DataFrame:
    """Body segments whose fingerprint the translation memory holds."""
    hit = cache(spark, root).filter(~X.is_blank(F.col("text"))).select("fingerprint", "provider", "created_at")
    return body(spark, root, "fingerprint", derive=derive).join(hit, "fingerprint").select("id", "provider", "created_at")


@query(f"""WITH {B}, {V}, p AS (SELECT version_id AS old_v, lead(version_id) OVER (PARTITION BY doc_id ORDER BY version_no, version_id) AS new_v FROM v WHERE version_id IN (SELECT version_id FROM segments)),
x AS (SELECT DISTINCT new_v, fingerprint, 1 AS side FROM p JOIN s ON s.version_id = old_v WHERE new_v IS NOT NULL UNION ALL SELECT DISTINCT new_v, fingerprint, 2 FROM p JOIN s ON s.version_id = new_v)
SELECT new_v AS to_version, count(*) FILTER (WHERE m = 1) AS n_gone, count(*) FILTER (WHERE m = 2) AS n_fresh, count(*) FILTER (WHERE m = 3) AS n_kept
FROM (SELECT new_v, fingerprint, sum(side) AS m FROM x WHERE fingerprint IS NOT NULL GROUP BY ALL) GROUP BY new_v""")
def fp_set_difference(spark: SparkSession, root: str, derive: bool = False) -> DataFrame:
    """Fingerprints gone, fresh and kept from version to version (J18, set operations)."""
    from palimpsest.plans.changes import version_steps

    steps = version_steps(spark, root)
    rows = table(spark, root, "segments").filter("role = 'body'")
    prints = (_derived(rows) if derive else rows).filter("fingerprint IS NOT NULL").select("version_id", "fingerprint").distinct()
    old = steps.join(prints.withColumnRenamed("version_id", "from_version"), "from_version").select("to_version", "fingerprint", F.lit(1).alias("side"))
    new = steps.join(prints.withColumnRenamed("version_id", "to_version"), "to_version").select("to_version", "fingerprint", F.lit(2).alias("side"))
    mask = old.unionAll(new).groupBy("to_version", "fingerprint").agg(F.sum("side").alias("m"))
    return mask.groupBy("to_version").agg(F.count_if(F.col("m") == 1).alias("n_gone"), F.count_if(F.col("m") == 2).alias("n_fresh"), F.count_if(F.col("m") == 3).alias("n_kept"))


@query(f"""WITH {B}, {V}, p AS (SELECT version_id AS old_v, lead(version_id) OVER (PARTITION BY doc_id ORDER BY version_no, version_id) AS new_v FROM v WHERE version_id IN (SELECT version_id FROM segments)),
o AS (SELECT new_v, page, order_index, fingerprint, id FROM p JOIN s ON s.version_id = old_v WHERE new_v IS NOT NULL),
place AS (SELECT new_v, page, order_index, min(id) AS old_id FROM o GROUP BY ALL), print AS (SELECT new_v, fingerprint, min(id) AS old_id FROM o WHERE fingerprint IS NOT NULL GROUP BY ALL)
SELECT s.id AS new_id, coalesce(place.old_id, print.old_id) AS old_id, CASE WHEN place.old_id IS NOT NULL THEN 'place' ELSE 'fingerprint' END AS tier
FROM p JOIN s ON s.version_id = p.new_v LEFT JOIN place ON place.new_v = p.new_v AND place.page = s.page AND place.order_index = s.order_index
LEFT JOIN print ON print.new_v = p.new_v AND print.fingerprint = s.fingerprint WHERE coalesce(place.old_id, print.old_id) IS NOT NULL""")
def migrate_coalesce(spark: SparkSession, root: str, derive: bool = False) -> DataFrame:
    """Old counterparts of new segments: those at the same page and position first, those of equal fingerprint else."""
    from palimpsest.plans.changes import version_steps

    steps = version_steps(spark, root)
    s = body(spark, root, "version_id", "page", "order_index", "fingerprint", derive=derive)
    old = steps.join(s.withColumnRenamed("version_id", "from_version"), "from_version")
    by_place = old.groupBy("to_version", "page", "order_index").agg(F.min("id").alias("at_place"))
    by_text = old.filter("fingerprint IS NOT NULL").groupBy("to_version", "fingerprint").agg(F.min("id").alias("by_text"))
    new = steps.select("to_version").join(s.withColumnRenamed("version_id", "to_version"), "to_version")
    found = new.join(by_place, ["to_version", "page", "order_index"], "left").join(by_text, ["to_version", "fingerprint"], "left")
    tier = F.when(F.col("at_place").isNotNull(), "place").otherwise("fingerprint")
    return found.select(F.col("id").alias("new_id"), F.coalesce("at_place", "by_text").alias("old_id"), tier.alias("tier")).filter("old_id IS NOT NULL")


@query(f"""WITH {B} SELECT g.en, count(*) AS n FROM glossary g JOIN s ON CASE WHEN g.case_sensitive THEN contains(s.text, g.en) ELSE contains(lower(s.text), lower(g.en)) END GROUP BY g.en""")
def glossary_presence(spark: SparkSession, root: str) -> DataFrame:
    """How many body segments hold each glossary term.

    Equal texts count once before the terms are looked up, all in one pass of an automaton.
    """
    texts = body(spark, root, "text").filter("text IS NOT NULL").groupBy("text").agg(F.count(F.lit(1)).alias("m"))
    return presence(texts, table(spark, root, "glossary"))


@query(f"""WITH {V}, a AS (SELECT doc_id, count(*) AS version_count, max(version_no) AS last_no, sum(page_count)::BIGINT AS pages FROM v GROUP BY doc_id),
c AS (SELECT doc_id, version_id AS current_id, page_count FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY is_current DESC, version_no DESC, version_id DESC) = 1)
SELECT m.doc_id, m.slug, coalesce(m.title, '') AS title, coalesce(a.version_count, 0) AS version_count, a.last_no, a.pages, c.current_id, c.page_count FROM manuals m LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)""")
def list_documents(spark: SparkSession, root: str) -> DataFrame:
    """Manuals with their versions rolled up in one aggregate."""
    v = versions(spark, root).select("doc_id", "version_id", "version_no", "is_current", "page_count")
    rolled = v.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("version_count"),
        F.max("version_no").alias("last_no"),
        F.sum("page_count").alias("pages"),
        F.max_by(F.struct("version_id", "page_count"), F.struct("is_current", "version_no", "version_id")).alias("c"),
    )
    m = table(spark, root, "manuals").select("doc_id", "slug", F.coalesce("title", F.lit("")).alias("title"))
    return m.join(rolled, "doc_id", "left").select("doc_id", "slug", "title", F.coalesce("version_count", F.lit(0)).cast("bigint").alias("version_count"), "last_no", "pages", F.col("c.version_id").alias("current_id"), F.col("c.page_count").alias("page_count"))


# --- aggregates -----------------------------------------------------------------------------------------------

_STATUS_ROWS = " UNION ALL ".join(f"SELECT '{s}' AS status" for s in STATUSES)


@query(f"""WITH {B}, {C}, d AS ({_STATUS_ROWS}), j AS (SELECT s.version_id, coalesce(c.status, 'missing') AS status, c.text FROM s LEFT JOIN c ON c.segment_id = s.id),
n AS (SELECT version_id, status, count(*) AS n, count(*) FILTER (WHERE {SEEN('text')}) AS translated, sum(length(text)) AS chars FROM j GROUP BY ALL)
SELECT x.version_id, d.status, coalesce(n.n, 0) AS n, coalesce(n.translated, 0) AS translated, coalesce(n.chars, 0)::BIGINT AS chars FROM (SELECT DISTINCT version_id FROM j) x CROSS JOIN d LEFT JOIN n ON n.version_id = x.version_id AND n.status = d.status""")
def translation_stats(spark: SparkSession, root: str) -> DataFrame:
    """Per version a row for each status, 0 where it does not occur; segments without a translation are missing."""
    c = current(spark, root, "status", "text").select(F.col("segment_id").alias("id"), "status", "text")
    rows = body(spark, root, "version_id").join(c, "id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    counts = rows.groupBy("version_id", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(~X.is_blank(F.col("text"))).alias("translated"), F.sum(F.char_length("text")).alias("chars"))
    return R.zero_filled(counts, ["version_id"], "status", STATUSES).na.fill(0, ["translated", "chars"]).select("version_id", "status", "n", "translated", "chars")


@query(f"WITH {S} SELECT kind, role, count(*) AS n FROM s GROUP BY ALL")
def kind_role_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Segments by kind and role."""
    return segments(spark, root, "kind", "role").groupBy("kind", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S} SELECT doc_id, version_id, kind, count(*) AS n FROM s GROUP BY ROLLUP (doc_id, version_id, kind)")
def kind_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Segments by manual, version and kind with subtotals (an extension)."""
    return segments(spark, root, "doc_id", "version_id", "kind").rollup("doc_id", "version_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V} SELECT doc_id, max(version_no) + 1 AS next_no, max(version_id) AS last_id, count(DISTINCT sha256) AS n_files FROM v GROUP BY doc_id")
def next_version_numbers(spark: SparkSession, root: str) -> DataFrame:
    """The number a manual's next version gets."""
    return versions(spark, root).groupBy("doc_id").agg((F.max("version_no") + 1).alias("next_no"), F.max("version_id").alias("last_id"), F.countDistinct("sha256").alias("n_files"))


@query(f"""WITH {T} SELECT provider, model, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in STATUSES)},
count(*) FILTER (WHERE text IS NULL OR NOT {SEEN('text')}) AS n_blank, round(avg(confidence), 6) AS confidence FROM t GROUP BY ALL""")
def provider_statuses(spark: SparkSession, root: str) -> DataFrame:
    """Conditional counts per provider and model."""
    blank = X.is_blank(F.col("text"))
    return translations(spark, root).groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES), F.count_if(blank).alias("n_blank"), F.round(F.avg("confidence"), 6).alias("confidence")
    )


@query(f"WITH {B} SELECT version_id, count(*) AS n, count(DISTINCT fingerprint) AS n_distinct FROM s GROUP BY version_id")
def distinct_fingerprints(spark: SparkSession, root: str, derive: bool = False) -> DataFrame:
    """Rows against distinct fingerprints per version."""
    return body(spark, root, "version_id", "fingerprint", derive=derive).groupBy("version_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fingerprint").alias("n_distinct"))


@query(f"WITH {B}, {C} SELECT s.version_id, max(c.revision) || ':' || count(c.id) AS revision_key FROM s JOIN c ON c.segment_id = s.id GROUP BY s.version_id")
def revision_keys(spark: SparkSession, root: str) -> DataFrame:
    """The key under which a version's layout may be kept (A10)."""
    c = current(spark, root).select(F.col("segment_id").alias("id"), "revision")
    return body(spark, root, "version_id").join(c, "id").groupBy("version_id").agg(F.concat_ws(":", F.max("revision"), F.count(F.lit(1))).alias("revision_key"))


@query(f"WITH {B} SELECT version_id, page, count(*) AS n, sum(length(text))::BIGINT AS chars, (page // 50) * 50 AS band FROM s GROUP BY ALL")
def body_chars_per_page(spark: SparkSession, root: str) -> DataFrame:
    """Body characters of each page, and its band of fifty pages."""
    return body(spark, root, "version_id", "page", "text").groupBy("version_id", "page").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")).withColumn("band", (F.floor(F.col("page") / 50) * 50).cast("int"))


@query(f"""WITH {S}, w AS (SELECT s.version_id, f.size AS size, sum(f.count) AS w FROM s, UNNEST(s.fonts) AS u(f) GROUP BY ALL)
SELECT version_id, size AS body_size, w::BIGINT AS weight FROM w QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY w DESC, size) = 1""")
def dominant_font_size(spark: SparkSession, root: str) -> DataFrame:
    """The font size most characters of a version have; the smaller of equals."""
    fonts = segments(spark, root, "version_id", "fonts").select("version_id", F.explode("fonts").alias("f"))
    return R.mode_of(fonts.select("version_id", F.col("f.size").alias("size"), F.col("f.count").alias("m")), ["version_id"], "size", F.col("m"), "body_size")


@query(f"""WITH {B}, w AS (SELECT version_id, round(bbox.x0, 0) AS x, count(*) AS w FROM s GROUP BY ALL), p AS (SELECT version_id, round(median(bbox.y1 - bbox.y0), 3) AS median_height FROM s GROUP BY version_id)
SELECT version_id, x AS left_margin, w AS weight, median_height FROM w JOIN p USING (version_id) QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY w DESC, x) = 1""")
def page_context(spark: SparkSession, root: str) -> DataFrame:
    """The usual left margin and the median box height of a version's body."""
    rows = body(spark, root, "version_id", "bbox").select("version_id", F.round("bbox.x0", 0).alias("x"), (F.col("bbox.y1") - F.col("bbox.y0")).alias("h"))
    heights = rows.groupBy("version_id").agg(F.round(F.median("h"), 3).alias("median_height"))
    return R.mode_of(rows, ["version_id"], "x", name="left_margin").join(heights, "version_id").select("version_id", "left_margin", "weight", "median_height")


@query(f"""WITH {S}, {V}, h AS (SELECT version_id, fingerprint, count(DISTINCT page) AS n_pages FROM s WHERE role <> 'body' AND fingerprint IS NOT NULL GROUP BY ALL)
SELECT version_id, fingerprint, n_pages FROM h JOIN v USING (version_id) WHERE n_pages > 0.8 * page_count""")
def running_heads(spark: SparkSession, root: str, derive: bool = False) -> DataFrame:
    """Texts outside the body that stand on more than four fifths of a version's pages."""
    heads = segments(spark, root, "version_id", "fingerprint", "page", "role", derive=derive).filter("role <> 'body' AND fingerprint IS NOT NULL")
    per = heads.select("version_id", "fingerprint", "page").distinct().groupBy("version_id", "fingerprint").agg(F.count(F.lit(1)).alias("n_pages"))
    return per.join(versions(spark, root).select("version_id", "page_count"), "version_id").filter("n_pages > 0.8 * page_count").drop("page_count")


@query(f"""WITH {B}, w AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]{{2,}}'))) AS word FROM s) SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= 2""")
def vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """Words of the body with their counts, from two on."""
    words = body(spark, root, "text").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), 0)).alias("w"))
    return words.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query(f"""WITH {S}, c AS (SELECT unnest(string_split(text, '')) AS ch FROM s) SELECT ch, count(*) AS n FROM c WHERE ord(ch) > 126 GROUP BY ch""")
def char_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Characters beyond ASCII with their counts."""
    rare = segments(spark, root, "text").select(F.explode(F.regexp_extract_all("text", F.lit("[^\\x00-\\x7e]"), 0)).alias("ch"))
    return rare.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S}, l AS (SELECT id, round(b.y1, 0) AS base FROM s, UNNEST(s.line_boxes) AS u(b)), g AS (SELECT id, base, count(*) AS n FROM l GROUP BY ALL)
SELECT id, count(*) AS n_lines, max(n) AS most_on_line, count(*) FILTER (WHERE n > 1) AS n_shared FROM g GROUP BY id""")
def shared_baselines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of a segment that share a baseline, the mark of a collapsed table."""
    lines = segments(spark, root, "line_boxes").select("id", F.explode("line_boxes").alias("b")).groupBy("id", F.round("b.y1", 0).alias("base")).agg(F.count(F.lit(1)).alias("n"))
    return lines.groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("n").alias("most_on_line"), F.count_if(F.col("n") > 1).alias("n_shared"))


@query(f"""WITH {T} SELECT status, count(*) AS n, count(*) FILTER (WHERE text IS NOT NULL AND k.text IS NOT NULL AND t.text = k.text) AS n_same, count(*) FILTER (WHERE t.text <> k.text) AS n_drifted
FROM (SELECT t.status, t.text, s.fingerprint FROM t JOIN (SELECT DISTINCT ON (id) * FROM segments) s ON s.id = t.segment_id) t JOIN ({M[6:-1]}) k USING (fingerprint) GROUP BY status""".replace("WHERE text IS NOT NULL AND", "WHERE t.text IS NOT NULL AND"))
def cache_drift(spark: SparkSession, root: str) -> DataFrame:
    """Translations that agree with the memory and that drifted from it (Q04)."""
    t = translations(spark, root).select(F.col("segment_id").alias("id"), "status", "text")
    joined = t.join(segments(spark, root, "fingerprint"), "id").join(cache(spark, root).select("fingerprint", F.col("text").alias("kept")), "fingerprint")
    return joined.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == F.col("kept")).alias("n_same"), F.count_if(F.col("text") != F.col("kept")).alias("n_drifted"))


# The same over all rows, without SQL: where the stored fingerprint is null the derived one stands for it.
for _f in (fingerprint_dups, cache_lookup, fp_set_difference, migrate_coalesce, distinct_fingerprints, running_heads):
    QUERIES[f"{_f.__name__}_whole"] = partial(_f, derive=True)

# where no fingerprint comes out, the derived ones count under the plain name too; SQL names texts by their folded normal form
for _name in ("fp_set_difference", "migrate_coalesce", "distinct_fingerprints"):
    QUERIES[_name] = QUERIES[f"{_name}_whole"]
    SQL[_name] = keyed(SQL[_name])
