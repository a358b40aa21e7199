"""Queries over the scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scalars as X
from palimpsest.functions.text import content_hash_col, fingerprint_col, normalize_col, normalize_native
from palimpsest.functions.textdiff import script_runs_col
from palimpsest.plans.store import B, C, S, T, V, body, current, segments, translations, versions
from palimpsest.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def derived_columns(spark: SparkSession, root: str) -> DataFrame:
    """Normal form, fingerprint and content hash derived for every segment, stored or not."""
    c = F.col("canonical_text")
    return segments(spark, root, "canonical_text").select("id", normalize_col(c).alias("normalized"), fingerprint_col(c).alias("fingerprint"), content_hash_col(c).alias("content_hash"))


@query(f"WITH {S} SELECT role, count(*) AS n, count(normalized) AS n_normalized, count(fingerprint) AS n_fingerprint, count(content_hash) AS n_content_hash FROM s GROUP BY role")
def stored_columns_agree(spark: SparkSession, root: str) -> DataFrame:
    """How many stored normal forms, fingerprints and content hashes equal those derived anew: all that are stored, as the SQL has it."""
    c = F.col("canonical_text")
    rows = segments(spark, root, "role", "canonical_text", "normalized", "fingerprint", "content_hash")
    same = {"normalized": normalize_col(c), "fingerprint": fingerprint_col(c), "content_hash": content_hash_col(c)}
    flags = rows.select("role", *((F.col(k) == d).alias(f"n_{k}") for k, d in same.items()))
    return flags.groupBy("role").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(f"n_{k}").alias(f"n_{k}") for k in same))


@query()
def normalized_native(spark: SparkSession, root: str) -> DataFrame:
    """The normal form of every document: inside codegen where the text is ASCII, by Python where NFKC may change it."""
    ascii_ = F.col("text").rlike("^[\\x20-\\x7e\\t\\n\\r]*$")
    n = F.coalesce(F.when(ascii_, normalize_native(F.col("text"))), normalize_col(F.when(~ascii_, F.col("text"))))
    return table(spark, root, "documents").select("doc_id", n.alias("t")).select("doc_id", F.char_length("t").cast("bigint").alias("n"), F.md5(F.lower("t")).alias("print"))


_BLANK = r"[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_INK = _BLANK.replace("[", "[^", 1)


@query(
    f"""WITH {B} SELECT kind, count(*) AS n,
count(*) FILTER (WHERE regexp_matches(text, '^([•▪◦‣·∙●○–—*-]|\\(?\\p{{Nd}}{{1,3}}[.)]|\\(?[a-zA-Z][.)]|\\(?[ivxIVX]{{1,4}}[.)]){_BLANK}+{_INK}')) AS n_list,
count(*) FILTER (WHERE regexp_matches(text, '^\\(?\\p{{Nd}}+(\\.\\p{{Nd}}+)*[.)]?{_BLANK}+{_INK}')) AS n_numbered, count(*) FILTER (WHERE regexp_matches(text, '^\\(?[IVXLC]{{1,5}}[.)]{_BLANK}+[A-Z]')) AS n_roman,
count(*) FILTER (WHERE regexp_matches(text, '^(?i:figure|fig\\.?|table|chart|picture|image){_BLANK}*[\\p{{Nd}}A-Za-z]')) AS n_caption,
count(*) FILTER (WHERE regexp_matches(text, '\\.{{3,}}{_BLANK}*\\p{{Nd}}+{_BLANK}*$')) AS n_toc_line, count(*) FILTER (WHERE regexp_matches(text, '\\.{{3,}}{_BLANK}*\\p{{Nd}}*{_BLANK}*$')) AS n_toc_tail,
count(*) FILTER (WHERE regexp_matches(text, '\\p{{Nd}}[\\p{{Nd}},]*(\\.\\p{{Nd}}+)?{_BLANK}*(?i:knots?|kts?|feet|foot|ft|psi|percent|%|seconds?|sec|minutes?|min|degrees?|deg|miles?|nm|nautical miles?|gallons?|lbs?|pounds?|inches|inch|in\\b)')) AS n_quantity
FROM s GROUP BY kind"""
)
def line_kinds(spark: SparkSession, root: str) -> DataFrame:
    """How many texts of each stored kind have each of the line forms."""
    rows = body(spark, root, "kind", "text").select("kind", X.line_marks(F.col("text")).alias("m"))
    names = {"list_item": "n_list"} | {m: f"n_{m}" for m in X.LINE_MARKS if m != "list_item"}
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("m")[m]).alias(name) for m, name in names.items()))


@query(r"""SELECT doc_id, CASE WHEN s = '' THEN 'doc' ELSE s END AS slug, s || '-' || doc_id = slug AS agrees FROM (SELECT doc_id, slug, regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^0-9a-z\x{4e00}-\x{9fff}]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM manuals)""")
def slugs(spark: SparkSession, root: str) -> DataFrame:
    """Slugs of titles."""
    m = table(spark, root, "manuals").select("doc_id", "slug", X.slugify(F.col("title")).alias("made"), F.col("title"))
    bare = F.when(F.col("title").isNull() | (F.col("made") == "doc"), "").otherwise(F.col("made"))
    return m.select("doc_id", F.col("made").alias("slug"), (F.concat_ws("-", bare, F.col("doc_id").cast("string")) == F.col("slug")).alias("agrees"))


@query(f"""WITH {V} SELECT version_id, coalesce(nullif(regexp_extract(coalesce(release_label, ''), '[0-9]+\\.[0-9]+(\\.[0-9]+)*', 0), ''), nullif(regexp_extract(coalesce(label, ''), '[0-9]+\\.[0-9]+(\\.[0-9]+)*', 0), ''), '') AS release,
regexp_extract(coalesce(doc_date, ''), '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}', 0) AS day, 'intake' = split_part(source_path, '/', 1) AS is_relative FROM v""")
def release_and_date(spark: SparkSession, root: str) -> DataFrame:
    """Release labels, dates and path form of versions."""
    return versions(spark, root).select(
        "version_id", X.release_label(F.col("release_label"), F.col("label")).alias("release"), X.doc_date(F.lit(None), F.col("doc_date")).alias("day"), (F.split_part("source_path", F.lit("/"), F.lit(1)) == "intake").alias("is_relative")
    )


@query(f"""WITH {S}, x AS (SELECT id, text || ' ....... ' || page AS row FROM s WHERE kind = 'heading') SELECT id, regexp_extract(row, '^(.*?)[ ]*([.·]{{3,}})[ ]*([0-9A-Za-z-]*)$', 1) AS title,
length(regexp_extract(row, '^(.*?)[ ]*([.·]{{3,}})[ ]*([0-9A-Za-z-]*)$', 2))::INTEGER AS dots, regexp_extract(row, '^(.*?)[ ]*([.·]{{3,}})[ ]*([0-9A-Za-z-]*)$', 3) AS page,
regexp_replace(text_only, '[ .·]{{3,}}$', '') AS stripped FROM (SELECT id, row, regexp_replace(row, '[0-9]+$', '') AS text_only FROM x)""")
def contents_rows(spark: SparkSession, root: str) -> DataFrame:
    """Contents rows taken apart and stripped of their leaders."""
    rows = segments(spark, root, "kind", "text", "page").filter("kind = 'heading'").select("id", F.concat_ws("", "text", F.lit(" ....... "), F.col("page").cast("string")).alias("row"))
    parts = X.dot_leader(F.col("row"))
    return rows.select("id", parts["title"].alias("title"), parts["dots"].alias("dots"), parts["page"].alias("page"), X.strip_toc_leader(F.regexp_replace("row", "[0-9]+$", "")).alias("stripped"))


@query(f"""WITH {B}, {C} SELECT s.id, (floor(h + (length(t) - h) / 3.6 + 0.5))::BIGINT AS n_tokens FROM (SELECT s.id, coalesce(s.text, '') AS t, length(regexp_replace(coalesce(s.text, ''), '[^\\x{{3400}}-\\x{{9fff}}\\x{{3000}}-\\x{{30ff}}]', '', 'g')) AS h FROM s) s""")
def token_estimates(spark: SparkSession, root: str) -> DataFrame:
    """Estimated tokens of body segments."""
    return body(spark, root, "text").select("id", X.estimate_tokens(F.col("text")).alias("n_tokens"))


@query(f"""WITH {T}, {S}, j AS (SELECT t.id, t.status, regexp_replace(coalesce(t.text, ''), '^[\\s\\x{{000b}}\\x{{001c}}-\\x{{001f}}\\x{{0085}}\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s\\x{{000b}}\\x{{001c}}-\\x{{001f}}\\x{{0085}}\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g') AS z, regexp_replace(coalesce(s.text, ''), '^[\\s\\x{{000b}}\\x{{001c}}-\\x{{001f}}\\x{{0085}}\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s\\x{{000b}}\\x{{001c}}-\\x{{001f}}\\x{{0085}}\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g') AS e FROM t JOIN s ON s.id = t.segment_id), q AS (SELECT *, CASE WHEN regexp_matches(z, '^[\\s\\x{{3002}}\\x{{ff0c}}\\x{{3001}}\\x{{ff1b}}\\x{{ff1a}}\\x{{ff01}}\\x{{ff1f}},.!?;:\\x{{2026}}\\x{{2014}}\\x{{2013}}"''\\x{{201c}}\\x{{201d}}\\x{{2018}}\\x{{2019}}()\\x{{ff08}}\\x{{ff09}}\\x{{3010}}\\x{{3011}}\\[\\]-]*$') THEN 0 ELSE length(z) END AS sub FROM j)
SELECT id, CASE WHEN e = '' OR z = '' THEN NULL WHEN length(e) >= 30 AND sub <= 2 THEN 'punctuation_only' WHEN length(e) >= 60 AND length(z) / length(e) < 0.06 THEN 'too_short' WHEN length(e) >= 50 AND regexp_matches(z, '[,;\\x{{ff0c}}\\x{{3001}}]$') THEN 'ends_with_comma' END AS why,
length(z) > 0 AND NOT (length(e) <= 2 AND length(z) > 12) AND length(z) <= greatest(length(e) * 3, 40) AS fits,
CASE WHEN status = 'failed' AND z = '' THEN 'empty' WHEN status = 'machine' AND contains(z, '〔') THEN 'mock' WHEN regexp_matches(z, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'ok' WHEN z = '' THEN 'meaningless'
WHEN (e <> '' AND z = e) OR regexp_matches(z, '^[A-Z0-9][A-Z0-9 ._/()%,\\x{{00b0}}+#''":\\x{{2013}}\\x{{2014}}-]*$') OR (coalesce(status, '') NOT IN ('', 'machine')) THEN 'ok' ELSE 'meaningless' END AS class,
regexp_matches(z, '[\\x{{4e00}}-\\x{{9fff}}]_[A-Za-z0-9]|[A-Za-z0-9]_[\\x{{4e00}}-\\x{{9fff}}]') AS broken FROM q""")
def translation_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Suspicion, shape, class and broken identifiers of every translation row."""
    t = translations(spark, root).select("id", "status", "text", "segment_id").join(segments(spark, root, "text").select(F.col("id").alias("segment_id"), F.col("text").alias("source")), "segment_id")
    en, zh = F.col("source"), F.col("text")
    return t.select("id", X.suspect(en, zh).alias("why"), X.shape_ok(en, zh).alias("fits"), X.classify_translation(zh, en, F.col("status")).alias("class"), X.looks_broken_identifier(F.coalesce(zh, F.lit(""))).alias("broken"))


# The stop words once more, for the SQL.
_STOP_WORDS = """string_split('the and for that with from this these those are was were has have had not but you your its into out over under then than when while will shall can may must should could would about after before being been done only such same each other more most some any all who whom which what there their they them his her', ' ')"""


@query(f"""WITH {B}, w AS (SELECT version_id, id, text AS a, lead(id) OVER o AS next_id, lead(text) OVER o AS b FROM s WINDOW o AS (PARTITION BY version_id ORDER BY order_index, id)),
k AS (SELECT id, next_id, a, b, list_filter(list_distinct(regexp_extract_all(lower(a), '[a-z0-9]{{3,}}')), lambda x: NOT list_contains({_STOP_WORDS}, x)) AS ta,
list_filter(list_distinct(regexp_extract_all(lower(b), '[a-z0-9]{{3,}}')), lambda x: NOT list_contains({_STOP_WORDS}, x)) AS tb FROM w WHERE b IS NOT NULL)
SELECT id, next_id, round(CASE WHEN least(len(ta), len(tb)) < 3 THEN 0.0 ELSE len(list_intersect(ta, tb)) / least(len(ta), len(tb)) END, 6) AS contained,
round(least(length(a), length(b)) / greatest(length(a), length(b)), 6) AS lengths FROM k""")
def neighbour_containment(spark: SparkSession, root: str) -> DataFrame:
    """Content words that neighbours share, and how alike their lengths are."""
    from palimpsest.plans.order import in_version

    w = body(spark, root, "version_id", "order_index", "text").select("id", F.col("text").alias("a"), F.lead("id").over(in_version()).alias("next_id"), F.lead("text").over(in_version()).alias("b")).filter("b IS NOT NULL")
    return w.select("id", "next_id", F.round(X.token_containment(F.col("a"), F.col("b")), 6).alias("contained"), F.round(X.len_ratio(F.col("a"), F.col("b")), 6).alias("lengths"))


# upper case of ligatures and of the sharp s is two letters or three
@query(f"""WITH {S}, x AS (SELECT id, coalesce(text, '') AS t, style.size AS size, style.color AS color FROM s) SELECT id, regexp_replace(upper(replace(replace(replace(replace(replace(replace(t, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS label,
regexp_matches(t, '[0-9]') OR (regexp_replace(t, '[^A-Za-z]', '', 'g') <> '' AND regexp_replace(t, '[^A-Za-z]', '', 'g') = upper(regexp_replace(t, '[^A-Za-z]', '', 'g'))) AS code_like,
CASE WHEN length(trim(t, ' ')) <= 8 AND regexp_matches(trim(t, ' '), '^[A-Z0-9-]+\\n?$') THEN 'code' WHEN len(string_split_regex(trim(t, ' '), ' +')) >= 5 AND regexp_matches(trim(t, ' '), '[.!?]\\n?$') THEN 'sentence' ELSE 'other' END AS bucket,
(color >> 16) & 255 AS r, (color >> 8) & 255 AS g, color & 255 AS b FROM x""")
def label_forms(spark: SparkSession, root: str) -> DataFrame:
    """Label keys, code-likeness, buckets and colours of every segment."""
    t, rgb = F.col("text"), X.int_to_rgb(F.col("style.color"))
    rows = segments(spark, root, "text", "style").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("id", X.upper_alnum(t).alias("label"), X.is_code_like(t).alias("code_like"), X.label_bucket(t).alias("bucket"), rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"))


# each character becomes a letter for its class, in the order in which the classes are told apart
_CLASSED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
'[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', ' ', 'g'), '[0-9\x{ff10}-\x{ff19}]', '0', 'g'), '[A-Za-z\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}]', 'a', 'g'),
'[\x{2e80}-\x{2eff}\x{3001}-\x{303f}\x{3040}-\x{30ff}\x{3100}-\x{312f}\x{31c0}-\x{31ef}\x{3200}-\x{33ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{a960}-\x{a97f}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{fe10}-\x{fe1f}\x{fe30}-\x{fe4f}\x{ff00}-\x{ffef}\x{1f200}-\x{1f2ff}\x{20000}-\x{2fa1f}]', chr(1), 'g'),
'[^\x00-\x7f]', chr(2) || '\0', 'g'), '\x02(?:\pL)', 'a', 'g'), '\x02(?:\pN)', '0', 'g')"""


@query(rf"""WITH {C}, x AS (SELECT regexp_replace(regexp_replace({_CLASSED}, '\x02.', '-', 'g'), '[^ 0a\x01]', '-', 'g') AS t FROM c WHERE text IS NOT NULL),
k AS (SELECT * FROM (VALUES ('space', ' +'), ('digit', '0+'), ('latin', 'a+'), ('cjk', '\x01+'), ('punct', '-+')) AS v(kind, p)), r AS (SELECT kind, unnest(regexp_extract_all(t, p)) AS run FROM x, k)
SELECT kind, count(*) AS n_runs, sum(length(run))::BIGINT AS n_chars FROM r GROUP BY kind""")
def script_run_counts(spark: SparkSession, root: str) -> DataFrame:
    """Runs of one script in current translations, by kind."""
    runs = current(spark, root, "text").select(F.explode(script_runs_col("text")).alias("r"))
    return runs.groupBy("r.kind").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.char_length("r.run")).alias("n_chars"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, root: str) -> DataFrame:
    """A value from a JSON column; null where the JSON is bad."""
    return table(spark, root, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


#: Former names.
for _name, _of in (("derived_columns_whole", "derived_columns"), ("normalized_whole", "normalized_native"), ("label_forms_whole", "label_forms")):
    QUERIES[_name] = QUERIES[_of]
