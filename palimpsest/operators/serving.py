"""What readers and importers ask of the store: ranges of pages, names of manuals and versions, views of changes, states.

Requests are tables, so a thousand of them are one join; none is looped over.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import relational as R

STATUSES = ("machine", "carried", "seeded", "reviewed", "missing", "failed")
#: Part of the result of a view: characters of a text, and changes of a step, unless more are asked for.
VIEW_CHARS, VIEW_CHANGES = 500, 4000


def in_page_ranges(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """``segments`` of the versions, pages and role that requests name.

    ``requests``: version_id, page_from, page_to, role; 0 and null of a page and
    null or the empty role are not given.  A segment without a page is in no
    given range; of several requests for a version each adds what it names.
    """
    s, q = segments.alias("s"), requests.select("version_id", "page_from", "page_to", "role").distinct().alias("q")
    given = lambda c: F.coalesce(F.col(f"q.{c}"), F.lit(0)) != 0
    holds = (F.col("s.version_id") == F.col("q.version_id")) & (~given("page_from") | (F.col("s.page") >= F.col("q.page_from"))) & (~given("page_to") | (F.col("s.page") <= F.col("q.page_to")))
    of_role = (F.coalesce(F.col("q.role"), F.lit("")) == "") | (F.col("s.role") == F.col("q.role"))
    return s.join(q, holds & of_role, "left_semi")


def resolved(requests: DataFrame, rows: DataFrame, key: str, names: list[str], order: list[str]) -> DataFrame:
    """(request_id, key): the row that a request names by any of ``names``, the first by ``order`` of several; null where none.

    ``requests``: request_id, wanted and, if ``rows`` belong to something,
    ``within`` as in ``rows``.  An equi-join per name, no comparison of all with all.
    """
    scope = ["within"] if "within" in requests.columns else []
    place = F.struct(*order, key)
    named = rows.select(*scope, key, place.alias("_place"), F.explode(F.array_distinct(F.array(*(F.col(n).cast("string") for n in names)))).alias("wanted")).filter("wanted IS NOT NULL")
    asked = requests.withColumn("wanted", F.trim("wanted"))
    return asked.join(named, [*scope, "wanted"], "left").groupBy("request_id").agg(F.min_by(key, "_place").alias(key))


def change_view(changes: DataFrame, texts: DataFrame, pages: DataFrame | None = None, include_unchanged: bool = False, chars: int | None = VIEW_CHARS, most: int | None = VIEW_CHANGES) -> DataFrame:
    """Changes as a reader sees them: (step, change_id, kind, ratio, pages, ids, old_text, new_text).

    ``changes`` as ``alignment.align`` gives them, ``texts``: id, text.
    Unchanged ones are left out unless asked for; ``pages`` (step, page) keeps
    changes of an old or new page in it; removed and unchanged ones carry no
    text, others at most ``chars`` characters and an ellipsis (null: all);
    ``most`` changes of a step in reading order (null: all).
    """
    kept = changes if include_unchanged else changes.filter("change_kind <> 'unchanged'")
    if pages is not None:
        c, p = kept.alias("c"), pages.select("step", "page").distinct().alias("p")
        kept = c.join(p, (F.col("c.step") == F.col("p.step")) & F.col("p.page").isin(F.col("c.old_page"), F.col("c.new_page")), "left_semi")
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("step").orderBy("position"))
        kept = kept.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
    first = lambda c: F.try_element_at(c, F.lit(1))
    rows = kept.select("step", (F.col("position") + 1).alias("change_id"), F.col("change_kind").alias("kind"), "ratio", "old_page", "new_page", first("old_ids").alias("old_id"), first("new_ids").alias("new_id"))
    shown = F.col("text") if chars is None else F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("…"))).otherwise(F.col("text"))
    told = texts.select("id", shown.alias("t"))
    for side in ("old", "new"):
        wanted = F.when(~F.col("kind").isin("unchanged", "removed"), F.col(f"{side}_id"))
        rows = rows.withColumn("_w", wanted).join(told.select(F.col("id").alias("_w"), F.col("t").alias(f"{side}_text")), "_w", "left").drop("_w").withColumn(f"{side}_text", F.coalesce(f"{side}_text", F.lit("")))
    return rows


def set_statuses(translations: DataFrame, requests: DataFrame, segments: DataFrame) -> DataFrame:
    """Current translations with the status and reviewer that requests give them.

    ``translations``: segment_id, text, status, revision, reviewed_by,
    reviewed_at, one row each; ``requests``: segment_id, status, reviewed_by,
    at.  A request for an unknown segment or with an unknown status is passed
    over, of several the last by ``at`` holds; a segment without a translation
    gets an empty one of revision 1; an empty reviewer leaves the former one.
    """
    valid = requests.filter(F.col("status").isin(*STATUSES)).join(segments.select(F.col("id").alias("segment_id")).distinct(), "segment_id", "left_semi")
    n = R.latest(valid, ["segment_id"], "at", "status").select("segment_id", F.col("status").alias("_s"), F.nullif("reviewed_by", F.lit("")).alias("_by"), "at")
    both = translations.join(n, "segment_id", "full")
    asked = F.col("_s").isNotNull()
    reviewed_at = F.when(asked & (F.col("_by").isNotNull() | (F.col("_s") == "reviewed")), F.col("at"))
    return both.select(
        "segment_id", F.when(asked & F.col("revision").isNull(), F.lit("")).otherwise(F.col("text")).alias("text"), F.coalesce("_s", "status").alias("status"),
        F.when(asked & F.col("revision").isNull(), F.lit(1)).otherwise(F.col("revision")).alias("revision"), F.coalesce("_by", "reviewed_by").alias("reviewed_by"), F.coalesce(reviewed_at, "reviewed_at").alias("reviewed_at"),
    )


def arrival_decisions(arrivals: DataFrame, versions: DataFrame, segments: DataFrame, translations: DataFrame) -> DataFrame:
    """(arrival_id, decision, version_id, label): what an importer does with each file that arrives.

    ``arrivals``: arrival_id, doc_id, sha256, reingest, allow_loss.  A file
    already extracted for its manual is ``reused`` (its version becomes the
    current one); asked to be read again it is ``replaced``, but ``refused``
    where that would drop translations and nobody allows it; one registered
    without segments is ``extracted``; any other is ``new``, with the next label.
    """
    v = versions.select("doc_id", "sha256", "version_id").distinct()
    prior = v.filter("sha256 IS NOT NULL").groupBy("doc_id", "sha256").agg(F.min("version_id").alias("version_id"))
    held = segments.groupBy("version_id").agg(F.count(F.lit(1)).alias("n_segments"))
    told = segments.select(F.col("id").alias("segment_id"), "version_id").join(translations.filter("text <> ''").select("segment_id").distinct(), "segment_id").select("version_id").distinct().withColumn("told", F.lit(True))
    known = v.groupBy("doc_id").agg(F.count_distinct("version_id").alias("n_versions"))
    rows = arrivals.join(prior, ["doc_id", "sha256"], "left").join(held, "version_id", "left").join(told, "version_id", "left").join(known, "doc_id", "left")
    again, has = F.coalesce("reingest", F.lit(False)), F.coalesce(F.col("n_segments") > 0, F.lit(False))
    decision = (
        F.when(F.col("version_id").isNull(), "new").when(~has, "extracted").when(~again, "reused")
        .when(F.coalesce("told", F.lit(False)) & ~F.coalesce("allow_loss", F.lit(False)), "refused").otherwise("replaced")
    )
    label = F.when(F.col("version_id").isNull(), F.concat(F.lit("v"), (F.coalesce("n_versions", F.lit(0)) + 1).cast("string")))
    return rows.select("arrival_id", decision.alias("decision"), "version_id", label.alias("label"))


def filled(missing: DataFrame, backup: DataFrame) -> DataFrame:
    """(id, backup_id, how): for each row without an answer one that has it, of equal fingerprint, else of equal normal form.

    ``missing``: id, fingerprint, normalized; ``backup`` the same; the least
    backup id stands for equal ones.  Case is no difference; nulls equal nothing.
    """
    prints = backup.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("id").alias("by_print"))
    forms = backup.filter("normalized IS NOT NULL").groupBy(F.lower("normalized").alias("_form")).agg(F.min("id").alias("by_form"))
    found = missing.withColumn("_form", F.lower("normalized")).join(prints, "fingerprint", "left").join(forms, "_form", "left")
    how = F.when(F.col("by_print").isNotNull(), "fingerprint").otherwise("normal form")
    return found.select("id", F.coalesce("by_print", "by_form").alias("backup_id"), how.alias("how")).filter("backup_id IS NOT NULL")


def put_snapshots(held: DataFrame, new: DataFrame) -> DataFrame:
    """The register of rendered files (snapshot_id, version_id, kind, params_hash, path, stale, bytes, created_at) with new ones in place of those of equal version, kind and parameters.

    ``new`` has no snapshot_id: one that replaces keeps the old id, others get
    the next ones in order of version, kind and parameters; the last by
    created_at of equal ones counts; rows without a version are left out.
    """
    keys = ["version_id", "kind", "params_hash"]
    named = lambda d: d.withColumns({k: F.coalesce(k, F.lit("")) for k in keys[1:]})
    fresh = R.latest(named(new).filter("version_id IS NOT NULL"), keys, "created_at", "path")
    old = named(held)
    kept = old.join(fresh.select(*keys), keys, "left_anti")
    replaced = fresh.join(old.select(*keys, "snapshot_id"), keys, "left")
    most = held.agg(F.coalesce(F.max("snapshot_id"), F.lit(0)).alias("_most"))
    added = replaced.filter("snapshot_id IS NULL").drop("snapshot_id").crossJoin(F.broadcast(most))  # one row
    numbered = added.withColumn("snapshot_id", F.col("_most") + F.row_number().over(Window.orderBy(*keys))).drop("_most")
    return kept.unionByName(replaced.filter("snapshot_id IS NOT NULL")).unionByName(numbered)


def latest_snapshots(held: DataFrame, fresh_only: bool = True) -> DataFrame:
    """The newest snapshot of each version and kind, whatever its parameters; stale ones only count if asked for."""
    rows = held.filter(F.coalesce("stale", F.lit(0)) == 0) if fresh_only else held
    return R.latest(rows, ["version_id", "kind"], "snapshot_id")


def mark_stale(held: DataFrame, versions: DataFrame) -> DataFrame:
    """Snapshots with those of the given versions (version_id) marked stale."""
    hit = versions.select("version_id", F.lit(True).alias("_hit")).distinct()
    return held.join(hit, "version_id", "left").withColumn("stale", F.when(F.col("_hit"), F.lit(1)).otherwise(F.coalesce("stale", F.lit(0)))).drop("_hit").select(*held.columns)


def is_banner(box: Column, width: Column, height: Column) -> Column:
    """Whether an image is a banner: nearly as wide as the page, at its upper or lower edge, and no thin line.  Boxes without area are none."""
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    edge = (box["y0"] <= 6.0) | (box["y1"] >= height - 6.0)
    return F.coalesce((w > 0) & (h >= 18.0) & (width > 0) & (height > 0) & (w >= 0.88 * width) & edge & (w * h >= 0.02 * width * height), F.lit(False))


def pages_to_label(images: DataFrame, segments: DataFrame, width: float, height: float) -> DataFrame:
    """(version_id, page, img_frac, live_chars, needs): pages whose figures may hold text that no segment has.

    Images under 80 points high do not count.  A page needs labels if images
    take over a quarter of it and it has under 400 characters of body text, or
    one image takes over 45 %.
    """
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    seen = images.filter(F.col("y1") - F.col("y0") >= 80).groupBy("version_id", "page").agg(F.sum(area).alias("all"), F.max(area).alias("most"))
    live = segments.filter("role = 'body'").groupBy("version_id", "page").agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("live_chars"))
    both = seen.join(live, ["version_id", "page"], "full").na.fill(0, ["all", "most", "live_chars"])
    frac, big = F.col("all") / (width * height), F.col("most") / (width * height)
    return both.select("version_id", "page", F.round(frac, 3).alias("img_frac"), "live_chars", (((frac > 0.25) & (F.col("live_chars") < 400)) | (big > 0.45)).alias("needs"))


#: Characters after a proportional cut in which a stop is looked for.
SNAP = 12
_STOPS = re.compile("[。，；：、,.;:]")
_HELD = re.compile(r"[\w]")


def split_by_ratio(zh: str | None, first: str | None, second: str | None) -> tuple[str, str]:
    """One translation of two texts divided by their lengths, after a stop close behind the place if there is one.

    Where a part would hold fewer than two letters or digits all of it goes to
    the first.  Nulls count as empty.
    """
    zh, a, b = zh or "", len(first or ""), len(second or "")
    if not a + b:
        return zh, ""
    cut = len(zh) * a // (a + b)
    stop = _STOPS.search(zh, max(cut - 1, 0), min(len(zh), cut + SNAP) - 1)
    if stop and cut:
        cut = stop.end()
    parts = zh[:cut].rstrip(), zh[cut:].lstrip()
    return parts if all(len(_HELD.findall(p)) >= 2 for p in parts) else (zh, "")


@F.pandas_udf(T.StructType([T.StructField("first", T.StringType()), T.StructField("second", T.StringType())]))
def split_by_ratio_col(zh: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_by_ratio(*x) for x in zip(zh, a, b, strict=True)], columns=["first", "second"])
