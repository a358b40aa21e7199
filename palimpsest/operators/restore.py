"""Finding old rows' places again: restoring translations, lookups with fallbacks, links and reports."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as X
from palimpsest.functions.text import normalize
from palimpsest.sources.tables import stage

# Limits of the containment tier.
LEAST_CONTAINED, LEAST_SHARE = 8, 0.5
RESTORED = "version_id bigint, segment_id bigint, tier string, text string, status string, provider string, model string, confidence double, revision int, reviewed_by string"


def _page_rest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The containment tier on one page: each old row takes the nearest-sized free segment that contains it or that it contains."""
    old, new = pdf[pdf["is_old"]], pdf[~pdf["is_old"]]
    free = {int(i): normalize(t) for i, t in zip(new["key"], new["canonical_text"], strict=True)}
    out = []
    for r in old.sort_values(["order_index", "key"]).itertuples():
        mine = normalize(r.canonical_text)
        fits = [
            (abs(len(t) - len(mine)), i)
            for i, t in free.items()
            if mine and len(t) >= LEAST_CONTAINED and (mine in t or (t in mine and len(t) / len(mine) >= LEAST_SHARE))
        ]
        if fits:
            _, i = min(fits)
            del free[i]
            out.append((r.key, i))
    return pd.DataFrame(out, columns=["row_id", "segment_id"])


def _nearest_place(free: list[tuple[int, int, int]], page: int, place: int) -> int:
    """The index in a sorted list of (page, place, row) of the nearest by page, then by place; of equal ones the first."""
    lo, hi = bisect_left(free, (page,)), bisect_left(free, (page + 1,))
    near = {page} if lo < hi else {free[x][0] for x in (lo - 1, hi) if 0 <= x < len(free)}
    around: list[int] = []
    for p in near:
        lo, hi = bisect_left(free, (p,)), bisect_left(free, (p + 1,))
        at = bisect_left(free, (p, place), lo, hi)
        before = [bisect_left(free, (p, free[at - 1][1]), lo, hi)] if at > lo else []  # the first of those at that place
        around += [*before, *([at] if at < hi else [])]
    return min(around, key=lambda x: (abs(free[x][0] - page), abs(free[x][1] - place), free[x]))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by version, fingerprint, side (new ones first) and place: each old row takes the nearest new one that is free.

    Held are the free new rows of one fingerprint in one version.
    """
    of, free = None, []
    for b in batches:
        found: list[tuple[int, int]] = []
        for version, print_, is_old, page, place, row in zip(*(b[c].to_pylist() for c in _NEAR), strict=True):
            if (version, print_) != of:
                of, free = (version, print_), []
            if not is_old:
                insort(free, (page, place, row))
                continue
            if free:
                best = _nearest_place(free, page, place)
                found.append((row, free.pop(best)[2]))
        columns = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row_id", "segment_id"])


_NEAR = ("version_id", "fingerprint", "is_old", "page", "order_index", "key")


def nearest(old: DataFrame, new: DataFrame) -> DataFrame:
    """(row_id, segment_id, tier): old rows of a version with the free new one of equal fingerprint that is nearest by page, then by place.

    Old rows choose in order of page and place.  A null page or place counts as 0; a null fingerprint equals nothing.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    side = lambda df, key, is_old: df.filter("fingerprint IS NOT NULL AND version_id IS NOT NULL").select("version_id", "fingerprint", F.lit(is_old).alias("is_old"), zero("page"), zero("order_index"), F.col(key).cast("bigint").alias("key"))
    both = side(old, "row_id", True).unionAll(side(new, "segment_id", False))
    laid = both.repartition("version_id", "fingerprint").sortWithinPartitions(*_NEAR)
    return laid.mapInArrow(_nearest, "row_id bigint, segment_id bigint").withColumn("tier", F.lit("near"))


def restore(backup: DataFrame, segments: DataFrame, shape_check: bool = True) -> DataFrame:
    """Backed-up answers on the segments of the same versions, each target once; see ``RESTORED`` for the columns.

    exact: equal page and fingerprint, in order of occurrence; near: equal
    fingerprint, the nearest by page and place; contains: on the page, one text
    within the other. Answers out of proportion to their new source are left
    for translation. Old rows that find no place are not in the result; null
    fingerprints and pages equal nothing.
    """
    # written once, so that the numbers are the same in every branch that reads them
    b = stage(backup.withColumn("row_id", F.monotonically_increasing_id()), "backup")
    s = segments.filter("id IS NOT NULL").select(F.col("id").alias("segment_id"), "version_id", "page", "order_index", "fingerprint", "canonical_text")

    def tier(old: DataFrame, new: DataFrame, keys: list[str], name: str) -> DataFrame:
        number = lambda df, last: df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("page", "order_index", last)))
        return number(old, "row_id").select(*keys, "_k", "row_id").join(number(new, "segment_id").select(*keys, "_k", "segment_id"), [*keys, "_k"]).select("row_id", "segment_id", F.lit(name).alias("tier"))

    found = tier(b, s, ["version_id", "page", "fingerprint"], "exact")
    rest_b, rest_s = b.join(found, "row_id", "left_anti"), s.join(found, "segment_id", "left_anti")
    near = stage(nearest(rest_b, rest_s), "near")
    found = found.unionAll(near)
    rest_b, rest_s = rest_b.join(near, "row_id", "left_anti"), rest_s.join(near, "segment_id", "left_anti")
    columns = ["version_id", "page", "order_index", "canonical_text"]
    # one key column without nulls: pandas would turn nullable ids into floats
    pages = rest_b.select(*columns, F.col("row_id").alias("key"), F.lit(True).alias("is_old")).unionAll(rest_s.select(*columns, F.col("segment_id").alias("key"), F.lit(False).alias("is_old")))
    contained = pages.groupBy("version_id", "page").applyInPandas(_page_rest, "row_id bigint, segment_id bigint").withColumn("tier", F.lit("contains"))
    placed = found.unionAll(contained).join(b.drop("canonical_text", "fingerprint", "page", "order_index"), "row_id").join(s.select("segment_id", "canonical_text"), "segment_id")
    kept = placed.filter(X.shape_ok(F.col("canonical_text"), F.col("text"))) if shape_check else placed
    return kept.select(*(c.strip().split(" ")[0] for c in RESTORED.split(",")))


def located(removed: DataFrame, segments: DataFrame) -> DataFrame:
    """(removed_id, segment_id, tier): removed rows found among old segments by id, else by equal text, else by their first 24 characters.

    The least id stands for equal texts.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, "\\s+", " "))
    r = removed.select("removed_id", "old_id", plain(F.col("text")).alias("_t"))
    s = segments.select(F.col("id").alias("segment_id"), plain(F.col("text")).alias("_t"))
    texts = s.groupBy("_t").agg(F.min("segment_id").alias("by_text"))
    heads = s.groupBy(F.substring("_t", 1, 24).alias("_h")).agg(F.min("segment_id").alias("by_head"))
    found = (
        r.join(s.select(F.col("segment_id").alias("old_id"), F.col("segment_id").alias("by_id")), "old_id", "left")
        .join(texts, "_t", "left")
        .withColumn("_h", F.substring("_t", 1, 24))
        .join(heads, "_h", "left")
    )
    tier = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_text").isNotNull(), "text").when(F.col("by_head").isNotNull(), "head")
    return found.select("removed_id", F.coalesce("by_id", "by_text", "by_head").alias("segment_id"), tier.alias("tier"))


def at_position(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(point_id, id, fraction): the box of its page that a height falls into, and how far down; the upper of two at an edge."""
    s = segments.select("version_id", "page", "id", F.col("bbox.y0").alias("_a"), F.col("bbox.y1").alias("_b"))
    hit = points.join(s, ["version_id", "page"]).filter(F.col("y").between(F.col("_a"), F.col("_b")))
    best = hit.groupBy("point_id").agg(F.min_by(F.struct("id", "_a", "_b", "y"), F.struct("_a", "id")).alias("r"))
    return best.select("point_id", "r.id", F.round((F.col("r.y") - F.col("r._a")) / F.greatest(F.lit(1e-9), F.col("r._b") - F.col("r._a")), 6).alias("fraction"))


def record_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links with the new ones in place of those of equal ends; a missing end equals a missing end."""
    same = F.col("o.new_segment_id").eqNullSafe(F.col("n.new_segment_id")) & F.col("o.old_segment_id").eqNullSafe(F.col("n.old_segment_id"))
    kept = old.alias("o").join(new.alias("n"), same, "left_anti")
    valid = F.col("ratio").between(0, 1) & (F.col("new_segment_id").isNotNull() | F.col("old_segment_id").isNotNull())
    return kept.unionByName(new.filter(valid))


def diff_summary(links: DataFrame, segments_per_version: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(step, change_kind, n) with every kind; what no link names is unchanged, rows of any role counted."""
    counted = links.filter("change_kind <> 'unchanged'").groupBy("step", "change_kind").agg(F.count(F.lit(1)).alias("n"))
    named = links.filter("new_segment_id IS NOT NULL AND change_kind <> 'unchanged'").groupBy("step").agg(F.count(F.lit(1)).alias("m"))
    rest = segments_per_version.join(named, "step", "left").select("step", F.lit("unchanged").alias("change_kind"), F.greatest(F.lit(0), F.col("n_segments") - F.coalesce("m", F.lit(0))).alias("n"))
    every = segments_per_version.select("step", F.explode(F.array(*map(F.lit, kinds))).alias("change_kind"))
    return every.join(counted.unionByName(rest), ["step", "change_kind"], "left").select("step", "change_kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def summary_text(counts: DataFrame) -> DataFrame:
    """(step, summary): one line of Markdown per kind with its share."""
    total = counts.groupBy("step").agg(F.sum("n").alias("t"))
    line = F.format_string("- %s: %d (%.1f%%)", F.col("change_kind"), F.col("n"), F.when(F.col("t") > 0, 100.0 * F.col("n") / F.col("t")).otherwise(F.lit(0.0)))
    rows = counts.join(total, "step").groupBy("step").agg(F.sort_array(F.collect_list(F.struct("change_kind", line.alias("line")))).alias("r"))
    return rows.select("step", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("summary"))


def edited(segments: DataFrame, order: str = "order_index") -> DataFrame:
    """A next version by a rule on positions, for tests: some rows dropped, a word or number changed, a row appended after some."""
    p = F.col(order)
    number = F.regexp_replace("text", "[0-9]+", X.rewrite_number(F.col("text")).cast("string"))
    word = F.regexp_replace("text", "\\bthe\\b", "this")
    changed = segments.filter(p % 97 != 13).withColumn("text", F.when(p % 89 == 7, word).when(p % 83 == 5, F.coalesce(number, F.col("text"))).otherwise(F.col("text")))
    added = segments.filter(p % 101 == 50).withColumn("text", F.concat(F.lit("Note to row "), p.cast("string")))
    return changed.unionByName(added)


def with_kind(segments: DataFrame, marks: DataFrame) -> DataFrame:
    """Page segments with their change kind, null where nothing changed (markers): of several marks the least kind by name."""
    one = marks.groupBy("segment_id").agg(F.min("change_kind").alias("change_kind"))
    return segments.join(one, segments["id"] == one["segment_id"], "left").drop("segment_id")


def estimated_share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
