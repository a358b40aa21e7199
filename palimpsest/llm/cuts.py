"""Text cut off by field limits or broken transfers.

Two kinds of evidence, both taken from the whole corpus:

* Spikes.  Per column and source, histograms of the lengths (in characters and
  in bytes) of the different texts that end without a stop.  A limit shows as a
  length that many more of them have than the lengths around it.  A text at a
  spike that ends without a stop was cut there, whatever its ending looks like.
  A source may have lost its limit later, so longer texts may exist: the
  maximum looked for is that of the surroundings, not of the column.
* Endings, for transfers that broke at any length, which leave no spike.  Every whole sentence adds to statistics of how sentences that
  begin in a certain way end: (opening words, number of commas, last word).
  A last fragment without a stop whose ending whole sentences share lacks only
  the stop; one whose opening mostly stands without a stop (references, labels,
  lead-ins) is complete if it ends the way those do.  Any other stops inside a
  sentence.

A text is cut if it ends without a stop, nothing continues it, and it stands at
a spike or its ending is not that of a complete sentence.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.tables import stage

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WRAP = re.compile(r"-\n(?=\w)")
_STOP = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s|$)|[。！？…]+[\"'”’）)」』]*|[!?]+(?=[\u4e00-\u9fff])")
_TRAILING_OFF = re.compile(r"(?:…|\.{3,})[\s…]*$")
_LETTER = re.compile(r"[^\W_]")
_HAN = re.compile("[\u3400-\u4dbf\u4e00-\u9fff]")
_CODE = re.compile(r"[A-Z]{1,5}-(\d+)")
_DIGITS = re.compile(r"\d[\d.,]*")
_COMMAS = re.compile(r"[,;，、；]")
_TAIL_VALUE = re.compile(r"(?:[A-Z]{1,5}-)?\d+$")
_LEAD_IN = re.compile(r"[:：]$")
_REFERENCE = re.compile(
    r"(?:\b(?:Tables?|Figures?|Fig\.?|Sections?|Chapters?|sheets?|pages?|Notes?|Items?|Steps?|Appendix|Annex|Part|Abschnitt|Tabelle|Tableau|Chapitre)\s*[\dA-Z]+|[表图第节章]\s*\d+)(?:[-.]\d+)*\s*[页章节]?$"
)
_PAIRS = {")": "(", "）": "（", "]": "[", "”": "“", "」": "「", "』": "『"}


def unwrapped(text: str) -> str:
    """One line without invisible characters; words divided at a line's end are joined."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return " ".join(_WRAP.sub("", text).split())


def parts(text: str) -> tuple[list[str], str]:
    """The whole sentences of an unwrapped text, and what follows the last stop.  An ellipsis at the end is no stop but a sign of more."""
    text = _TRAILING_OFF.sub("", text)
    whole, at = [], 0
    for m in _STOP.finditer(text):
        s = text[at : m.start()].strip()
        if s:
            whole.append(s)
        at = m.end()
    return whole, text[at:].strip()


def _hash(*x: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, x)).encode("utf-8", "surrogatepass"))


def _mask(word: str) -> str:
    if not _DIGITS.search(word):
        return word
    word = _CODE.sub(lambda m: "\x02" + "abcdefgh"[min(len(m.group(1)), 8) - 1], word)  # a letter for the number of digits
    return _DIGITS.sub("\x03", word)


def shape(sentence: str) -> tuple[str, str, int]:
    """(opening, closing, commas): codes keep their number of digits, other numbers none; case stays in the closing."""
    commas = sentence.count(",") + sentence.count(";") + sentence.count("、")
    if _HAN.search(sentence):
        head = _mask(sentence[:14])
        opening = head[:6] if "\x02" in head[:3] else head[:2]  # a code alone says little
        closing = _mask(sentence[-14:])[-2:]
    else:
        first, last = sentence.split(None, 2)[:2], sentence.rsplit(None, 1)[-1]
        opening = _mask(" ".join(first)).lower()
        closing = _mask(last.strip("\"'“”,;:()[]"))
    return opening, closing, commas


def balanced(fragment: str) -> bool:
    """Whether the last character closes a bracket or quote that the fragment opened."""
    last = fragment[-1:]
    if last == '"':
        return fragment.count('"') % 2 == 0
    return last in _PAIRS and fragment.count(_PAIRS[last]) == fragment.count(last)


def unclosed(fragment: str) -> bool:
    """Whether a bracket or quote is still open."""
    return any(fragment.count(a) > fragment.count(b) for b, a in _PAIRS.items())


OPEN_ENDED, LEAD_IN, MARKED, UNCLOSED = 0, 1, 2, 3
#: What follows whole sentences is no label if it has fewer words, or characters of Han text with values as one.
LEAST_LABEL = {False: 4, True: 8}
#: Kinds of statistic rows.
WHOLE_SHAPE, WHOLE_OPENING, WHOLE_CLOSING = 0, 1, 2


def _analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: statistics of whole sentences (summed up per batch), and texts that end without a stop."""
    for b in batches:
        shapes: Counter[tuple[str, str, int]] = Counter()
        out: list[tuple] = []
        for column, row_id, source, text in zip(*(b[c].to_pylist() for c in ("column", "row_id", "source", "text")), strict=True):
            line = unwrapped(text)
            whole, rest = parts(line)
            shapes.update(map(shape, whole))
            if _LETTER.search(rest):
                o, c, k = shape(rest)
                refers = _REFERENCE.search(rest) and (_HAN.search(rest) or len(rest.split()) > 3)
                mark = UNCLOSED if unclosed(rest) or _TRAILING_OFF.search(line) else LEAD_IN if refers or _LEAD_IN.search(rest) else MARKED if balanced(rest) else OPEN_ENDED
                value = _TAIL_VALUE.search(rest)
                out.append((column, row_id, source, _hash(o, c, k), _hash(o), _hash(c), mark, bool(_HAN.search(rest)), bool(whole) and len(_mask(rest) if _HAN.search(rest) else rest.split()) < LEAST_LABEL[bool(_HAN.search(rest))], value.group() if value else None, bool(_COMMAS.search(rest[-1:])), len(text), len(text.encode("utf-8", "surrogatepass")), _hash(text)))
        seen: Counter[tuple[int, int]] = Counter()
        for (o, c, k), times in shapes.items():
            seen[WHOLE_SHAPE, _hash(o, c, k)] += times
            seen[WHOLE_OPENING, _hash(o)] += times
            seen[WHOLE_CLOSING, _hash(c)] += times
        cols = list(zip(*out, strict=True)) if out else [()] * 14
        n, m = len(out), len(seen)
        signed = lambda xs: np.array(xs, np.uint64).view(np.int64)
        kinds = [k for k, _ in seen]
        keys = [h for _, h in seen]
        none = pa.nulls
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(cols[0], pa.string()), none(m, pa.string())]),
                pa.concat_arrays([pa.array(cols[1], pa.int64()), none(m, pa.int64())]),
                pa.concat_arrays([pa.array(cols[2], pa.string()), none(m, pa.string())]),
                pa.concat_arrays([pa.array(signed(cols[3])), pa.array(signed(keys))]),
                pa.concat_arrays([pa.array(signed(cols[4])), none(m, pa.int64())]),
                pa.concat_arrays([pa.array(signed(cols[5])), none(m, pa.int64())]),
                pa.concat_arrays([pa.array(cols[6], pa.int32()), none(m, pa.int32())]),
                pa.concat_arrays([pa.array(cols[7], pa.bool_()), none(m, pa.bool_())]),
                pa.concat_arrays([pa.array(cols[8], pa.bool_()), none(m, pa.bool_())]),
                pa.concat_arrays([pa.array(cols[9], pa.string()), none(m, pa.string())]),
                pa.concat_arrays([pa.array(cols[10], pa.bool_()), none(m, pa.bool_())]),
                pa.concat_arrays([pa.array(cols[11], pa.int32()), none(m, pa.int32())]),
                pa.concat_arrays([pa.array(cols[12], pa.int32()), none(m, pa.int32())]),
                pa.concat_arrays([pa.array(signed(cols[13])), none(m, pa.int64())]),
                pa.concat_arrays([none(n, pa.int32()), pa.array(kinds, pa.int32())]),
                pa.concat_arrays([none(n, pa.int64()), pa.array(list(seen.values()), pa.int64())]),
            ],
            [x.split()[0] for x in _ANALYSED.split(", ")],
        )


_ANALYSED = "column string, row_id bigint, source string, shape bigint, opening bigint, closing bigint, mark int, han boolean, stub boolean, tail_value string, comma boolean, n_chars int, n_bytes int, name bigint, stat int, n bigint"


def analysed(texts: DataFrame) -> DataFrame:
    """Staged analysis of ``texts`` (column, row_id, source, text); null and empty texts take no part."""
    rows = texts.select("column", "row_id", "source", "text").filter(F.col("row_id").isNotNull() & (F.length("text") > 0))
    return stage(rows.mapInArrow(_analysed, _ANALYSED), "endings")


def open_ended(staged: DataFrame) -> DataFrame:
    return staged.filter("stat IS NULL").drop("stat", "n").dropDuplicates(["column", "row_id"])


#: A limit has at least so many characters and texts, and so many times the texts of a mean length around it.
LEAST_LIMIT, LEAST_SPIKE, SPIKE_FACTOR = 16, 12, 8
#: Lengths within this ratio of a length are around it.
AROUND = 1.25
#: At most this share of the texts at a limit ends alike; texts of one pattern may have one length without any limit.
ALIKE = 0.5


def spikes(open_: DataFrame) -> DataFrame:
    """(column, source, unit, length, n, share): lengths at which a limit cuts.

    Counted are different texts that end without a stop, so that one text
    repeated often makes no spike.  A length is a spike if it has at least
    ``LEAST_SPIKE`` of them and ``SPIKE_FACTOR`` times as many as a mean length
    around it (within ``AROUND``), and they do not all end alike.  A limit in
    one unit is mirrored in the other; a text at a spike of both belongs to the
    larger one, and a spike that keeps too few texts of its own is dropped.
    ``n`` counts the texts that a spike keeps, ``share`` is their share of the
    source's texts without a stop.  A null source is a source.
    The histogram has at most one row per source, unit and length; a source's
    lengths are what one task sorts.
    """
    different = open_.select("column", "source", "name", "closing", "n_chars", "n_bytes").distinct()
    lengths = different.select("column", "source", "closing", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("x"))
    by_ending = lengths.groupBy("column", "source", "x.unit", "x.length", "closing").agg(F.count(F.lit(1)).alias("n"))
    histogram = by_ending.groupBy("column", "source", "unit", "length").agg(F.sum("n").alias("n"), F.max("n").alias("alike"))
    reach = round(math.log(AROUND) * 1e6)
    of_source = Window.partitionBy("column", "source", "unit")
    around = of_source.orderBy(F.round(F.ln("length") * 1e6).cast("bigint")).rangeBetween(-reach, reach)
    n_lengths = F.floor(F.col("length") * AROUND) - F.ceil(F.col("length") / AROUND)
    seen = histogram.filter("length > 0").select("*", F.sum("n").over(of_source).alias("total"), ((F.sum("n").over(around) - F.col("n")) / F.greatest(F.lit(1), n_lengths)).alias("mean"))
    found = (F.col("length") >= LEAST_LIMIT) & (F.col("n") >= LEAST_SPIKE) & (F.col("n") >= SPIKE_FACTOR * F.col("mean")) & (F.col("alike") <= ALIKE * F.col("n"))
    peaks = seen.filter(found)
    rows = different
    for unit in ("chars", "bytes"):
        peak = peaks.filter(F.col("unit") == unit).select(F.col("column").alias("c"), F.col("source").alias("s"), F.col("length").alias("l"), F.struct("n", "unit", "length", "mean", "total").alias(unit))
        rows = rows.join(peak, (F.col("column") == F.col("c")) & F.col("source").eqNullSafe(F.col("s")) & (F.col(f"n_{unit}") == F.col("l")), "left").drop("c", "s", "l")
    larger = F.when(F.col("bytes.n") > F.coalesce("chars.n", F.lit(0)), F.col("bytes")).otherwise(F.col("chars"))
    own = rows.select("column", "source", larger.alias("peak")).filter("peak IS NOT NULL").groupBy("column", "source", "peak").agg(F.count(F.lit(1)).alias("own"))
    kept = own.filter((F.col("own") >= LEAST_SPIKE) & (F.col("own") >= SPIKE_FACTOR * F.col("peak.mean")))
    return kept.select("column", "source", "peak.unit", "peak.length", F.col("own").alias("n"), (F.col("own") / F.col("peak.total")).alias("share"))


LEAST_WHOLE, LEAST_ENDING = 2, 3
#: Of a shape's opening: so many of its whole sentences must have the shape, and so many of its uses lack a stop for a label.
WHOLE_SHARE, LABEL_SHARE, LABEL_ENDING = 0.002, 0.5, 0.05


def judged(staged: DataFrame) -> DataFrame:
    """Every text that ends without a stop, with ``at_spike`` and ``complete`` (never at a spike).  One row per (column, row_id)."""
    open_ = open_ended(staged)
    stat = staged.filter("stat IS NOT NULL").groupBy("stat", F.col("shape").alias("key")).agg(F.sum("n").alias("n"))
    of = lambda kind, key, name: stat.filter(F.col("stat") == kind).select(F.col("key").alias(key), F.col("n").alias(name))
    bare = open_.groupBy("opening").agg(F.count(F.lit(1)).alias("n_bare"))
    bare_ending = open_.groupBy("opening", "closing").agg(F.count(F.lit(1)).alias("n_ending"))
    # statistics of the shapes in use only; shapes are few against texts
    used = (
        open_.select("shape", "opening", "closing").distinct()
        .join(of(WHOLE_SHAPE, "shape", "n_shape"), "shape", "left")
        .join(of(WHOLE_OPENING, "opening", "n_opening"), "opening", "left")
        .join(of(WHOLE_CLOSING, "closing", "n_closing"), "closing", "left")
        .join(bare, "opening")
        .join(bare_ending, ["opening", "closing"])
        .na.fill(0, ["n_shape", "n_opening", "n_closing"])
    )
    found = stage(spikes(open_).select("column", "source", "unit", "length"), "spikes")
    limit = lambda unit, size: found.filter(F.col("unit") == unit).select(F.col("column").alias("c"), F.col("source").alias("s"), F.col("length").alias("l"), F.lit(True).alias(f"at_{size}"))
    rows = open_
    for unit in ("chars", "bytes"):
        rows = rows.join(limit(unit, unit), (F.col("column") == F.col("c")) & F.col("source").eqNullSafe(F.col("s")) & (F.col(f"n_{unit}") == F.col("l")), "left").drop("c", "s", "l")
    rows = rows.join(used.drop("opening", "closing"), "shape")
    at_spike = F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))
    label = F.col("n_bare") >= LABEL_SHARE * (F.col("n_bare") + F.col("n_opening"))
    lacks_stop = (F.col("n_shape") >= LEAST_WHOLE) & (F.col("n_shape") >= WHOLE_SHARE * F.col("n_opening"))
    ends_like_label = (F.col("n_closing") >= LEAST_ENDING) | (F.col("n_ending") >= F.greatest(F.lit(LEAST_ENDING), LABEL_ENDING * F.col("n_bare")))
    telling = F.col("n_opening") + F.col("n_bare") >= 20
    marked = (F.col("mark") == MARKED) & ~(telling & ~F.col("han") & (F.col("n_bare") < 0.2 * (F.col("n_bare") + F.col("n_opening"))))
    complete = (F.col("mark") == LEAD_IN) | marked | lacks_stop | (label & ~F.col("stub") & (F.col("n_bare") >= 3) & ends_like_label)
    complete &= (F.col("mark") != UNCLOSED) & ~at_spike
    return rows.select("column", "row_id", "source", "n_chars", "n_bytes", "tail_value", "comma", at_spike.alias("at_spike"), complete.alias("complete"))


def values_of(text: Column) -> Column:
    """The codes and numbers of a text, as written."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"-\n", ""), F.lit(r"((?:[A-Z]{1,5}-)?\d+)"), 1))


def value_cut(tail: Column, values: Column) -> Column:
    """Whether a code or number at the very end is only the beginning of one in the source text."""
    return F.coalesce(tail.isNotNull() & ~F.array_contains(values, tail) & F.exists(values, lambda v: v.startswith(tail)), F.lit(False))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: (row_id, whether the row after it continues it), and the partition's first and last row."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first, held = None, None
    for b in batches:
        out: list[tuple] = []
        for row in zip(*(b[c].to_pylist() for c in ("version_id", "row_id", "asks", "continues")), strict=True):
            if held and row[1] == held[1]:
                continue  # delivered twice
            if first is None:
                first = row
            if held and held[2]:
                out.append((held[1], row[0] == held[0] and row[3], None, None, None))
            held = row
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FOLLOW_TYPES, strict=True)], _FOLLOW_NAMES)
    if held:
        out = [(held[1] if held[2] else None, None, part, held[0], None), (None, first[3], part, first[0], True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FOLLOW_TYPES, strict=True)], _FOLLOW_NAMES)


_FOLLOW_TYPES = (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.bool_())
_FOLLOW_NAMES = ("row_id", "continued", "part", "version_id", "head")


def continued(rows: DataFrame) -> DataFrame:
    """(row_id, continued) of the rows that ask: whether the next row of the version continues it.

    ``rows``: version_id, row_id, position, asks, continues.  Rows are sorted
    by ranges, so one version may spread over many tasks; where a range ends,
    the first row of the next range answers.  A last row is not continued.
    """
    spread = rows.repartitionByRange("version_id", "position", "row_id").sortWithinPartitions("version_id", "position", "row_id")
    seen = stage(spread.mapInArrow(_follow, "row_id bigint, continued boolean, part int, version_id bigint, head boolean"), "follow")
    inside = seen.filter("part IS NULL").select("row_id", "continued")
    # two rows per task from here on: each end meets the head of the next task that has rows
    rows = seen.filter("part IS NOT NULL")
    by_part = Window.orderBy("part")
    ends = rows.filter("head IS NULL").select("part", "row_id", "version_id")
    heads = rows.filter("head").select("part", F.lead(F.struct(F.col("version_id").alias("v"), F.col("continued").alias("c"))).over(by_part).alias("next"))
    after = ends.join(heads, "part")
    last = after.filter("row_id IS NOT NULL").select("row_id", F.coalesce((F.col("next.v") == F.col("version_id")) & F.col("next.c"), F.lit(False)).alias("continued"))
    return inside.unionAll(last).dropDuplicates(["row_id"])
