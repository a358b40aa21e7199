"""Boxes on pages: spatial joins, free rectangles, line breaking, fitting and placing of texts."""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scalars as X

# Limits of the page model, in points, and of fitting.
OCR_OVERLAP, OCR_TEXT, OCR_LABEL = 0.75, 25, 4
COVERED = 0.5
HOST_AREA, HOST_OVERLAP = 4.0, 0.8
FIRST_SHRINK, SHRINK, FLOOR, LEADING = 0.92, 0.94, 0.55, 1.24
HEADER_Y, FOOTER_Y = 66.0, 776.0
NOT_FIRST = "，。、；：！？）」』】》”’,.;:!?)]}%"
NOT_LAST = "（「『【《“‘([{"


def overlap_share(a: Column, b: Column) -> Column:
    """Shared area over the area of ``a``; 0 for an empty box."""
    area = X.box_area(a)
    return F.when(area > 0, X.box_overlap(a, b) / area).otherwise(F.lit(0.0))


def without_known_labels(labels: DataFrame, segments: DataFrame, key: str = "label_id") -> DataFrame:
    """OCR labels (key, version_id, page, text, box) that no segment of the page already says or covers.

    A label is known if a segment has the same letters and digits, or contains
    them (from four on), or a long segment lies over three quarters of it.
    """
    l = labels.withColumn("_key", X.upper_alnum(F.col("text")))
    s = segments.select("version_id", "page", X.upper_alnum(F.col("text")).alias("_said"), F.char_length("text").alias("_n"), F.col("bbox").alias("_over"))
    says = (F.col("_key") == F.col("_said")) | ((F.length("_key") >= OCR_LABEL) & F.contains("_said", "_key"))
    covers = (F.col("_n") >= OCR_TEXT) & (overlap_share(F.col("box"), F.col("_over")) > OCR_OVERLAP)
    known = l.join(s, ["version_id", "page"]).filter(says | covers).select(key).distinct()
    return l.join(known, key, "left_anti").drop("_key")


def uncovered(spans: DataFrame, rects: DataFrame, key: str = "span_id") -> DataFrame:
    """Spans (key, version_id, page, box) outside all rectangles of their page: centre outside, and at most half covered."""
    b, r = F.col("box"), F.col("rect")
    cx, cy = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    inside = cx.between(r["x0"], r["x1"]) & cy.between(r["y0"], r["y1"])
    hit = spans.join(rects.select("version_id", "page", "rect"), ["version_id", "page"]).filter(inside | (overlap_share(b, r) > COVERED)).select(key).distinct()
    return spans.join(hit, key, "left_anti")


def fragments_in_hosts(segments: DataFrame) -> DataFrame:
    """Ids of segments that lie within a much larger one of their page (four times the area, four fifths covered)."""
    s = segments.select("version_id", "page", "id", "bbox")
    h = s.select("version_id", "page", F.col("id").alias("host_id"), F.col("bbox").alias("host"))
    inner = (F.col("id") != F.col("host_id")) & (X.box_area(F.col("host")) > HOST_AREA * X.box_area(F.col("bbox"))) & (overlap_share(F.col("bbox"), F.col("host")) >= HOST_OVERLAP)
    return s.join(h, ["version_id", "page"]).filter(inner).select("id").distinct()


def next_below(segments: DataFrame) -> DataFrame:
    """(id, next_y): where the next box of the same column begins below a box; null if nothing does."""
    s = segments.select("version_id", "page", "id", "bbox")
    o = s.select("version_id", "page", F.col("id").alias("_o"), F.col("bbox").alias("_b"))
    below = (F.col("_b.y0") >= F.col("bbox.y1")) & (F.col("_b.x0") < F.col("bbox.x1")) & (F.col("_b.x1") > F.col("bbox.x0"))
    found = s.join(o, ["version_id", "page"]).filter(below).groupBy("id").agg(F.min("_b.y0").alias("next_y"))
    return s.select("id").join(found, "id", "left")


def page_geometry(segments: DataFrame) -> DataFrame:
    """Per page: the band of the body, its margins, the area taken, and the bands outside it."""
    body = F.col("role") == "body"
    return segments.groupBy("version_id", "page").agg(
        F.min(F.when(body, F.col("bbox.y0"))).alias("top"),
        F.max(F.when(body, F.col("bbox.y1"))).alias("bottom"),
        F.min(F.when(body, F.col("bbox.x0"))).alias("left"),
        F.max(F.when(body, F.col("bbox.x1"))).alias("right"),
        F.round(F.sum(F.when(body, X.box_area(F.col("bbox")))), 3).alias("taken"),
        F.count_if(~body).alias("n_outside"),
    )


def free_rectangles(boxes: list[tuple[float, float, float, float]], width: float, height: float, pad: float = 3.0) -> list[tuple[float, float, float, float]]:
    """Rectangles free of all boxes, largest first: bands between box edges, and the gaps within each band."""
    cuts = sorted({HEADER_Y, FOOTER_Y, *(min(max(y, 0.0), height) for b in boxes for y in (b[1], b[3]))})
    found = []
    for top, bottom in zip(cuts, cuts[1:], strict=False):
        if bottom - top < 8:
            continue
        edge = 0.0
        for x0, _, x1, _ in [*sorted(b for b in boxes if b[3] > top + 0.5 and b[1] < bottom - 0.5), (width, 0, width, 0)]:
            if x0 - edge > 40:
                found.append((edge + pad, top + pad, x0 - pad, bottom - pad))
            edge = max(edge, x1)
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return sorted((r for r in found if r[2] - r[0] > 50 and r[3] - r[1] > 20), key=size, reverse=True)


# --- line breaking ------------------------------------------------------------------------------------------------
_UNIT = re.compile(r"[⺀-鿿＀-￯]|[^\s⺀-鿿＀-￯]+|\s+")


def char_width(c: str) -> float:
    w = X.WIDTHS
    if "⺀" <= c <= "鿿" or "＀" <= c <= "￯":
        return w["han"]
    return w["upper"] if "A" <= c <= "Z" else w["digit"] if c.isdigit() else w["blank"] if c == " " else w["lower"]


def text_width(text: str, size: float) -> float:
    return sum(map(char_width, text)) * size


def wrap(text: str | None, size: float, width: float) -> list[str]:
    """Greedy lines of at most ``width``: breaks between Han characters and words, no closing mark first, no opening mark last.

    A word wider than a line is broken. Null and blank texts give no line.
    """
    lines, line = [], ""
    for unit in _UNIT.findall((text or "").strip()):
        if unit.isspace():
            unit = " "
        if text_width(line + unit, size) <= width or (unit in NOT_FIRST and line):
            line += unit
            continue
        carry = ""
        while line and line[-1] in NOT_LAST:
            line, carry = line[:-1], line[-1] + carry
        if line.strip():
            lines.append(line.rstrip())
        line = carry + unit.lstrip()
        while text_width(line, size) > width and len(line) > 1:
            k = max(1, next((i for i in range(1, len(line) + 1) if text_width(line[:i], size) > width), len(line)) - 1)
            lines.append(line[:k])
            line = line[k:]
    return [*lines, line.rstrip()] if line.strip() else lines


def fit(text: str | None, size: float, width: float, height: float) -> tuple[float, list[str], bool]:
    """(size, lines, cut off): the text set as large as the box allows, shrunk to a floor, then cut with an ellipsis."""
    now, floor = size, size * FLOOR
    first = True
    while True:
        lines = wrap(text, now, width)
        if len(lines) * now * LEADING <= height or now <= floor:
            break
        now, first = max(floor, now * (FIRST_SHRINK if first else SHRINK)), False
    room = max(1, int(height // (now * LEADING)))
    if len(lines) <= room:
        return round(now, 2), lines, False
    last = lines[room - 1]
    while last and text_width(last + "…", now) > width:
        last = last[:-1]
    return round(now, 2), [*lines[: room - 1], last + "…"], True


LAYOUT = "segment_id bigint, size double, lines array<string>, n_lines int, overflow boolean"


def layout(boxes: DataFrame) -> DataFrame:
    """(segment_id, size, lines, n_lines, overflow) of translated texts set into their boxes.

    ``boxes``: segment_id, text, size, width, height.  Widths come from
    character classes, as no font files are at hand; a map over batches.
    """

    def run(parts):
        for pdf in parts:
            done = [fit(t, s or 10.0, w or 1.0, h or 1.0) for t, s, w, h in zip(pdf["text"], pdf["size"], pdf["width"], pdf["height"], strict=True)]
            yield pd.DataFrame({"segment_id": pdf["segment_id"], "size": [d[0] for d in done], "lines": [d[1] for d in done], "n_lines": [len(d[1]) for d in done], "overflow": [d[2] for d in done]})

    return boxes.select("segment_id", "text", "size", "width", "height").mapInPandas(run, LAYOUT)


def place_labels(labels: list[tuple[str, tuple[float, float, float, float], float]], width: float, height: float, gap: float = 3.0) -> list[tuple[str, tuple[float, float, float, float]] | None]:
    """A box for each (text, its own box, score), best score first: right, below or above it, else on rings around it; None if there is no room.

    Boxes stay on the page and off each other and off all labels.
    """
    own = [box for _, box, _ in labels]
    taken: list[tuple[float, float, float, float]] = []
    out: list[tuple[str, tuple[float, float, float, float]] | None] = [None] * len(labels)
    clash = lambda a, b: a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]
    for k in sorted(range(len(labels)), key=lambda k: -labels[k][2]):
        text, (x0, y0, x1, y1), _ = labels[k]
        size = max(4.0, (y1 - y0) * 0.78)
        w, h = text_width(text, size) + 4, size * 1.3 + 2
        spots = [(x1 + gap, y0), (x0, y1 + gap * 0.6), (x0, y0 - h - gap)]
        for ring in (1, 2, 3, 4, 6, 8):
            dx, dy = (x1 - x0 + w) / 2 + gap * ring, (y1 - y0 + h) / 2 + gap * 1.5 * ring
            spots += [(x0 + a * dx, y0 + b * dy) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1))]
        for x, y in spots:
            box = (x, y, x + w, y + h)
            if x >= 0 and y >= 0 and box[2] <= width and box[3] <= height and not any(clash(box, b) for b in taken) and not any(clash(box, b) for b in own):
                insort(taken, box)
                out[k] = (text, tuple(round(v, 2) for v in box))
                break
    return out


# --- labels read off images -----------------------------------------------------------------------------------
LEAST_GLUED = 5
_GLUED_DIGIT, _GLUED_CASE = re.compile(r"(?<=[A-Za-z])(?=\d)"), re.compile(r"(?<=[a-z])(?=[A-Z])")


def split_capitals(word: str, vocabulary: Iterable[str]) -> list[str]:
    """A run of capitals divided at the longest words of a vocabulary; what no word begins goes to the part before it."""
    known = {v for v in vocabulary if v}
    longest = max(map(len, known), default=0)
    if len(word) < LEAST_GLUED or not word.isupper():
        return [word]
    parts: list[str] = []
    at = 0
    while at < len(word):
        found = next((word[at : at + n] for n in range(min(longest, len(word) - at), 0, -1) if word[at : at + n] in known), None)
        if found:
            parts.append(found)
        elif parts:
            parts[-1] += word[at]
        else:
            parts.append(word[at])
        at += len(found or " ")
    return parts


def label_form(text: str | None, vocabulary: Iterable[str] = ()) -> str:
    """A label with blanks where reading glued words, numbers or cases together; null gives the empty text."""
    spaced = _GLUED_CASE.sub(" ", _GLUED_DIGIT.sub(" ", " ".join((text or "").split())))
    return " ".join(split_capitals(spaced, vocabulary)) if spaced and " " not in spaced else spaced
