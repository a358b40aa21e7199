"""Scalar text functions as column expressions inside whole-stage codegen.

All take and return columns; null in gives the value stated, null otherwise.
Regular expressions keep to what both Java and RE2 read alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, limits and prices that results depend on.
HAN = "[\\u4e00-\\u9fa5]"
_WHITE = "\\s\\u000b\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NOT_WHITE = f"[^{_WHITE}]"
HAN_WIDE = "[\\u3400-\\u9fff]"
LETTER_OR_HAN = "[A-Za-z\\u3400-\\u9fff]"
BROKEN_IDENTIFIER = "[\\u4e00-\\u9fff]_[A-Za-z0-9]|[A-Za-z0-9]_[\\u4e00-\\u9fff]"
HAN_BASIC = "[\\u4e00-\\u9fff]"
DESIGNATION = "^[A-Z0-9][A-Z0-9 ._/()%,\\u00b0+#'\":\\u2013\\u2014-]*\\z"
PUNCTUATION_ONLY = "^[\\s\\u3002\\uff0c\\u3001\\uff1b\\uff1a\\uff01\\uff1f,.!?;:\\u2026\\u2014\\u2013\"'\\u201c\\u201d\\u2018\\u2019()\\uff08\\uff09\\u3010\\u3011\\[\\]-]*\\z"
STOP_WORDS = (
    "the and for that with from this these those are was were has have had not but you your its into out over"
    " under then than when while will shall can may must should could would about after before being been done"
    " only such same each other more most some any all any who whom which what there their they them his her"
).split()
TOKENS_PER_OTHER = 3.6
WIDTHS = {"han": 1.0, "upper": 0.667, "lower": 0.5, "digit": 0.556, "blank": 0.278}


def is_trivial(c: Column) -> Column:
    """Too short or without a letter or Han character; null counts as trivial."""
    t = F.coalesce(F.trim(c), F.lit(""))
    return (F.length(t) < 2) | ~t.rlike(LETTER_OR_HAN)


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends; null gives the empty string."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^[{_WHITE}]+|[{_WHITE}]+\\z", "")


def is_blank(c: Column) -> Column:
    """Null, or nothing but Unicode white space."""
    return c.isNull() | ~c.rlike(NOT_WHITE)


def has_han(c: Column) -> Column:
    return F.coalesce(c.rlike(HAN), F.lit(False))


def is_ordinal_fragment(c: Column) -> Column:
    return F.trim(F.lower(c)).isin("th", "st", "nd", "rd")


def char_kind(c: Column) -> Column:
    """The class of a one-character string: cjk, latin, digit, space or punct; the empty string is punct."""
    return (
        F.when(c.rlike("^[\\s\\u00a0\\u2000-\\u200a\\u202f\\u3000]$"), "space")
        .when(c.rlike("^[0-9\\uff10-\\uff19]$"), "digit")
        .when(c.rlike("^[A-Za-z\\uff21-\\uff3a\\uff41-\\uff5a]$"), "latin")
        .when(c.rlike("^[\\u2e80-\\u2eff\\u3001-\\u30ff\\u3100-\\u312f\\u31c0-\\u31ef\\u3200-\\u4dbf\\u4e00-\\u9fff\\ua960-\\ua97f\\uac00-\\ud7af\\uf900-\\ufaff\\ufe10-\\ufe1f\\ufe30-\\ufe4f\\uff00-\\uffef]$"), "cjk")
        .when(c.rlike("^\\p{L}$"), "latin")
        .when(c.rlike("^\\p{N}$"), "digit")
        .otherwise("punct")
    )


def slugify(c: Column, default: str = "doc") -> Column:
    """Lower case; everything but letters, digits and Han becomes one hyphen; no hyphens at the ends."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z\\u4e00-\\u9fff]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def release_label(*sources: Column) -> Column:
    """The first dotted number of the first source that has one, else the empty string."""
    found = [F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), "[0-9]+\\.[0-9]+(\\.[0-9]+)*", 0), F.lit("")) for c in sources]
    return F.coalesce(*found, F.lit(""))


def doc_date(meta: Column, stem: Column) -> Column:
    """yyyy-mm-dd from a ``D:yyyymmdd`` mark, else from a date in the name, else the empty string."""
    meta, stem = F.coalesce(meta, F.lit("")), F.coalesce(stem, F.lit(""))
    mark = F.regexp_extract(meta, "D:([0-9]{4})([0-9]{2})([0-9]{2})", 0)
    iso = F.concat_ws("-", F.substring(mark, 3, 4), F.substring(mark, 7, 2), F.substring(mark, 9, 2))
    return F.when(mark != "", iso).otherwise(F.regexp_extract(stem, "20[0-9]{2}-[0-9]{2}-[0-9]{2}", 0))


def strip_toc_leader(c: Column) -> Column:
    """Without three or more blanks and dots at the end."""
    return F.regexp_replace(c, "[ .\\u00b7]{3,}$", "")


def dot_leader(c: Column) -> Column:
    """(title, dots, page) of a contents row; nulls if the text is none."""
    pattern = "^(.*?)[ ]*([.\\u00b7]{3,})[ ]*([0-9A-Za-z-]*)$"
    hit = c.rlike(pattern)
    part = lambda i: F.when(hit, F.regexp_extract(c, pattern, i))
    return F.struct(part(1).alias("title"), F.length(part(2)).alias("dots"), part(3).alias("page"))


def len_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer length in [0, 1]; two empty texts give 1.  Null counts as empty."""
    la, lb = F.length(F.coalesce(a, F.lit(""))), F.length(F.coalesce(b, F.lit("")))
    return F.when(F.greatest(la, lb) == 0, F.lit(1.0)).otherwise(F.least(la, lb) / F.greatest(la, lb))


def content_tokens(c: Column) -> Column:
    """Distinct lower-case words of three letters or digits and more, without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{3,}"), 0))
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def token_containment(a: Column, b: Column) -> Column:
    """Overlap coefficient of content tokens; 0 where a side has fewer than three."""
    ta, tb = content_tokens(a), content_tokens(b)
    small = F.least(F.size(ta), F.size(tb))
    return F.when(small < 3, F.lit(0.0)).otherwise(F.size(F.array_intersect(ta, tb)) / small)


def estimate_tokens(c: Column) -> Column:
    """One token per Han character, one per 3.6 others, rounded half up."""
    t = F.coalesce(c, F.lit(""))
    han = F.regexp_count(t, F.lit("[\\u3400-\\u9fff\\u3000-\\u30ff]"))
    return F.floor(han + (F.length(t) - han) / TOKENS_PER_OTHER + F.lit(0.5)).cast("bigint")


def looks_broken_identifier(c: Column) -> Column:
    """An underscore between a Han character and a letter or digit."""
    return F.coalesce(c.rlike(BROKEN_IDENTIFIER), F.lit(False))


def substantive_length(c: Column) -> Column:
    """Length of a trimmed text, 0 if it holds nothing but punctuation and blanks."""
    t = strip(c)
    return F.when(t.rlike(PUNCTUATION_ONLY), F.lit(0)).otherwise(F.length(t))


def suspect(en: Column, zh: Column) -> Column:
    """Why a translation looks wrong: punctuation_only, too_short or ends_with_comma, the first that holds, else null.

    A pair with a blank or null side is not judged.
    """
    e, z = strip(en), strip(zh)
    judged = (e != "") & (z != "")
    return (
        F.when(judged & (F.length(e) >= 30) & (substantive_length(z) <= 2), "punctuation_only")
        .when(judged & (F.length(e) >= 60) & (F.length(z) / F.length(e) < 0.06), "too_short")
        .when(judged & (F.length(e) >= 50) & z.rlike("[,;\\uff0c\\u3001]\\z"), "ends_with_comma")
    )


def shape_ok(en: Column, zh: Column, ratio: int = 3, floor: int = 40) -> Column:
    """A non-blank answer of at most max(ratio * source, floor) characters; of very short sources at most 12."""
    e, z = strip(en), strip(zh)
    short = (F.length(e) <= 2) & (F.length(z) > 12)
    return (F.length(z) > 0) & ~short & (F.length(z) <= F.greatest(F.length(e) * ratio, F.lit(floor)))


def classify_translation(text: Column, source: Column, status: Column) -> Column:
    """mock, empty, meaningless or ok: a failed blank is empty, a machine text with placeholder brackets mock,
    a machine text without Han that keeps neither its source nor the form of a designation meaningless."""
    t, s, st = strip(text), strip(source), F.coalesce(status, F.lit(""))
    return (
        F.when((st == "failed") & (t == ""), "empty")
        .when((st == "machine") & t.contains("\u3014"), "mock")
        .when(t.rlike(HAN_BASIC), "ok")
        .when(t == "", "meaningless")
        .when(((s != "") & (t == s)) | t.rlike(DESIGNATION) | ((st != "") & (st != "machine")), "ok")
        .otherwise("meaningless")
    )


def is_code_like(c: Column) -> Column:
    """Has a digit, or letters that are all upper case."""
    letters = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z]", "")
    return F.coalesce(c.rlike("[0-9]"), F.lit(False)) | ((letters != "") & (letters == F.upper(letters)))


def upper_alnum(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def estimated_width(c: Column, size: Column) -> Column:
    """Width of a line set in ``size`` points, from character classes."""
    t = F.coalesce(c, F.lit(""))
    count = lambda cls: F.regexp_count(t, F.lit(cls))
    han, up, digit, blank = count("[\\u2e80-\\u9fff\\uff00-\\uffef]"), count("[A-Z]"), count("[0-9]"), count(" ")
    rest = F.length(t) - han - up - digit - blank
    return (han * WIDTHS["han"] + up * WIDTHS["upper"] + digit * WIDTHS["digit"] + blank * WIDTHS["blank"] + rest * WIDTHS["lower"]) * size


# The forms of lines.
_W, _NW = f"[{_WHITE}]", NOT_WHITE
LINE_MARKS = {
    "list_item": f"^(?:[\u2022\u25aa\u25e6\u2023\u00b7\u2219\u25cf\u25cb\u2013\u2014*\\-]|\\(?\\p{{Nd}}{{1,3}}[.)]|\\(?[a-zA-Z][.)]|\\(?[ivxIVX]{{1,4}}[.)]){_W}+{_NW}",
    "numbered": f"^\\(?\\p{{Nd}}+(?:\\.\\p{{Nd}}+)*[.)]?{_W}+{_NW}",
    "roman": f"^\\(?[IVXLC]{{1,5}}[.)]{_W}+[A-Z]",
    "caption": f"^(?i:figure|fig\\.?|table|chart|picture|image){_W}*[\\p{{Nd}}A-Za-z]",
    "toc_line": f"\\.{{3,}}{_W}*\\p{{Nd}}+{_W}*\\z",
    "toc_tail": f"\\.{{3,}}{_W}*\\p{{Nd}}*{_W}*\\z",
    "quantity": f"\\p{{Nd}}[\\p{{Nd}},]*(?:\\.\\p{{Nd}}+)?{_W}*(?i:knots?|kts?|feet|foot|ft|psi|percent|%|seconds?|sec|minutes?|min|degrees?|deg|miles?|nm|nautical miles?|gallons?|lbs?|pounds?|inches|inch|in\\b)",
}


def line_marks(c: Column) -> Column:
    """A struct of booleans, one for each form a text may have; forms do not exclude each other.  Null has none."""
    t = F.coalesce(c, F.lit(""))
    return F.struct(*(t.rlike(pattern).alias(name) for name, pattern in LINE_MARKS.items()))


def rewrite_number(c: Column) -> Column:
    """A changed number for synthetic edits: a fifth more from 100 on, five more below."""
    n = F.regexp_extract(c, "([0-9]+)", 1).cast("bigint")
    return F.when(n >= 100, F.floor(n * 6 / 5)).otherwise(n + 5)


def font_flags(flags: Column) -> Column:
    """(bold, italic) from the flag bits 16 and 2."""
    return F.struct((flags.bitwiseAND(F.lit(16)) != 0).alias("bold"), (flags.bitwiseAND(F.lit(2)) != 0).alias("italic"))


def int_to_rgb(color: Column) -> Column:
    part = lambda shift: F.shiftright(color, shift).bitwiseAND(F.lit(255))
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def luminance(color: Column) -> Column:
    rgb = int_to_rgb(color)
    return (rgb["r"] * 0.299 + rgb["g"] * 0.587 + rgb["b"] * 0.114) / 255.0


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def box_overlap(a: Column, b: Column) -> Column:
    """Shared area of two boxes."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def box_union(a: Column, b: Column) -> Column:
    return F.struct(
        F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1")
    )


def label_bucket(c: Column) -> Column:
    """code for short marks, sentence for what reads like one, else other."""
    t = F.trim(F.coalesce(c, F.lit("")))
    words = F.size(F.split(t, " +"))
    return F.when((F.length(t) <= 8) & t.rlike("^[A-Z0-9-]+$"), "code").when((words >= 5) & t.rlike("[.!?]$"), "sentence").otherwise("other")


def page_list(spec: str | tuple[int, int] | list[int] | int | None, n_pages: int) -> list[int]:
    """Pages of a selector: one page, (from, to), a list, or text of parts like ``3``, ``2-5``, ``7-`` and ``-4``; null is all."""
    last = range(1, n_pages + 1)
    if spec is None or spec == "":
        return list(last)
    if isinstance(spec, int):
        return [spec] if spec in last else []
    if isinstance(spec, tuple):
        lo, hi = sorted(spec)
        return [p for p in last if lo <= p <= hi]
    if isinstance(spec, list):
        return sorted({p for p in spec if p in last})
    pages: set[int] = set()
    for part in spec.replace("~", "-").split(","):
        lo, dash, hi = part.strip().partition("-")
        if not dash:
            pages.add(int(lo))
        else:
            a, b = int(lo or 1), int(hi or n_pages)
            pages.update(range(min(a, b), max(a, b) + 1))
    return [p for p in last if p in pages]


# A leader of dots with its page, before the number of the next entry.
_ENTRY_END = f"(\\.{{4,}}{_W}\\p{{Nd}}{{1,4}}[A-Za-z]?\\.?){_W}+(?=\\p{{Nd}}+[A-Z]?(?:\\.\\p{{Nd}}+)*{_W})"


def contents_entries(c: Column) -> Column:
    """The entries of a contents row that holds several, each with its leader and page; none for any other text."""
    t = F.coalesce(c, F.lit(""))
    parts = F.filter(F.transform(F.split(F.regexp_replace(t, _ENTRY_END, "$1\u0001"), "\u0001"), strip), lambda p: p != "")
    several = (F.regexp_count(t, F.lit("\\.{4,}")) > 1) & (F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike("\\.{4,}"))
    return F.when(several, parts).otherwise(F.array().cast("array<string>"))


def _replaced_once(c: Column, old: Column, new: Column) -> Column:
    at = F.instr(c, old)
    return F.concat(F.substring(c, F.lit(1), at - 1), new, F.substring(c, at + F.length(old), F.length(c)))


def rewrite_quantity(c: Column) -> Column:
    """A text with its first number with a unit changed: a fifth more from 100 on, five more below; thousands with a comma.  Null where there is none."""
    pattern = LINE_MARKS["quantity"]
    old = F.regexp_substr(c, F.lit(pattern))
    number = F.regexp_extract(old, "^[\\p{Nd},]+(?:\\.\\p{Nd}+)?", 0)
    unit = strip(F.substring(old, F.length(number) + 1, F.length(old)))
    value = F.regexp_replace(number, ",", "").try_cast("double")
    changed = F.when(value >= 100, value * 1.2).otherwise(value + 5)
    whole = changed == F.floor(changed)
    shown = F.when(whole & (value >= 1000), F.format_number(changed, 0)).when(whole, changed.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", changed))
    return F.when(F.coalesce(value.isNotNull() & (old != ""), F.lit(False)), _replaced_once(c, old, F.concat(shown, F.lit(" "), unit)))


# Words that synthetic edits change, and the sentence they put in.
EDITED_WORDS = {" warning ": " caution ", " aircraft ": " airframe ", " engine ": " motor ", " landing ": " approach ", " immediately ": " promptly "}
LEAST_SENTENCE = 30


def rewrite_words(c: Column) -> Column:
    """A text with the first place of the first of ``EDITED_WORDS`` that it holds changed; null where it holds none."""
    return F.coalesce(*(F.when(F.contains(c, F.lit(a)), _replaced_once(c, F.lit(a), F.lit(b))) for a, b in EDITED_WORDS.items()))


def rewrite_sentence(c: Column, sentence: Column) -> Column:
    """A text with its last sentence replaced; null if fewer than three sentences stand there or the last is short."""
    last = F.regexp_substr(c, F.lit(f"(?s)(?<=[.!?]{_W}{{1,9}})(?!{_W})(?:(?![.!?]{_W}).)*\\z"))
    stops = F.regexp_count(c, F.lit(f"[.!?]{_W}+"))
    fits = (stops >= 2) & (F.length(strip(last)) >= LEAST_SENTENCE)
    return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(last)), sentence))
