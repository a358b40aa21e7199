"""Visually identical text with different characters: skeletons, the consistent form, and groups of look-alikes.

A skeleton is made by decomposing canonically, replacing every character by
its prototype, and decomposing again.  Texts that look the same have equal
skeletons; letter case, digits against letters, the number of blanks and
missing accents still tell texts apart.  The consistent form of a text is its
skeleton, composed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions.text import normalize
from palimpsest.sources.tables import stage

# Letters of other scripts with the shape of a Latin letter, in pairs (letter, Latin letter).
LOOK_ALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "Ϲ": "C", "Ϳ": "J", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p",
    "υ": "u", "ϲ": "c", "ϳ": "j", "γ": "y", "σ": "o", "ϱ": "p",
    # Cyrillic
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K",
    "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Ү": "Y", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e",
    "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i",
    "ј": "j", "ѵ": "v", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ү": "y", "г": "r", "ь": "b", "ѡ": "w", "Ԍ": "G",
    # Armenian
    "Լ": "L", "Ս": "U", "Տ": "S", "Օ": "O", "զ": "q", "հ": "h", "ո": "n",
    "ս": "u", "ց": "g", "օ": "o", "յ": "j",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W",
    "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮩ": "V", "Ꮪ": "S",
    "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B", "Ꭵ": "i", "Ꭹ": "Y",
    "Ꮍ": "Y", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮷ": "d", "Ᏻ": "G", "Ꮒ": "h",
    "ꭵ": "i", "ꮁ": "r", "ꮃ": "w", "ꮓ": "z", "ꮩ": "v", "ꮪ": "s", "ꮯ": "c",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P",
    "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J",
    "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S",
    "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A",
    "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Canadian syllabics
    "ᐯ": "V", "ᑌ": "U", "ᑭ": "P", "ᑯ": "d", "ᑲ": "b", "ᒍ": "J", "ᒪ": "L",
    "ᕁ": "x", "ᕼ": "H", "ᖇ": "R", "ᗅ": "A", "ᗞ": "D", "ᗰ": "M", "ᗷ": "B",
    "᙭": "X",
    # Hebrew, Arabic, Georgian, Malayalam, Oriya, Myanmar, Ethiopic
    "ו": "l", "ן": "l", "ס": "o", "ا": "l", "ه": "o", "ყ": "y", "ჿ": "o",
    "ഠ": "o", "ଠ": "O", "ဝ": "o", "ሀ": "U", "ዐ": "O",
    # Runic, Tifinagh
    "ᚷ": "X", "ᛕ": "K", "ᛖ": "M", "ⴹ": "E", "ⵏ": "l", "ⵔ": "O", "ⵝ": "X",
    # Latin small capitals
    "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    # Latin letters of the phonetic alphabet
    "ɑ": "a", "ɡ": "g",
    # hyphens drawn like the hyphen-minus
    "‐": "-", "‑": "-",
}

#: Decompositions that only change width, line breaking or font.
_FORMS = ("<wide>", "<narrow>", "<noBreak>", "<font>")
_INVISIBLE_MARKS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}
_HIGHEST = 0x20000


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str | None]:
    """The prototype of every character that has another than itself; ``None`` drops a character.

    Built by rule from the character database: width, font and no-break forms
    and ligatures of letters go to what they stand for, format characters and
    variation selectors vanish, every blank becomes the one blank.
    """
    table: dict[int, str | None] = {}
    for cp in range(_HIGHEST):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if ch.isspace():
            table[cp] = " "
        elif kind == "Cf" or cp in _INVISIBLE_MARKS or 0xFE00 <= cp <= 0xFE0F:
            table[cp] = None
        elif parts := unicodedata.decomposition(ch):
            tag, _, rest = parts.partition(" ")
            if tag in _FORMS or (tag == "<compat>" and kind[0] in "LN" and all(chr(int(x, 16)).isalpha() for x in rest.split())):
                table[cp] = "".join(chr(int(x, 16)) for x in rest.split())
    for ch, latin in LOOK_ALIKES.items():
        table[ord(ch)] = latin
    for cp, to in list(table.items()):  # a form of a form, and a form of a look-alike
        if to:
            table[cp] = "".join(table.get(ord(c), c) or "" for c in unicodedata.normalize("NFD", to))
    for cp in range(0xE0100, 0xE01F0):  # the rest of the variation selectors
        table[cp] = None
    return table


_ASCII_BLANKS = str.maketrans("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", " " * 9)


def skeleton(text: str | None) -> str:
    """Decompose, replace every character by its prototype, decompose again.  ``None`` gives ``""``."""
    if not text:
        return ""
    if text.isascii():
        return text.translate(_ASCII_BLANKS)
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(prototypes()))


def consistent(text: str | None) -> str:
    """The one form of all texts that look like this one; equal forms if and only if equal skeletons."""
    if text and text.isascii():
        return text.translate(_ASCII_BLANKS)
    return unicodedata.normalize("NFC", skeleton(text))


@F.pandas_udf(StringType())
def consistent_col(s: pd.Series) -> pd.Series:
    return s.map(consistent, na_action="ignore")


def consistent_forms(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``<column>_form`` for each named column.  Null stays null, blank texts stay blank."""
    return df.withColumns({f"{c}_form": consistent_col(F.col(c)) for c in columns})


def _hashed(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, looks, texts = [], [], []
            for i, stored, raw in zip(b["id"].to_pylist(), b["normalized"].to_pylist(), b["canonical_text"].to_pylist(), strict=True):
                raw = raw or ""
                if (normalize(raw) if stored is None else stored).count(" ") >= least_words - 1:
                    ids.append(i)
                    looks.append(xxhash.xxh3_128_digest(skeleton(raw).encode("utf-8", "surrogatepass")))
                    texts.append(xxhash.xxh3_128_digest(raw.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(texts, pa.binary())], ["id", "look", "chars"])

    return run


def looks(rows: DataFrame, least_words: int = 1) -> DataFrame:
    """(id, look, chars): 128-bit hashes of each text's skeleton and of its characters, every id once, staged as it is read several times.

    ``rows``: id, normalized, canonical_text.  A null canonical text is the
    empty text; where ``normalized`` is null it is derived.
    """
    hashed = rows.select("id", "normalized", "canonical_text").mapInArrow(_hashed(least_words), "id bigint, look binary, chars binary")
    return stage(hashed.distinct(), "looks")


def look_groups(rows: DataFrame, least_words: int = 1) -> DataFrame:
    """One row per text: the group it looks like (its least id), the group's rows and its different spellings."""
    seen = looks(rows, least_words)
    spelled = seen.groupBy("look", "chars").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"))
    groups = spelled.groupBy("look").agg(F.min("lo").alias("group_id"), F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_spellings"))
    return seen.join(groups, "look").select("id", "group_id", "n_rows", "n_spellings")


def look_alike_pairs(rows: DataFrame, least_words: int = 1) -> DataFrame:
    """(id_a, id_b), id_a < id_b: texts of equal skeletons whose characters differ.

    Spellings are paired before rows, so a group of many equal copies adds
    pairs only with the copies of another spelling.
    """
    seen = looks(rows, least_words)
    spelled = seen.groupBy("look", "chars").agg(F.count(F.lit(1)).alias("n"))
    a, b = spelled.alias("a"), spelled.alias("b")
    differ = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.chars") < F.col("b.chars"))).select(
        F.col("a.chars").alias("chars_a"), F.col("b.chars").alias("chars_b")
    )
    return (
        differ.join(seen.select(F.col("chars").alias("chars_a"), F.col("id").alias("x")), "chars_a")
        .join(seen.select(F.col("chars").alias("chars_b"), F.col("id").alias("y")), "chars_b")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
