"""Text primitives: normal form, fingerprints, and their column forms.

The scalar functions accept ``None`` and return the value defined for the
empty text.  Column forms are Arrow-batched; ASCII texts take a path without
Unicode tables.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The mark classes of the normal form (quotes, dashes, ellipsis) and the characters it drops.
SINGLE_QUOTES = '\u2018\u2019\u201a\u201b\u2032\u2039\u203a`\xb4\u02bc\u02b9'
DOUBLE_QUOTES = '\u201c\u201d\u201e\u201f\u2033\xab\xbb'
DASHES = '\u2010\u2011\u2012\u2013\u2014\u2015\u2212'
ELLIPSIS = '\u2026'
ZERO_WIDTH = '\u200b\u200c\u200d\u2060\ufeff'

_MARKS = str.maketrans(
    {c: "'" for c in SINGLE_QUOTES}
    | {c: '"' for c in DOUBLE_QUOTES}
    | {c: "-" for c in DASHES}
    | {c: None for c in ZERO_WIDTH}
    | {ELLIPSIS: "..."}
)
_MARK = re.compile("[" + "".join(map(chr, _MARKS)) + "]")
_BACKTICK = str.maketrans({"`": "'"})


def normalize(text: str | None) -> str:
    """Compatibility composition, one form of quotes, dashes and ellipsis, single blanks, no zero-width marks.

    Case stays.  ``None`` and blank texts give ``""``.  Idempotent.
    """
    if not text:
        return ""
    if text.isascii():
        text = text.translate(_BACKTICK) if "`" in text else text
    else:
        text = _MARK.sub(lambda m: _MARKS[ord(m[0])] or "", unicodedata.normalize("NFKC", text))
    return " ".join(text.split())


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def fingerprint(text: str | None) -> str:
    """Content identity: 128 bits over the case-folded normal form, 32 hex digits."""
    return digest(normalize(text).casefold())


def content_hash(text: str | None) -> str:
    """Exact identity: 128 bits over the normal form with case."""
    return digest(normalize(text))


@F.pandas_udf(StringType())
def normalize_col(s: pd.Series) -> pd.Series:
    return s.map(normalize, na_action="ignore").fillna("")


@F.pandas_udf(StringType())
def fingerprint_col(s: pd.Series) -> pd.Series:
    return s.map(fingerprint, na_action="ignore").fillna(fingerprint(""))


@F.pandas_udf(StringType())
def content_hash_col(s: pd.Series) -> pd.Series:
    return s.map(content_hash, na_action="ignore").fillna(content_hash(""))


@F.pandas_udf(StringType())
def _derive_fingerprint(s: pd.Series) -> pd.Series:
    return s.map(fingerprint, na_action="ignore")


@F.pandas_udf(StringType())
def _derive_normalized(s: pd.Series) -> pd.Series:
    return s.map(normalize, na_action="ignore")


def stored_or_fingerprint(stored: str = "fingerprint", text: str = "canonical_text") -> Column:
    """The stored fingerprint, else the one derived from the text.

    The UDF only gets texts of rows without a stored value (nulls for the rest),
    as Spark would run it on every row of a CASE.
    """
    gap = F.when(F.col(stored).isNull(), F.coalesce(F.col(text), F.lit("")))
    return F.coalesce(F.col(stored), _derive_fingerprint(gap))


def stored_or_normalized(stored: str = "normalized", text: str = "canonical_text") -> Column:
    gap = F.when(F.col(stored).isNull(), F.coalesce(F.col(text), F.lit("")))
    return F.coalesce(F.col(stored), _derive_normalized(gap))


# --- native approximations: same contract on texts whose NFKC form is themselves -------------------------


def normalize_native(c: Column) -> Column:
    """The normal form without NFKC, inside whole-stage codegen (equal on ASCII and Latin-1 letters)."""
    mapped = F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + ZERO_WIDTH, "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES))
    return F.trim(F.regexp_replace(F.replace(mapped, F.lit(ELLIPSIS), F.lit("...")), r"[\s\u000B\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+", " "))


def md5_fingerprint(c: Column) -> Column:
    """128-bit, 32 hex digit content identity inside codegen, where the digest need not be the stored one."""
    return F.md5(F.lower(normalize_native(c)))


@lru_cache(maxsize=None)
def compiled(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, flags)
