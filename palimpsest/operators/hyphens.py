"""Words divided at line ends, decided by the whole corpus' vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.textdiff import hyphen_join, hyphen_words

WORD = "[0-9A-Za-z][0-9A-Za-z'-]*"


def vocabulary(texts: DataFrame, text: str, least: int = 1) -> DataFrame:
    """(word, n) of all case-folded words within lines; words divided at a line's end are left out."""
    whole = F.regexp_replace(F.col(text), "[0-9A-Za-z'-]+-\\n\\s*[0-9A-Za-z'-]+", " ")
    words = texts.select(F.explode(F.regexp_extract_all(whole, F.lit(WORD), 0)).alias("w"))
    return words.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        out = []
        for i, t in zip(pdf["id"], pdf["text"], strict=True):
            lines = t.split("\n")
            out += [(i, at, a, b, *hyphen_words(a, b)) for at, (a, b) in enumerate(zip(lines, lines[1:], strict=False)) if a.rstrip().endswith("-")]
        yield pd.DataFrame(out, columns=["id", "at", "line", "following", "soft", "hard"])


def _decided(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = [(i, at, *hyphen_join(a, b, {s: int(n), h: int(m)})) for i, at, a, b, s, h, n, m in pdf[["id", "at", "line", "following", "soft", "hard", "n_soft", "n_hard"]].itertuples(index=False)]
        yield pd.DataFrame(rows, columns=["id", "at", "how", "why"])


def decisions(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, at, how, why) for every line of ``texts`` (id, text) that ends in a hyphen.

    The vocabulary is joined by the two words each division could make, so it
    is never shipped whole. Texts without such a line, and null, give no row.
    """
    found = texts.filter(F.col("text").rlike("-\\s*\n")).select("id", "text").mapInPandas(_pairs, "id bigint, at int, line string, following string, soft string, hard string")
    count = lambda kind: words.select(F.col("word").alias(kind), F.col("n").alias(f"n_{kind}"))
    both = found.join(count("soft"), "soft", "left").join(count("hard"), "hard", "left").na.fill(0, ["n_soft", "n_hard"])
    return both.mapInPandas(_decided, "id bigint, at int, how string, why string")
