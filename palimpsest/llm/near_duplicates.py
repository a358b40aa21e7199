"""Near-duplicate passages with small edits, insertions or another order of sentences.

1. Equal texts form a class; only one row per class goes on.
2. Each class gets the set of its word runs and a DartMinHash signature of it.
   Every run weighs the same, as the likeness asked for is that of plain sets;
   ``signatures`` also takes unequal weights.
3. The signature is cut into ``BANDS`` bands of ``ROWS`` darts; classes with an
   equal band are candidates.  A pair of likeness s becomes one with
   probability 1 - (1 - s^ROWS)^BANDS: 0.984 at 0.5, 0.9998 at 0.6.
4. Candidates are held against a 64-byte sketch (four bits of 128 darts) that
   drops those far below the threshold, then against the whole sets, exactly.

Only band keys, 16-byte pairs and sketches are shuffled for candidates; whole
sets only for pairs that look alike.  Nothing is capped: a bucket that many
classes share is split by adaptive skew handling of the join, and copies never
enter a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.shingles import U, likeness, shingle_sets
from palimpsest.functions.text import normalize
from palimpsest.llm.dart_minhash import band_keys, signatures
from palimpsest.sources.tables import stage

ROWS, BANDS = 4, 64
SKETCH_DARTS = 128
#: A candidate whose sketch agrees in fewer than threshold - SLACK of its darts is dropped (about five deviations).
SLACK = 0.22


class NearDuplicates(NamedTuple):
    members: DataFrame  # id, cls: every row once
    links: DataFrame  # cls_a, cls_b, likeness: classes of different texts, cls_a < cls_b


def _classes(least_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for i, stored, raw in zip(b["id"].to_pylist(), b["normalized"].to_pylist(), b["canonical_text"].to_pylist(), strict=True):
                t = (normalize(raw) if stored is None else stored).lower()
                if t.count(" ") >= least_words - 1:
                    ids.append(i)
                    texts.append(t)
            cls = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts), U, len(texts)).view(np.int64)
            _, first = np.unique(cls, return_index=True)
            new = np.zeros(len(texts), bool)
            new[first] = True
            h, at = shingle_sets([t for t, n in zip(texts, new, strict=True) if n], k) if len(first) else (np.empty(0, U), np.zeros(1, np.int64))
            sizes = np.zeros(len(texts), np.int64)
            sizes[new] = np.diff(at)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cls), sets], ["id", "cls", "runs"])

    return run


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = b["runs"]
            h = sets.flatten().to_numpy(zero_copy_only=False).view(U)
            at = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(sets)))))
            sig = signatures(h, at, np.ones(len(h)), bands * rows)
            keys = band_keys(sig, bands, rows).view(np.int64)
            nibble = (sig[:, :SKETCH_DARTS] & U(15)).astype(np.uint8)
            packed = (nibble[:, 0::2] << 4 | nibble[:, 1::2]).astype(np.uint8)
            words = np.ascontiguousarray(packed).view(np.int64)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    b["cls"],
                    sets,
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1))),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words.shape[1]), pa.array(words.reshape(-1))),
                ],
                ["cls", "runs", "keys", "sketch"],
            )

    return run


def _agreeing(a: str, b: str):
    """Equal nibbles of two sketches, in whole-stage code: fold the bits of each nibble of the XOR, count the rest."""
    words = SKETCH_DARTS // 16
    total = F.lit(SKETCH_DARTS)
    for i in range(words):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total - F.bit_count(x)
    return total


def near_duplicates(rows: DataFrame, threshold: float, k: int = 3, least_words: int = 1, bands: int = BANDS, darts: int = ROWS) -> NearDuplicates:
    """Classes of equal texts and the links between different ones of likeness ``threshold`` or more.

    ``rows``: id, normalized, canonical_text; other columns are ignored.  Where
    ``normalized`` is null the normal form of ``canonical_text`` stands (null:
    the empty text).  Ids may repeat and count once.  Texts under
    ``least_words`` words take no part; a text under ``k`` words is its only
    run.  An empty table gives empty results.
    """
    made = stage(
        rows.select("id", "normalized", "canonical_text").mapInArrow(_classes(least_words, k), "id bigint, cls bigint, runs array<bigint>"),
        "passages",
    )
    members = made.select("id", "cls").distinct()
    distinct = made.filter(F.size("runs") > 0).dropDuplicates(["cls"]).select("cls", "runs")
    signed = stage(distinct.mapInArrow(_signed(bands, darts), "cls bigint, runs array<bigint>, keys array<bigint>, sketch array<bigint>"), "signed")
    key = signed.select("cls", F.explode("keys").alias("key"))
    candidates = (
        key.alias("a").join(key.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")))
        .select(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b"))
        .distinct()
    )
    # agreement by chance is 1/16 of the darts that differ
    least = int(SKETCH_DARTS * max(0.0, threshold - SLACK))
    sketch = signed.select("cls", "sketch")
    alike = (
        candidates.join(sketch.select(F.col("cls").alias("cls_a"), F.col("sketch").alias("sa")), "cls_a")
        .join(sketch.select(F.col("cls").alias("cls_b"), F.col("sketch").alias("sb")), "cls_b")
        .filter(_agreeing("sa", "sb") >= least)
        .select("cls_a", "cls_b")
    )
    sets = signed.select("cls", "runs")
    links = (
        alike.join(sets.select(F.col("cls").alias("cls_a"), F.col("runs").alias("ra")), "cls_a")
        .join(sets.select(F.col("cls").alias("cls_b"), F.col("runs").alias("rb")), "cls_b")
        .withColumn("likeness", likeness(F.col("ra"), F.col("rb")))
        .filter(F.col("likeness") >= threshold)
        .select("cls_a", "cls_b", "likeness")
    )
    return NearDuplicates(members, links)


def linked_pairs(found: NearDuplicates) -> DataFrame:
    """Every pair of ids, id_a < id_b, of equal texts or of linked classes."""
    m = found.members
    same = m.alias("a").join(m.alias("b"), (F.col("a.cls") == F.col("b.cls")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    across = (
        found.links.join(m.select(F.col("cls").alias("cls_a"), F.col("id").alias("x")), "cls_a")
        .join(m.select(F.col("cls").alias("cls_b"), F.col("id").alias("y")), "cls_b")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return same.unionAll(across)


def membership(found: NearDuplicates) -> DataFrame:
    """One row per passage: its class (the least id of its equal texts), the class's size and its links to other texts."""
    rep = found.members.groupBy("cls").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"))
    ends = found.links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    return (
        found.members.join(rep, "cls")
        .join(ends, "cls", "left")
        .select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    )
