"""What changed between full snapshots of a table.

1. Each snapshot's keys are laid out by ranges of (step, key) and sorted, a
   step being a pair of consecutive snapshots.  Within each range a two-pointer
   merge walks the old and the new side of a step together and emits keys that
   one side lacks.  Keys are made distinct before the shuffle, so a key that
   fills a third of a snapshot is one row, and a step that fills a third of the
   table spreads over many ranges.
2. Rows of left-over keys get the sets of their word runs.  Pairs of an old and
   a new row of a step that share a run of their *prefix* are candidates: of a
   set of n runs in the order of (frequency, hash), two sets of likeness t or
   more share one of their first n - ceil(t n) + 1.  Frequencies come from a
   sketch of fixed size over all left-over rows, so that common runs, which
   would pair everything with everything, are the ones left out.
3. Candidates are verified on the whole sets, which gives typed changes.

Where rows have a key that stays and columns that change, ``column_changes``
does with the merge alone: it compares the columns of keys that both sides have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.shingles import CELL_BITS, U, likeness, shingle_sets
from palimpsest.sources.tables import parallelism, stage

OLD, NEW = 0, 1


def consecutive(versions: DataFrame, entity: str, version: str, number: str, present: DataFrame) -> DataFrame:
    """(from_version, to_version): each version with its next higher one of the same entity.

    Versions that are not in ``present`` (their ids, any number of times) are
    left out.  Equal numbers go by version id; versions without an entity or a
    number have no neighbours.
    """
    known = versions.filter(F.col(entity).isNotNull() & F.col(number).isNotNull()).select(entity, version, number).dropDuplicates([version])
    held = known.join(present.select(version).distinct(), version, "left_semi")
    after = F.lead(version).over(Window.partitionBy(entity).orderBy(number, version))
    return held.select(F.col(version).alias("from_version"), after.alias("to_version")).filter("to_version IS NOT NULL")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two-pointer merge of sorted (step, key, side) rows: keys of one side only.

    Equal keys stand side by side, the old one first, so both pointers move
    along the same stream; the last row of a batch waits for the next one.
    """
    held = None
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        step, key, side = b["step"].to_numpy(zero_copy_only=False), b["key"], b["side"].to_numpy(zero_copy_only=False)
        n = len(step)
        if n < 2:
            held = b
            continue
        same_key = pa.compute.equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
        meets = (step[1:] == step[:-1]) & same_key & (side[1:] != side[:-1])
        both = np.zeros(n, bool)
        both[:-1] |= meets
        both[1:] |= meets
        keep = np.flatnonzero(~both[:-1])
        yield b.take(pa.array(keep))
        held = None if both[-1] else b.slice(n - 1)
        if held is None:
            continue
    if held is not None:
        yield held


def one_sided(rows: DataFrame) -> DataFrame:
    """(step, key, side) of keys that only one side of a step has.  ``rows``: step, key, side, any number of times."""
    keys = rows.select("step", "key", "side").distinct()
    spread = keys.repartitionByRange(parallelism(rows.sparkSession), "step", "key").sortWithinPartitions("step", "key", "side")
    return spread.mapInArrow(_merged, "step bigint, key string, side int")


def _compared(columns: list[str]):
    """Two-pointer merge of sorted (step, key, side, digests) rows, at most one of a key and side: typed changes with the columns that differ."""
    m = len(columns)
    names = np.array(columns, object)

    def typed(b: pa.RecordBatch, first: np.ndarray, second: np.ndarray | None) -> pa.RecordBatch:
        rows = b.take(pa.array(first))
        if second is None:
            kinds = np.where(rows["side"].to_numpy(zero_copy_only=False) == OLD, "removed", "added").tolist()
            changed = [[] for _ in kinds]
        else:
            kinds = ["changed"] * len(first)
            changed = second
        return pa.RecordBatch.from_arrays([rows["step"], rows["key"], pa.array(kinds, pa.string()), pa.array(changed, pa.list_(pa.string()))], ["step", "key", "change_kind", "changed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            n = b.num_rows
            if n < 2:
                held = b if n else held
                continue
            step, key = b["step"].to_numpy(zero_copy_only=False), b["key"]
            meets = (step[1:] == step[:-1]) & pa.compute.equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
            digests = b["digests"].flatten().to_numpy(zero_copy_only=False).reshape(n, 2 * m)
            at = np.flatnonzero(meets)
            differ = digests[at] != digests[at + 1]
            differ = differ[:, :m] | differ[:, m:]
            some = differ.any(axis=1)
            yield typed(b, at[some], [names[d].tolist() for d in differ[some]])
            both = np.zeros(n, bool)
            both[:-1] |= meets
            both[1:] |= meets
            yield typed(b, np.flatnonzero(~both[:-1]), None)
            held = None if both[-1] else b.slice(n - 1)
        if held is not None and held.num_rows:
            yield typed(held, np.arange(held.num_rows), None)

    return run


def column_changes(rows: DataFrame, steps: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(to_version, key, change_kind, changed): keys added, removed and changed from snapshot to snapshot, with the columns that differ.

    ``rows``: version_id, ``key`` and ``columns``; ``steps``: from_version,
    to_version.  Only digests of columns are shuffled.  Equal rows of a key
    count once; different rows of a key in one snapshot are taken together by
    their least and greatest digests, aggregated before the shuffle, so a key
    that fills a third of a snapshot is one row.  A null key is a key of its
    own, a null value a value of its own.  Rows without a version take no part.
    """
    digests = F.array(*(F.xxhash64(F.col(c).isNull(), F.col(c)) for c in columns))
    named = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    digested = rows.filter("version_id IS NOT NULL").select("version_id", named.alias("key"), digests.alias("d"))
    once_ = digested.groupBy("version_id", "key").agg(F.concat(F.min("d"), F.max("d")).alias("digests"))
    side = lambda c, n: once_.join(steps.select(F.col(c).alias("version_id"), F.col("to_version").alias("step")), "version_id").select("step", "key", F.lit(n).alias("side"), "digests")
    both = side("from_version", OLD).unionAll(side("to_version", NEW))
    spread = both.repartitionByRange(parallelism(rows.sparkSession), "step", "key").sortWithinPartitions("step", "key", "side")
    found = spread.mapInArrow(_compared(columns), "step bigint, key string, change_kind string, changed array<string>")
    return found.select(F.col("step").alias("to_version"), F.nullif("key", F.lit("\x00")).alias("key"), "change_kind", "changed")


def _run_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = shingle_sets([t or "" for t in b["words"].to_pylist()], k)
            sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b["step"], b["side"], b["id"], sets], ["step", "side", "id", "runs"])

    return run


def _prefixes(threshold: float, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.frombuffer(counts.value, np.int64)
        for b in batches:
            sets = b["runs"]
            h = sets.flatten().to_numpy(zero_copy_only=False).view(U)
            sizes = np.asarray(pa.compute.list_value_length(sets)).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((h, frequency[(h >> U(64 - CELL_BITS)).astype(np.int64)], owner))
            h = h[order]
            place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # in whole numbers, lest rounding shortens a prefix
            kept = sizes - np.ceil(np.round(threshold * sizes, 9)).astype(np.int64) + 1
            first = place < np.repeat(kept, sizes)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[first], minlength=len(sizes))))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[first].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b["step"], b["side"], b["id"], prefix], ["step", "side", "id", "prefix"])

    return run


def like_pairs(rows: DataFrame, threshold: float, k: int = 3) -> DataFrame:
    """(step, old_id, new_id, likeness) of every old and new row of a step with that likeness or more.

    ``rows``: step, side, id, words (null as the empty text), each id once per step and side.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = rows.sparkSession
    sets = stage(rows.select("step", "side", "id", "words").mapInArrow(_run_sets(k), "step bigint, side int, id bigint, runs array<bigint>"), "runs")
    cells = sets.select(F.explode("runs").alias("h")).groupBy(F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(1 << CELL_BITS, np.int64)
    seen = cells.toArrow()  # at most 2^18 rows, whatever the input
    counts[seen["cell"].to_numpy()] = seen["n"].to_numpy()
    sketch = spark.sparkContext.broadcast(counts.tobytes())
    prefixes = sets.mapInArrow(_prefixes(threshold, sketch), "step bigint, side int, id bigint, prefix array<bigint>").select("step", "side", "id", F.explode("prefix").alias("run"))
    old, new = (prefixes.filter(F.col("side") == s).drop("side").alias(a) for s, a in ((OLD, "o"), (NEW, "n")))
    met = old.join(new, ["step", "run"]).select("step", F.col("o.id").alias("old_id"), F.col("n.id").alias("new_id")).distinct()
    of = lambda side, name, runs: sets.filter(F.col("side") == side).select("step", F.col("id").alias(name), F.col("runs").alias(runs))
    verified = met.join(of(OLD, "old_id", "ro"), ["step", "old_id"]).join(of(NEW, "new_id", "rn"), ["step", "new_id"])
    return verified.withColumn("likeness", likeness(F.col("ro"), F.col("rn"))).filter(F.col("likeness") >= threshold).select("step", "old_id", "new_id", "likeness")


def changes(rows: DataFrame, steps: DataFrame, threshold: float, k: int = 3) -> DataFrame:
    """(to_version, change_kind, old_id, new_id): what was added, removed or modified from snapshot to snapshot.

    ``rows``: version_id, id, key, words; ``steps``: from_version, to_version.
    Rows delivered twice count once.  A row is left over if the other snapshot
    of the step has no row of its key (so order and repeats do not matter).
    ``modified``: each old and new left-over of at least ``threshold``
    likeness.  ``removed`` and ``added``: left-overs in no such pair, with 0
    for the side that is not there.  A null key is a key of its own.
    """
    rows = rows.select("version_id", "id", F.coalesce("key", F.lit("\x00")).alias("key"), "words")
    named = rows.select("version_id", "id", "key")
    as_old = named.join(steps.select(F.col("from_version").alias("version_id"), F.col("to_version").alias("step")), "version_id").withColumn("side", F.lit(OLD))
    as_new = named.join(steps.select(F.col("to_version").alias("version_id"), F.col("to_version").alias("step")), "version_id").withColumn("side", F.lit(NEW))
    placed = as_old.unionByName(as_new).select("step", "side", "key", "id")
    left = stage(placed.join(one_sided(placed), ["step", "side", "key"], "left_semi").select("step", "side", "id").distinct(), "left_over")
    texts = rows.select("id", "words").join(left.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    pairs = stage(like_pairs(left.join(texts, "id"), threshold, k), "like")
    alone = lambda side, name: left.filter(F.col("side") == side).join(pairs.select("step", F.col(name).alias("id")), ["step", "id"], "left_anti")
    zero = F.lit(0).cast("bigint")
    return (
        pairs.select(F.col("step").alias("to_version"), F.lit("modified").alias("change_kind"), "old_id", "new_id")
        .unionAll(alone(OLD, "old_id").select("step", F.lit("removed"), "id", zero))
        .unionAll(alone(NEW, "new_id").select("step", F.lit("added"), zero, "id"))
    )


def least_prefix(n: int, threshold: float) -> int:
    """How many runs of a set of ``n`` a prefix holds."""
    return n - math.ceil(round(threshold * n, 9)) + 1
