"""Relational building blocks: latest rows, zero-filled counts, islands, anchors, upserts and cascades.

Every operator is DataFrame in, DataFrame out; a change of a table is a new
table.  Ties are broken by a named column, never left to chance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.tables import parallelism, stage


def latest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row of greatest ``order`` per key (nulls lowest): a partial aggregate, so hot keys are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def zero_filled(counts: DataFrame, keys: Sequence[str], dimension: str, values: Sequence[str], n: str = "n") -> DataFrame:
    """A row for every key and every value of the dimension, 0 where ``counts`` has none.  The values are a fixed, short list."""
    every = counts.select(*keys).distinct().withColumn(dimension, F.explode(F.array(*map(F.lit, values))))
    return every.join(counts, [*keys, dimension], "left").withColumn(n, F.coalesce(n, F.lit(0)).cast("bigint"))


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, touch: float = 0.0) -> DataFrame:
    """Overlapping or touching intervals merged: (keys, island, start, end, n)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + touch), 1).otherwise(0)
    numbered = df.withColumn("_f", fresh).withColumn("island", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"))


def consecutive_runs(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Runs of consecutive positions: (keys, first, last, n)."""
    w = Window.partitionBy(*keys).orderBy(position)
    run = df.withColumn("_run", F.col(position) - F.row_number().over(w))
    return run.groupBy(*keys, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def occurrence_anchors(old: DataFrame, new: DataFrame, step: str, key: str, order: Sequence[str]) -> DataFrame:
    """One-to-one pairs of equal keys within a step: the k-th occurrence of the old with the k-th of the new side.

    The relational tier of the alignment: no sequence matching, so it scales
    with the shuffle.  Returns the old columns with ``old_`` and the new ones
    with ``new_`` in front, full outer.
    """
    w = Window.partitionBy(step, key).orderBy(*order)
    number = lambda df, p: df.withColumn("_k", F.row_number().over(w)).select(F.col(step).alias("_s"), F.col(key).alias("_key"), "_k", *(F.col(c).alias(p + c) for c in df.columns if c not in (step, key)))
    return number(old, "old_").join(number(new, "new_"), ["_s", "_key", "_k"], "full").withColumnsRenamed({"_s": step, "_key": key}).drop("_k")


def first_of(*tiers: DataFrame, key: str) -> DataFrame:
    """Cascade: each key's row from the first tier that has one; later tiers only see keys still open."""
    out = tiers[0]
    for tier in tiers[1:]:
        out = out.unionByName(tier.join(out.select(key), key, "left_anti"))
    return out


def keep_old_if_blank(new: Column, old: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(new), F.lit("")), old)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], *, blanks_keep: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` written over it by key; columns in ``blanks_keep`` stay where the new value is blank or null.

    Keys match null-safely, so a null key is a key.  ``new`` must have each key once.
    """
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, on, "full")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}").alias(c)
        if c in blanks_keep:
            return keep_old_if_blank(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        return F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*(value(c) for c in old.columns))


def cascade_delete(parents_gone: DataFrame, key: str, children: DataFrame, child_key: str) -> DataFrame:
    """Children without those of the deleted parents; children of no parent stay."""
    return children.join(parents_gone.select(F.col(key).alias(child_key)).distinct(), child_key, "left_anti").select(*children.columns)


def allocate_ids(df: DataFrame, order: Sequence[str], base: int, name: str = "id") -> DataFrame:
    """Consecutive ids from ``base`` + 1 in the given order, without one task numbering all rows.

    Rows are range-partitioned by the order; each partition numbers its own
    from the sum of the counts before it.  ``order`` must tell all rows apart.
    The partitioned rows are staged, so that both uses see the same ranges.
    """
    spread = stage(df.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "spread")
    at = Window.partitionBy("_p").orderBy(*order)
    sizes = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return spread.withColumn("_k", F.row_number().over(at)).join(before, "_p").withColumn(name, (F.lit(base) + F.col("_base") + F.col("_k")).cast("bigint")).drop("_p", "_k", "_base")


def mode_of(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None, name: str = "mode") -> DataFrame:
    """The heaviest value per key; of equal weights the smallest value."""
    weighed = df.groupBy(*keys, value).agg((F.sum(weight) if weight is not None else F.count(F.lit(1))).alias("_w"))
    return weighed.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_w"), value)).alias(name), F.max("_w").cast("bigint").alias("weight"))
