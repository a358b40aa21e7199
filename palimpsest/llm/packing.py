"""Filling fixed-capacity containers with items of varying length, by context sizes.

There are several context sizes, by default the capacity and its halves.

1. Routing: an item goes to the smallest context that holds it; an item longer
   than the capacity is cut into pieces of it.
2. Packing, from the longest context down: a tier's items, in their order,
   first fill gaps of the windows that longer tiers left open (best fit), and
   what no gap takes is packed into windows of the tier's own size.
3. Joining: windows of shorter contexts fill gaps of longer windows as a whole,
   or stand together in a new window of the capacity, fullest first.  While the
   room left over would hold a window, the emptiest ones give their pieces to
   gaps of others.  Without ``join`` windows stay in their own context.
4. Step groups: windows of a task are dealt to groups of equal number and
   nearly equal fill, context by context; a group's number is its own.

A sequence is packed in stretches of ``STRETCH`` positions (of ids where there
is no position), and a stretch of many rows in portions of as many, so one
sequence that holds a third of all rows spreads over many tasks and no list is
unbounded; a portion costs at most one window that is not full.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.tables import parallelism

STRETCH = 8192
CONTEXTS = 4
GROUP = 8
#: Windows dealt to step groups at once.
POOL = 4096
NO_SEQUENCE = -(2**63)


def contexts(capacity: int, n: int = CONTEXTS) -> tuple[int, ...]:
    """The context sizes, longest first: the capacity and its halves."""
    return tuple(dict.fromkeys(max(1, capacity >> i) for i in range(n)))


def tier_of(length: int, sizes: tuple[int, ...]) -> int:
    """The smallest of ``sizes`` (longest first) that holds a length."""
    tier = 0
    while tier + 1 < len(sizes) and length <= sizes[tier + 1]:
        tier += 1
    return tier


Piece = tuple[int, int, int]  # item, first character, length


class _Gaps:
    """Open windows by their free room; the smallest room that suffices is taken."""

    def __init__(self) -> None:
        self._free: list[tuple[int, int]] = []

    def add(self, free: int, window: int) -> None:
        insort(self._free, (free, window))

    def take(self, n: int) -> tuple[int, int] | None:
        at = bisect_left(self._free, (n, -1))
        return self._free.pop(at) if at < len(self._free) else None


def pack(lengths: list[int], capacity: int, sizes: tuple[int, ...] | None = None, join: bool = True) -> list[list[Piece]]:
    """Windows as lists of (item, first character, length), each in the items' order; windows by their first item."""
    sizes = sizes or contexts(capacity)
    pieces: list[list[Piece]] = [[] for _ in sizes]
    made: list[list[Piece]] = []
    room: list[int] = []  # the context size of each window
    for item, n in enumerate(lengths):
        start = 0
        while n - start > capacity:
            made.append([(item, start, capacity)])
            room.append(capacity)
            start += capacity
        pieces[tier_of(n - start, sizes)].append((item, start, n - start))
    longer, short = _Gaps(), []
    for size, routed in zip(sizes, pieces, strict=True):
        own = _Gaps()
        for piece in routed:
            n = piece[2]
            spot, gaps = longer.take(n), longer
            if spot is None:
                spot, gaps = own.take(n), own
            if spot is None:
                spot = (size, len(made))
                made.append([])
                room.append(size)
                if size < sizes[0]:
                    short.append(spot[1])
            free, window = spot
            made[window].append(piece)
            if free > n or not n:
                gaps.add(free - n, window)
        longer_now = own._free
        for free, window in longer_now:
            longer.add(free, window)
    if join and short:
        made = _settled(_joined(made, set(short), capacity), capacity)
    for w in made:
        w.sort()
    made.sort()
    return made


def _joined(made: list[list[Piece]], short: set[int], capacity: int) -> list[list[Piece]]:
    """Windows of shorter contexts put as a whole into gaps of full-sized ones, best fit, fullest first."""
    fill = [sum(p[2] for p in w) for w in made]
    gaps = _Gaps()
    for i, n in enumerate(fill):
        if i not in short and (n < capacity):
            gaps.add(capacity - n, i)
    out = {i: w for i, w in enumerate(made) if i not in short}
    for i in sorted(short, key=lambda i: (-fill[i], i)):
        spot = gaps.take(fill[i])
        free, window = spot or (capacity, i)
        out.setdefault(window, []).extend(made[i])
        if free > fill[i] or not fill[i]:
            gaps.add(free - fill[i], window)
    return list(out.values())


#: Windows whose pieces find no other place before the emptying ends.
MOST_FAILED = 8


def _settled(made: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """The windows with as many as possible of the emptiest ones dissolved into the gaps of others."""
    fill = [sum(p[2] for p in w) for w in made]
    spare = sum(capacity - n for n in fill)
    gaps = sorted((capacity - n, i) for i, n in enumerate(fill) if n < capacity)
    failed = 0
    for i in sorted(range(len(made)), key=lambda i: fill[i]):
        if spare < capacity or failed >= MOST_FAILED or fill[i] == capacity:
            break
        own = (capacity - fill[i], i)
        if own not in gaps:  # took pieces of another meanwhile
            continue
        gaps.remove(own)
        moved: list[tuple[Piece, int, int]] = []
        for piece in sorted(made[i], key=lambda p: -p[2]):
            at = bisect_left(gaps, (piece[2], -1))
            if at == len(gaps):
                break
            free, window = gaps.pop(at)
            insort(gaps, (free - piece[2], window))
            moved.append((piece, window, free))
        if len(moved) == len(made[i]):
            for piece, window, _ in moved:
                made[window].append(piece)
                fill[window] += piece[2]
            made[i], spare = [], spare - capacity
            continue
        failed += 1
        for piece, window, free in reversed(moved):
            gaps.remove((free - piece[2], window))
            insort(gaps, (free, window))
        insort(gaps, own)
    return [w for w in made if w]


def step_groups(fills: list[int], size: int = GROUP) -> list[int]:
    """A group per window: groups of at most ``size`` windows, the fullest dealt back and forth."""
    n = -(-len(fills) // size)
    group = [0] * len(fills)
    for rank, w in enumerate(sorted(range(len(fills)), key=lambda i: -fills[i])):
        turn, place = divmod(rank, n)
        group[w] = place if turn % 2 == 0 else n - 1 - place
    return group


_COLUMNS = (
    "seq bigint, stretch bigint, portion int, batch_no int, context int, step_group bigint, item_ids array<bigint>, piece_starts array<int>, n_items int, filled int, unused int"
)


def _packed(capacity: int, sizes: tuple[int, ...], join: bool):
    schema = pa.schema(
        [("seq", pa.int64()), ("stretch", pa.int64()), ("portion", pa.int32()), ("batch_no", pa.int32()), ("context", pa.int32()), ("step_group", pa.int64()), ("item_ids", pa.list_(pa.int64()))]
        + [("piece_starts", pa.list_(pa.int32())), ("n_items", pa.int32()), ("filled", pa.int32()), ("unused", pa.int32())]
    )

    def windows_of(seq: int, stretch: int, portion: int, ids: list[int], lengths: list[int]) -> Iterator[list]:
        for no, w in enumerate(pack(lengths, capacity, sizes, join)):
            fill = sum(p[2] for p in w)
            context = sizes[tier_of(fill, sizes)]
            yield [seq, stretch, portion, no, context, 0, [ids[p[0]] for p in w], [p[1] for p in w], len(w), fill, (capacity if join else context) - fill]

    def dealt(pool: list[list], part: int, used: int) -> tuple[pa.RecordBatch, int]:
        """The pool as a batch, its windows in step groups of one context each, numbered from ``used``."""
        by_context: dict[int, list[int]] = {}
        for i, row in enumerate(pool):
            by_context.setdefault(row[4], []).append(i)
        for context in sorted(by_context, reverse=True):
            rows = by_context[context]
            groups = step_groups([pool[i][9] for i in rows])
            for i, g in zip(rows, groups, strict=True):
                pool[i][5] = (part << 32) + used + g
            used += max(groups) + 1
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pool, strict=True), schema, strict=True)], schema=schema), used

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, used = TaskContext.get().partitionId(), 0
        held: tuple | None = None  # (seq, stretch, portion), ids, lengths
        pool: list[list] = []
        for b in batches:
            seq, stretch, ids, n = (b[c].to_numpy(zero_copy_only=False) for c in ("seq", "stretch", "id", "n"))
            change = np.flatnonzero((seq[1:] != seq[:-1]) | (stretch[1:] != stretch[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(seq)], strict=True):
                if lo == hi:
                    continue
                key = (int(seq[lo]), int(stretch[lo]))
                if held and held[0][:2] != key:
                    pool += windows_of(*held[0], held[1], held[2])
                    held = None
                if not held:
                    held = ((*key, 0), [], [])
                new = np.ones(hi - lo, bool)  # an item delivered twice stands beside itself
                new[1:] = ids[lo + 1 : hi] != ids[lo : hi - 1]
                new[0] = not held[1] or held[1][-1] != ids[lo]
                held[1].extend(ids[lo:hi][new].tolist())
                held[2].extend(n[lo:hi][new].tolist())
                while len(held[1]) > 2 * STRETCH:  # many rows of one position
                    pool += windows_of(*held[0], held[1][:STRETCH], held[2][:STRETCH])
                    held = ((*key, held[0][2] + 1), held[1][STRETCH:], held[2][STRETCH:])
                if len(pool) >= POOL:
                    batch, used = dealt(pool, part, used)
                    pool = []
                    yield batch
        if held:
            pool += windows_of(*held[0], held[1], held[2])
        if pool:
            yield dealt(pool, part, used)[0]

    return run


def pack_sequences(
    items: DataFrame, sequence: str, item: str, position: str, length: str, capacity: int, sizes: tuple[int, ...] | None = None, join: bool = True
) -> DataFrame:
    """Containers per sequence: their items in order, filled and unused room, context and step group.

    ``sizes``: the context sizes, longest (the capacity) first, by default its
    halves.  ``context`` is the smallest of them that holds a container, and
    ``step_group`` numbers groups over the whole table.  With ``join`` windows of
    short contexts share containers of the capacity; ``unused`` counts against
    what a container may hold.

    ``items``: a row per item; equal rows of one item count once.  Null or zero
    lengths take no room and still get a container; items without a position come
    first, in stretches of their ids; equal positions go by item id.  Items without a sequence are one
    sequence (null); rows without an item id are left out.  ``piece_starts`` is 0 for a whole item and the first character of the
    piece for one that was cut.  An empty table gives no container.
    """
    rows = items.select(
        F.coalesce(F.col(sequence).cast("bigint"), F.lit(NO_SEQUENCE)).alias("seq"),
        F.coalesce(F.floor(F.col(position) / STRETCH), -1 - F.floor(F.abs(F.col(item)) / STRETCH)).cast("bigint").alias("stretch"),
        F.coalesce(F.col(position), F.lit(-1)).cast("bigint").alias("position"),
        F.col(item).cast("bigint").alias("id"),
        F.coalesce(F.col(length), F.lit(0)).cast("int").alias("n"),
    ).filter(F.col("id").isNotNull())
    spread = rows.repartition(parallelism(items.sparkSession), "seq", "stretch").sortWithinPartitions("seq", "stretch", "position", "id")
    packed = spread.mapInArrow(_packed(capacity, sizes or contexts(capacity), join), _COLUMNS)
    return packed.withColumn("seq", F.nullif("seq", F.lit(NO_SEQUENCE)))
