"""Alignment of two versions' segments: unchanged, modified, added, removed, moved, reordered, split and merged.

A pair of versions is one unit of work (a grouped kernel); pairs run in
parallel.  Memory of a task is that of the two versions, and the work inside a
block is bounded by the fixed limits below, which are part of the result.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalars import STOP_WORDS
from palimpsest.functions.text import digest, normalize
from palimpsest.functions.textdiff import ratio

# Thresholds and limits of the alignment.
PAIR_RATIO, PAIR_LENGTHS = 0.55, 0.34
REST_RATIO, REST_LENGTHS, REST_CONTAINMENT, REST_TOKENS = 0.30, 0.50, 0.30, 3
GROUP_RATIO, GROUP_GAIN, GROUP_SIZE = 0.55, 0.03, 4
GROUP_BUDGET, GROUP_FREE = 20_000, 600
BLOCK_PRODUCT = 120_000
ANCHOR_WORK = 2_000_000
KIND_RANK = {"added": 0, "modified": 1, "unchanged": 2, "moved": 3, "reordered": 4, "split": 5, "merged": 6, "removed": 7}
_TOKEN = re.compile(r"[a-z0-9]{3,}")
_STOP_WORDS = frozenset(STOP_WORDS)


def length_ratio(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    return min(len(a), len(b)) / max(len(a), len(b))


def tokens(text: str) -> frozenset[str]:
    return frozenset(_TOKEN.findall(text.casefold())) - _STOP_WORDS


def containment(a: frozenset[str], b: frozenset[str]) -> float:
    small = min(len(a), len(b))
    return len(a & b) / small if small >= REST_TOKENS else 0.0


@dataclass
class Side:
    """One version's body segments in order."""

    ids: list[int]
    pages: list[int]
    orders: list[int]
    texts: list[str]
    norms: list[str] = field(init=False)
    prints: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.norms = [normalize(t) for t in self.texts]
        self.prints = [digest(t.casefold()) for t in self.norms]

    def joined(self, run: Iterable[int]) -> str:
        return " ".join(self.texts[k] for k in run)


@dataclass
class Group:
    """One old segment split into several new ones, or several merged into one; it may grow from a pair."""

    kind: str
    old: tuple[int, ...]
    new: tuple[int, ...]
    score: float
    pair: tuple[int, int] | None

    @property
    def rank(self) -> tuple:
        return -self.score, self.kind == "merged", -len(self.new), self.old, self.new

    def claims(self) -> tuple[set[int], set[int]]:
        o, n = self.pair or (None, None)
        return set(self.old) - {o}, set(self.new) - {n}


class Alignment:
    def __init__(self, old: Side, new: Side):
        self.old, self.new = old, new
        self.pairs: list[tuple[int, int]] = []
        self.groups: list[Group] = []
        self.removed: list[int] = []
        self.added: list[int] = []
        self._ratios: dict[tuple[int, int], float] = {}
        self._anchor()
        self._sequence()

    # --- equal fingerprints -------------------------------------------------------------------------------
    def _anchor(self) -> None:
        """One-to-one pairs of equal fingerprints: first in common order, then the nearest of what is left."""
        a, b = self.old.prints, self.new.prints
        n_old, n_new = Counter(a), Counter(b)
        free_old, free_new = set(range(len(a))), list(range(len(b)))
        if sum(n * n_new[f] for f, n in n_old.items()) <= ANCHOR_WORK:
            for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
                self.pairs += [(m.a + k, m.b + k) for k in range(m.size)]
            free_old -= {i for i, _ in self.pairs}
            taken = {j for _, j in self.pairs}
            free_new = [j for j in free_new if j not in taken]
        places: dict[str, list[int]] = defaultdict(list)
        for i in sorted(free_old):
            places[a[i]].append(i)
        for j in free_new:
            at = places.get(b[j])
            if at:
                k = bisect_left(at, j)
                near = [x for x in (k - 1, k) if 0 <= x < len(at)]
                self.pairs.append((at.pop(min(near, key=lambda x: (abs(at[x] - j), x))), j))

    # --- what is left, in order -----------------------------------------------------------------------------
    def _sequence(self) -> None:
        paired_old, paired_new = {i for i, _ in self.pairs}, {j for _, j in self.pairs}
        rest_old = [i for i in range(len(self.old.ids)) if i not in paired_old]
        rest_new = [j for j in range(len(self.new.ids)) if j not in paired_new]
        matcher = difflib.SequenceMatcher(None, [self.old.norms[i] for i in rest_old], [self.new.norms[j] for j in rest_new], autojunk=False)
        block: tuple[list[int], list[int]] = ([], [])
        for tag, i, k, j, m in matcher.get_opcodes():
            if tag != "equal":
                block[0].extend(rest_old[i:k])
                block[1].extend(rest_new[j:m])
                continue
            self._block(*block)
            block = ([], [])
            self.pairs += zip(rest_old[i:k], rest_new[j:m], strict=True)
        self._block(*block)

    def _block(self, olds: list[int], news: list[int]) -> None:
        """Pair by similarity, grow splits and merges, pair the rest under stricter terms; what remains is removed or added."""
        if not olds and not news:
            return
        free_old, free_new = set(olds), set(news)
        scored = {}
        for r, i, j in self._greedy(olds, news, free_old, free_new, strict=False):
            scored[i, j] = r
        groups = self._grow(olds, news, scored, free_old, free_new)
        for g in groups:
            if g.pair:
                scored = {p: r for p, r in scored.items() if p[1] != g.pair[1]}
            free_old -= set(g.old)
            free_new -= set(g.new)
        self.groups += groups
        rest = self._greedy([i for i in olds if i in free_old], [j for j in news if j in free_new], free_old, free_new, strict=True)
        self.pairs += [*scored, *((i, j) for _, i, j in rest)]
        self.removed += [i for i in olds if i in free_old]
        self.added += [j for j in news if j in free_new]

    def _greedy(self, olds: Sequence[int], news: Sequence[int], free_old: set[int], free_new: set[int], strict: bool) -> list[tuple[float, int, int]]:
        """One-to-one pairs, likest first, then nearest; takes them out of the free sets."""
        lengths, least = (REST_LENGTHS, REST_RATIO) if strict else (PAIR_LENGTHS, PAIR_RATIO)
        reach = max(4, BLOCK_PRODUCT // max(len(olds), len(news), 1)) if len(olds) * len(news) > BLOCK_PRODUCT else None
        words_old = {i: tokens(self.old.texts[i]) for i in olds} if strict else {}
        words_new = {j: tokens(self.new.texts[j]) for j in news} if strict else {}
        candidates = []
        matchers: dict[int, difflib.SequenceMatcher] = {}
        for x, i in enumerate(olds):
            span = range(len(news)) if reach is None else range(max(0, x - reach), min(len(news), x + reach + 1))
            for y in span:
                j = news[y]
                if length_ratio(self.old.texts[i], self.new.texts[j]) < lengths:
                    continue
                if strict and containment(words_old[i], words_new[j]) < REST_CONTAINMENT:
                    continue
                r = self._alike(matchers, i, j, least)
                if r >= least:
                    candidates.append((-r, abs(x - y), x, y))
        taken = []
        for r, _, x, y in sorted(candidates):
            i, j = olds[x], news[y]
            if i in free_old and j in free_new:
                free_old.discard(i)
                free_new.discard(j)
                taken.append((-r, i, j))
        return taken

    def _alike(self, matchers: dict[int, difflib.SequenceMatcher], i: int, j: int, least: float) -> float:
        """The ratio of two segments if it reaches ``least``, else 0.  Upper bounds come first; a matcher keeps what it knows of the new text."""
        a, b = self.old.norms[i], self.new.norms[j]
        if a == b or not a or not b:
            return float(a == b)
        r = self._ratios.get((i, j))
        if r is None:
            matcher = matchers.get(j)
            if matcher is None:
                matcher = matchers[j] = difflib.SequenceMatcher(None, "", b)
            matcher.set_seq1(a)
            if matcher.real_quick_ratio() < least or matcher.quick_ratio() < least:
                return 0.0
            r = self._ratios[i, j] = matcher.ratio()
        return r

    def _grow(self, olds: list[int], news: list[int], scored: dict[tuple[int, int], float], free_old: set[int], free_new: set[int]) -> list[Group]:
        """Splits and merges: runs of two to four neighbours that together are like one segment of the other side."""
        place_old, place_new = ({x: p for p, x in enumerate(xs)} for xs in (olds, news))
        found: list[Group] = []
        budget = GROUP_BUDGET

        def runs(members: list[int], free: set[int], at: int, back: int, anchor: int | None):
            nonlocal budget
            for a in range(max(0, at - back), min(at, len(members) - 1) + 1):
                for size in range(2, min(GROUP_SIZE, len(members) - a) + 1):
                    run = tuple(members[a : a + size])
                    if (anchor is None or anchor in run) and all(m in free or m == anchor for m in run):
                        if budget <= 0:
                            return
                        budget -= 1
                        yield run

        def consider(kind: str, old: tuple[int, ...], new: tuple[int, ...], pair: tuple[int, int] | None) -> None:
            least = max(GROUP_RATIO, scored[pair] + GROUP_GAIN) if pair else GROUP_RATIO
            a, b = normalize(self.old.joined(old)), normalize(self.new.joined(new))
            if 2 * min(len(a), len(b)) < least * (len(a) + len(b)):  # no ratio exceeds this
                return
            score = ratio(a, b)
            if score >= GROUP_RATIO and (pair is None or score >= scored[pair] + GROUP_GAIN):
                found.append(Group(kind, old, new, round(score, 6), pair))

        if free_new:
            for i, j in scored:
                for run in runs(news, free_new, place_new[j], 3, j):
                    consider("split", (i,), run, (i, j))
        if free_old:
            for i, j in scored:
                for run in runs(olds, free_old, place_old[i], 3, i):
                    consider("merged", run, (j,), (i, j))
        if len(free_old) + len(free_new) <= GROUP_FREE:

            def across(p: int, n_from: int, n_to: int) -> int:
                return round(p * (n_to - 1) / (n_from - 1)) if n_from > 1 and n_to > 1 else 0

            for i in (x for x in olds if x in free_old):
                for run in runs(news, free_new, across(place_old[i], len(olds), len(news)), 2, None):
                    consider("split", (i,), run, None)
            for j in (x for x in news if x in free_new):
                for run in runs(olds, free_old, across(place_new[j], len(news), len(olds)), 2, None):
                    consider("merged", run, (j,), None)
        chosen: list[Group] = []
        used_old, used_new, grown = set(), set(), set()
        for g in sorted(found, key=lambda g: g.rank):
            o, n = g.claims()
            if not (o & used_old or n & used_new or (g.pair and g.pair in grown)):
                used_old |= o
                used_new |= n
                grown |= {g.pair} - {None}
                chosen.append(g)
        return chosen

    # --- changes --------------------------------------------------------------------------------------------
    def _reordered(self, unmoved: list[tuple[int, int]]) -> set[tuple[int, int]]:
        """Of equal pairs on one page, those that stand earlier among them in the new version than in the old."""
        by_page: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p in unmoved:
            by_page[self.old.pages[p[0]]].append(p)
        out = set()
        for pairs in by_page.values():
            was = {p: k for k, p in enumerate(sorted(pairs, key=lambda p: self.old.orders[p[0]]))}
            now = {p: k for k, p in enumerate(sorted(pairs, key=lambda p: self.new.orders[p[1]]))}
            out |= {p for p in pairs if now[p] < was[p]}
        return out

    def changes(self) -> list[tuple]:
        """(kind, old ids, new ids, ratio, old page, new page) in reading order of the new version."""
        o, n = self.old, self.new
        pairs = sorted(self.pairs)
        same = [p for p in pairs if o.norms[p[0]] == n.norms[p[1]]]
        reordered = self._reordered([p for p in same if o.pages[p[0]] == n.pages[p[1]]])
        equal = set(same)
        out = []
        for i, j in pairs:
            if (i, j) not in equal:
                kind, r = "modified", self._ratios.get((i, j)) or ratio(o.texts[i], n.texts[j])
            else:
                kind, r = ("moved" if o.pages[i] != n.pages[j] else "reordered" if (i, j) in reordered else "unchanged"), 1.0
            out.append(((float(j), KIND_RANK[kind], o.orders[i], n.orders[j]), (kind, [o.ids[i]], [n.ids[j]], r, o.pages[i], n.pages[j])))
        for g in self.groups:
            i, j = g.old[0], g.new[0]
            out.append(((float(j), KIND_RANK[g.kind], o.orders[i], n.orders[j]), (g.kind, [o.ids[x] for x in g.old], [n.ids[x] for x in g.new], g.score, o.pages[i], n.pages[j])))
        for i in self.removed:
            k = bisect_left(pairs, (i + 1,))
            slot = pairs[k][1] - 0.5 if k < len(pairs) else float(len(n.ids))
            out.append(((slot, KIND_RANK["removed"], o.orders[i], -1), ("removed", [o.ids[i]], [], 0.0, o.pages[i], None)))
        for j in self.added:
            out.append(((float(j), KIND_RANK["added"], -1, n.orders[j]), ("added", [], [n.ids[j]], 0.0, None, n.pages[j])))
        return [change for _, change in sorted(out, key=lambda x: x[0])]


CHANGES = "step bigint, position int, change_kind string, old_ids array<bigint>, new_ids array<bigint>, ratio double, old_page int, new_page int"


def _side(df: pd.DataFrame) -> Side:
    df = df.drop_duplicates("id").sort_values(["order_index", "id"])
    number = lambda c: df[c].fillna(0).astype(int).tolist()
    return Side(df["id"].tolist(), number("page"), number("order_index"), df["text"].fillna("").tolist())


def _kernel(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
    rows = Alignment(_side(both[~both["is_new"]]), _side(both[both["is_new"]])).changes()
    return pd.DataFrame(
        [(key[0], k, *r) for k, r in enumerate(rows)], columns=["step", "position", "change_kind", "old_ids", "new_ids", "ratio", "old_page", "new_page"]
    ).astype({"old_page": "Int32", "new_page": "Int32"})


def align(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per change of every step, in reading order.

    ``segments``: version_id, id, page, order_index, text (the canonical one;
    null as the empty text), body rows only, rows delivered twice count once;
    ``steps``: from_version, to_version (the step's name).  A version without
    rows makes every row of the other one added or removed.
    """
    rows = segments.filter("id IS NOT NULL").select("version_id", "id", "page", "order_index", "text")
    places = steps.select(
        F.explode(F.array(F.struct(F.col("from_version").alias("version_id"), F.lit(False).alias("is_new")), F.struct(F.col("to_version").alias("version_id"), F.lit(True).alias("is_new")))).alias("p"),
        F.col("to_version").alias("step"),
    ).select("step", "p.*")
    return rows.join(places, "version_id").drop("version_id").groupBy("step").applyInPandas(_kernel, CHANGES)


def revisions(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """(step, revision): a name of what both sides of a step hold, whatever the order rows come in."""
    rows = segments.filter("id IS NOT NULL").select("version_id", "id", "page", "order_index", "text").distinct()
    of_version = rows.groupBy("version_id").agg(F.sum(F.xxhash64("id", "page", "order_index", "text").cast("decimal(38,0)")).alias("h"))
    side = lambda c, name: of_version.select(F.col("version_id").alias(c), F.col("h").alias(name))
    both = steps.join(side("from_version", "a"), "from_version", "left").join(side("to_version", "b"), "to_version", "left")
    return both.select(F.col("to_version").alias("step"), F.xxhash64("from_version", "a", "b").alias("revision"))


def align_stored(segments: DataFrame, steps: DataFrame, path: str) -> DataFrame:
    """The changes of every step, taken from ``path`` where it holds them for what the versions hold now; others are aligned and added.

    Rows of former revisions stay in the store and are not read.  The store is
    one folder of parquet; writers of one store take turns.
    """
    spark = segments.sparkSession
    want = revisions(segments, steps)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        held = spark.read.parquet(path).select("step", "revision").distinct()
        todo = want.join(held, ["step", "revision"], "left_anti")
    else:
        todo = want
    missing = steps.join(todo.select(F.col("step").alias("to_version")), "to_version", "left_semi")
    align(segments, missing).join(todo, "step").write.mode("append").parquet(path)
    return spark.read.parquet(path).join(want, ["step", "revision"], "left_semi").drop("revision")


def change_counts(changes: DataFrame) -> DataFrame:
    """Counts per step and kind with the segments that groups hold on each side."""
    return changes.groupBy("step", "change_kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("old_ids")).alias("n_old"), F.sum(F.size("new_ids")).alias("n_new")
    )


def links(changes: DataFrame) -> DataFrame:
    """One row per new body segment and one per removed: (new_segment_id, old_segment_id, change_kind, ratio)."""
    first_old = F.try_element_at("old_ids", F.lit(1))
    return changes.select(
        "step",
        F.explode_outer("new_ids").alias("new_segment_id"),
        first_old.alias("old_segment_id"),
        "change_kind",
        "ratio",
    )


def changes_by_segment(changes: DataFrame) -> DataFrame:
    """(step, segment_id, side, change_kind): every part of a split and every member of a merge is marked."""
    new = changes.select("step", F.explode("new_ids").alias("segment_id"), F.lit("new").alias("side"), "change_kind")
    gone = changes.filter(F.col("change_kind").isin("removed", "split", "merged")).select("step", F.explode("old_ids").alias("segment_id"), F.lit("old").alias("side"), "change_kind")
    return new.unionAll(gone)
