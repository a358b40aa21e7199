"""The golden scenario: 40 segments on four pages, edited into 41."""

import random

import pytest

from palimpsest.operators.alignment import Alignment, Side, align, change_counts, changes_by_segment, links

VERBS = "opens closes feeds drains heats cools locks arms trims vents".split()
PARTS = "valve pump gauge seal duct relay lamp filter latch panel".split()


def sentence(i: int) -> str:
    r = random.Random(i)
    return f"Item {i}: the {r.choice(PARTS)} number {i * 37} {r.choice(VERBS)} the {r.choice(PARTS)} at station {i * 91 + 5} once the {r.choice(PARTS)} shows {r.randint(100, 999)} units on dial {chr(65 + i % 26)}{i}."


def golden():
    old = [(i + 1, i // 10 + 1, i, sentence(i)) for i in range(40)]
    texts = {i: sentence(i) for i in range(40)}
    plan = []
    for i in range(40):
        t, page = texts[i], i // 10 + 1
        if i in (12, 13, 16):
            continue
        if i == 5:
            t = t.replace("once", "when")
        if i == 21:
            t = "Item 21: the pump number 777 was renewed in service and nothing of its former duty remains but station 1916 today."
        if i == 33:
            t = t.replace("at station", "close to the old station").replace("once", "as soon as")
        if i == 30:
            a, b = t.split(" at station ")
            plan += [(page, a), (page, "at station " + b)]
            continue
        if i == 36:
            plan.append((page, t + " " + texts[37]))
            continue
        if i == 37:
            continue
        plan.append((page, t))
        if i == 8:
            plan.append((page, "Wholly new wording stands here about lubrication of the remote hinge."))
        if i == 27:
            plan += [(page, "A first inserted remark on winter storage of batteries."), (page, "Second remark: grease must never touch rubber hoses.")]
    at = [k for k, (_, t) in enumerate(plan) if t in (texts[23], texts[24])]
    plan[at[0]], plan[at[1]] = plan[at[1]], plan[at[0]]
    plan.append((4, texts[16]))
    new = [(1000 + k, page, k, t) for k, (page, t) in enumerate(plan)]
    return old, new


def side(rows):
    return Side(*map(list, zip(*rows, strict=True))) if rows else Side([], [], [], [])


def counts(changes):
    out = {}
    for c in changes:
        out[c[0]] = out.get(c[0], 0) + 1
    return out


def test_golden_counts_and_coverage():
    old, new = golden()
    changes = Alignment(side(old), side(new)).changes()
    assert counts(changes) == {"unchanged": 30, "modified": 3, "added": 3, "removed": 2, "moved": 1, "reordered": 1, "split": 1, "merged": 1}
    assert sum(len(c[1]) for c in changes) == len(old) == 40
    assert sum(len(c[2]) for c in changes) == len(new) == 41
    assert sorted(i for c in changes for i in c[1]) == [r[0] for r in old]


@pytest.mark.parametrize("rows", [[], golden()[0]])
def test_identical_and_empty(rows):
    assert counts(Alignment(side(rows), side(rows)).changes()) == ({"unchanged": 40} if rows else {})


def test_one_side_empty_and_equal_captions():
    old, _ = golden()
    assert counts(Alignment(side(old), side([])).changes()) == {"removed": 40}
    assert counts(Alignment(side([]), side(old)).changes()) == {"added": 40}
    same = [(i, 1, i, "Figure" if i % 2 else f"row {i} says something else entirely {i * i}") for i in range(8)]
    assert counts(Alignment(side(same), side([(100 + r[0], *r[1:]) for r in same if r[0] != 3])).changes()) == {"unchanged": 7, "removed": 1}


def test_dataframe_form(spark):
    old, new = golden()
    rows = [(1, *r) for r in old] + [(2, *r) for r in new] + [(2, *new[0]), (3, 5000, 1, 0, None)]
    df = spark.createDataFrame(rows, "version_id bigint, id bigint, page int, order_index int, text string").selectExpr("*", "id AS step")
    steps = spark.createDataFrame([(1, 2), (2, 3)], "from_version bigint, to_version bigint")
    done = align(df, steps).cache()
    by = {(r.step, r.change_kind): (r.n, r.n_old, r.n_new) for r in change_counts(done).collect()}
    assert by[2, "unchanged"] == (30, 30, 30) and by[2, "split"] == (1, 1, 2) and by[2, "merged"] == (1, 2, 1)
    assert by[3, "removed"][0] == 41 and by[3, "added"][0] == 1
    edges = links(done).filter("step = 2")
    assert edges.filter("new_segment_id IS NOT NULL").count() == 41 and edges.filter("new_segment_id IS NULL").count() == 2
    assert changes_by_segment(done).filter("step = 2 AND change_kind = 'split'").count() == 3
    done.unpersist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "version_id bigint, id bigint, page int, order_index int, text string")
    assert align(none, spark.createDataFrame([], "from_version bigint, to_version bigint")).count() == 0


def test_stored_alignment_is_reused_and_follows_edits(spark, tmp_path):
    from palimpsest.operators.alignment import align, align_stored, revisions

    texts = ["Drain the left pump before service.", "Close the aft valve and tag it.", "Record the reading of the gauge."]
    rows = [(v, 100 * v + i, 1, i, t) for v in (1, 2, 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "version_id bigint, id bigint, page int, order_index int, text string").selectExpr("*", "1 AS revision", "2 AS step")
    steps = spark.createDataFrame([(1, 2), (2, 3)], "from_version bigint, to_version bigint")
    path = f"{tmp_path}/store"
    key = lambda d: sorted(map(str, d.select("step", "position", "change_kind", "old_ids", "new_ids", "ratio").collect()))
    assert key(align_stored(df, steps, path)) == key(align(df, steps))
    files = {f.name for f in (tmp_path / "store").glob("part-*")}
    before = spark.read.parquet(path).count()
    assert key(align_stored(df, steps, path)) == key(align(df, steps))
    assert spark.read.parquet(path).count() == before and files <= {f.name for f in (tmp_path / "store").glob("part-*")}
    edited = spark.createDataFrame([(v, i, p, o, t.replace("aft", "fore") if v == 3 else t) for v, i, p, o, t in rows], "version_id bigint, id bigint, page int, order_index int, text string")
    assert key(align_stored(edited, steps, path)) == key(align(edited, steps))
    assert spark.read.parquet(path).count() == before + 3  # only the second step was aligned anew
    assert {r.step for r in revisions(edited, steps).collect()} == {2, 3}
    assert align_stored(df.limit(0), steps.limit(0), f"{tmp_path}/none").count() == 0
