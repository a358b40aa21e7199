"""Requests: page ranges, names, views of changes, states, registers, banners."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import serving as O


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_page_ranges(spark):
    s = spark.createDataFrame([(1, 7, 1, "body"), (2, 7, 2, "body"), (3, 7, 3, "header"), (4, 7, None, "body"), (5, 8, 1, "body"), (6, None, 1, "body")], "id int, version_id int, page int, role string").selectExpr("*", "0 AS page_from")
    ask = lambda *r: [x.id for x in O.in_page_ranges(s, spark.createDataFrame(r, "version_id int, page_from int, page_to int, role string")).orderBy("id").collect()]
    assert ask((7, 2, 0, "")) == [2, 3] and ask((7, 0, 2, "body")) == [1, 2] and ask((7, 0, 0, None)) == [1, 2, 3, 4] and ask((7, None, None, "header"), (8, 1, 1, "body")) == [3, 5]
    assert ask((9, 0, 0, "")) == []


def test_names(spark):
    m = spark.createDataFrame([(1, "pump"), (2, "3"), (3, "valve"), (4, None)], "doc_id bigint, slug string").selectExpr("*", "0 AS wanted_")
    asked = spark.createDataFrame([("a", "valve"), ("b", " 3 "), ("c", "none"), ("d", None), ("e", "4")], "request_id string, wanted string")
    assert rows(O.resolved(asked, m, "doc_id", ["doc_id", "slug"], [])) == [("a", 3), ("b", 2), ("c", None), ("d", None), ("e", 4)]


def test_change_view(spark):
    c = spark.createDataFrame(
        [(5, 0, "unchanged", [1], [11], 1.0, 1, 1), (5, 1, "modified", [2], [12], 0.9, 1, 2), (5, 2, "removed", [3], [], 0.0, 2, None), (5, 3, "added", [], [13], 0.0, None, 3)],
        "step bigint, position int, change_kind string, old_ids array<bigint>, new_ids array<bigint>, ratio double, old_page int, new_page int",
    )
    t = spark.createDataFrame([(i, "x" * 600 if i == 12 else f"text {i}") for i in (1, 2, 3, 11, 12, 13)], "id bigint, text string")
    got = {r.change_id: r for r in O.change_view(c, t).collect()}
    assert set(got) == {2, 3, 4} and got[2].new_text == "x" * 500 + "…" and got[2].old_text == "text 2" and got[3].old_text == got[3].new_text == "" and got[4].new_text == "text 13"
    assert O.change_view(c, t, include_unchanged=True, chars=None).filter("change_id = 2").first().new_text == "x" * 600
    assert [r.change_id for r in O.change_view(c, t, most=2).orderBy("change_id").collect()] == [2, 3]
    pages = spark.createDataFrame([(5, 2)], "step bigint, page int")
    assert sorted(r.change_id for r in O.change_view(c, t, pages).collect()) == [2, 3]
    assert O.change_view(c.limit(0), t).count() == 0


def test_statuses(spark):
    held = spark.createDataFrame([(1, "甲", "machine", 3, None, None), (2, "乙", "reviewed", 1, "ann", "t0"), (4, "丁", "machine", 1, None, None)], "segment_id bigint, text string, status string, revision int, reviewed_by string, reviewed_at string")
    asked = spark.createDataFrame([(1, "reviewed", "bo", "t1"), (1, "machine", "", "t0"), (2, "failed", "", "t2"), (3, "missing", "", "t1"), (9, "reviewed", "bo", "t1"), (4, "nonsense", "bo", "t1")], "segment_id bigint, status string, reviewed_by string, at string")
    s = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id bigint")
    assert rows(O.set_statuses(held, asked, s)) == [(1, "甲", "reviewed", 3, "bo", "t1"), (2, "乙", "failed", 1, "ann", "t0"), (3, "", "missing", 1, None, None), (4, "丁", "machine", 1, None, None)]
    assert rows(O.set_statuses(held.limit(0), asked.limit(0), s)) == []


def test_arrivals(spark):
    v = spark.createDataFrame([(1, "a", 10), (1, "b", 11), (1, None, 12), (2, "a", 20)], "doc_id bigint, sha256 string, version_id bigint")
    s = spark.createDataFrame([(100, 10), (200, 20)], "id bigint, version_id bigint")
    t = spark.createDataFrame([(100, "甲"), (200, "")], "segment_id bigint, text string")
    asked = [("x", 1, "a", False, False), ("y", 1, "a", True, False), ("z", 1, "a", True, True), ("e", 1, "b", False, False), ("n", 1, "c", False, False), ("f", 7, "a", None, None), ("r", 2, "a", True, False), ("q", 1, None, False, False)]
    got = {r.arrival_id: tuple(r)[1:] for r in O.arrival_decisions(spark.createDataFrame(asked, "arrival_id string, doc_id bigint, sha256 string, reingest boolean, allow_loss boolean"), v, s, t).collect()}
    assert got == {"x": ("reused", 10, None), "y": ("refused", 10, None), "z": ("replaced", 10, None), "e": ("extracted", 11, None), "n": ("new", None, "v4"), "f": ("new", None, "v1"), "r": ("replaced", 20, None), "q": ("new", None, "v4")}


def test_snapshots(spark):
    held = spark.createDataFrame([(1, 7, "pdf", "p", "old", 0, 1, "t0"), (2, 7, "png", "q", "b", 0, 1, "t0"), (3, 8, "pdf", "p", "c", 1, 1, "t0")], "snapshot_id bigint, version_id bigint, kind string, params_hash string, path string, stale int, bytes int, created_at string")
    new = spark.createDataFrame([(7, "pdf", "p", "new", 0, 2, "t1"), (7, "pdf", "p", "older", 0, 2, "t0"), (9, None, None, "d", 0, 2, "t1"), (None, "pdf", "p", "x", 0, 2, "t1"), (8, "pdf", "r", "e", 0, 2, "t1")], "version_id bigint, kind string, params_hash string, path string, stale int, bytes int, created_at string")
    done = O.put_snapshots(held, new)
    assert [(r.snapshot_id, r.path) for r in done.orderBy("snapshot_id").collect()] == [(1, "new"), (2, "b"), (3, "c"), (4, "e"), (5, "d")]
    assert {(r.version_id, r.kind): r.path for r in O.latest_snapshots(done).collect()} == {(7, "pdf"): "new", (7, "png"): "b", (8, "pdf"): "e", (9, ""): "d"}
    stale = O.mark_stale(done, spark.createDataFrame([(7,), (7,)], "version_id bigint"))
    assert {r.version_id for r in O.latest_snapshots(stale).collect()} == {8, 9} and O.latest_snapshots(stale, fresh_only=False).count() == 4


def test_banners_and_pages(spark):
    boxes = [(0.0, 0.0, 595.0, 40.0, True), (0.0, 0.0, 595.0, 10.0, False), (0.0, 400.0, 595.0, 460.0, False), (10.0, 800.0, 590.0, 842.0, True), (0.0, 0.0, 300.0, 40.0, False), (None, None, None, None, False)]
    df = spark.createDataFrame([((a, b, c, d), hit) for a, b, c, d, hit in boxes], "box struct<x0:double,y0:double,x1:double,y1:double>, hit boolean")
    assert df.filter(O.is_banner(F.col("box"), F.lit(595.0), F.lit(842.0)) != F.col("hit")).count() == 0
    images = spark.createDataFrame([(1, 1, 0.0, 0.0, 595.0, 300.0), (1, 2, 0.0, 0.0, 595.0, 500.0), (1, 3, 0.0, 0.0, 595.0, 70.0)], "version_id int, page int, x0 double, y0 double, x1 double, y1 double")
    s = spark.createDataFrame([(1, 1, "body", "x" * 399), (1, 2, "body", "x" * 900), (1, 3, "body", None), (1, 1, "header", "x" * 900)], "version_id int, page int, role string, text string")
    assert [(r.page, r.live_chars, r.needs) for r in O.pages_to_label(images, s, 595.0, 842.0).orderBy("page").collect()] == [(1, 399, True), (2, 900, True), (3, 0, False)]


@pytest.mark.parametrize(
    ("zh", "a", "b", "expected"),
    [("先关阀门，再排空压力。", "close the valve", "then drain it", ("先关阀门，", "再排空压力。")), ("先关", "a" * 50, "b" * 2, ("先关", "")), ("", "a", "b", ("", "")), (None, None, None, ("", "")), ("甲乙丙丁", "", "", ("甲乙丙丁", "")), ("一二三四五六", "aaa", "bbb", ("一二三", "四五六"))],
)
def test_split_by_ratio(zh, a, b, expected):
    assert O.split_by_ratio(zh, a, b) == expected


def test_contents_entries_and_edits(spark):
    from palimpsest.functions import scalars as X

    texts = ["8.1 Speed check ...... 153 8.2 Fly-up check ...... 154", "8.1 Speed ...... 153", "", None, "no dots 8.2 here", "A ..... 1 B ..... 2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.e for r in df.select("i", X.contents_entries(F.col("t")).alias("e")).orderBy("i").collect()]
    assert got == [["8.1 Speed check ...... 153", "8.2 Fly-up check ...... 154"], [], [], [], [], []]
    edits = spark.createDataFrame([(0, "Climb to 1,000 feet at 90 kts."), (1, "Hold 20 psi, then 20 psi."), (2, "none"), (3, None), (4, "Drain 101.5 lbs now"), (5, "Wait 250 sec")], "i int, t string")
    assert [r.q for r in edits.select("i", X.rewrite_quantity(F.col("t")).alias("q")).orderBy("i").collect()] == ["Climb to 1,200 feet at 90 kts.", "Hold 25 psi, then 20 psi.", None, None, "Drain 121.8 lbs now", "Wait 300 sec"]
    words = spark.createDataFrame([(0, "see the warning lamp and the warning horn"), (1, "warning"), (2, None)], "i int, t string")
    assert [r.w for r in words.select("i", X.rewrite_words(F.col("t")).alias("w")).orderBy("i").collect()] == ["see the caution lamp and the warning horn", None, None]
    long = "One. Two is here. " + "x" * 40
    sent = spark.createDataFrame([(0, long), (1, "One. " + "x" * 40), (2, "One. Two. short"), (3, None)], "i int, t string")
    assert [r.s for r in sent.select("i", X.rewrite_sentence(F.col("t"), F.lit("New.")).alias("s")).orderBy("i").collect()] == ["One. Two is here. New.", None, None, None]


@pytest.mark.parametrize(("text", "expected"), [("FUELPUMP", "FUEL PUMP"), ("FUELXPUMP", "FUELX PUMP"), ("abcDef", "abc Def"), ("KX12", "KX 12"), ("ON", "ON"), (None, ""), ("  A  B ", "A B"), ("ZZZZZ", "ZZZZZ")])
def test_label_forms(text, expected):
    from palimpsest.operators.geometry import label_form

    assert label_form(text, ["FUEL", "PUMP", "FUELING"]) == expected


def test_filled(spark):
    m = spark.createDataFrame([(1, "f", "Abc"), (2, None, "abc"), (3, "g", None), (4, "h", "x")], "id bigint, fingerprint string, normalized string")
    b = spark.createDataFrame([(10, "f", "q"), (9, "f", "r"), (11, None, "ABC"), (12, None, None)], "id bigint, fingerprint string, normalized string")
    assert rows(O.filled(m, b)) == [(1, 9, "fingerprint"), (2, 11, "normal form")]
