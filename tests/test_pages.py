"""Extraction from spans, spatial joins, line breaking and placing."""

import random
from itertools import permutations

from __spark_entry__ import queries
from palimpsest.operators import extraction as E
from palimpsest.operators import geometry as G


def span(block, line, span_, text, x0, y0, size=10.0, font="Calibri", width=None, page=1, flags=0, version=1):
    x0, y0, size = float(x0), float(y0), float(size)
    w = float(width or len(text) * size * 0.5)
    return (version, 7, page, block, line, span_, text, x0, y0, x0 + w, y0 + size, x0, y0 + size * 0.8, size, font, 0, flags, 595.0)


KIND = "version_id bigint, doc_id bigint, page int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double, origin_x double, origin_y double, size double, font string, color int, flags int, width double"


def page_rows():
    return [
        span(0, 0, 0, "Manual of the pump", 54, 40),
        span(1, 0, 0, "1.1 Pump", 54, 100, 14, "Cambria-Bold"),
        span(2, 0, 0, "The pump supplies the opera-", 54, 130),
        span(2, 1, 0, "tion circuit and keeps it full.", 54, 143.4),
        span(3, 0, 0, "• Check the gauge before use", 70, 170),
        span(4, 0, 0, "Figure 1-1. The pump", 54, 200),
        span(5, 0, 0, "This paragraph goes over to the next", 54, 230),
        span(6, 0, 0, "block without an end of sentence.", 54, 243.4),
        span(7, 0, 0, "Part", 54, 300, width=30), span(8, 0, 0, "Limit", 200, 300, width=30), span(9, 0, 0, "State", 350, 300, width=30),
        span(7, 1, 0, "KX-1", 54, 313.4, width=30), span(8, 1, 0, "30 psi", 200, 313.4, width=30), span(9, 1, 0, "ON", 350, 313.4, width=30),
        span(10, 0, 0, "8", 54, 400, width=5), span(10, 0, 1, "th", 59.2, 399.3, 6.5, width=5), span(10, 0, 2, "unit in the row", 70, 400),
        span(11, 0, 0, "12", 290, 790),
        span(12, 0, 0, "  ", 54, 500),
        span(0, 0, 0, "Second page text.", 54, 120, page=2),
    ]


def test_extraction(spark):
    got = E.extract(spark.createDataFrame(page_rows(), KIND)).orderBy("order_index").collect()
    seen = [(r.page, r.kind, r.role, r.text) for r in got]
    assert [r.order_index for r in got] == list(range(len(got)))
    assert (1, "header", "header", "Manual of the pump") in seen
    assert (1, "heading", "body", "1.1 Pump") in seen
    assert (1, "paragraph", "body", "The pump supplies the operation circuit and keeps it full.") in seen
    assert (1, "list_item", "body", "• Check the gauge before use") in seen
    assert (1, "caption", "body", "Figure 1-1. The pump") in seen
    assert (1, "paragraph", "body", "This paragraph goes over to the next block without an end of sentence.") in seen
    assert [t for _, k, _, t in seen if k == "table_cell"] == ["Part", "Limit", "State", "KX-1", "30 psi", "ON"]
    assert (1, "paragraph", "body", "8th unit in the row") in seen
    assert (1, "page_num", "pagenum", "12") in seen
    assert seen[-1] == (2, "paragraph", "body", "Second page text.")
    assert all(r.fingerprint and r.bbox.x1 > r.bbox.x0 for r in got)
    assert E.extract(spark.createDataFrame([], KIND)).count() == 0


def test_extraction_runs_once(spark, root):
    plan = queries()["extracted_segments"](spark, root)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInPandas" not in plan
    assert plan.count("Exchange ") == 2  # rows by page, segments by version


def test_pages_over_the_ends_of_batches(spark):
    whole = E.extract(spark.createDataFrame(page_rows(), KIND)).orderBy("order_index").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert E.extract(spark.createDataFrame(page_rows(), KIND)).orderBy("order_index").collect() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spans_of_one_number_come_in_one_order(spark):
    rows = [span(0, 0, 0, t, x, y) for t, x, y in (("alpha beta", 54, 100), ("gamma delta", 150, 104), ("epsilon zeta", 260, 108))]
    got = {tuple((r.text, r.n_lines) for r in E.extract(spark.createDataFrame(order, KIND).coalesce(1), columns=("text", "n_lines")).orderBy("order_index").collect()) for order in permutations(rows)}
    assert len(got) == 1


def test_lines_compare_within_reach():
    piece = lambda base, size=10.0: E.Piece("x", 0.0, base - 8, 5.0, base + 2, base, size, "", 0, 0, 0, False, False, False, round(base, 1))

    def plain(pieces):
        lines = []
        for p in pieces:
            home = next((ln for ln in lines if E.same_baseline(ln[0], p)), None)
            home.append(p) if home else lines.append([p])
        return lines

    rng = random.Random(7)
    for n in range(300):
        pieces = [piece(rng.uniform(0, 200), rng.choice((4.0, 10.0, 40.0))) for _ in range(rng.randrange(1, 40))]
        if n % 3:
            pieces.sort(key=lambda p: p.row)
        assert E.onto_lines(pieces) == plain(pieces)
    assert len(E.onto_lines([piece(13.4 * n) for n in range(20_000)])) == 20_000


def test_wrap_and_fit():
    assert G.wrap("左泵开关。右泵", 10, 40) == ["左泵开关。", "右泵"]
    assert G.wrap("（泵）开关", 10, 20) == ["（泵）", "开关"] or all(not ln.endswith("（") for ln in G.wrap("（泵）开关", 10, 20))
    assert G.wrap(None, 10, 50) == [] and G.wrap("  ", 10, 50) == []
    assert "".join(G.wrap("x" * 50, 10, 30)) == "x" * 50
    size, lines, over = G.fit("泵" * 40, 10, 100, 30)
    assert size < 10 and not over and len(lines) * size * G.LEADING <= 30
    assert G.fit("泵" * 400, 10, 100, 30)[2] and G.fit("泵" * 400, 10, 100, 30)[1][-1].endswith("…")


def test_free_rectangles_and_labels():
    free = G.free_rectangles([(50, 100, 300, 200)], 595, 842)
    assert free and all(not (r[0] < 300 and 50 < r[2] and r[1] < 200 and 100 < r[3]) for r in free)
    labels = [("泵", (100, 100, 140, 110), 0.9), ("阀门", (145, 100, 180, 110), 0.8), ("表", (100, 112, 140, 122), 0.7)]
    placed = [p for p in G.place_labels(labels, 595, 842) if p]
    assert len(placed) == 3
    boxes = [b for _, b in placed] + [b for _, b, _ in labels]
    assert all(a is b or a[0] >= b[2] or b[0] >= a[2] or a[1] >= b[3] or b[1] >= a[3] for a in boxes for b in boxes)


def test_spatial_joins(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    s = spark.createDataFrame([(1, 1, 1, (0.0, 0.0, 100.0, 50.0), "PUMP LIMIT AND MORE WORDS HERE"), (1, 1, 2, (10.0, 10.0, 20.0, 20.0), "x"), (1, 1, 3, (0.0, 60.0, 50.0, 70.0), "y"), (1, 1, 4, None, None)], f"version_id bigint, page int, id bigint, bbox {box}, text string")
    assert [r.id for r in G.fragments_in_hosts(s).collect()] == [2]
    assert {r.id: r.next_y for r in G.next_below(s).collect()} == {1: 60.0, 2: 60.0, 3: None, 4: None}
    labels = spark.createDataFrame([(1, 1, 1, "pump-limit", (300.0, 0.0, 310.0, 5.0)), (2, 1, 1, "new", (300.0, 0.0, 310.0, 5.0)), (3, 1, 1, "under", (1.0, 1.0, 9.0, 9.0))], f"label_id bigint, version_id bigint, page int, text string, box {box}")
    assert [r.text for r in G.without_known_labels(labels, s).collect()] == ["new"]
    spans = spark.createDataFrame([(1, 1, 1, "in", (10.0, 10.0, 20.0, 20.0)), (2, 1, 1, "out", (200.0, 0.0, 210.0, 5.0))], f"span_id bigint, version_id bigint, page int, text string, box {box}")
    rects = spark.createDataFrame([(1, 1, (0.0, 0.0, 100.0, 50.0))], f"version_id bigint, page int, rect {box}")
    assert [r.text for r in G.uncovered(spans, rects).collect()] == ["out"]
