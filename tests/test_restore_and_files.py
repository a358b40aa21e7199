"""Restoring, lookups with fallbacks, links, reports, files, landing."""

import json

from pyspark.sql import functions as F

from palimpsest.operators import restore as O
from palimpsest.sources import files as S
from palimpsest.streaming import landing as L


def test_restore_tiers(spark):
    kind = "version_id bigint, page int, order_index int, fingerprint string, canonical_text string, text string, status string, provider string, model string, confidence double, revision int, reviewed_by string"
    rest = ("machine", "p", "m", 0.5, 2, "r")
    old = spark.createDataFrame(
        [(1, 1, 0, "a", "alpha text", "甲", *rest), (1, 1, 1, "a", "alpha text", "乙", *rest), (1, 2, 2, "b", "beta text", "丙", *rest), (1, 3, 3, "c", "gamma text here", "丁", *rest), (1, 4, 4, "z", "lost", "戊", *rest), (1, 5, 5, "w", "wide text", "长" * 99, *rest), (1, 6, 6, None, None, "空", *rest)], kind
    )
    new = spark.createDataFrame([(10, 1, 1, 0, "a", "alpha text"), (11, 1, 9, 1, "a", "alpha text"), (12, 1, 7, 2, "b", "beta text"), (13, 1, 3, 3, "q", "so gamma text here too"), (14, 1, 5, 5, "w", "wide text"), (15, 1, 6, 6, None, None)], "id bigint, version_id bigint, page int, order_index int, fingerprint string, canonical_text string")
    got = {r.segment_id: (r.tier, r.text) for r in O.restore(old, new).collect()}
    assert got == {10: ("exact", "甲"), 11: ("near", "乙"), 12: ("near", "丙"), 13: ("contains", "丁")}
    assert 14 in {r.segment_id for r in O.restore(old, new, shape_check=False).collect()}
    assert O.restore(old.limit(0), new.limit(0)).count() == 0


def test_located_and_positions(spark):
    s = spark.createDataFrame([(1, "one  text"), (2, "the very long beginning of a text that ends so"), (3, "one text")], "id bigint, text string")
    r = spark.createDataFrame([(100, 3, "whatever"), (101, 99, "one text"), (102, None, "the very long beginning of another text"), (103, None, "none")], "removed_id bigint, old_id bigint, text string")
    assert {x.removed_id: (x.segment_id, x.tier) for x in O.located(r, s).collect()} == {100: (3, "id"), 101: (1, "text"), 102: (2, "head"), 103: (None, None)}


def test_links_and_summary(spark):
    kind = "step bigint, new_segment_id bigint, old_segment_id bigint, change_kind string, ratio double"
    old = spark.createDataFrame([(1, 5, None, "added", 0.0), (1, 6, 2, "modified", 0.8), (1, None, 3, "removed", 0.0)], kind)
    new = spark.createDataFrame([(1, 5, None, "moved", 1.0), (1, 7, 4, "modified", 1.5), (1, None, None, "added", 0.0)], kind)
    got = {(r.new_segment_id, r.old_segment_id): r.change_kind for r in O.record_links(old, new).collect()}
    assert got == {(5, None): "moved", (6, 2): "modified", (None, 3): "removed"}
    n = spark.createDataFrame([(1, 10), (2, 4)], "step bigint, n_segments bigint")
    counts = O.diff_summary(old, n, ("unchanged", "added", "modified", "removed"))
    assert {(r.step, r.change_kind): r.n for r in counts.collect()} == {(1, "unchanged"): 8, (1, "added"): 1, (1, "modified"): 1, (1, "removed"): 1, (2, "unchanged"): 4, (2, "added"): 0, (2, "modified"): 0, (2, "removed"): 0}
    assert "- added: 1 (9.1%)" in {r.step: r.summary for r in O.summary_text(counts).collect()}[1]


def test_edit_rule(spark):
    df = spark.range(0, 202).selectExpr("id", "cast(id as int) AS order_index", "concat('the value ', id) AS text")
    out = {(r.order_index, r.text) for r in O.edited(df).collect()}
    assert (13, "the value 13") not in out and (7, "this value 7") in out and (5, "the value 10") in out and (50, "Note to row 50") in out and (50, "the value 50") in out


def test_glossary_and_json_files(spark, tmp_path):
    path = str(tmp_path / "g.json")
    assert S.read_glossary(spark, path).count() == 0
    with open(path, "w", encoding="utf-8") as f:
        json.dump([{"en": "wing", "zh": "翼"}, {"en": " ", "zh": "x"}, {"en": "y", "zh": None}, {"en": "HUD", "zh": "平显", "case_sensitive": True}], f)
    assert {(r.en, r.case_sensitive) for r in S.read_glossary(spark, path).collect()} == {("wing", False), ("HUD", True)}
    out = str(tmp_path / "out")
    for n in (1, 2):
        S.write_json(spark.range(n), out)
        assert spark.read.json(out).count() == n


def test_landed_files(spark, tmp_path):
    for name, content in (("a.pdf", b"x"), ("b.pdf", b"x"), ("c.pdf", b"y"), ("d.txt", b"z")):
        (tmp_path / name).write_bytes(content)
    landed = S.landed_files(spark, str(tmp_path))
    assert landed.count() == 3
    known = landed.filter(F.endswith("path", F.lit("c.pdf"))).select("sha256")
    fresh = S.new_files(landed, known).collect()
    assert len(fresh) == 1 and fresh[0].path.endswith("a.pdf")


def test_paths_and_settings(spark, tmp_path):
    row = spark.createDataFrame([("C:\\data\\in\\a.pdf", "b.pdf")], "x string, y string").select(S.relative_path(F.col("x"), "c:/data").alias("r"), S.absolute_path(F.col("y"), "/root/d").alias("a")).first()
    assert (row.r, row.a) == ("in/a.pdf", "/root/d/b.pdf")
    f = tmp_path / "s.json"
    f.write_text('{"size": 3, "name": "file"}')
    assert S.settings({"size": 1, "name": "d", "on": False}, str(f), {"PALIMPSEST_SIZE": "7", "PALIMPSEST_ON": "yes"}) == {"size": 7, "name": "file", "on": True}


def test_landing_is_idempotent(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id bigint, text string, version_id bigint"
    spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "b", 1)], schema).write.parquet(folder + "/first")
    from pyspark.sql.types import _parse_datatype_string

    stream = lambda: L.segment_stream(spark, folder + "/*", _parse_datatype_string(schema))
    L.land(stream(), target, str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(target).count() == 2
    spark.createDataFrame([(2, "b", 1), (3, "c", 2)], schema).write.parquet(folder + "/second")
    L.land(stream(), target, str(tmp_path / "c1")).awaitTermination(60)
    L.land(stream(), target, str(tmp_path / "c2")).awaitTermination(60)  # all files again
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_hyphens_by_corpus_vocabulary(spark):
    from palimpsest.operators.hyphens import decisions, vocabulary

    rows = [(1, "the hydr-\naulic line"), (2, "hydraulic pump and a re-set key"), (3, "press re-\nset now"), (4, None), (5, "F-\n16 flies"), (6, "no division")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {(r.id, r.at): (r.how, r.why) for r in decisions(df, vocabulary(df, "text")).collect()}
    assert got == {(1, 0): ("soft", "vocabulary"), (3, 0): ("hard", "compound"), (5, 0): ("hard", "capital or digit follows")}


def test_restoring_onto_next_versions_leaves_no_place_out(spark, root):
    from palimpsest.plans import catalogue
    from palimpsest.plans.changes import version_steps
    from palimpsest.plans.store import segments

    got = catalogue.QUERIES["restored_translations"](spark, root).collect()
    at = {r.id: r.order_index for r in segments(spark, root, "order_index").collect()}
    assert {r.version_id for r in got} <= {r.to_version for r in version_steps(spark, root).collect()}
    assert len({r.segment_id for r in got}) == len(got)
    assert any(at[r.segment_id] is not None and at[r.segment_id] % 97 == 13 for r in got) and len({r.tier for r in got}) > 1


def test_near_tier_takes_the_nearest(spark):
    import random

    from palimpsest.operators.restore import nearest

    r = random.Random(4)
    side = lambda n, start: [(r.choice([1, 2, None]), r.choice(["f", "g", None]), r.choice([1, 2, 5, 9, None]), r.randrange(12), start + k) for k in range(n)]
    old, new = side(80, 1000), side(60, 1)
    kind = "version_id bigint, fingerprint string, page int, order_index int"
    got = {(x.row_id, x.segment_id) for x in nearest(spark.createDataFrame(old, f"{kind}, row_id bigint"), spark.createDataFrame(new, f"{kind}, segment_id bigint")).collect()}
    want, used = set(), set()
    for v, f, page, place, row in sorted(old, key=lambda x: (x[2] or 0, x[3], x[4])):
        fits = [(abs((p or 0) - (page or 0)), abs(q - place), p or 0, q, i) for w, g, p, q, i in new if v is not None and f is not None and (w, g) == (v, f) and i not in used]
        if fits:
            used.add(min(fits)[4])
            want.add((row, min(fits)[4]))
    assert got == want and want
