"""Planner, batches, execution, upserts, glossary and answers."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import glossary as G
from palimpsest.functions import scalars as X
from palimpsest.operators import memory as M
from palimpsest.operators import relational as R

TERMS = G.Terms([("ILS", "仪表着陆系统", True), ("wing tip", "翼尖", False), ("wing", "机翼", False), ("HUD", "平显", True), ("", "x", False), ("x", None, False)])


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("ILS 着陆", "仪表着陆系统（ILS）着陆"),
        ("ILS and ILS", "仪表着陆系统（ILS） and ILS"),
        ("TR_05_ILS_x and wing tip", "TR_05_ILS_x and 翼尖"),
        ("wing", "机翼"),
        ("swing", "swing"),
        ("仪表着陆系统 ILS", "仪表着陆系统 ILS"),
        (None, None),
        ("", ""),
    ],
)
def test_enforce(text, expected):
    assert TERMS.enforce(text) == expected
    assert TERMS.enforce(TERMS.enforce(text)) == expected


def test_pseudo_translate():
    assert TERMS.pseudo_translate("Check the wing  tip, F-16 HUD") == "〔Check〕 〔the〕 翼尖, 〔F-16〕 平显"
    assert TERMS.pseudo_translate(None) == ""


@pytest.mark.parametrize(
    ("raw", "wanted", "expected"),
    [
        ('[{"id": 1, "zh": "甲"}]', [1], {1: "甲"}),
        ('```json\n{"translations": [{"segment_id": "2", "text": " 乙 "}]}\n```', [2], {2: "乙"}),
        ('Here: {"3": "丙", "4": "丁"} done', [3], {3: "丙"}),
        ('{"items": {"5": "a"}}', [5], {5: "a"}),
        ('[{"id":1,"zh":"a"},{"id":1,"zh":" "}]', [1], {1: "a"}),
        ('[{"id":1,"zh":""}]', [1], ValueError),
        ("no json", [1], ValueError),
        ('[{"id":1,"zh":"a"}]', [1, 2], ValueError),
    ],
)
def test_parse_answer(raw, wanted, expected):
    if expected is ValueError:
        with pytest.raises(ValueError):
            G.parse_answer(raw, wanted)
    else:
        assert G.parse_answer(raw, wanted) == expected


def test_plan_order(spark):
    s = spark.createDataFrame(
        [(1, 9, "body", "Long text one", "f1"), (2, 9, "header", "Head line", "f2"), (3, 9, "body", "7", "f3"), (4, 9, "body", "Memory text", "f4"), (5, 9, "body", "Seed text", None), (6, 9, "body", "New text", "f6"), (7, 9, "body", "Broken own", "f4"), (8, 9, None, None, None)],
        "id bigint, version_id bigint, role string, text string, fingerprint string",
    )
    own = spark.createDataFrame([(1, "好"), (7, "A_仪表"), (6, "　")], "id bigint, text string")
    cache = spark.createDataFrame([("f4", "记忆"), ("f6", "B_坏")], "fingerprint string, text string")
    links = spark.createDataFrame([(5, 50, 0.72, "旧"), (6, 60, 0.71, "旧")], "id bigint, old_id bigint, ratio double, old_text string")
    got = {r.id: r.action for r in M.plan(s, own, cache, links).collect()}
    assert got == {1: "cached", 2: "carried_verbatim", 3: "carried_verbatim", 4: "carried", 5: "seeded", 6: "machine", 7: "carried", 8: "carried_verbatim"}
    forced = {r.id: r.action for r in M.plan(s, own, cache, links, force=True).collect()}
    assert forced[1] == forced[4] == forced[7] == "machine" and forced[5] == "seeded"


def test_greedy_batches(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([10, 1800, 5, None, 2000, 3])] + [(2, 100 + i, 1) for i in range(13)], "g bigint, id bigint, n int")
    got = {(r.g, r.batch_no): (list(r.ids), r.chars) for r in M.greedy_batches(df, "g", "id", F.col("n")).collect()}
    assert got[1, 0] == ([0], 10) and got[1, 1] == ([1], 1800) and got[1, 2] == ([2, 3], 5) and got[1, 3] == ([4], 2000) and got[1, 4] == ([5], 3)
    assert len(got[2, 0][0]) == 12 and got[2, 1][0] == [112]


def test_execute_retries_and_fails(spark):
    batches = spark.createDataFrame([([1, 2], "good"), ([3], "bad"), ([4], "fatal")], "ids array<bigint>, payload string")

    def ask(payload):
        if payload == "fatal":
            raise M.Fatal
        if payload == "bad":
            raise OSError
        return '[{"id":1,"zh":"甲"},{"id":2,"zh":"乙"}]'

    got = {r.id: (r.text, r.status) for r in M.execute(batches, ask, wait=lambda s: None).collect()}
    assert got == {1: ("甲", "machine"), 2: ("乙", "machine"), 3: ("", "failed"), 4: ("", "failed")}


def test_upserts(spark):
    kind = "segment_id bigint, text string, status string, provider string, model string, revision int, reuse_of bigint"
    old = spark.createDataFrame([(1, "a", "machine", "p", "m", 1, None), (2, "b", "machine", "p", "m", 3, 7)], kind)
    new = spark.createDataFrame([(1, "a", "reviewed", "", None, None, None), (2, "c", "machine", "q", "", None, None), (3, None, "failed", None, None, None, None)], kind).drop("revision")
    got = {r.segment_id: (r.text, r.status, r.provider, r.model, r.revision, r.reuse_of) for r in M.upsert_translations(old, new).collect()}
    assert got == {1: ("a", "reviewed", "p", "m", 1, None), 2: ("c", "machine", "q", "m", 4, 7), 3: ("", "failed", None, None, 1, None)}


def test_relational_blocks(spark):
    ids = R.allocate_ids(spark.createDataFrame([(x,) for x in "hgfedcba"], "k string"), ["k"], 100).collect()
    assert sorted((r.k, r.id) for r in ids) == [(k, 101 + i) for i, k in enumerate("abcdefgh")]
    spans = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.5, 6.0), (1, 9.0, 10.0)], "g int, a double, b double")
    assert sorted((r.a, r.b, r.n) for r in R.islands(spans, ["g"], "a", "b", 1.0).collect()) == [(0.0, 6.0, 2), (9.0, 10.0, 1)]
    t = spark.createDataFrame([(None, "x"), ("k", "y")], "key string, v string")
    n = spark.createDataFrame([(None, " "), ("new", "z")], "key string, v string")
    assert sorted(((r.key or "", r.v) for r in R.upsert(t, n, ["key"], blanks_keep=["v"]).collect())) == [("", "x"), ("k", "y"), ("new", "z")]


@pytest.mark.parametrize(("spec", "expected"), [(None, [1, 2, 3, 4, 5]), (2, [2]), ((4, 2), [2, 3, 4]), ([5, 9, 1], [1, 5]), ("2-3,5", [2, 3, 5]), ("4-", [4, 5]), ("~2", [1, 2]), ("9", [])])
def test_page_list(spec, expected):
    assert X.page_list(spec, 5) == expected


def test_prompt_records_of_the_whole_plan(spark, root, monkeypatch):
    import json

    from palimpsest.plans import memory as Q

    rows = [
        (1, "machine", "plain", None), (2, "seeded", "Drain the pump.", "排空泵。"), (3, "machine", 'say "ON" / \\ off', None), (4, "machine", "wrapped-\nline\ttab", None), (5, "seeded", "Δp é 10°", "压差“é”\n10°"),
        (6, "machine", None, None), (7, "cached", "left out", None), (8, "carried", "left out", None), (9, "carried_verbatim", "7", None), (10, "machine", "", None),
    ]
    monkeypatch.setattr(Q, "_plan", lambda spark, root, derive: spark.createDataFrame(rows, "id bigint, action string, text string, seed string"))
    got = [tuple(r) for r in Q.QUERIES["prompt_records_whole"](spark, root).collect()]
    record = lambda i, en, zh: json.dumps({k: v for k, v in (("id", i), ("en", en), ("prev_zh", zh)) if v is not None}, ensure_ascii=False, separators=(",", ":"))
    assert sorted(got) == sorted((i, record(i, en, zh)) for i, action, en, zh in rows if action in ("machine", "seeded"))


def test_runs_cover_a_text_and_terms_keep_their_edges():
    text = "Check HUD_2.txt, wing tips of the wing\ttip; ILS-9 and F16."
    assert "".join(run for _, run in G.runs(text)) == text
    assert [run for kind, run in G.runs(text) if kind == G.IDENTIFIER] == ["HUD_2.txt", "F16."] or [run for kind, run in G.runs(text) if kind == G.IDENTIFIER][0] == "HUD_2.txt"
    # neither part of a longer word nor over another blank
    assert TERMS.enforce("wings and wing\ttip") == "wings and 机翼\ttip"
    assert TERMS.enforce("HUD HUD hud") == "平显（HUD） HUD hud"
    assert TERMS.pseudo_translate("wing  tip, wing") == "翼尖, 机翼"
    assert TERMS.pseudo_translate("a  b  ") == "〔a〕  〔b〕  "


@pytest.mark.parametrize(
    ("raw", "expected"),
    [('{"data": {"1": "a", "2": "b"}}', {1: "a", 2: "b"}), ('{"1": "a", "2": "b"}', {1: "a", 2: "b"}), ('so: {"items": [{"seg_id": "1", "target": "a"}, {"id": 2, "zh": "b"}]} done', {1: "a", 2: "b"}), ('```json\n{"items": [{"id": 1, "zh": "a"}, {"id": 2, "zh": "b"}]}\n```', {1: "a", 2: "b"})],
)
def test_shapes_of_answers(raw, expected):
    assert G.parse_answer(raw, [1, 2]) == expected


def test_presence_by_automaton_and_by_join(spark, monkeypatch):
    texts = spark.createDataFrame([("The WING tip and the ILS", 3), ("ils only", 2), ("", 5), (None, 7)], "text string, m bigint").selectExpr("*", "1 AS n")
    g = spark.createDataFrame([("wing", "翼", False, None), ("ILS", "仪", True, None), ("tip", "尖", None, None), ("gear", "架", False, None), (None, "x", False, None), ("wing", "机翼", False, None)], "en string, zh string, case_sensitive boolean, note string")
    want = {"wing": 6, "ILS": 3, "tip": 3}
    assert {r.en: r.n for r in G.presence(texts, g).collect()} == want
    monkeypatch.setattr(G, "MOST_TERMS", 2)
    assert {r.en: r.n for r in G.presence(texts, g).collect()} == want
    assert G.presence(texts, g.limit(0)).count() == 0
