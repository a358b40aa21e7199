"""Normal form, fingerprints, similarity, differences, hyphens and runs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import text as T
from palimpsest.functions import textdiff as D


@pytest.mark.parametrize(
    ("given_", "expected"),
    [
        (None, ""), ("", ""), (" \t\n", ""), ("a  b", "a b"), ("“x” ‘y’", "\"x\" 'y'"), ("a—b…", "a-b..."), ("ＡＢ", "AB"), ("zero​width", "zerowidth"), ("`q`", "'q'"), ("ﬁne", "fine"),
    ],
)
def test_normalize(given_, expected):
    assert T.normalize(given_) == expected


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_normalize_is_idempotent_and_diffs_rebuild(s):
    n = T.normalize(s)
    assert T.normalize(n) == n
    other = s[::-1]
    steps = D.char_diffs(s, other)
    assert "".join(x["text"] for x in steps if x["op"] != "insert") == n
    assert "".join(x["text"] for x in steps if x["op"] != "delete") == T.normalize(other)
    words = D.word_diff(s, other)
    assert "".join(x["text"] for x in words if x["op"] != "insert") == s
    assert "".join(x["run"] for x in D.script_runs(s)) == s


def test_fingerprints():
    assert T.fingerprint("Straße  A") == T.fingerprint("STRASSE a") != T.fingerprint("strase a")
    assert T.content_hash("A") != T.content_hash("a")
    assert len(T.fingerprint(None)) == 32


def test_ratio():
    assert D.ratio("", "") == 1.0 and D.ratio("a", "") == 0.0 and D.ratio(" a ", "a") == 1.0
    assert D.ratio("tide", "diet") != D.ratio("diet", "tide")


@pytest.mark.parametrize(
    ("lines", "vocabulary", "expected"),
    [
        (["the opera-", "tion of"], None, "the operation of"),
        (["a well-", "known fact"], None, "a well-known fact"),
        (["see F-", "16 now"], None, "see F-16 now"),
        (["- ", "item one"], None, "- item one"),
        (["pres-", "sure rise"], {"pressure": 3}, "pressure rise"),
        (["re-", "set it"], {"reset": 1, "re-set": 4}, "re-set it"),
        (["plain", "text"], None, "plain text"),
        (["12-", "volt lamp"], None, "12- volt lamp"),
        ([], None, ""),
        (None, None, ""),
    ],
)
def test_dehyphenate(lines, vocabulary, expected):
    assert D.dehyphenate(lines, vocabulary) == expected


def test_canonical_and_decisions():
    assert D.canonical("the opera-\ntion ends") == "the operation ends" and D.canonical(None) == "" and D.canonical("a  b") == "a b"
    assert [d["how"] for d in D.join_decisions(["opera-", "tion is", "x"])] == ["soft", "space"]


def test_script_runs_by_class():
    assert [(r["kind"], r["run"]) for r in D.script_runs("A1 阀，é")] == [("latin", "A"), ("digit", "1"), ("space", " "), ("cjk", "阀，"), ("latin", "é")]


def test_word_diff_prefers_deletion():
    assert D.word_diff("a b", "a c") == [{"op": "equal", "text": "a "}, {"op": "delete", "text": "b"}, {"op": "insert", "text": "c"}]


def test_columns_on_nulls(spark):
    df = spark.createDataFrame([(None, None), ("A  b", "a b")], "x string, y string")
    from pyspark.sql import functions as F

    rows = df.select(T.normalize_col("x").alias("n"), T.fingerprint_col("x").alias("f"), D.ratio_col("x", "y").alias("r"), D.char_diffs_col("x", "y").alias("d"), D.canonical_col("x").alias("c")).collect()
    assert rows[0].n == "" and rows[0].f == T.fingerprint("") and rows[0].r == 1.0 and rows[0].d == [] and rows[0].c == ""
    assert rows[1].n == "A b" and rows[1].r < 1.0
    native = spark.createDataFrame([("a— b  c …",)], "x string").select(T.normalize_native(F.col("x")).alias("n")).first().n
    assert native == T.normalize("a— b  c …")


def test_whole_text_queries_against_python(spark, tmp_path):
    import hashlib
    import re

    from palimpsest.plans import texts as Q

    texts = [None, "", " \t\n", "plain  text", "`q` it's", "“x”—‘y’…", "ＡＢ ﬁne", "½ ① é é", "zero​width", "中文，句子。", "KX-1", "Δp 10°", "Drain the left pump now.", "tail\n", "A B", "PUMP é", "ÄB-9"]
    style = "struct<bold:boolean,italic:boolean,size:double,color:int,align:string,list_level:int,indent:double>"
    rows = [(i, t, t, None if i % 2 else "stored", None if i % 3 else "stored", None, (True, False, 9.0, 0x102030 + i, None, 0, 0.0)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, f"id bigint, text string, canonical_text string, normalized string, fingerprint string, content_hash string, style {style}").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    run = lambda name: {r[0]: tuple(r)[1:] for r in Q.QUERIES[name](spark, str(tmp_path)).collect()}
    assert run("derived_columns_whole") == {i: (T.normalize(t), T.fingerprint(t), T.content_hash(t)) for i, t in enumerate(texts)}
    assert run("normalized_whole") == {i: (len(T.normalize(t)), hashlib.md5(T.normalize(t).lower().encode()).hexdigest()) for i, t in enumerate(texts)}

    def form(t):
        t = t or ""
        letters, bare = re.sub("[^A-Za-z]", "", t), t.strip(" ")
        code = bool(re.search("[0-9]", t)) or (letters != "" and letters == letters.upper())
        bucket = "code" if len(bare) <= 8 and re.fullmatch("[A-Z0-9-]+\n?", bare) else "sentence" if len(re.split(" +", bare)) >= 5 and re.search("[.!?]$", bare) else "other"
        return re.sub("[^A-Z0-9]", "", t.upper()), code, bucket

    assert run("label_forms_whole") == {i: (*form(t), 0x10, 0x20, 0x30 + i) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    ("line", "following", "how", "why"),
    [
        (" 1-", "word", "space", "list number"), ("opera-", "(tions", "soft", "suffix"), ("over-", '"see', "hard", "compound"), ("opera-", "中文", "space", "no word follows"), ("50-", "50", "hard", "capital or digit follows"),
        ("#5-", "#8", "hard", "no letters"), ("word -", "x", "space", "free-standing hyphen"), ("•-", "x", "space", "bullet"), ("• -", "x", "space", "free-standing hyphen"), ("R-", "aero", "hard", "single character"), ("x", "", "space", "no hyphen"), ("x-", " ", "space", "no next line"),
    ],
)
def test_hyphen_reasons(line, following, how, why):
    assert D.hyphen_join(line, following) == (how, why)


def test_counts_decide_between_both_forms():
    assert D.hyphen_join("pres-", "sure", {"pressure": 2, "pres-sure": 2}) == ("hard", "compound")
    assert D.hyphen_join("opera-", "tion", {"opera-tion": 1}) == ("hard", "compound")
    assert D.dehyphenate(["air-", "to-", "air", "fight"], {"air-to-air": 5}) == "air-to-air fight"
