"""The parts of the leak search against plain versions of themselves."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import leaks as L

row = st.lists(st.integers(0, 4), min_size=7, max_size=7)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(row, st.integers(-2, 2)), min_size=1, max_size=6), st.data())
def test_edits_of_many_pairs(pairs, data):
    shift = pairs[0][1]
    a = np.array([x for x, _ in pairs])
    b = np.array([data.draw(st.lists(st.integers(0, 4), min_size=7 + shift, max_size=7 + shift)) for _ in pairs])
    for most in (0, 1, 2, 3):
        got = L.edits(a, b, most)
        for x, y, d in zip(a, b, got, strict=True):
            assert (d <= most) == L.within_edits(x, y, most) and (d > most or L.within_edits(x, y, int(d)) and (not d or not L.within_edits(x, y, int(d) - 1)))


def test_no_window_is_keyed_by_one_word():
    r = np.random.default_rng(2)
    w = r.integers(1, 2**62, (400, 10), dtype=np.uint64)
    w[:, :6] = 7  # a word that fills most of every window
    keys, counts = L.sampled_keys(w, L.walked(10), 19)
    assert counts.any(axis=1).all()
    shared = np.unique(keys[counts], return_counts=True)[1].max()
    every = np.unique(keys, return_counts=True)[1].max()
    assert shared < every and shared < 100
    same, _ = L.sampled_keys(w[:1], L.walked(10), 19)
    assert (same == keys[0]).all()


def test_bitmap_holds_every_pair_of_the_items(spark):
    texts = [f"alpha{i} beta{i * 7 % 50} gamma{i % 3} delta" for i in range(500)] + [None, "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "_id bigint, _text string")
    bits, raw = L._bitmap(df, L.WORD)
    known = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(bool)
    assert len(known) == 1 << bits
    cells = set()
    for t in texts:
        flat, _ = L.word_hashes([L.words_of(t)])
        if len(flat) > 1:
            cells |= set(L._pair_cells(flat, bits).tolist())
    assert set(np.flatnonzero(known).tolist()) == cells


def test_words_of_other_scripts_can_leak(spark):
    passage = "阀 门 在 关 闭 前 应 先 排 空 压 力"
    docs = spark.createDataFrame([(1, "x " + passage + " y"), (2, "else")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, passage)], "item_id bigint, text string")
    assert L.leaks(docs, "doc_id", "text", items, "item_id", "text").count() == 0
    assert [tuple(r) for r in L.leaks(docs, "doc_id", "text", items, "item_id", "text", word=r"\w+").collect()] == [(1, 5)]


def test_edits_are_reported(spark):
    item = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10"
    docs = spark.createDataFrame([(1, item), (2, item.replace("e5", "zz")), (3, item.replace("e5 ", "")), (4, item.replace("e5", "e5 new")), (5, item.replace("e5", "q").replace("h8", "q"))], "doc_id bigint, text string").selectExpr("*", "1 AS edits", "2 AS name")
    items = spark.createDataFrame([(9, item), (9, item)], "item_id bigint, text string")
    got = {tuple(r) for r in L.near_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 9, 0), (2, 9, 1), (3, 9, 1), (4, 9, 1)}
