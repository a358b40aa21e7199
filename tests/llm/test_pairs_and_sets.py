"""Near-duplicates, look-alikes, leaks, packing and tokens against brute force and round trips."""

import base64
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import confusables as C
from palimpsest.llm import leaks as L
from palimpsest.llm import packing as P
from palimpsest.llm import tokens as K
from palimpsest.llm.dart_minhash import signatures
from palimpsest.llm.near_duplicates import linked_pairs, membership, near_duplicates

WORDS = [f"word{i}" for i in range(300)]


def runs(t, k=3):
    w = t.lower().split(" ")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_signature_agreement_estimates_weighted_likeness():
    r = np.random.default_rng(1)
    h = r.integers(1, 2**63, 120, dtype=np.uint64)
    w = r.uniform(0.05, 1, 120)
    a, b = np.arange(0, 90), np.arange(30, 120)
    sig = signatures(np.concatenate((h[a], h[b])), np.array([0, 90, 180]), np.concatenate((w[a], w[b])), 512)
    true = w[30:90].sum() / w.sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.08
    assert (sig != 0).all()
    assert (signatures(h[:0], np.array([0, 0]), w[:0], 8) == 0).all()


def passages():
    r = random.Random(3)
    rows, n = [], 0
    for _ in range(120):
        base = r.choices(WORDS, k=r.choice([16, 30, 60]))
        for _ in range(r.choice([1, 1, 2, 4])):
            t = list(base)
            for _ in range(r.choice([0, 1, 2, 6])):
                t[r.randrange(len(t))] = r.choice(WORDS)
            n += 1
            rows.append((n, " ".join(t), None))
    rows += [(n + 1 + i, "the same hot passage repeated " * 4, None) for i in range(30)]
    rows += [(9001, None, "  Null normal form: " + " ".join(WORDS[:20])), (9002, None, None), (9003, "", ""), (9004, "too short", None)]
    return [(i, t.strip() if t else t, c) for i, t, c in rows]


def test_near_duplicates_against_brute_force(spark):
    rows = passages()
    texts = {i: (t if t is not None else " ".join((c or "").split())) for i, t, c in rows}
    live = {i: runs(t) for i, t in texts.items() if t.count(" ") >= 15}
    truth = {(a, b) for a in live for b in live if a < b and len(live[a] & live[b]) / len(live[a] | live[b]) >= 0.5}
    df = spark.createDataFrame(rows + rows[:9], "id bigint, normalized string, canonical_text string").selectExpr("*", "1 AS cls", "2 AS key")
    found = near_duplicates(df, 0.5, least_words=16)
    got = [tuple(r) for r in linked_pairs(found).collect()]
    assert len(got) == len(set(got)) and set(got) <= truth
    assert len(set(got)) >= 0.99 * len(truth)
    m = {r.id: r for r in membership(found).collect()}
    assert set(m) == set(live) and m[9001].n_copies == 1 and max(r.n_copies for r in m.values()) == 30
    none = spark.createDataFrame([], "id bigint, normalized string, canonical_text string")
    assert linked_pairs(near_duplicates(none, 0.5)).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("fine", "ﬁne", True), ("ABC 12", "ＡＢＣ　１２", True), ("é", "é", True), ("soft", "so­ft", True), ("a b", "a b", True), ("Acetone", "Асеtоnе", True), ("x​y", "xy", True),
        ("Abc", "abc", False), ("l0", "lO", False), ("1l", "ll", False), ("a  b", "a b", False), ("resume", "résumé", False), ("m²", "m2", False),
    ],
)
def test_skeletons(a, b, same):
    assert (C.skeleton(a) == C.skeleton(b)) is same
    assert (C.consistent(a) == C.consistent(b)) is same


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_skeleton_is_idempotent_and_follows_composition(s):
    assert C.skeleton(C.skeleton(s)) == C.skeleton(s)
    assert C.skeleton(unicodedata.normalize("NFC", s)) == C.skeleton(unicodedata.normalize("NFD", s)) == C.skeleton(s)


def test_look_alike_pairs(spark):
    long = " ".join(WORDS[:16])
    rows = [(1, None, long), (2, None, long.replace("o", "о")), (3, None, long), (4, None, long + "."), (5, None, None), (6, "", ""), (2, None, long.replace("o", "о"))]
    df = spark.createDataFrame(rows, "id bigint, normalized string, canonical_text string").selectExpr("*", "0 AS look")
    assert sorted(tuple(r) for r in C.look_alike_pairs(df, 16).collect()) == [(1, 2), (2, 3)]
    groups = {r.id: (r.group_id, r.n_rows, r.n_spellings) for r in C.look_groups(df, 16).collect()}
    assert groups == {1: (1, 3, 2), 2: (1, 3, 2), 3: (1, 3, 2), 4: (4, 1, 1)}
    forms = C.consistent_forms(df.filter("id = 5"), "canonical_text").first()
    assert forms.canonical_text_form is None
    assert C.look_alike_pairs(df.limit(0), 16).count() == 0


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = WORDS[:60]
    items = [(i, " ".join(r.choices(vocabulary, k=25))) for i in range(12)] + [(50, "short one"), (51, None), (52, "")]
    docs = []
    for d in range(150):
        t = r.choices(vocabulary, k=40)
        if d % 3 == 0:
            w = items[r.randrange(12)][1].split()
            a = r.randrange(15)
            t[10:10] = w[a : a + r.choice([8, 9, 10, 14])]
        docs.append((d, ", ".join(t).upper() if d % 2 else " ".join(t)))
    docs += [(900, None), (901, ""), (902, "中文 only"), (None, items[0][1])]
    gram = lambda t: {tuple(L.words_of(t)[i : i + 10]) for i in range(len(L.words_of(t)) - 9)}
    truth = {(d, i) for d, t in docs if d is not None for i, x in items if gram(t) & gram(x)}
    ddf = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS key", "2 AS words")
    idf = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(x) for x in L.leaks(ddf, "doc_id", "text", idf, "item_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == truth and truth

    def near(a, b):
        return any(L.within_edits(np.array(x), np.array(y), 1) for x in gram(a) for y in gram(b))

    wide = {(d, i) for d, t in docs if d is not None and t for i, x in items if x and near(t, x)}
    found = {tuple(x) for x in L.leaks(ddf, "doc_id", "text", idf, "item_id", "text", max_edits=1).collect()}
    assert found <= wide and truth <= found and len(found) >= 0.95 * len(wide)
    assert L.leaks(ddf.limit(0), "doc_id", "text", idf.limit(0), "item_id", "text").count() == 0


def test_leaks_with_a_word_added_left_out_or_changed(spark):
    r = random.Random(9)
    items = [(i, " ".join(r.choices(WORDS[:60], k=25))) for i in range(12)]
    docs = []
    for d in range(120):
        i, at = r.randrange(12), r.randrange(15)
        w = items[i][1].split()[at : at + 10]
        place = 2 + r.randrange(6)
        w[place : place + (d % 3 > 0)] = [] if d % 3 == 1 else [f"other{d}"]
        if d % 5 == 0 and d % 2:  # two edits
            w[0:1] = ["otherwise", "added"]
        docs.append((d, " ".join(w if d % 7 == 0 else [*r.choices(WORDS[200:], k=12), *w, *r.choices(WORDS[200:], k=12)])))
    hashes = {x: k for k, x in enumerate({w for _, t in docs + items for w in t.split()})}
    cut = lambda t, n: [tuple(hashes[x] for x in t.split()[a : a + n]) for a in range(len(t.split()) - n + 1)]
    tens = [(i, b) for i, t in items for b in cut(t, 10)]
    # at most one edit leaves four of ten words alike in place from the front or the back
    close = lambda a, b: a[:4] == b[:4] or a[-4:] == b[-4:]
    truth = {(d, i) for d, t in docs for n in (9, 10, 11) for a in cut(t, n) for i, b in tens if close(a, b) and L.within_edits(np.array(a), np.array(b), 1)}
    ddf, idf = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(x) for x in L.leaks(ddf, "doc_id", "text", idf, "item_id", "text", max_edits=1).collect()]
    assert len(got) == len(set(got)) and set(got) <= truth and len(got) >= 0.97 * len(truth)
    for kind in range(3):
        assert sum(d % 3 == kind for d, _ in truth) > 25


def test_packing_is_whole_and_tight(spark):
    r = random.Random(4)
    lengths = [r.choice([0, 3, 8, 40, 200, 600, 900, 1500, 1800, 4000]) for _ in range(700)]
    windows = P.pack(lengths, 1800)
    seen = {}
    for w in windows:
        assert sum(p[2] for p in w) <= 1800 and w == sorted(w)
        for item, start, n in w:
            seen.setdefault(item, []).append((start, n))
    assert {i: sum(n for _, n in s) for i, s in seen.items()} == dict(enumerate(lengths))
    assert all(len(s) == 1 for i, s in seen.items() if lengths[i] <= 1800)
    assert len(windows) <= 1.1 * -(-sum(lengths) // 1800)
    groups = P.step_groups([sum(p[2] for p in w) for w in windows])
    assert max(np.bincount(groups)) <= P.GROUP
    assert P.pack([], 1800) == []
    rows = [(7, i, i, n) for i, n in enumerate(lengths)] + [(7, 3, 3, lengths[3]), (None, 9000, None, None), (8, 9001, 20_000, 5), (8, 9002, 1, 5), (8, None, 2, 5)]
    df = spark.createDataFrame(rows, "v bigint, id bigint, place bigint, n int").selectExpr("*", "1 AS seq", "2 AS stretch")
    out = P.pack_sequences(df, "v", "id", "place", "n", 1800).collect()
    assert sum(x.filled for x in out if x.seq == 7) == sum(lengths)
    assert sorted(list(x.item_ids) for x in out if x.seq == 8) == [[9001], [9002]] and [list(x.item_ids) for x in out if x.seq is None] == [[9000]]
    assert P.pack_sequences(df.limit(0), "v", "id", "place", "n", 1800).count() == 0


PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(K.DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \n\t'sdtmrevl19.中")), max_size=25), max_size=6))
def test_tokens_equal_the_library(reference, texts):
    assert K.encode(texts) == [reference.encode_ordinary(t) for t in texts]


def test_token_columns(spark, reference):
    rows = [(1, "it's <|endoftext|>  fine\n"), (2, ""), (3, None), (4, "长" * 3000), (5, "x" * 20_000)]
    df = spark.createDataFrame(rows, "k bigint, t string").selectExpr("*", "1 AS ids")
    enc = K.encode_column(df, "k", "t")
    got = {r.k: r.ids for r in enc.collect()}
    assert got == {k: reference.encode_ordinary(t or "") for k, t in rows}
    assert {r.k: r.text for r in K.decode_column(enc, "k", "ids").collect()} == {k: t or "" for k, t in rows}
    text = rows[0][1]
    assert "".join(text[a:b] for a, b, _ in K.encode_offsets(text)) == text
    assert K.encode_column(df.limit(0), "k", "t").count() == 0
