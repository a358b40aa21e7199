"""The label model: it decides where single functions err, and pairs may keep several defects."""

import random

import pytest

from palimpsest.llm import pairs as D

SOURCE = "Before the left pump KX-1234 is removed, drain 300 psi from the aft valve and tag it. Record the reading of the gauge at 17 mm."
ANSWER = "拆下左泵KX-1234之前，应从后阀排出300 psi，并挂签。记录压力表在17 mm处的读数。"
FRENCH_CUT = "Avant de déposer la pompe gauche KX-1234, vidangez la soupape"


def corpus():
    """(pattern counts per defect, votes): mostly sound pairs, some broken ones."""
    r = random.Random(3)
    rows = []
    for i in range(3000):
        rows.append((SOURCE, ANSWER if i % 7 else ANSWER.rstrip("。"), False))
    for i in range(120):
        rows.append((SOURCE, ANSWER[: r.randint(14, 30)], True))
        rows.append((SOURCE, "Avant de déposer la pompe, vidangez 300 psi de la soupape arrière et notez la valeur.", False))
    rows += [(SOURCE, ANSWER[:20], False)] * 6  # cut where whole sentences end alike, so the corpus statistics pass it
    rows += [(SOURCE, FRENCH_CUT, True)] * 4
    return rows


@pytest.fixture(scope="module")
def posteriors():
    rows = corpus()
    voted = [D.votes(s, a, c, True) for s, a, c in rows]
    out = []
    for i, defect in enumerate(D.DEFECTS):
        codes = [D.encode_votes(v[i]) for v in voted]
        counts = {c: codes.count(c) for c in set(codes)}
        post = D.fit(defect, counts)
        out.append([post[c] for c in codes])
    return rows, voted, out


def test_model_differs_from_every_single_function(posteriors):
    _, voted, post = posteriors
    i = D.DEFECTS.index(D.TRUNCATED)
    kept = [p >= D.CUTOFFS[D.TRUNCATED] for p in post[i]]
    for j in range(6):
        alone = [v[i][j] > 0 for v in voted]
        assert alone != kept
    missed_by_endings = [k for k, v in zip(kept, voted, strict=True) if v[i][0] < 0 and v[i][1] > 0 and v[i][3] > 0]
    assert missed_by_endings and all(missed_by_endings)
    lacks_only_the_stop = [k for k, v in zip(kept, voted, strict=True) if v[i][0] < 0 and v[i][1] > 0 and v[i][3] < 0]
    assert lacks_only_the_stop and not any(lacks_only_the_stop)


def test_pairs_keep_several_defects(posteriors):
    rows, _, post = posteriors
    at = [k for k, row in enumerate(rows) if row[1] == FRENCH_CUT]
    for k in at:
        assert [d for d, p in zip(D.DEFECTS, post, strict=True) if p[k] >= D.CUTOFFS[d]] == [D.WRONG_LANGUAGE, D.TRUNCATED]


def test_every_defect_has_five_functions_that_can_vote():
    assert all(len(t) >= 5 for t in D.TRUST.values())
    seen = {d: [set() for _ in t] for d, t in D.TRUST.items()}
    answers = [ANSWER, ANSWER[:16], None, "…", "°", SOURCE, SOURCE.lower(), SOURCE.upper()[:90], FRENCH_CUT, "抱歉，我无法翻译这段内容。", "请提供更多上下文。", "I cannot translate this request", "整備員は KX-1234 を取り外す前に確認します。", "拆下左泵，", "Si baja, ponga el interruptor. Y repita 5 veces."]
    for a in answers:
        for recurs in (None, 1, 9):
            for cut in (True, False):
                for d, v in zip(D.DEFECTS, D.votes(SOURCE, a, cut, True, recurs, cut), strict=True):
                    for j, x in enumerate(v):
                        seen[d][j].add(x)
    seen[D.EMPTY][5] |= {D.votes("°", "°", False, False)[0][5]}
    for d, sets in seen.items():
        for s in sets:
            assert s & {0, 1} and s & {-1, 0} and len(s - {D.BARRED}) > 1, (d, sets)


def test_barred_defects_have_no_posterior():
    assert D.encode_votes((D.BARRED,) * 6) == 0
    assert D.fit(D.TRUNCATED, {0: 5})[0] == 0.0
    assert D.fit(D.COPIED, {}) == {}
    v = D.decode_votes(D.encode_votes((1, -1, 0, 0, 1, -1)), 6)
    assert v == (1, -1, 0, 0, 1, -1)


def test_recurring_answers(spark):
    rows = [(i, f"source {i}", f"抱歉，无法翻译第{i}段。", False, True) for i in range(5)] + [(9, "source 1", None, False, True), (10, None, "抱歉，无法翻译第7段。", False, True), (11, "a", "b", False, True)]
    df = spark.createDataFrame(rows, "pair_id bigint, source_text string, answer string, cut boolean, source_stops boolean")
    got = [r.recurs for r in D.recurring_answers(df).collect()]
    assert got == [6]
