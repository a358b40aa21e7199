"""Cut texts, broken pairs and residue: rules, constructed defects with their precision and recall, edge cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import cuts as U
from palimpsest.llm import pairs as D
from palimpsest.llm import residue as R

SUBJECTS = "pump valve gauge relay duct latch".split()
PLACES = "forward aft left right inner outer".split()


def whole_sentence(r):
    a, b = r.choice(SUBJECTS), r.choice(SUBJECTS)
    return r.choice(
        [
            f"Before the {r.choice(PLACES)} {a} is removed, drain {r.randint(10, 999)} psi from the {r.choice(PLACES)} {b} and tag it for reuse.",
            f"The {r.choice(PLACES)} {a} feeds the {b} through breaker KX-{r.randint(1000, 9999)}, which opens at {r.randint(10, 999)} kPa.",
            f"If the {a} shows less than {r.randint(10, 99)} volts, set the {r.choice(PLACES)} {b} to standby and wait {r.randint(2, 60)} seconds.",
        ]
    )


def texts():
    r = random.Random(6)
    rows, cut = [], set()
    for i in range(900):
        t = " ".join(whole_sentence(r) for _ in range(r.randint(1, 4)))
        source = r.choice("abc")
        if i % 9 == 0:
            t += f" For limits of the {r.choice(SUBJECTS)} refer to Table {r.randint(1, 9)}-{r.randint(1, 60)}"
        elif i % 9 == 1:
            t += f" To service the {r.choice(SUBJECTS)}, do in order:"
        elif source == "a" and len(t) > 150 and i % 2:
            t = t[:150]
            cut |= set() if t.endswith(".") else {i}
        elif i % 17 == 0:
            k = r.randint(40, len(t) - 12)
            if t[k - 1] not in ". " and t[k] not in ". ":
                t, cut = t[:k], cut | {i}
        rows.append(("c", i, source, t))
    return rows, cut


def test_cuts_found_and_spike_seen(spark):
    rows, cut = texts()
    extra = [("c", 5000, None, None), ("c", 5001, "b", ""), ("c", 5002, "b", "..."), ("c", None, "b", "x"), rows[0]]
    df = spark.createDataFrame(rows + extra, "column string, row_id bigint, source string, text string").selectExpr("*", "1 AS shape", "2 AS n")
    staged = U.analysed(df)
    got = {r.row_id for r in U.judged(staged).filter("NOT complete").collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.03 * len(cut) + 1
    spike = U.spikes(U.open_ended(staged)).filter("unit = 'chars'").collect()
    assert [(s.source, s.length) for s in spike] == [("a", 150)]
    assert U.judged(U.analysed(df.limit(0))).count() == 0


def test_unclosed_and_trailing_off():
    assert U.parts("Whole. Then it sto…") == (["Whole"], "Then it sto")
    assert U.unclosed("see (KX-1") and not U.unclosed("see (KX-1)") and U.balanced('reads "NO STEP"')


def test_continued_over_ranges(spark):
    rows = [(1, i, i, i % 3 == 0, i % 2 == 1) for i in range(40)] + [(2, 100, 0, True, True), (2, 100, 0, True, True)]
    got = {r.row_id: r.continued for r in U.continued(spark.createDataFrame(rows, "version_id bigint, row_id bigint, position bigint, asks boolean, continues boolean")).collect()}
    assert got == {**{i: i + 1 < 40 and (i + 1) % 2 == 1 for i in range(0, 40, 3)}, 100: False}


SOURCE = "Before the left pump KX-1234 is removed, drain 300 psi from the aft valve and tag it."
ANSWER = "拆下左泵KX-1234之前，应从后阀排出300 psi，并挂签。"


@pytest.mark.parametrize(
    ("answer", "cut", "expected"),
    [
        (ANSWER, False, None), (None, False, "empty"), (" 　", False, "empty"), ("——", False, "empty"), ("​", False, "empty"),
        ("抱歉，我无法翻译这段内容。", False, "refusal"), ("I'm sorry, but I can't translate this passage.", False, "refusal"), ("该请求已被拒绝，请咨询专业译员。", False, "refusal"),
        (SOURCE, False, "copied"), (SOURCE.upper(), False, "copied"), ("“" + SOURCE.replace(",", "").replace(" ", "  ") + "”", False, "copied"),
        ("Si el indicador KX-1234 baja de 300 psi, ponga el interruptor en ON y repita.", False, "wrong_language"), ("整備員は KX-1234 を取り外す前に確認します。", False, "wrong_language"),
        ("Перед снятием блока KX-1234 убедитесь, что давление не выше 300 psi.", False, "wrong_language"),
        ("拆下左泵KX-1234之前，应从后", True, "truncated"), (ANSWER.rstrip("。"), False, None),
        ('语音单元回答“抱歉，请求被拒绝”，此时拆下左泵KX-1234并排出300 psi。', False, None),
    ],
)
def test_votes_tell_defects(answer, cut, expected):
    v = D.votes(SOURCE, answer, cut, True)
    # with the priors alone, on a corpus of mostly sound pairs
    kept = [d for d, votes in zip(D.DEFECTS, v, strict=True) if D.fit(d, {D.encode_votes(votes): 1, D.encode_votes(D.votes(SOURCE, ANSWER, False, True)[D.DEFECTS.index(d)]): 200})[D.encode_votes(votes)] >= D.CUTOFFS[d]]
    assert kept == ([expected] if expected else [])


def kept_defects(source, answer, cut=False):
    """The defects kept with the priors alone, on a corpus of mostly sound pairs."""
    sound = D.votes(SOURCE, ANSWER, False, True)
    fits = ((d, D.encode_votes(v), D.encode_votes(w)) for d, v, w in zip(D.DEFECTS, D.votes(source, answer, cut, True), sound, strict=True))
    return [d for d, v, w in fits if D.fit(d, {v: 1} | {w: 200 + (v == w)})[v] >= D.CUTOFFS[d]]


@pytest.mark.parametrize(
    "answer",
    [
        "申し訳ありませんが、この文章は翻訳できません。", "翻訳できません。", "この質問にはお答えできません。", "죄송합니다. 漢字 원문은 번역할 수 없습니다.",
        "I'm sorry, but I cannot translate this text into 中文.", "Leider kann ich den Text nicht ins 中文 übersetzen.", "К сожалению, я не могу перевести это на 中文.", "Je suis désolé, je ne peux pas traduire en 中文.",
    ],
)
def test_refusals_that_hold_han_characters(answer):
    assert kept_defects(SOURCE, answer) == ["refusal"]


ASK_BACKS = [
    "请提供更多上下文。", "请问您指的是哪个阀？", "需要更多上下文才能继续。", "请粘贴需要翻译的文本。", "Please supply more context.", "Could you clarify which pump KX-1234 is meant?", "What do you mean by tag?", "Please provide the text you want me to translate.",
    "Bitte geben Sie mehr Kontext an.", "Welches Ventil meinen Sie?", "Veuillez fournir plus de contexte.", "Pourriez-vous préciser la phrase ?", "Por favor, proporcione más contexto.", "Serve più contesto.", "Forneça mais contexto, por favor.",
    "Пожалуйста, уточните, о каком клапане идёт речь.", "Нужно больше контекста.", "文脈をもう少し教えてください。", "翻訳したい文章を入力してください。", "문맥을 더 알려 주세요.",
]


@pytest.mark.parametrize("answer", ASK_BACKS)
def test_bare_ask_backs_are_refusals(answer):
    assert kept_defects(SOURCE, answer) == ["refusal"]


@pytest.mark.parametrize(
    ("source", "answer"),
    [
        ("Please provide more details of the fault to the maker of the pump.", "请提供更多故障细节给泵的制造商。"), ("The context of the fault must be given in the report.", "报告中必须给出故障的上下文。"),
        ("Consult the maker before the valve is opened.", "打开阀门前请咨询制造商。"), ("The screen asks which valve is meant.", "屏幕显示“请问您指的是哪个阀？”字样。"),
    ],
)
def test_translated_requests_are_no_refusals(source, answer):
    assert kept_defects(source, answer) == []


@settings(max_examples=400, deadline=None)
@given(st.from_regex(D._ASKS_BACK))
def test_marks_leave_no_ask_back_out(text):
    assert D.asks_back(text)


def test_label_model_on_bare_ask_backs(spark):
    rows = [(i, SOURCE, ASK_BACKS[i // 40 % len(ASK_BACKS)] if i % 40 == 0 else ANSWER, False, True) for i in range(800)]
    df = spark.createDataFrame(rows, "pair_id bigint, source_text string, answer string, cut boolean, source_stops boolean")
    got = {x.pair_id: x.defect for x in D.main_defect(D.defects(D.voted(df))).collect()}
    assert got == dict.fromkeys(range(0, 800, 40), "refusal")


def test_copies_that_hold_han_characters():
    source = "Press the key marked 停止 before the left pump is removed."
    assert kept_defects(source, source.upper()) == ["copied"]


@settings(max_examples=400, deadline=None)
@given(st.from_regex(D._DECLINES), st.sampled_from(["", "阀", "中文 "]))
def test_marks_leave_no_refusal_out(refusal, before):
    assert D._DECLINES.search(before + refusal) is None or D.declines(before + refusal)


@pytest.mark.parametrize(("source", "answer"), [("KX-1234", "KX-1234"), ("300 psi", "300 psi"), ("°", "°"), ("Δp 30 N, α 8°", "Δp 30 N，α 8°"), ("ON", "ON"), (None, "阀")])
def test_kept_codes_are_no_defect(source, answer):
    v = D.votes(source, answer, False, False)
    assert all(votes[0] < 1 for d, votes in zip(D.DEFECTS, v, strict=True) if d != D.EMPTY) and v[0][0] < 1 or answer == "°"


def test_label_model_on_broken_pairs(spark):
    r = random.Random(2)
    rows, truth = [], {}
    for i in range(1500):
        code, n = f"KX-{r.randint(1000, 9999)}", r.randint(10, 999)
        en = f"Before the left pump {code} is removed, drain {n} psi from the aft valve and tag it for reuse."
        zh, cut = f"拆下左泵{code}之前，应从后阀排出{n} psi，并挂签以便再次使用。", False
        if i % 25 == 0:
            kind = D.DEFECTS[(i // 25) % 5]
            truth[i] = kind
            zh = {"empty": r.choice(["", "…", None]), "refusal": r.choice(["抱歉，我不能处理该请求。", "Sorry, this request was declined."]), "copied": en.lower(), "wrong_language": "Si l'indicateur descend sous 20 V, placez le commutateur sur ON.", "truncated": zh[: r.randint(12, 24)]}[kind]
            cut = kind == "truncated"
        rows.append((i, en, zh, cut, True))
    df = spark.createDataFrame(rows, "pair_id bigint, source_text string, answer string, cut boolean, source_stops boolean")
    found = D.defects(D.voted(df))
    got = {x.pair_id: x.defect for x in D.main_defect(found).collect()}
    assert got == truth
    assert D.main_defect(D.defects(D.voted(df.limit(0)))).count() == 0


@pytest.mark.parametrize(
    ("message", "kind"),
    [
        ("Connect gauge {{ gauge }} to the pump.", "placeholder"), ("drain ${limit} from the pump", "placeholder"), ("see [INSERT FIGURE HERE]", "placeholder"), ("part %(part)s", "placeholder"), ("<<AUTHOR>>", "placeholder"),
        ("Lorem ipsum dolor sit amet, consectetur", "filler"), ("Text goes here.", "filler"), ("此处为占位文字，正式内容待补充。", "filler"), ("xxxxx xxxx xxxxx xxx", "filler"),
        ("404 Not Found", "error"), ("Error 500: Internal Server Error", "error"), ("抱歉，您访问的页面不存在（错误代码 404）。", "error"), ("Traceback (most recent call last):", "error"), ("Not Found (404)", "error"),
        ("Please enable JavaScript to view this page.", "scripts"), ("请启用 JavaScript 以查看此页面。", "scripts"), ("<noscript>JS must be allowed</noscript>", "scripts"),
        ("The export writes the tail number into the field {tail_no}, where braces mark a name.", ""), ("If the tablet shows error 404, the sheet was not loaded.", ""), ("Typists left the words lorem ipsum on sheet 4.", ""),
        ("The viewer runs without JavaScript, so no browser setting has to be changed.", ""), ("A page not found in the index may be bound behind the tab.", ""), ("drain 404 psi from the pump", ""), ("", ""), ("<|endoftext|>", ""),
    ],
)
def test_residue_rules(message, kind):
    assert R.classify(message)[0] == kind


def test_residue_over_documents(spark):
    rows = [(1, "Good content stands here.", "s"), (2, "Title\n\nAccess denied.", "s"), (3, "Access denied.", "t"), (4, "Access denied.", None), (5, None, "s"), (6, "", "s"), (7, " \n", "s"), (8, "Home\nPlease enable JavaScript to read.", "s"), (9, "Oops!", "u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS name", "'x' AS kind")
    assert {r.doc_id for r in R.residue(df, "doc_id", "text", "source").collect()} == {2, 3, 4, 8}
    assert R.masked("See HYD-12 at 12:30, http://a.b/c") == R.masked("See KX-9 at 7, http://x.y")
    assert R.residue(df.limit(0), "doc_id", "text", "source").count() == 0
