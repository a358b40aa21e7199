"""Broken prompt and response pairs, by noisy labelling functions and a label model per defect.

Every defect has six or seven labelling functions that look at different things
(phrases, lengths, values, scripts, order of words, endings over the corpus)
and vote for it (+1), against it (-1) or not at all (0).  How often each vote
pattern occurs over all pairs is all the label model sees: a two-class model
with independent votes, fitted by expectation maximisation.  What is known
beforehand about the functions only starts the fit; its weight is ``STRENGTH``
of the pairs.  A pair keeps every defect whose posterior reaches the cutoff,
so a text in another language may be cut as well.  Cutoffs are chosen on pairs
broken on purpose (``palimpsest.llm.validate_pairs``).

A defect that its definition rules out for a pair is barred there: a pair with
a source under five words cannot be a copy, one whose source has no full stop
cannot be cut, and what refuses or gives the source back is not in another
language.  Barred pairs take no part in the fit.

There are at most 3^7 + 1 patterns of a defect, so what reaches the driver and
what is broadcast is bounded whatever the number of pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.confusables import skeleton
from palimpsest.sources.tables import stage

EMPTY, REFUSAL, COPIED, WRONG_LANGUAGE, TRUNCATED = DEFECTS = ("empty", "refusal", "copied", "wrong_language", "truncated")
LEAST_COPIED_WORDS = 5

_QUOTED = re.compile(r"“[^”]*(?:”|$)|\"[^\"]*\"|「[^」]*」|『[^』]*』|«[^»]*»")
_DECLINES = re.compile(
    r"(?:无法|不能|不便|恕难|难以|不可以)[^。]{0,8}(?:翻译|译文|处理(?:该|此|这)|回答|答复|协助|完成(?:该|此|这))|(?:请求|要求)(?:已)?被拒绝|超出了?我的|作为(?:一个|一名)?(?:语言助手|语言模型|人工智能|AI)|不予(?:翻译|提供)"
    r"|\b(?:can ?not|can.?t|unable to|not able to|won.?t|will not|may not|refuse to)\s+(?:\w+ ){0,2}(?:translat|help|assist|answer|provid|process|comply|complete|continue)"
    r"|\b(?:must|have to|need to) decline\b|\brequest (?:was|has been|is) (?:declined|refused|denied|rejected)\b|\bno translation can\b|\boutside (?:of )?what i\b|\bbeyond (?:my|what i)\b"
    r"|\bas an? (?:large )?(?:ai|language model|language assistant|assistant)\b|\bagainst (?:my|the|our) (?:policy|guidelines)\b"
    r"|\bkann (?:ich )?[^.]{0,40}nicht (?:übersetzen|beantworten|helfen|bearbeiten)|\bleider kann\b|\bes tut mir leid\b|\bals sprachmodell\b"
    r"|\bje (?:ne )?(?:peux|suis|puis)[^.]{0,30}pas\b[^.]{0,40}(?:traduire|aider|répondre)|\bdésolé|\ben tant que modèle\b"
    r"|\bno puedo (?:traducir|ayudar|responder)|\blo siento\b|\bcomo modelo de lenguaje\b|\bnon posso (?:tradurre|aiutare)|\bnão posso (?:traduzir|ajudar)"
    r"|не могу (?:перевести|помочь|ответить)|извините|к сожалению|как языковая модель|申し訳|翻訳できません|お手伝いできません|お答えできません|죄송|번역할 수 없|도와드릴 수 없|답변할 수 없",
    re.I,
)
_OPENS = re.compile(
    r"^\W*(?:很?抱歉|对不起|不好意思|作为|恕|我(?:无法|不能|不便)|该请求|此请求|这个问题|sorry|i.?m sorry|i am sorry|apologies|unfortunately|as an? |i (?:am|can|must|have|cannot|will)\b|that is outside|this request|no translation"
    r"|leider|es tut|désolé|je |lo siento|no puedo|извините|к сожалению|申し訳|죄송)",
    re.I,
)
_ASKS = re.compile(
    r"请提供更多|请咨询|如有其他问题|乐意帮忙|使用规定|敏感内容|更多上下文|more context|another wording|anything else (?:you|i)|content policy|restricted data|rephrase|weitere(?:n)? kontext|plus de contexte|más contexto|больше контекста",
    re.I,
)
#: Asks back about the text to translate, which alone makes an answer a refusal.
_ASKS_BACK = re.compile(
    r"(?:提供|补充|给出|需要|缺少|说明|告诉我|告知)[^。？！?!]{0,10}(?:上下文|语境|背景(?:信息|资料))|请(?:您|你)?(?:再)?提供更多|(?:提供|发送|粘贴|输入|发给我)[^。？！?!]{0,8}(?:需要?|要|想|待)翻译|(?:您|你)(?:指的|的意思|想问的|想说的)是|(?:您|你)是指|请问(?:您|你|这|此|该|原文)"
    r"|\b(?:more|further|additional|extra|enough|some|without) (?:\w+ )?context\b|\b(?:provide|supply|give|share|send|need)\b[^.?!]{0,20}\bcontext\b|\b(?:please|you) (?:re)?(?:clarify|phrase)\b|\b(?:do|did|would) you mean\b"
    r"|\b(?:provide|supply|give|share|send|paste|enter)\b[^.?!]{0,20}\b(?:text|passage|sentence|content)\b[^.?!]{0,30}\btranslat"
    r"|\b(?:mehr|weitere[nr]?|zusätzliche[nr]?) (?:kontext|zusammenhang)\b|\bmeinen sie\b|\bmeinst du\b|\b(?:könnten|können) sie\b[^.?!]{0,30}\b(?:präzisieren|klarstellen|erläutern, was)"
    r"|\b(?:plus de|davantage de) contexte\b|\bcontexte supplémentaire\b|\b(?:pourriez|pouvez|voulez)-vous (?:préciser|clarifier|reformuler|dire)\b"
    r"|\b(?:más|mayor) contexto\b|\b(?:mais) contexto\b|\bcontexto adicional\b|\b(?:podría|podrías|puede|puedes|poderia|pode) (?:aclarar|reformular|esclarecer)\b|\b(?:più|maggior[ei]?|ulteriore) contesto\b|\bcontesto aggiuntivo\b|\b(?:potrebbe|può|puoi|potresti) (?:chiarire|riformulare)\b"
    r"|(?:больше|дополнительный|дополнительного) контекст|контекста не хватает|пожалуйста,? уточните|уточните,? пожалуйста|не могли бы вы (?:уточнить|пояснить)|что вы имеете в виду"
    r"|(?:文脈|コンテキスト|背景情報)[^。？！]{0,12}(?:教えて|提供|ご提示|提示して|お知らせ|必要|不足)|もう少し[^。？！]{0,8}教えて|どういう意味です|翻訳(?:したい|する|してほしい)[^。？！]{0,12}(?:入力して|提供して|教えて|送って|お送り)"
    r"|(?:문맥|맥락)[^.?!]{0,12}(?:제공|알려|필요|부족|주세요)|번역할 [^.?!]{0,16}(?:주세요|알려|입력)|무슨 뜻인가요",
    re.I,
)
#: One of these stands in every text that ``_ASKS_BACK`` finds, once case is folded.
_ASK_MARKS = (
    *("上下文", "语境", "背景", "提供更多", "翻译", "您指的", "你指的", "您的意思", "你的意思", "您想", "你想", "您是指", "你是指", "请问"),
    *("context", "clarify", "phrase", "you mean", "translat", "kontext", "zusammenhang", "meinen sie", "meinst du", "nnen sie", "nnten sie", "-vous ", "aclarar", "reformular", "esclarecer", "contesto", "chiarire", "riformulare"),
    *("контекст", "уточни", "пояснить", "имеете в виду", "文脈", "コンテキスト", "もう少し", "どういう意味", "翻訳", "문맥", "맥락", "번역할", "무슨 뜻"),
)
#: A source that itself speaks of such things may be translated by a text that seems to ask back.
_SOURCE_ASKS = re.compile(
    r"\b(?:context|background|clarif\w+|(?:re)?phras\w+|translat\w+)\b|\byou mean\b|\b(?:provide|supply|give|send|share|submit|state|offer)\b[^.?!]{0,30}\b(?:more|further|additional|extra)\b", re.I
)
_VALUE = re.compile(r"(?:[A-Z]{1,5}-)?\d+(?:\.\d+)*")
_CODE = re.compile(r"\b[A-Z]{1,5}-\d+\b")
_LETTERS = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.!?。！？][\"'”’)）\]」』]*$")
_TRAILING_OFF = re.compile(r"(?:…|\.{3,})[\s…]*$")
_HAN = re.compile("[㐀-䶿一-鿿]")
_OTHER_SCRIPT = re.compile("[぀-ヿㇰ-ㇿ가-힯ᄀ-ᇿЀ-ӿ֐-ۿऀ-෿฀-๿]")
# Frequent function words of languages in Latin script.
FUNCTION_WORDS = frozenset(
    "the of and to in is for on that with as at by from this be are or an it not when if should first about"
    " der die das und ist nicht den dem ein eine mit von für auf zu wenn vor nach bei unter"
    " le la les des et est une du dans pour que pas sur avant ne si sous avec au aux"
    " el los las del que una por con para si en no y se ponga"
    " il lo gli che di per con non una sono della o os as um uma não para com".split()
)
#: Characters of an answer per character of an English source; below it an answer is suspiciously short.
SHORT = 0.22


#: Of ASCII: what is neither letter nor digit, and what is blank or a control character.
_NO_WORD = {c: None for c in range(128) if not chr(c).isalnum()}
_NOT_SHOWN = {c: None for c in (*range(33), 127)}


def folded(text: str) -> str:
    """Letters and digits of a text's skeleton, without case."""
    if text.isascii():
        return text.lower().translate(_NO_WORD)
    return "".join(c for c in skeleton(text).casefold() if c.isalnum() or unicodedata.category(c) == "Mn")


#: One of these stands in every text that ``_DECLINES`` finds, whatever its language, once case is folded.
_DECLINE_MARKS = (
    *"无法 不能 不便 恕难 难以 不可以 被拒绝 超出 作为 不予 translat help assist answer provid process compl continue decline request outside beyond against".split(),
    *("as a", "kann", "es tut", "sprachmodell", "je ", "désolé", "en tant", "puedo", "siento", "modelo", "posso", "не могу", "извините", "к сожалению", "как языковая"),
    *("申し訳", "できません", "죄송", "번역할 수", "도와드릴 수", "답변할 수"),
)
_LATIN_RUN = re.compile(r"[a-z]{2}")
#: Han characters and all that a skeleton may turn into one.
_HAN_LIKE = re.compile("[\u2e80-\u9fff\uf900-\ufaff\ufe30-\ufe4f\U0001f200-\U0001f2ff\U00020000-\U0003ffff]")
_SPEAKS = re.compile(r"[^\W_]")


def _shown(text: str) -> str:
    if text.isascii():
        return text.translate(_NOT_SHOWN)
    return "".join(c for c in text if unicodedata.category(c)[0] not in "ZC")


def _caseless(text: str) -> str:
    """Case folded as ``re.I`` sees it, for which both Turkish letters are an i."""
    return text.replace("İ", "i").replace("ı", "i").casefold()


def declines(unquoted: str, low: str | None = None) -> bool:
    """Whether ``_DECLINES`` finds something; the expression itself only runs where one of its marks stands."""
    low = _caseless(unquoted) if low is None else low
    return any(m in low for m in _DECLINE_MARKS) and bool(_DECLINES.search(unquoted))


def asks_back(unquoted: str, low: str | None = None) -> bool:
    """Whether ``_ASKS_BACK`` finds something, by way of its marks likewise."""
    low = _caseless(unquoted) if low is None else low
    return any(m in low for m in _ASK_MARKS) and bool(_ASKS_BACK.search(unquoted))


#: A text that speaks of itself or its writer, and words (by how they begin) about translating and helping.
_SELF_MARKS = re.compile("我(?!们|国|方|军)|本(?:助手|模型|系统无法)|私|わたし|저는|제가")
_SELF_WORDS = frozenset("i me my myself ai ich mir mein meine meiner je mon moi yo puedo siento mío io posso eu я мне могу".split())
_TALK_MARKS = re.compile("翻译|译文|译员|请求|要求被|回答|答复|协助|帮助您|帮到|上下文|语境|敏感|政策|规定(?:不|所)|抱歉|对不起|翻訳|文脈|お手伝い|번역|문맥|요청")
_TALK_WORDS = tuple(
    "translat request assist help answer context policy comply sorry apolog clarif rephras declin refus übersetz anfrage kontext traduire traduction demande contexte traducir traducción solicitud contexto contesto tradurre перевести перевод запрос контекст".split()
)


def _speaks_of_itself(text: str, words: set[str]) -> bool:
    return not words.isdisjoint(_SELF_WORDS) or not text.isascii() and bool(_SELF_MARKS.search(text))


def _talks(text: str, words: set[str]) -> bool:
    return any(w.startswith(_TALK_WORDS) for w in words) or not text.isascii() and bool(_TALK_MARKS.search(text))


def _word_set(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


_COMMON_HAN = re.compile("[的了在是并将与和及应请不为至从到时后前该此或再由于]")
_KANA = re.compile("[\u3040-\u30ff\u31f0-\u31ff]")
_HAN_STOP = re.compile("[。，、；：]")
_LATIN_STOP = re.compile(r"[^\W\d_][.,] ?(?:[^\W\d_]|$)")
_OPEN_TAIL = re.compile(r"[,，、;；:：(（\[“「『《‘/-]\s*$|(?:的|了|和|与|及|并|或|在|从|将|把|对|向|为|由|at|the|of|and|to|in|or)$")
_ANY_STOP = re.compile(r"[.!?。！？]+(?=\s|$|[\"'”’)）\]」』]|[^\x00-\x7f])|[。！？]")
#: Answers this much shorter than an English source are suspicious, and this much longer are not.
LONG_ENOUGH = 0.3
BARRED = -2


def _refusal(source: str, unquoted: str, values: set[str], told: set[str], asks: bool, declines_: bool, recurs: int | None) -> tuple[int, ...]:
    words = _word_set(unquoted)
    talk, itself = _talks(unquoted, words), _speaks_of_itself(unquoted, words)
    if talk or itself:  # a source that says so itself explains it
        theirs = _word_set(source)
        talk &= not _talks(source, theirs)
        itself &= not _speaks_of_itself(source, theirs)
    return (
        1 if declines_ else -1,
        1 if asks else (0 if _ASKS.search(unquoted) else -1),
        1 if _OPENS.match(unquoted) else -1,
        1 if itself else -1,
        0 if not values else (-1 if values & told else 1),
        1 if talk else -1,
        0 if recurs is None or len(unquoted) < LEAST_RECURRING_CHARS else (1 if recurs >= LEAST_RECURRENCE else -1),
    )


def _empty(source: str, answer: str, speaks: bool, values: set[str], told: set[str]) -> tuple[int, ...]:
    if speaks:
        return -1, -1, -1, -1, (0 if not values else (-1 if values & told else 1)), 0
    flat, given = _shown(answer), _shown(source)
    kept = bool(flat) and flat == given
    return (
        1,
        1 if not flat else (0 if all(unicodedata.category(c)[0] == "P" for c in flat) else -1),
        1 if _SPEAKS.search(source) else -1,
        1 if len(flat) < 3 and len(flat) < 0.05 * len(given) else (0 if not flat else -1),
        1 if values else 0,
        -1 if kept else 0,
    )


def _copied(source: str, answer: str, f_answer: str, f_source: str, same: bool, han: bool, values: set[str], told: set[str], words: int) -> tuple[int, ...]:
    if words < LEAST_COPIED_WORDS:
        return (BARRED,) * 7
    said, given = ([w.casefold() for w in _LETTERS.findall(skeleton(x))] for x in (answer, source))
    own, theirs = set(said), set(given)
    both = set(zip(said, said[1:])) & set(zip(given, given[1:]))
    return (
        1 if same else -1,
        1 if len(own) >= LEAST_COPIED_WORDS and len(own & theirs) >= 0.9 * len(own) else -1,
        0 if f_source and 0.85 <= len(f_answer) / len(f_source) <= 1.15 else -1,
        -1 if han and not _HAN.search(source) else 0,
        1 if f_answer[:12] == f_source[:12] and f_answer[-6:] == f_source[-6:] else -1,
        0 if values == told else -1,
        1 if len(said) >= LEAST_COPIED_WORDS and len(both) >= 0.8 * len(set(zip(said, said[1:]))) else -1,
    )


def _wrong_language(source: str, answer: str, n_han: int) -> tuple[int, ...]:
    plain = _CODE.sub(" ", answer)
    n_other = len(_OTHER_SCRIPT.findall(plain))
    words = [w for w in _LETTERS.findall(plain) if len(w) > 1 and not w.isupper() and not _HAN.search(w)]
    letters = n_han + max(n_other, sum(map(len, words)))
    low_words = {w.casefold() for w in words}
    low = source.casefold() if len(low_words) >= 3 else ""
    foreign = sum(w not in low for w in low_words)
    return (
        0 if not letters else (1 if letters >= 6 and n_han < 0.1 * letters else (-1 if n_han >= 0.5 * letters else 0)),
        1 if n_other >= 3 else -1,
        1 if not low_words.isdisjoint(FUNCTION_WORDS) else -1,
        1 if foreign >= 3 else -1,
        1 if _KANA.search(plain) else (-1 if _COMMON_HAN.search(plain) else (1 if letters >= 6 and not n_han else 0)),
        -1 if _HAN_STOP.search(answer) and not n_other else (1 if _LATIN_STOP.search(answer) else 0),
    )


def _truncated(source: str, answer: str, cut: bool, at_limit: bool | None, values: set[str]) -> tuple[int, ...]:
    tail = _TRAILING_OFF.sub("", answer.rstrip())
    stops = bool(_STOP.search(tail))
    size = len(answer) / max(1, len(source))
    sentences = len(_ANY_STOP.findall(source)) - len(_ANY_STOP.findall(answer))
    # what tells that content is missing hangs together, so it is one vote
    missing = (size < SHORT) + (sentences > 1) - (size >= LONG_ENOUGH) - (sentences <= 0)
    last = _VALUE.findall(source)[-1] if values else None
    return (
        1 if cut else -1,
        -1 if stops else 1,
        1 if missing > 0 else (-1 if missing < 0 else 0),
        0 if last is None else (-1 if last in _VALUE.findall(answer) else 1),
        1 if not stops and (_OPEN_TAIL.search(tail) or len(tail) < len(answer.rstrip())) else 0,
        1 if at_limit and not stops else 0,
    )


def votes(source: str | None, answer: str | None, cut: bool, source_stops: bool, recurs: int | None = None, at_limit: bool | None = None) -> tuple[tuple[int, ...], ...]:
    """The votes of all labelling functions, a tuple per defect in the order of ``DEFECTS``; barred defects hold ``BARRED``.

    ``recurs``: of how many different sources the answer is given; ``at_limit``: whether its length is one at which
    its provider cuts.  Null where nobody knows.
    """
    source, answer = source or "", answer or ""
    speaks = bool(_SPEAKS.search(answer))
    values = set(_VALUE.findall(source))
    told = set(_VALUE.findall(answer)) if speaks else set()
    empty = _empty(source, answer, speaks, values, told)
    if not speaks:
        return empty, *((BARRED,) * n for n in (7, 7, 6, 6))
    unquoted = _QUOTED.sub(" ", answer if answer.isascii() else unicodedata.normalize("NFKC", answer))
    low = _caseless(unquoted)
    asks, declines_ = asks_back(unquoted, low) and not _SOURCE_ASKS.search(source), declines(unquoted, low)
    refuses = asks or declines_
    refusal = _refusal(source, unquoted, values, told, asks, declines_, recurs)
    n_han = len(_HAN.findall(answer))
    wrapped = source.replace("-\n", "")
    if n_han and (wrapped.isascii() or not _HAN_LIKE.search(wrapped)):  # the skeleton keeps Han characters, so nothing with one of them equals a text without
        same = given_back = False
        copied = (-1, -1, -1, -1, -1, 0 if values == told else -1, -1) if _words(wrapped) >= LEAST_COPIED_WORDS else (BARRED,) * 7
    else:
        f_answer, f_source = folded(answer), folded(wrapped)
        same = bool(f_answer) and f_answer in (f_source, folded(source))
        copied = _copied(wrapped, answer, f_answer, f_source, same, bool(n_han), values, told, _words(skeleton(wrapped)))
        given_back = same or copied[1] > 0 or _shown(answer) == _shown(source)
    wrong = (BARRED,) * 6 if given_back or refuses else _wrong_language(source, answer, n_han)
    truncated = _truncated(wrapped, answer, cut, at_limit, values) if source_stops and not same else (BARRED,) * 6
    return empty, refusal, copied, wrong, truncated


def _words(text: str) -> int:
    """How many pieces hold a letter; counted as far as it matters."""
    n = 0
    for w in text.split():
        n += w.isalpha() or bool(_LETTERS.search(w))
        if n > LEAST_COPIED_WORDS:
            break
    return n


#: Shorter pairs repeat often; what they got is kept for so many of them.
KEPT_PAIRS, KEPT_CHARS = 50_000, 120


@lru_cache(maxsize=KEPT_PAIRS)
def _kept_codes(*pair) -> tuple[int, ...]:
    return tuple(map(encode_votes, votes(*pair)))


def _codes(source: str | None, answer: str | None, *rest) -> tuple[int, ...]:
    if len(source or "") + len(answer or "") <= KEPT_CHARS:
        return _kept_codes(source, answer, *rest)
    return tuple(map(encode_votes, votes(source, answer, *rest)))


def _against(defective: float, sound: float) -> tuple[tuple[float, float, float], ...]:
    """A function that votes against a defect with these probabilities, and else not at all."""
    return tuple((p, 0.999 - p, 0.001) for p in (defective, sound))


#: Where the fit starts: per defect and function, the probability of a vote for it on defective pairs and on sound ones.
TRUST = {
    EMPTY: ((0.99, 0.001), (0.7, 0.001), (0.95, 0.002), (0.9, 0.002), (0.6, 0.1), _against(0.01, 0.1)),
    REFUSAL: ((0.75, 0.001), (0.35, 0.001), (0.7, 0.005), (0.6, 0.01), (0.8, 0.1), (0.75, 0.01), (0.7, 0.05)),
    COPIED: ((0.95, 0.0005), (0.95, 0.002), _against(0.05, 0.9), _against(0.02, 0.95), (0.9, 0.002), _against(0.05, 0.3), (0.95, 0.001)),
    WRONG_LANGUAGE: ((0.8, 0.002), (0.5, 0.001), (0.6, 0.002), (0.6, 0.002), (0.7, 0.01), (0.6, 0.02)),
    TRUNCATED: ((0.95, 0.005), (0.98, 0.05), (0.7, 0.05), (0.7, 0.05), (0.3, 0.02), (0.3, 0.001)),
}
#: What is left goes to abstaining in this share, the rest to votes against.
ABSTAIN = 0.2
PRIOR = 0.02
#: Weight of what is known beforehand, as a share of the pairs that count.
STRENGTH = 0.02
#: Posterior from which a defect is kept, chosen on pairs broken on purpose (validate_pairs).
CUTOFFS = {EMPTY: 0.5, REFUSAL: 0.01, COPIED: 0.5, WRONG_LANGUAGE: 0.5, TRUNCATED: 0.35}
#: An answer of so many characters or more that so many different sources get is boilerplate.
LEAST_RECURRING_CHARS, LEAST_RECURRENCE = 6, 3


def encode_votes(v: tuple[int, ...]) -> int:
    """The pattern's number; barred ones are 0."""
    if v[0] == BARRED:
        return 0
    code = 1
    for x in v:
        code = code * 3 + x + 1
    return code


def decode_votes(code: int, n: int) -> tuple[int, ...]:
    out = []
    for _ in range(n):
        code, x = divmod(code, 3)
        out.append(x - 1)
    return tuple(reversed(out))


def fit(defect: str, counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Posterior of the defect per vote pattern, by expectation maximisation over the patterns' counts; 0 where it is barred."""
    trust = TRUST[defect]
    patterns = sorted(p for p in counts if p)
    m, total = len(trust), sum(counts[p] for p in patterns)
    if not total:
        return dict.fromkeys(counts, 0.0)
    v = np.array([decode_votes(p, m) for p in patterns]) + 1
    n = np.array([counts[p] for p in patterns], float)
    prior = np.empty((2, m, 3))
    for j, (hit, false) in enumerate(trust):
        for y, p in ((1, hit), (0, false)):
            prior[y, j] = p if isinstance(p, tuple) else ((1 - p) * (1 - ABSTAIN), (1 - p) * ABSTAIN, p)
    theta, share = prior.copy(), PRIOR
    weight = np.array([STRENGTH * total * (1 - PRIOR), STRENGTH * total * PRIOR])
    for _ in range(rounds):
        logs = np.stack([np.log(theta[y, np.arange(m), v]).sum(1) + np.log(share if y else 1 - share) for y in (0, 1)])
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        for y, w in ((1, n * post), (0, n * (1 - post))):
            for j in range(m):
                seen = np.array([w[v[:, j] == x].sum() for x in range(3)])
                theta[y, j] = (seen + weight[y] * prior[y, j]) / (seen.sum() + weight[y])
        share = (float((n * post).sum()) + PRIOR * STRENGTH * total) / (total * (1 + STRENGTH))
    return dict.fromkeys(counts, 0.0) | {p: float(x) for p, x in zip(patterns, post, strict=True)}


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        given = zip(*(b[x].to_pylist() for x in ("source_text", "answer", "cut", "source_stops", "recurs", "at_limit")), strict=True)
        codes = [_codes(*row) for row in given]
        columns = list(zip(*codes, strict=True)) if codes else [()] * len(DEFECTS)
        yield pa.RecordBatch.from_arrays([b["pair_id"], *(pa.array(c, pa.int32()) for c in columns)], ["pair_id", *DEFECTS])


def recurring_names(pairs: DataFrame) -> DataFrame:
    """(answer_name, recurs): answers that at least ``LEAST_RECURRENCE`` different sources get.  ``pairs``: answer_name, source_name.

    Pairs are made distinct first, so an answer that fills a third of all rows
    is one row per different source, and counts are partial before the shuffle.
    """
    counted = pairs.select("answer_name", "source_name").distinct().groupBy("answer_name").agg(F.count(F.lit(1)).cast("int").alias("recurs"))
    return counted.filter(F.col("recurs") >= LEAST_RECURRENCE)


def recurring_answers(pairs: DataFrame) -> DataFrame:
    """The same of ``pairs`` (source_text, answer); answers are named digits aside, short ones not at all."""
    named = pairs.filter(F.length("answer") >= LEAST_RECURRING_CHARS)
    return recurring_names(named.select(answer_name("answer").alias("answer_name"), F.xxhash64("source_text").alias("source_name")))


def answer_name(answer: str) -> Column:
    return F.xxhash64(F.regexp_replace(F.lower(answer), "[0-9]+", "0"))


def voted(pairs: DataFrame) -> DataFrame:
    """(pair_id, a vote pattern per defect) of ``pairs`` (pair_id, source_text, answer, cut, source_stops and, if known, at_limit and recurs), staged."""
    kind = "pair_id bigint, " + ", ".join(f"{d} int" for d in DEFECTS)
    at_limit = F.col("at_limit") if "at_limit" in pairs.columns else F.lit(None).cast("boolean")
    rows = pairs.withColumn("at_limit", at_limit)
    if "recurs" not in pairs.columns:
        rows = rows.withColumn("answer_name", answer_name("answer")).join(recurring_answers(rows), "answer_name", "left").withColumn("recurs", F.coalesce("recurs", F.lit(1)))
    return stage(rows.select("pair_id", "source_text", "answer", "cut", "source_stops", "recurs", "at_limit").mapInArrow(_voted, kind), "votes")


def defects(votes_: DataFrame) -> DataFrame:
    """(pair_id, defect, posterior): every defect of every pair whose posterior reaches its cutoff."""
    spark = votes_.sparkSession
    long = votes_.select("pair_id", F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS))).alias("x")).select("pair_id", "x.*")
    counted: dict[str, dict[int, int]] = {d: {} for d in DEFECTS}
    for r in long.groupBy("defect", "pattern").count().collect():  # at most 2188 patterns of each of five defects
        counted[r["defect"]][r["pattern"]] = r["count"]
    kept = [(d, p, x) for d in DEFECTS for p, x in fit(d, counted[d]).items() if x >= CUTOFFS[d]]
    table = spark.createDataFrame(kept, "defect string, pattern int, posterior double")
    return long.join(F.broadcast(table), ["defect", "pattern"]).select("pair_id", "defect", "posterior")


def main_defect(found: DataFrame) -> DataFrame:
    """(pair_id, defect): of the defects a pair keeps, the first of ``DEFECTS``: what is empty says nothing, what refuses
    or gives the source back is not judged by its language, and a text that stops early is named by what it says."""
    rank = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
    return found.groupBy("pair_id").agg(F.min_by("defect", rank).alias("defect"))
