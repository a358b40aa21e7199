"""Cutoffs of the label model, chosen on pairs broken on purpose.

    python -m palimpsest.llm.validate_pairs DIR [SEED]

A sample of at most ``SAMPLE`` pairs of the tables in DIR is broken in one way
each (emptied, refused, given back, put into another language, cut inside the
last sentence); the label model is fitted on all pairs of the tables, the broken
ones held out, and per defect the cutoff in the middle of those with
an F1 within ``NEAR_BEST`` of the best, over broken and untouched pairs, is printed with its figures.  The
refusals used here are worded apart from the lists of ``pairs``; texts in other
languages come from the documents table.  Nothing of this runs in a query.
"""

from __future__ import annotations

import random
import sys
from collections import Counter

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import pairs as P
from palimpsest.llm.cuts import analysed, judged
from palimpsest.llm.queries import pair_rows
from palimpsest.llm.truncation import TRANSLATIONS, answer_texts
from palimpsest.sources.tables import table

SAMPLE = 6000
#: F1 over a few hundred broken pairs is no surer than this.
NEAR_BEST = 0.003
EMPTIES = (None, "", "  ", "　\n", "​", "...", "——", "？", "。。。", "- -")
REFUSALS = (
    "抱歉，这段文字超出我能处理的范围。", "我无法翻译此内容，请换一段试试。", "对不起，我不能协助完成该请求。", "作为AI助手，我不便提供该译文。", "请提供更多上下文，以便我准确翻译。", "请问您指的是哪一个部件？",
    "I am not able to translate this text.", "Sorry, I can't help with that request.", "As an AI language model I cannot assist with this.", "Could you provide more context for this passage?", "I must decline to translate this.",
    "Es tut mir leid, ich kann diesen Text nicht übersetzen.", "Je suis désolé, je ne peux pas traduire ce texte.", "Lo siento, no puedo traducir este texto.", "К сожалению, я не могу перевести этот текст.", "申し訳ありませんが、翻訳できません。", "죄송합니다. 번역할 수 없습니다.",
)


def _copy(source: str, r: random.Random) -> str:
    return r.choice((source, source.upper(), source.lower(), " ".join(source.split()), f"“{source}”", source.replace(",", ""), source.rstrip(".")))


def _cut(answer: str, r: random.Random) -> str | None:
    start = max(answer[:-2].rfind("。"), 0)
    if len(answer) - start < 9 or not answer.endswith(("。", "！", "？")):
        return None
    return answer[: r.randrange(start + 4, len(answer) - 3)]


def broken(source: str, answer: str, defect: str, foreign: list[str], r: random.Random) -> tuple[bool, str | None]:
    """(whether the pair can be broken so, the broken answer)."""
    if defect == P.EMPTY:
        return bool(P._SPEAKS.search(source)), r.choice(EMPTIES)
    if defect == P.REFUSAL:
        return True, r.choice(REFUSALS)
    if defect == P.COPIED:
        return P._words(source) >= P.LEAST_COPIED_WORDS + 1, _copy(source, r)
    if defect == P.WRONG_LANGUAGE:
        return bool(foreign), r.choice(foreign) if foreign else None
    text = _cut(answer, r)
    return text is not None, text


def best_cutoff(posterior: np.ndarray, positive: np.ndarray) -> tuple[float, float, float]:
    """(cutoff, precision, recall): the middle of the cutoffs of nearly best F1."""
    grid = np.concatenate(([0.01, 0.02], np.arange(0.05, 1, 0.05), [0.98, 0.99]))
    scores = []
    for c in grid:
        kept = posterior >= c
        hit = (kept & positive).sum()
        precision, recall = hit / max(1, kept.sum()), hit / max(1, positive.sum())
        scores.append((2 * precision * recall / max(1e-9, precision + recall), precision, recall))
    top = np.flatnonzero(np.array([s[0] for s in scores]) >= max(s[0] for s in scores) - NEAR_BEST)
    at = top[len(top) // 2]
    return float(grid[at]), float(scores[at][1]), float(scores[at][2])


def validate(spark: SparkSession, root: str, seed: int = 5, sample: int = SAMPLE) -> dict[str, tuple[float, float, float]]:
    """Per defect (cutoff, precision, recall) over broken pairs and the untouched rest of the sample."""
    r = random.Random(seed)
    rows = pair_rows(spark, root).select("pair_id", "source_text", "answer", "cut", "source_stops", "at_limit", "recurs")
    found = P.main_defect(P.defects(P.voted(rows))).select("pair_id", "defect")
    chosen = rows.join(found, "pair_id", "left").filter("defect IS NULL AND answer IS NOT NULL AND source_text IS NOT NULL").orderBy(F.xxhash64("pair_id", F.lit(seed))).limit(sample).collect()
    texts = table(spark, root, "documents").filter("lower(substr(lang, 1, 2)) IN ('fr', 'de', 'es')").select(F.substring("text", 1, 400).alias("t")).orderBy(F.xxhash64("t")).limit(2000).collect()
    foreign = [s for x in texts if x.t for s in x.t.replace("\n", " ").split(". ") if len(s.split()) >= 6]
    made: list[tuple[int, str, str | None, str]] = []
    kept: list = []
    for k, row in enumerate(chosen):
        ok, text = broken(row.source_text, row.answer, P.DEFECTS[k % 10], foreign, r) if k % 10 < 5 else (False, None)
        if ok:
            made.append((k, row, text, P.DEFECTS[k % 10]))
        elif k % 10 >= 5:
            kept.append(row)
    cut_texts = spark.createDataFrame([(TRANSLATIONS, -1 - k, None, t) for k, _, t, d in made if d == P.TRUNCATED], "column string, row_id bigint, source string, text string")
    ends = judged(analysed(answer_texts(spark, root).unionAll(cut_texts))).filter("row_id < 0 AND NOT complete").select("row_id").collect()
    cut = {-1 - x.row_id for x in ends}
    votes = [(P.votes(row.source_text, t, k in cut, row.source_stops, 1, False), d) for k, row, t, d in made]
    votes += [(P.votes(row.source_text, row.answer, row.cut, row.source_stops, 1, row.at_limit), "") for row in kept]
    out = {}
    pattern = P.voted(rows)
    for i, defect in enumerate(P.DEFECTS):
        counts: Counter[int] = Counter({x[defect]: x["count"] for x in pattern.groupBy(defect).count().collect()})
        codes = [P.encode_votes(v[i]) for v, _ in votes]
        counts.update({c: 0 for c in codes})  # judged by the fit, which they take no part in
        posterior = P.fit(defect, dict(counts))
        # what is broken otherwise may have this defect too
        mine = [(posterior[c], d == defect) for c, (_, d) in zip(codes, votes, strict=True) if d in ("", defect)]
        out[defect] = best_cutoff(np.array([x for x, _ in mine]), np.array([y for _, y in mine]))
    return out


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name, (cutoff, precision, recall) in validate(session, sys.argv[1], *map(int, sys.argv[2:3])).items():
        print(f"{name}: cutoff {cutoff:.2f}, precision {precision:.4f}, recall {recall:.4f}")
