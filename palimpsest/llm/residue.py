"""Template residue, filler, error messages and script notices that stand in place of content.

1. Texts are cut into messages: sentences, and lines that no wrapping explains.
   Codes, numbers, dates and addresses are masked, so that one message has one
   normalised form wherever it occurs, and that form's hash is its name.
2. Names are grouped over the whole corpus: in how many documents and from how
   many sources a message comes.  A message *recurs widely* in at least
   ``LEAST_DOCS`` documents of ``LEAST_SOURCES`` sources.
3. Widely recurring messages are classed by broad phrase rules, which would take
   many a sentence of content for residue if it stood there once.  Other
   messages are only classed by strict rules: an unfilled placeholder (which
   stands in a sentence of its own each time), or a whole notice.
   Messages that tell of marks, settings or errors are content either way.

Rules only see texts that hold one of their trigger words, found by one
automaton pass over each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.tables import stage

LEAST_DOCS, LEAST_SOURCES = 3, 2
PLACEHOLDER, FILLER, ERROR, SCRIPTS = "placeholder", "filler", "error", "scripts"
KINDS = (PLACEHOLDER, FILLER, ERROR, SCRIPTS)

_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n\s*\n")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+|\b[\w.+-]+@[\w-]+\.[\w.]+")
_VALUE = re.compile(r"(?:\b[A-Z]{1,5}[-/])?\d+(?:[.,:/-]\d+)*")

# --- placeholders -------------------------------------------------------------------------------------------
_NAME = r"[A-Za-z][A-Za-z0-9_ .-]{0,40}"
PLACEHOLDERS = re.compile(
    r"\{\{[^{}]{0,60}\}\}"  # {{ name }}
    rf"|[$#]\{{{_NAME}\}}"  # ${name} #{name}
    rf"|%\({_NAME}\)[sdfr]"  # %(name)s
    r"|\{%[^%{}]{0,60}%\}"  # {% block name %}
    rf"|<%=?[^%<>]{{0,60}}%>|<<{_NAME}>>|<[A-Z][A-Z_ ]{{2,40}}>"
    rf"|@@{_NAME}@@|\[\[{_NAME}\]\]|__[A-Z][A-Z_ ]{{1,40}}__|%%{_NAME}%%"
    r"|\[(?:INSERT|ADD|ENTER|YOUR|TODO|TBD|PLACEHOLDER|FILL)\b[^\[\]]{0,60}\]"
    r"|\((?:TODO|TBD|FIXME)\b[^()]{0,60}\)|\b(?:TODO|FIXME):"
    r"|\{(?:\d{1,2}|[a-z][a-z_]{1,40})\}"  # {0} {name}
)
#: Words of a message that explains a mark instead of leaving it unfilled.
EXPLAINS = re.compile(
    r"\b(?:field|fields|variable|variables|config|configuration|listing|syntax|braces?|brackets?|format|prints|command line|macro"
    r"|parameter|literal|points to|array index|marks? a name|stands? for|placeholder for)\b|变量|字段|花括号|方括号|占位符表示|语法",
    re.I,
)
_SPECIAL = re.compile(r"<\|[^|<>]{1,40}\|>|<NULL>|<null>")

# --- filler -------------------------------------------------------------------------------------------------
#: The words of the usual filler text.
_LATIN_FILLER = r"(?:lorem|ipsum|dolor|amet|consectetur|adipis[ci]+ng|elit|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|minim|veniam|nostrud|ullamco|laboris|commodo|consequat)"
FILLERS = re.compile(
    rf"\b{_LATIN_FILLER}(?:\W+(?:sit|sed|do|ut|et|ad|enim|quis|in|{_LATIN_FILLER})){{2,}}\b"
    r"|\b(?:text|content|copy|description|title|heading) goes here\b|\b(?:placeholder|dummy|filler) (?:copy|text|content|paragraph)\b"
    r"|\byour (?:text|content) here\b|\b(?:insert|add|enter) (?:your )?(?:text|content|copy|body text) here\b"
    r"|\b(?:blindtext|platzhaltertext|mustertext)\b|\b(?:texte de remplissage|faux texte|texto de relleno)\b|占位(?:文字|文本|符文字)|此处(?:填写|输入)"
    r"|\b(?:x{3,}\W+){3,}x{2,}|\b(?:asdf|qwer|jkl|hjkl|sdfg|zxcv|foo|bar|blah|bla)(?:\s+(?:asdf|qwer|jkl|hjkl|sdfg|zxcv|foo|bar|blah|bla)){3,}",
    re.I,
)
_FILLED = r"(?:text|copy|content|heading|title|paragraphs?|body(?: text)?|caption|image|section|description)"
#: Of messages that recur widely: something is named as a stand-in, or as still to come.
FILLERS_BROAD = re.compile(
    rf"\b(?:sample|dummy|placeholder|filler|temporary|mock)\s+(?:\w+ )?{_FILLED}\b|\b{_FILLED}\b[^.]{{0,30}}\b(?:goes here|(?:will|to|yet to|is to) (?:follow|be (?:added|replaced|supplied|provided|completed|inserted|written|announced)))\b"
    r"|\b(?:will|to) be (?:replaced|filled in|supplied)\b[^.]{0,30}\b(?:before|later|release|publication|print)|\bcoming soon\b|\bunder construction\b|\blorem ipsum\b|\blayout (?:purposes|only)\b"
    r"|占位|待补充|待填写|待完善|示例(?:文字|文本|内容|标题)|样例文本|敬请期待|\b(?:beispieltext|platzhalter)\b|\btexte (?:provisoire|d.exemple|d.attente)\b|\btexto de (?:ejemplo|muestra)\b",
    re.I,
)

# --- errors -------------------------------------------------------------------------------------------------
_REASON = (
    r"(?:Not Found|Bad Gateway|Bad Request|Forbidden|Unauthori[sz]ed|Gone|Conflict|Internal Server Error|Service(?: Temporarily)? Unavailable|Gateway Time-?out"
    r"|Request Time-?out|Too Many Requests|Payment Required|Method Not Allowed|Precondition Failed|Moved Permanently)"
)
ERRORS = re.compile(
    rf"\b[1-5]\d\d\b[\s:–—-]{{0,4}}{_REASON}\b|\b{_REASON}\s*[(\[]\s*[1-5]\d\d\s*[)\]]|<(?:h1|title|p|b)>\s*(?:[1-5]\d\d\s*)?{_REASON}"
    r"|\bHTTP(?:/\d(?:\.\d)?)?\s+[1-5]\d\d\b|\b(?:Error|Fehler|Erreur|Status|错误)\s+[1-5]\d\d\s*(?:[.:：]|$)|\btimed out\s*[\[(]\s*[1-5]\d\d\s*[\])]"
    r"|错误代码\s*\d+|出错了|服务器(?:繁忙|错误|内部错误|暂时)|页面不存在|无法加载所?请求|无法访问此(?:页面|网站)|请求超时"
    r"|\bTraceback \(most recent call last\)|\b(?:java|javax|org|com)\.[\w.]+(?:Exception|Error)\b|\bat [\w.$]+\([\w$]+\.java:\d+\)|^\s*(?:Key|Value|Type|Index|Attribute|Runtime)Error:"
    r"|\bSomething went wrong\b|(?-i:\bFailed to (?:load|fetch|open|render|retrieve|connect)\b)"
    r"|\b(?:database|server) connection failed\b|\bconnection (?:refused|reset by peer)\b|\bthis (?:page|document|file|site|service|content) is (?:\w+ )?(?:unavailable|not available)\b|\b(?:page|document|file|site|service|content) is (?:temporarily|currently) unavailable\b"
    r"|\bsession (?:has )?(?:expired|timed out)\b|\bplease (?:sign|log) in\b|\bunable to (?:connect|load|fetch|retrieve)\b|\b(?:retry|try again) later\b"
    r"|\bplease try again (?:later|in \d+)\b"
    r"|\b(?:angeforderte|aufgerufene) Seite (?:wurde nicht gefunden|existiert nicht)|\bpage (?:demandée|introuvable)\b[^.]{0,30}(?:introuvable|n'existe|$)|\bserveur a rencontré\b|\bServerfehler\b",
    re.I | re.M,
)
_SHOWN = r"(?:load|show|display|open|render|connect|retriev|fetch|reach|process|complet|find|serv|deliver|access)\w*"
_ASKED = r"(?:page|site|server|service|document|file|content|request|viewer|session|database|connection|gateway|website|resource|index|volume|sheet|manual)"
#: Of messages that recur widely: something failed to be shown, or somebody is sent away.
ERRORS_BROAD = re.compile(
    rf"\b(?:we|us|you|server|site|service|system)\b[^.]{{0,30}}\b(?:could ?n.t|could not|unable to|failed to|prevented)\b[^.]{{0,20}}\b{_SHOWN}|\b(?:prevented us from|failed to|unable to|could not be|couldn.t be|cannot be|can.t be) {_SHOWN}\b[^.]{{0,30}}\b{_ASKED}\b"
    rf"|\b{_ASKED}\b[^.]{{0,40}}\b(?:(?:could not|cannot|can.t|couldn.t) be {_SHOWN}|(?:is|are|was) (?:temporarily |currently |no longer )?(?:unavailable|not available)|not found\W*$|(?:has )?(?:expired|timed out)|does ?n.t exist|does not exist)"
    r"|^\W*(?:oops|whoops|uh.oh|access denied|permission denied|not found|forbidden|unauthori[sz]ed|bad request|page not found|no results?|zugriff verweigert|accès refusé|acceso denegado|拒绝访问|请稍后再试)\W*$|\bwent wrong\b|\bunexpected error\b|\binternal error\b|\btoo many requests\b"
    r"|^\W*(?:error|fehler|erreur|status|错误)\s*(?:code|reference|id|number|no\.?|代码)?\s*[:#]?\s*(?:[A-Z]{1,5}[-/])?\d+\W*$|\b(?:try again|retry later|reload|refresh (?:the|this) page)\b|\bcontact (?:the |your |our )?(?:\w+ )?(?:administrator|webmaster|support|keeper)\b"
    r"|出错|(?:无法|不能|未能)(?:加载|显示|打开|访问|连接|找到)|(?:请求|连接|会话)(?:已)?(?:超时|失败|过期)|(?:页面|文件|内容|资源)(?:不存在|未找到|已删除|暂时不可用)|服务(?:器)?(?:繁忙|不可用|异常)|请(?:稍后|重新)(?:再试|重试|登录|加载)"
    r"|\bseite (?:konnte|kann|wurde)\b[^.]{0,30}\bnicht\b|\bpage (?:introuvable|demandée)|\bpágina no (?:encontrada|existe|disponible)",
    re.I,
)

# --- script notices -----------------------------------------------------------------------------------------
_SCRIPT = r"(?:\bJava ?Script\b|\bJS\b|\bscript(?:s|ing)?\b|\bactive content\b|\bcookies\b|脚本|<noscript\b)"
_SWITCH = (
    r"(?:\benabl|\bdisabled\b|\bactivat|\bturn(?:ed)? (?:\w+ )?(?:on|off)\b|\bswitch(?:ed)? (?:\w+ )?(?:on|off)\b|\brequire[sd]?\b|\bmust be allowed\b|\bworks? only with\b|\bneeds? to\b"
    r"|\b(?:does ?n.t|does not|won.t|cannot|can.t) (?:work|run|load|display)|\bactiver\b|\baktivier|\berforderlich\b|\bnécessaire\b|\ballow(?:ed)?\b|启用|允许|开启|支持|需要)"
)
SCRIPT_NOTICES = re.compile(rf"<noscript\b|{_SCRIPT}[\s\S]{{0,160}}{_SWITCH}|{_SWITCH}[\s\S]{{0,160}}{_SCRIPT}", re.I)
SCRIPTS_BROAD = re.compile(rf"{_SCRIPT}[\s\S]{{0,120}}(?:browser|浏览器|navigateur|navegador|reload|refresh|刷新)|(?:browser|浏览器|navigateur|navegador|reload|refresh|刷新)[\s\S]{{0,120}}{_SCRIPT}", re.I)

# --- messages that tell of such things ----------------------------------------------------------------------
#: The mark or message is the subject of a sentence: named as words, quoted, shown under a condition, done without, or explained.
TOLD = re.compile(
    r"\b(?:words?|phrase|term|text|string|message|code|status|letters|caption|label|so-called|called|known as)\s+[\"“'‘«]?(?:lorem|error|not found|java ?script|[1-5]\d\d\b)"
    r"|\b(?:if|when|whenever|where|should|once|unless)\b[^.]{0,60}\b(?:shows?|displays?|reads?|reports?|says|sees|gives|returns|appears?|lights?)\b"
    r"|\b(?:stands? for|refers? to|denotes|indicates that|explains)\b|^(?:(?!n.t\b|\bnot\b|\bcannot\b)[\s\S])*\bwithout (?:\w+ )?(?:java ?script|scripts?|scripting|active content|cookies)\b|\b(?:has|have|needs?|uses?|contains?) no (?:java ?script|scripts?|cookies|active content)\b"
    r"|(?:如果|若|当)[^。]{0,20}(?:显示|出现)|(?:字样|一词|表示)",
    re.I,
)
_QUOTED = re.compile(r"“[^”]*”|\"[^\"]*\"|「[^」]*」|«[^»]*»")

#: A message is only held against the rules of a kind if one of these stands in it, once case is folded; "_" is a blank.
TRIGGERS = {
    PLACEHOLDER: "{ } [[ << @@ __ %( %% <% [insert [add [enter [your [todo [tbd [placeholder [fill (todo (tbd (fixme todo: fixme: <a <b <c <d <e <f <g <h <i <j <k <l <m <n <o <p <q <r <s <t <u <v <w <x <y <z",
    FILLER: "lorem ipsum dolor amet consectetur adipis eiusmod incididunt labore aliqua veniam nostrud ullamco consequat goes_here sample_ dummy placeholder filler temporary_text temporary_co mock_ will_follow to_follow to_be_ will_be_ coming_soon under_construction layout_purposes layout_only text_here content_here copy_here blindtext platzhalter mustertext beispieltext remplissage faux_texte relleno texte_provisoire texte_d texto_de 占位 待补充 待填写 待完善 此处填写 此处输入 示例 样例 敬请期待 xxx asdf qwer jkl sdfg zxcv foo_ blah bla_",
    ERROR: "not_found gateway bad_request forbidden unauthori gone conflict error fehler erreur unavailable not_available time-out timeout timed_out too_many_requests payment_required not_allowed precondition moved_permanently http status_ 错误 出错 服务器 服务繁忙 服务不可用 服务异常 页面 文件不 内容不 资源不 无法加 无法显 无法打 无法访 无法连 无法找 不能加 不能显 不能打 不能访 不能连 不能找 未能加 未能显 未能打 未能访 未能连 未能找 超时 请求失 连接失 会话失 请求已 连接已 会话已 过期 请稍后 请重新 traceback exception went_wrong prevented failed_to unable_to_load unable_to_show unable_to_display unable_to_open unable_to_render unable_to_connect unable_to_retriev unable_to_fetch unable_to_reach unable_to_process unable_to_complet unable_to_find unable_to_serv unable_to_deliver unable_to_access could_not couldn cannot_be can't_be can’t_be connection_failed connection_re expired not_exist n't_exist n’t_exist sign_in log_in try_again retry_later reload refresh_th contact_ seite introuvable page_demand serveur página oops whoops uh-oh denied verweigert refusé denegado no_result 拒绝访问",
    SCRIPTS: "script js_ _js active_content cookies 脚本",
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in TRIGGERS.items():
        for w in words.split(" "):
            w = w.replace("_", " ") if w != "__" else w
            bits = 1 << KINDS.index(kind)
            found.add_word(w, found.get(w, 0) | bits if w in found else bits)
    found.make_automaton()
    return found


def masked(message: str) -> str:
    """The normalised form: case-folded, single blanks, without the values of codes, numbers, dates and addresses."""
    if "@" in message or "://" in message or "www." in message:
        message = _ADDRESS.sub("@", message)
    message = _VALUE.sub("0", message)
    return " ".join(message.casefold().split())


#: A text of so few lines tells no width at which its lines are wrapped; it is this at least.
FEW_LINES, LEAST_WIDTH = 4, 40


def messages(text: str) -> list[str]:
    """Sentences, and lines that end although the next word would have fitted and begins anew."""
    lines = text.split("\n")
    if len(lines) > 1:
        width = max(map(len, lines))
        if len(lines) < FEW_LINES:
            width = max(width, LEAST_WIDTH)
        joined = [lines[0]]
        for before, line in zip(lines, lines[1:]):
            begins = line[:1]
            hard = begins and not begins.islower() and len(before) + 1 + len(line.split(None, 1)[0] if line.strip() else "") <= width
            joined.append("\n\n" if hard else "\n")
            joined.append(line)
        text = "".join(joined)
    return [m for m in (" ".join(x.split()) for x in _SENTENCE.split(text)) if m]


def triggered(text: str) -> int:
    """The kinds (a bit each) of which a text holds a trigger word."""
    bits = 0
    for _, b in _automaton().iter(text.lower()):
        bits |= b
    return bits


def classify(message: str) -> tuple[str, bool]:
    """(kind, plain) of a message, ("", False) for content.  A kind that only counts where the message recurs widely has plain False."""
    bits = triggered(message)
    if not bits:
        return "", False
    of = {kind: bits >> i & 1 for i, kind in enumerate(KINDS)}
    said = _QUOTED.sub(" ", message)
    for kind, rules in ((FILLER, FILLERS), (ERROR, ERRORS), (SCRIPTS, SCRIPT_NOTICES)):
        if of[kind] and _holds(rules, said):
            return kind, True
    if of[PLACEHOLDER] and PLACEHOLDERS.search(_SPECIAL.sub(" ", message)) and not EXPLAINS.search(message):
        return PLACEHOLDER, True
    for kind, rules in ((FILLER, FILLERS_BROAD), (SCRIPTS, SCRIPTS_BROAD), (ERROR, ERRORS_BROAD)):
        if of[kind] and _holds(rules, said):
            return kind, False
    return "", False


#: What tells of a message stands before it or at most so many characters after.
TOLD_AFTER = 40


def _holds(rules: re.Pattern, said: str) -> bool:
    found = rules.search(said)
    return bool(found) and not TOLD.search(said[: found.end() + TOLD_AFTER])


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hits = _automaton()
    for b in batches:
        out: list[tuple[int, str | None, int, str, bool]] = []
        for doc, text, source in zip(b["_id"].to_pylist(), b["_text"].to_pylist(), b["_source"].to_pylist(), strict=True):
            if next(hits.iter(" ".join(text.lower().split())), None) is None:
                continue
            seen: set[int] = set()
            for m in messages(text):
                kind, sure = classify(m)
                if kind:
                    name = xxhash.xxh3_64_intdigest(masked(m).encode("utf-8", "surrogatepass"))
                    if name not in seen:
                        seen.add(name)
                        out.append((doc, source, name, kind, sure))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(np.array(cols[2], np.uint64).view(np.int64)), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())],
            ["doc_id", "source", "name", "kind", "plain"],
        )


def classed_messages(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, name, kind, plain): every different message of every document that a rule classes, strictly (plain) or broadly.

    A message that no rule classes is content however often it recurs, so it has no row.
    Null, empty and blank texts have no message; a null source counts as one source.
    """
    rows = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS _id", f"`{text}` AS _text", f"CAST(`{source}` AS STRING) AS _source").filter(F.col("_id").isNotNull() & (F.length("_text") > 0))
    return stage(rows.mapInArrow(_classed, "doc_id bigint, source string, name bigint, kind string, plain boolean"), "messages")


def recurring(messages_: DataFrame) -> DataFrame:
    """(name, n_docs, n_sources, kind, plain, wide) of each message over the whole corpus; pre-aggregated per source."""
    per_source = messages_.groupBy("name", "source").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"), F.max("plain").alias("plain"))
    groups = per_source.groupBy("name").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_sources"), F.max("kind").alias("kind"), F.max("plain").alias("plain"))
    return groups.withColumn("wide", (F.col("n_docs") >= LEAST_DOCS) & (F.col("n_sources") >= LEAST_SOURCES))


def residue(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, kind): documents with residue in place of content, once per kind."""
    found = classed_messages(docs, doc_id, text, source)
    wide = recurring(found).filter("wide AND NOT plain").select("name")
    by_recurrence = found.filter("NOT plain").select("doc_id", "name", "kind").join(wide, "name").select("doc_id", "kind")
    return found.filter("plain").select("doc_id", "kind").unionAll(by_recurrence).distinct()
