"""Template residue, filler, error pages and scripts-required notices in place of content (problem 8).

Method: every text is cut into units (whole text, body of a section, value of a field) and every unit into
messages (lines, else sentences). Numbers, addresses, dates and ids in a message are masked and the normalised
message is hashed; equal hashes are grouped over all documents and sources. Phrase rules classify a message as
filler, error or scripts notice; a placeholder rule finds unfilled slots outside of code and quotations. Messages that
no phrase names are classified by their group: one that recurs widely (``min_docs`` documents in ``min_sources``
sources) and stands beside classified messages in at least ``company`` of its places belongs to the pages these come
from, whatever it says. A share does not depend on the size of the corpus, so sentences of real content, which recur
as well in a large one, stay content. A unit is residue if it holds a classified message and nothing but such
messages, page furniture and messages classified by their group, or if it is made of the latter alone, where they
stand beside classified ones in ``sure`` of their places.

Defined results: a null or blank text is kept (``reason`` null), as is a row without doc_id; repeated rows are judged alike; an empty table
gives an empty result; columns of the input beyond those named are ignored.
"""

from __future__ import annotations

import functools
import html
import json
import re
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.common import cut, spread

# ---- fixed values: placeholder syntaxes -------------------------------------------------------------------
SLOT = re.compile(
    r"""\{\{[-~]?\s*[.$]?[^\W\d][^{}\n]{0,60}\}\}      # {{ name }}, {{.Name}}
      | \{%-?\s*[^\W\d][^{}%\n]{0,60}-?%\}              # {% name %}
      | \$\{[^\W\d][\w.]{0,60}\}                        # ${NAME}
      | \#\{[^\W\d][\w. ]{0,60}\}                       # #{name}
      | <%[=-]?[^<>\n]{1,60}%>                          # <%= name %>
      | (?<![A-Za-z0-9_%])%(?:[A-Z][A-Z0-9_]{2,40}|[一-鿿]{1,20})%(?![A-Za-z0-9_])  # %NAME%
      | (?<![A-Za-z0-9_@])@@[^\W\d]\w{0,60}?@@          # @@name@@
      | (?<![A-Za-z0-9_])__(?:[A-Z][A-Z0-9_]{1,60}?|[一-鿿]{1,20})__(?![A-Za-z0-9_])  # __NAME__
      | <(?i:your|insert|enter|add|fill|replace|ihr|hier)\b[^<>\n]{1,60}>
      | <[^<>\n]{0,6}(?:请|待)[^<>\n]{0,30}>
      | <your\s[^<>\n]{1,40}\shere>
      | \[(?i:insert|enter|your|add|fill\sin|replace|to\sbe)\b[^\[\]\n]{1,60}\]
      | \[[^\[\]\n]{0,40}(?i:folgt|einfügen|eintragen|ergänzen|here|hier)\]
      | \[\[[^\W\d][^\[\]\n]{0,60}\]\]                  # [[name]]
      | 【(?:请|待|填|此处|在此)[^】\n]{0,40}】
      | \[(?:请|待|填|此处|在此)[^\]\n]{0,40}\]
      | （(?:请|待|此处|在此|请在此)?(?:填写|填入|填|插入|替换|补充)[^（）\n]{0,30}）
      | [\[（(<【](?i:platzhalter|placeholder|ausfüllen|占位符?)[^\]）)>】\n]{0,30}[\]）)>】]
      | \$\([^\W\d]\w{0,60}\)                             # $(name)
      | (?<![A-Za-z0-9_.])(?:CHANGE_?ME|REPLACE_?ME|FILL_?ME(?:_?IN)?|FIX_?ME_?NAME|YOUR_[A-Z_]+_HERE|INSERT_[A-Z_]+_HERE)(?![A-Za-z0-9_])
      | %![A-Za-z]?\([^()\n]{0,40}\)                    # %!s(MISSING)
      | <no\svalue>|<nil>|<undefined>|\[object\sObject\]
    """,
    re.X,
)
#: {name} alone is a slot only in prose: after a slash it is a route parameter, after a letter a composite literal.
BARE_SLOT = re.compile(r"(?<![A-Za-z0-9_/$#{%=)\]])\{[^\W\dA-Z][\w ]{0,40}\}(?![}A-Za-z0-9_/])")

# ---- fixed values: phrases --------------------------------------------------------------------------------
FILLER = re.compile(
    r"""sample\stext|dummy\s(?:text|paragraph|copy)|placeholder\s(?:text|copy)|(?:description|content|text|more)\s(?:is\s)?coming\ssoon
      | your\s(?:text|content|description)\s(?:goes\s)?here|add\s(?:content|text|a\sdescription)\s(?:for|to|in)\s(?:this|the)\b|some\stext\shere
      | write\s(?:a|your)\s[\w\s]{0,30}(?:in\sthis\sbox|here)|to\sbe\s(?:supplied|written|announced|completed)\.?$
      | lorem\sipsum|replace\sbefore\spublishing|under\sconstruction|text\sto\sfollow|insert\s(?:text|content)\shere
      | ^(?:tbd|tba|todo|n/?a|none|bla(?:\W+bla)*|foo(?:\W+bar)?(?:\W+baz)?|test(?:\W+test)*|asdf\w*|qwert\w*|abc|xyz|placeholder|untitled)\W*$
      | platzhalter(?:text)?\b|blindtext|hier\s(?:steht|folgt|kommt)\b|inhalt\s(?:folgt|kommt)|text\sfolgt|beispieltext|wird\snoch\s(?:ergänzt|ausgefüllt)|mustertext
      | 占位(?:文本|文字|内容|符)|示例(?:文字|文本|段落|内容)|内容待(?:补充|补|填)|敬请期待|待补充|此处(?:填写|输入|为示例)|在此(?:填写|输入)|请替换|测试测试|暂无(?:内容|描述|说明)|正文待|稍后补充|说明待
    """,
    re.X,
)
SCRIPTS = re.compile(
    r"""(?:enable|allow|activate|turn\son|require[sd]?|needs?|without|execute|disabled)\b[^.]{0,50}\b(?:javascript|scripts?|js)\b
      | \b(?:javascript|scripts?|js)\b[^.]{0,40}(?:disabled|is\soff|must\sbe|required|turned\soff|not\senabled|to\srun|in\syour\sbrowser)
      | checking\syour\sbrowser
      | (?:javascript|skripte?)\b[^.]{0,40}(?:aktivier|zugelassen|erlaub|deaktiviert|eingeschaltet|benötig|erforderlich)
      | (?:aktivieren|erlauben|benötigt|führt\skeine)\b[^.]{0,40}(?:javascript|skripte?)
      | (?:启用|开启|允许|打开|需要|未开启|禁用|关闭了?)[^。]{0,10}(?:脚本|\s?javascript)|(?:脚本|javascript)[^。]{0,8}(?:被禁用|未启用|未开启|已关闭)
    """,
    re.X,
)
ERROR = re.compile(
    r"""^\W*(?:error\W+|http(?:/\d(?:\.\d)?)?\s)?(?:[45]\d\d\W{1,3})?(?:not\sfound|forbidden|unauthorized|bad\s(?:gateway|request)|gateway\stime-?out|service\s(?:temporarily\s)?unavailable|internal\sserver\serror|too\smany\srequests|request\stimeout|gone|zeitüberschreitung|未找到页面|服务器)(?:\W*$|\W+\(|\W+am\b)
      | zeitüberschreitung\sam\sgateway
      | ^\W*(?:error|fehler|错误)\s?\d{3,4}\b|page\s(?:was\s|could\s)?not\s(?:be\s)?found|(?:could|can)(?:\snot|n't)\sfind\s(?:that|the|this)\s(?:document|page|file|resource)
      | something\swent\swrong|request\s(?:was\s)?blocked|session\s(?:has\s|is\s)?(?:expired|timed\sout)|(?:permission|not\sallowed|not\sauthori[sz]ed)\sto\s(?:view|access|see|read)
      | (?:site|service|system|page|server)\s(?:is\s)?(?:currently\s)?(?:down|under\smaintenance|undergoing\smaintenance|offline)|maintenance\smode
      | (?:repository|page|document|service|resource|site|file)\sis\s(?:not|currently\sun|temporarily\sun|no\slonger\s)\s?available|temporarily\sunavailable
      | unable\sto\s(?:connect|reach|load)\b|requested\s(?:revision|page|resource|url|document|file)\s(?:does\snot\sexist|was\snot\sfound|could\snot\sbe)
      | link\syou\sfollowed|(?:internal|unexpected)\s(?:server\s)?error(?:\soccurred)?\W*$|access\s(?:is\s)?denied|too\smany\srequests\W*$|rate\slimit\sexceeded
      | ^render(?:ing)?\sfailed|^template:\s.*(?:executing|parse)|^fatal:\s|^traceback\b|no\ssuch\sfile\sor\sdirectory|could\snot\srender|exception\sin\sthread
      | upstream\sserver\sdid\snot|the\sconnection\swas\sreset
      | (?:seite|dokument|datei)\s(?:wurde\s)?nicht\sgefunden|interner\sserverfehler|zugriff\sverweigert|wartungsarbeiten|sitzung\sist\sabgelaufen|nicht\s(?:verfügbar|erreichbar)\W*$|zu\sviele\sanfragen|keine\sberechtigung
      | 页面不存在|(?:未找到|找不到)(?:该|此|您)?[^。]{0,8}(?:页面|文档|资源)|(?:页面|文档)(?:未找到|找不到|走丢)|服务器(?:内部)?(?:错误|繁忙|异常)|请求(?:过于频繁|被拦截|超时)[，,]?|(?:登录|会话)已(?:过期|失效)|(?:没有|无)(?:权限)?(?:访问|查看)权?限?|(?:网站|系统|服务器?)(?:正在)?(?:维护|升级)|服务(?:暂时|暂)?不可用|网关(?:超时|错误)|仓库不可用|无法连接
    """,
    re.X,
)
#: Furniture around a page and its tracking numbers: neither content nor residue by itself.
FURNITURE = re.compile(
    r"""^\W*(?:error:|oops!?|whoops!?|sorry|home|docs|navigation|overview|packages|symbols|search|products|status|sign\sin(?:\sto\scontinue)?|log\sin(?:\sto\scontinue)?|privacy|terms|imprint|menu|contact|about|help|skip\sto\s(?:main\s)?content|loading|首页|文档|搜索|登录|language:?\s*\w+|version:?\s*\w+|startseite|suche|datenschutz|impressum|[|\-–·•>/\s])+\W*$
      | ^\W*©.*$ | ^\W*[\w.-]+\.(?:example|com|org|net|dev|io)\W*$ | ^\W*[\w\s]{1,40}\s-\s(?:package\sbrowser|docs|documentation)\W*$
      | ^\W*(?:request\sid|incident|trace|ray(?:\sid)?|reference|error\sid|correlation\sid|id)\W*<id>\W*$ | ^\W*(?:<id>|0)\W*$
    """,
    re.X,
)
#: Words of the Latin dummy text; a sentence made of them alone is filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)

#: Every phrase above that has no Chinese in it holds one of these parts of words (or starts, or has a word, as named);
#: they spare other messages the search. A test derives every form of the phrases and looks for them.
FILLER_PARTS = tuple(
    """sample dummy placeholder coming here add box supplied written announced completed lorem publishing construction follow insert
    platzhalter blindtext hier inhalt folgt beispieltext noch mustertext""".split()
)
FILLER_STARTS = ("tbd", "tba", "todo", "n/a", "na", "none", "bla", "foo", "test", "asdf", "qwert", "abc", "xyz", "placeholder", "untitled")
SCRIPT_PARTS = ("script", "browser", "skript")
ERROR_PARTS = tuple(
    """found forbidden unauthorized bad gateway available error fehler gone timeout find wrong blocked expired timed permission allowed authori maintenance down offline
    unable requested followed denied many exceeded failed executing parse fatal traceback directory render exception upstream reset
    gefunden verweigert wartungsarbeiten abgelaufen verfügbar erreichbar anfragen berechtigung zeitüberschreitung""".split()
)
_CHINESE = re.compile("[\u4e00-\u9fff]")


def may_be_filler(low: str, parts=FILLER_PARTS) -> bool:
    return low.startswith(FILLER_STARTS) or any(p in low for p in parts) or bool(_CHINESE.search(low))


def may_be_scripts(low: str, words: list[str], parts=SCRIPT_PARTS) -> bool:
    return any(p in low for p in parts) or "js" in words or bool(_CHINESE.search(low))


def may_be_error(low: str, parts=ERROR_PARTS) -> bool:
    return any(p in low for p in parts) or bool(_CHINESE.search(low))


_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1|```|\Z)")
_QUOTED = re.compile(r'`[^`\n]*`|"[^"\n]{0,400}"|“[^”\n]{0,400}”|„[^“”\n]{0,400}[“”]|「[^」\n]{0,400}」|«[^»\n]{0,400}»|‘[^’\n]{0,400}’')
_HEADING = re.compile(r"^\s{0,3}#{1,6}(?:\s|$)|^(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) /\S*\s*$")
_NOISE_KEYS = {"version", "language", "request id", "incident", "trace", "ray", "error", "fatal", "template", "traceback", "render failed", "reference", "loading"}
_FIELD = re.compile(r"^\s*(?:[-*•]\s+)?([A-Za-z一-鿿][\w一-鿿]*(?: [A-Za-z][\w]*){0,2})\s?(?::(?=\s|$)|：)\s*")
_BULLET = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")
_FLAG = re.compile(r"^\s+--?[A-Za-z][\w-]*(?:[ =]<[^<>]*>)?\s{2,}")
_GO = re.compile(r"(?m)^(?:package \w+\s*$|func .*\{\s*$|import \($)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
_MASKS = (
    (re.compile(r"https?://\S+|\b[\w.+-]+@[\w-]+\.[\w.]+"), "<addr>"),
    (re.compile(r"\b\d{4}-\d\d-\d\d(?:[T ][\d:.]+(?:Z|[+-]\d\d:?\d\d)?)?|\b\d{1,2}:\d\d(?::\d\d)?\b"), "<date>"),
    (re.compile(r"(?i)\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{6,}\b|\b\d{7,}\b|\b[0-9a-f]{8}-[0-9a-f-]{20,}\b"), "<id>"),
    (re.compile(r"(?<!\d)(?![45]\d\d(?!\d|[.,]\d))\d+(?:[.,]\d+)*"), "0"),  # codes of errors stay
)
_MASKED = re.compile(r"\d|@|://")  #: one of these stands in everything that is masked
_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"</?(?:noscript|html|body|head|title|p|div|h[1-6]|span|br|center|hr|main|header|footer|nav|strong|em|b|i)\b[^<>]*>", re.I)


def normalise(text: str) -> str:
    t = html.unescape(text) if "&" in text else text
    if t.isascii() and "\r" not in t:
        return t
    t = t.replace("\r\n", "\n").replace("\r", "\n").replace("﻿", "").replace(" ", " ").replace("​", "")
    return unicodedata.normalize("NFC", t)


def mask(message: str) -> str:
    if _MASKED.search(message):
        for pattern, by in _MASKS:
            message = pattern.sub(by, message)
    return " ".join(message.split()).lower()


_HOME = re.compile(r"[asdfghjklqwe]{3,}")
_ODD = re.compile(r"[asdfghjklöä]{3,}|[qwertyuiop]{4,}|[zxcvbnm]{3,}|([a-z])\1{2,}|(?:(?![aeiouy])[a-z]){5,}|[asdfghjklqwe]{5,}")
_LETTERS = re.compile(r"[a-z]+")
_DUMMIES = frozenset("foo bar baz qux quux test abc xyz xxx asdf qwerty bla blah".split())
#: One of these stands in every slot; lines without them are spared the search.
_SLOT_SIGN = re.compile(r"[{$#<%@\[【（(]|__|(?:CHANGE|REPLACE|FILL|FIX)_?ME|_HERE")


@functools.lru_cache(100_000)
def _home(word: str) -> bool:
    return bool(_HOME.fullmatch(word))


@functools.lru_cache(100_000)
def _odd(word: str) -> bool:
    return bool(_ODD.fullmatch(word))


def _mashed(words: list[str]) -> bool:
    """Keyboard mashing: few different words repeated, or letter runs that no word of a language has."""
    if len(words) >= 4 and (len(set(words)) <= 2 or _DUMMIES.issuperset(words)):
        return True
    if len(words) >= 3 and sum(map(_home, words)) >= 0.85 * len(words):
        return True
    return sum(map(_odd, words)) > 0.6 * len(words) and all(_LETTERS.fullmatch(w) for w in words)


def judge(message: str, parts: tuple = (FILLER_PARTS, SCRIPT_PARTS, ERROR_PARTS)) -> str:
    """Class of a masked message: filler, error, scripts, furniture, or '' for anything else. ``parts`` are those that occur in its text."""
    words = _WORD.findall(message)
    if not words:
        return "furniture"
    if len(words) >= 2 and not LATIN.isdisjoint(words) and sum(w in LATIN for w in words) >= 0.9 * len(words) and any(len(w) > 4 for w in words):
        return "filler"
    if FURNITURE.match(message):
        return "furniture"
    if _FAILED.match(message):
        return "error"
    if "\x00" in message:  # a quotation: the sentence talks about something
        return ""
    chinese = not message.isascii() and bool(_CHINESE.search(message))
    if (chinese or message.startswith(FILLER_STARTS) or _any_in(parts[0], message)) and FILLER.search(message):
        return "filler"
    if (chinese or "js" in words or _any_in(parts[1], message)) and SCRIPTS.search(message) and not _ONLY.search(message):
        return "scripts"
    if (chinese or _any_in(parts[2], message)) and ERROR.search(message):
        return "error"
    return "filler" if _mashed(words) else ""


def _any_in(parts: tuple, message: str) -> bool:
    for p in parts:
        if p in message:
            return True
    return False


_FAILED = re.compile(r"\W*(?:template: |render(?:ing)? failed\b|fatal: |traceback\b)")
_ONLY = re.compile(r"\bonly\b|nur\b|只有")
_CODE_LINE = re.compile(r"[{};()=]|^\s*(?:package|import|return|if|for|var|type|const|func)\b|^\t")
_QUOTE = re.compile("[`\"“„「«‘]")
_ERROR_NUMBER = re.compile(r"(?i)error \d")
_COMMENT = re.compile(r"^\s*(?://+|/\*+|\*+/?)\s?")


def _leaves(x: object) -> list[str]:
    if isinstance(x, str):
        return [x]
    if isinstance(x, dict):
        return [s for v in x.values() for s in _leaves(v)]
    if isinstance(x, list):
        return [s for v in x for s in _leaves(v)]
    return []


def _units(text: str) -> tuple[bool, list[tuple[bool, list[str]]]]:
    """(has a slot, [(has code, lines)]): slots are looked for outside of code fences, inline code and quotations."""
    head = text.lstrip()[:1]
    if head in "{[" and head:
        try:
            leaves = _leaves(json.loads(text))
        except (ValueError, RecursionError):
            leaves = None
        if leaves is not None:
            bare = [_QUOTED.sub("\x00", s) for s in leaves]
            small = len(leaves) <= 4
            units = [(False, [x for s in bare for x in s.split("\n")])] if small else [(False, s.split("\n")) for s in bare]
            return any(SLOT.search(s) for s in bare), units
    go = bool(_GO.search(text))
    text = _FENCE.sub("\n\x01\n", text) if "```" in text or "~~~" in text else text
    # What no line can hold because the text does not is not looked for line by line.
    quotes, slots = bool(_QUOTE.search(text)), bool(_SLOT_SIGN.search(text))
    units: list[tuple[bool, list[str]]] = []
    code, lines, slot = False, [], False

    def close() -> None:
        nonlocal code, lines
        if lines or code:
            units.append((code, lines))
        code, lines = False, []

    for raw in text.split("\n"):
        if raw.strip() == "\x01":
            code = True
            continue
        start = raw.lstrip()
        if not start:
            continue
        first = start[0]
        comment = first in "/*" and start.startswith(("//", "/*", "*"))
        line = _QUOTED.sub("\x00", raw) if quotes and _QUOTE.search(raw) else raw
        prose = comment or not go or not _CODE_LINE.search(line)
        if slots and not slot and _SLOT_SIGN.search(line) and (SLOT.search(line) or (prose and BARE_SLOT.search(line))):
            slot = True
        if go and not comment and not prose:
            code = True
            continue
        if (first == "#" or raw[0] in "GPDHO") and _HEADING.match(raw):
            close()
            continue
        if first == "-" and (m := _FLAG.match(line)):
            close()
            line = line[m.end() :]
        elif (":" in line or "：" in line) and (m := _FIELD.match(line)) and m.group(1).lower() not in _NOISE_KEYS and not _ERROR_NUMBER.match(line):
            close()
            line = line[m.end() :]
        elif (first in "-*•" or first.isdigit()) and (m := _BULLET.match(line)):
            close()
            line = line[m.end() :]
        if comment:
            line = _COMMENT.sub("", line)
        if line.strip():
            lines.append(line)
    close()
    return slot, units


def messages(text: str, known: dict[str, tuple[int, str]] | None = None) -> tuple[bool, list[tuple[int, int, str]]]:
    """(has a slot, [(unit, hash of the masked message, class)]). Class 'code' stands for code in the unit. ``known`` remembers masked messages."""
    known = {} if known is None else known
    text = normalise(text)
    slot, units = _units(text)
    low = text.lower()
    parts = tuple(tuple(p for p in every if p in low) for every in (FILLER_PARTS, SCRIPT_PARTS, ERROR_PARTS))
    out = []
    for n, (code, lines) in enumerate(units):
        if code:
            out.append((n, 0, "code"))
        if len(lines) > 1 and _mashed([w for x in lines for w in _WORD.findall(x.lower())]):
            out.append((n, 0, "filler"))
            continue
        for line in lines:
            line = (_TAG.sub(" ", line) if "<" in line else line).strip()
            if not line:
                continue
            # A line of several sentences is judged sentence by sentence, so a phrase taints only its own.
            sentences = [x for x in _SENTENCE.split(line) if x.strip()] if len(line) > 12 else [line]
            for m in map(mask, sentences):
                if m not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[m] = xxhash.xxh64_intdigest(m.encode("utf-8", "replace")) - (1 << 63) or 1, judge(m, parts)
                out.append((n, *known[m]))
    return slot, out


REMEMBERED = 100_000  #: masked messages whose class a task remembers; only a matter of time


def _scan(batches):
    known: dict[str, tuple[int, str]] = {}
    for pdf in batches:
        rows = []
        for doc, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
            if not isinstance(text, str) or not text.strip():
                continue
            slot, found = messages(text, known)
            if slot:
                rows.append((doc, source, -1, 0, "slot", False, 0, False))
            units: dict[int, list] = {}
            for n, h, k in found:
                units.setdefault(n, []).append((h, k))
            seen = set()
            for n, own in units.items():
                kinds = {k for _, k in own}
                if "code" in kinds:
                    continue
                suspect = bool(kinds & {"filler", "error", "scripts"})
                unknown = sum(k == "" for _, k in own)
                for h, k in own:
                    if k == "" or (suspect and k != "furniture"):
                        rows.append((doc, source, n, h, k, suspect, unknown, h not in seen))
                        seen.add(h)
        yield pd.DataFrame(rows, columns=["doc_id", "source", "unit", "hash", "kind", "suspect", "unknown", "first"])


def scan_messages(documents: DataFrame) -> DataFrame:
    """One row per message of every text, furniture and units with code left out: (doc_id, source, unit, hash, kind, suspect, unknown, first).

    A slot is a row of unit -1, hash 0 marks mashed units. suspect: the unit holds a classified message; unknown: its
    messages of no class; first: the first place of a hash in its text.
    """
    src = F.lower(F.regexp_replace(F.trim(F.coalesce(F.col("source"), F.lit(""))), r"[\s_-]+", "-"))
    rows = spread(documents.where("doc_id is not null").select("doc_id", src.alias("source"), "text"))
    return rows.mapInPandas(_scan, "doc_id long, source string, unit int, hash long, kind string, suspect boolean, unknown int, first boolean")


def message_groups(found: DataFrame, min_docs: int, min_sources: int) -> DataFrame:
    """(hash, share): the messages of no class that recur in ``min_docs`` documents and ``min_sources`` sources, with the share of their places beside classified messages. Counts combine before the shuffle, no group is gathered."""
    per_source = found.where("kind = ''").groupBy("hash", "source").agg(F.count("*").alias("n"), F.count(F.when(F.col("suspect"), 1)).alias("beside"), F.count(F.when(F.col("first"), 1)).alias("d"))
    group = per_source.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("beside").alias("beside"), F.sum("d").alias("docs"), F.count("*").alias("sources"))
    return group.where((F.col("docs") >= min_docs) & (F.col("sources") >= min_sources)).select("hash", (F.col("beside") / F.col("n")).alias("share"))


def residue(documents: DataFrame, min_docs: int = 3, min_sources: int = 2, company: float = 0.6, sure: float = 0.9) -> DataFrame:
    """(doc_id, reason) of every document that is residue; reason is slot, filler, error or scripts (the first in this order), or recurring for a unit of messages classified by their groups alone."""
    found = cut(scan_messages(documents))
    grouped = message_groups(found, min_docs, min_sources).where(F.col("share") >= company)
    unknown = found.where("kind = ''").select("doc_id", "unit", "hash", "suspect", "unknown")
    # Units all of whose messages of no class are classified by their groups; the others are content.
    by_group = unknown.join(grouped, "hash").groupBy("doc_id", "unit").agg(F.count("*").alias("n"), F.min("share").alias("share"), F.first("suspect").alias("suspect"), F.first("unknown").alias("unknown")).where("n = unknown")
    classified = found.where("kind in ('filler', 'error', 'scripts')").select("doc_id", "unit", "kind", "unknown")
    clean = classified.where("unknown = 0").unionByName(classified.where("unknown > 0").join(by_group.where("suspect").select("doc_id", "unit"), ["doc_id", "unit"], "left_semi")).select("doc_id", "kind")
    alone = by_group.where(~F.col("suspect") & (F.col("share") >= sure)).select("doc_id", F.lit("recurring").alias("kind"))
    order = F.expr("case kind when 'slot' then 0 when 'filler' then 1 when 'error' then 2 when 'scripts' then 3 else 4 end")
    return clean.unionByName(found.where("kind = 'slot'").select("doc_id", "kind")).unionByName(alone).groupBy("doc_id").agg(F.min_by("kind", order).alias("reason"))


def split_residue(documents: DataFrame, **options) -> DataFrame:
    """Every row of ``documents`` with ``reason`` and ``kept``; null and blank texts are kept."""
    verdict = residue(documents, **options)
    return documents.drop("reason", "kept").join(verdict, "doc_id", "left").withColumn("kept", F.col("reason").isNull())
