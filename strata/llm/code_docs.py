"""Functions paired with their documentation (problem 4).

Method: one recursive pattern of the ``regex`` library captures comment, signature and balanced body together;
strings, runes and comments inside are protected, so a brace in a string ends nothing. Captures whose comment says
nothing are filtered. In ``symbols`` a function's comment and signature are apart and bodies are missing: the same
grammar reads the signature there, and its captures pass the same filter.

A comment says something if, without comment markers, tool directives, to-do notes, function words and words of
the symbol's own name in any inflection, at least five words are left; two Chinese characters count as one word.

Defined results: null, empty or blank comments and signatures give no pair; a text that holds no function gives no
row; repeated texts give repeated rows; tables without rows give none; other columns are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import DataFrame

from strata.common import spread
from strata.operators.versions import current_versions
from strata.sources.gosource import FUNCTION, GRAMMAR

DECLARATION = regex.compile(GRAMMAR + r"(?m:^)(?<doc>(?&lead))(?<sig>" + FUNCTION + r")[ \t]*+(?<body>(?&blk))?+", regex.X)
#: A signature alone, as the symbol table holds it; methods of interfaces lack the keyword.
SIGNATURE = regex.compile(GRAMMAR + r"\s*+(?<sig>(?:" + FUNCTION + r"|(?<fname>[^\W\d]\w*+)(?&par)(?&typ)*+))", regex.X)

# ---- fixed values: words that carry no meaning of their own -------------------------------------------------
FUNCTION_WORDS = frozenset(
    """a an the this that these those it its they them their he she his her we us our you your i me my who whom whose which what
    and or but nor so yet if then else than as at by for from in into of off on onto out over to up with within without under about after before
    between through during until while when where why how because since though although unless whether per via not no only also just too very more most
    less least such same other another any all each every both either neither few many much some several own here there now again once
    is are was were be been being am do does did doing done has have had having can could will would shall should may might must
    let lets itself themselves one ones etc eg ie vs""".split()
)
DIRECTIVE = re.compile(
    r"^\s*(?:go:\w+|\+build\b|nolint\b|lint:|nosec\b|gosec:|revive:|staticcheck:|exhaustive:|noinspection\b|line\s+\S+:\d+|export\s+\w+\s*$|cgo\b|#cgo\b|#include\b|swagger:|@\w+|coverage:|golint:|codecov:|Code generated\b.*DO NOT EDIT)[^\n]*", re.I
)
TODO = re.compile(r"^\s*(?:TODO|FIXME|XXX|HACK|BUG|WIP|TBD)\b[^\n]*", re.I)

_LINE_MARK = re.compile(r"^\s*(?:/{2,}|/\*+|\*+/|\*(?!\S)|\*(?=\s))\s?")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CJK = re.compile(r"[㐀-鿿豈-﫿]")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def clean_comment(comment: str) -> str:
    """The comment's text without markers, tool directives and to-do notes; paragraphs keep their blank lines."""
    text = comment.replace("\r\n", "\n").replace("\r", "\n").strip()
    lines = []
    for line in text.split("\n"):
        line = _LINE_MARK.sub("", line)
        line = re.sub(r"\s*\*+/\s*$", "", line)
        line = re.sub(r"^\s*/\*+\s?", "", line)
        if DIRECTIVE.match(line) or TODO.match(line):
            continue
        lines.append(line.rstrip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def stem(word: str) -> str:
    """One form for all inflections of an English word."""
    w = re.sub(r"['’].*$", "", word.lower())
    for end, by in (("ies", "y"), ("ied", "y"), ("ying", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""), ("ers", ""), ("er", ""), ("ors", ""), ("or", "")):
        if w.endswith(end) and len(w) - len(end) >= 3 and not w.endswith("ss"):
            w = w[: -len(end)] + by
            break
    if len(w) > 3 and w[-1] == "e":
        w = w[:-1]
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiou":
        w = w[:-1]
    return w[:-1] + "i" if w.endswith("y") else w


def content_words(cleaned: str, name: str) -> float:
    """Words left of a cleaned comment; pairs of Chinese characters count as words."""
    parts = _PARTS.findall(name)
    own = {stem(p) for p in parts} | {p.lower() for p in parts} | {name.lower()}
    chinese = len(_CJK.findall(cleaned))
    rest = _CJK.sub(" ", cleaned)
    words = [w for w in _WORDS.findall(rest) if len(w) > 1 or w.lower() == "a"]
    left = [w for w in words if w.lower() not in FUNCTION_WORDS and w.lower() not in own and stem(w) not in own]
    return len(left) + chinese / 2


def says_something(comment: str | None, name: str | None, least: int = 5) -> bool:
    return bool(comment) and content_words(clean_comment(comment), name or "") >= least


def declarations(text: str):
    """(name, receiver, signature, comment, body, line) of every function in a source text, documented or not."""
    text = text.replace("﻿", "").replace("\r\n", "\n")
    line, at = 1, 0
    for m in DECLARATION.finditer(text, concurrent=True):
        line, at = line + text.count("\n", at, m.start("sig")), m.start("sig")
        recv = (m["recv"] or "").strip("()").split()
        yield m["fname"], re.sub(r"[*\[].*$", "", recv[-1].lstrip("*")) if recv else None, re.sub(r"\s+", " ", m["sig"]).strip(), m["doc"], m["body"], line


def _pair_rows(batches):
    for pdf in batches:
        keep, signatures, descriptions = [], [], []
        for name, signature, comment in zip(pdf["name"], pdf["signature"], pdf["doc_comment"]):
            ok = isinstance(signature, str) and signature.strip() and isinstance(comment, str) and comment.strip()
            if ok:
                found = SIGNATURE.match(signature.replace("\r\n", "\n"))
                sig = found["sig"] if found else signature
                text = clean_comment(comment)
                ok = content_words(text, name or (found["fname"] if found else "")) >= 5
            keep.append(bool(ok))
            if ok:
                signatures.append(re.sub(r"\s+", " ", sig).strip())
                descriptions.append(text)
        out = pdf.loc[keep, ["id", "name", "kind"]].copy()
        out["signature"], out["description"] = signatures, descriptions
        yield out.rename(columns={"id": "symbol_id"})


def symbol_pairs(symbols: DataFrame) -> DataFrame:
    """(symbol_id, name, kind, signature, description) of the current version of each func and method whose comment says something."""
    # The kind is part of an id, so other kinds can fall out before the versions are compared.
    symbols = symbols.select("id", "name", "kind", "signature", "doc_comment", "file_path", "created_at", "updated_at")
    current = current_versions(symbols.where("kind in ('func', 'method')"), "name", "kind", "signature", "doc_comment")
    return current.select("id", "name", "kind", "signature", "doc_comment").mapInPandas(_pair_rows, "symbol_id string, name string, kind string, signature string, description string")


def _file_rows(batches):
    for pdf in batches:
        rows = []
        for doc, path, text in zip(pdf["doc_id"], pdf["file_path"], pdf["text"]):
            if not isinstance(text, str) or "func" not in text:
                continue
            for name, receiver, signature, comment, body, line in declarations(text):
                cleaned = clean_comment(comment)
                if content_words(cleaned, name) >= 5:
                    rows.append((doc, path, line, receiver, name, signature, cleaned, body))
        yield pd.DataFrame(rows, columns=["doc_id", "file_path", "line", "receiver", "name", "signature", "description", "body"])


def file_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id, file_path, line, receiver, name, signature, description, body) of each function in source texts whose comment says something."""
    return spread(documents.where("doc_id is not null").select("doc_id", "file_path", "text")).mapInPandas(
        _file_rows, "doc_id long, file_path string, line int, receiver string, name string, signature string, description string, body string"
    )
