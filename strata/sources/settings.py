"""Settings files: JSON, or the plain subset of YAML that settings need."""

from __future__ import annotations

import json
import os
import re

_PLAIN = {"true": True, "false": False, "null": None, "~": None, "": None}


def _value(text: str):
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in re.findall(r"""(?:'[^']*'|"[^"]*"|[^,])+""", text[1:-1]) if x.strip()]
    if text.lower() in _PLAIN:
        return _PLAIN[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_yaml(text: str):
    """Nested mappings and lists by indentation, inline lists, quoted and plain values, comments. Anchors, block texts and inline mappings are errors."""
    rows = []
    for n, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"""^((?:[^'"#]|'[^']*'|"[^"]*"|(?<=\S)#)*?)(?:^|\s)#.*$""", r"\1", raw).rstrip()
        if line.strip() and line.strip() != "---":
            if "\t" in line[: len(line) - len(line.lstrip())]:
                raise ValueError(f"line {n}: indentation by tabs")
            rows.append((n, len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, indent: int):
        out = [] if rows[at][2].startswith("-") else {}
        while at < len(rows) and rows[at][1] >= indent:
            n, depth, line = rows[at]
            if depth != indent:
                raise ValueError(f"line {n}: unexpected indentation")
            at += 1
            if isinstance(out, list):
                if not re.match(r"-(\s|$)", line):
                    raise ValueError(f"line {n}: a list item was expected")
                out.append(_value(line[1:]))
                continue
            m = re.match(r"""("[^"]*"|'[^']*'|[^:]+?)\s*:(?:\s+(.*))?$""", line)
            if not m or (m[2] or "")[:1] in ("&", "*", "|", ">", "{"):
                raise ValueError(f"line {n}: not a plain mapping")
            key = str(_value(m[1]))
            if m[2]:
                out[key] = _value(m[2])
            elif at < len(rows) and (rows[at][1] > indent or (rows[at][1] == indent and rows[at][2].startswith("-"))):
                out[key], at = block(at, rows[at][1])
            else:
                out[key] = None
        return out, at

    if not rows:
        return {}
    found, at = block(0, rows[0][1])
    if at < len(rows):
        raise ValueError(f"line {rows[at][0]}: unexpected indentation")
    return found


def expand(x):
    """``~`` and environment variables in every text of a settings tree."""
    if isinstance(x, dict):
        return {k: expand(v) for k, v in x.items()}
    if isinstance(x, list):
        return [expand(v) for v in x]
    return os.path.expandvars(os.path.expanduser(x)) if isinstance(x, str) and (x.startswith("~") or "$" in x) else x


def load(path: str) -> dict:
    with open(os.path.expanduser(path), encoding="utf-8") as f:
        text = f.read()
    found = json.loads(text) if path.endswith(".json") else parse_yaml(text)
    if not isinstance(found, dict):
        raise ValueError("settings are a mapping")
    return expand(found)
