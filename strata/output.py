"""Results as JSON or text, on the terminal or in a file. What is printed is bounded by the limits of its query."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def as_rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def results_json(query: str, rows: list[dict]) -> str:
    return json.dumps({"query": query, "count": len(rows), "results": rows}, indent=2, ensure_ascii=False, default=str)


def results_text(query: str, rows: list[dict], verbose: bool = False) -> str:
    # The labels of the listing.
    if not rows:
        return "No results found"
    out = [f"Found {len(rows)} result(s) for: {query}", ""]
    for n, r in enumerate(rows, 1):
        out += [f"{n}. {r['name']}", f"   Kind:    {r['kind']}", f"   Package: {r['package_path']}", f"   File:    {r['file_path']}:{r['line_start']}"]
        if verbose:
            out += [f"   {label + ':':<8} {r[c]:.3f}" for label, c in (("Vector", "vector"), ("Keyword", "keyword"), ("Graph", "graph")) if (r.get(c) or 0) > 0]
            out += [f"   Score:   {r['combined']:.3f}"] + ([f"   Why:     {'; '.join(r['reasons'])}"] if r.get("reasons") else [])
        text = r.get("semantic_text") or ""
        out += ([f"   {text[:100]}{'...' if len(text) > 100 else ''}"] if text else []) + [""]
    return "\n".join(out)


def emit(text: str, path: str | None = None) -> None:
    if path is None:
        print(text)
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write(text + "\n")


def write_json(df: DataFrame, path: str) -> None:
    """Any number of rows as JSON lines, written by the tasks."""
    df.write.json(path)
