"""Command line: python -m strata --index PATH COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from strata import output
from strata.api import Config, Engine


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strata")
    top.add_argument("--index", required=True, help="folder of the index, shared by all executors")
    top.add_argument("--config", help="settings, JSON or YAML")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments, **options):
        c = commands.add_parser(name, **options)
        for flags, given in arguments:
            c.add_argument(*flags, **given)
        c.add_argument("--json", action="store_true")
        c.add_argument("--output", help="file instead of the terminal")

    text, k = (["query"], {}), (["-k", "--top-k"], {"type": int, "default": 0})
    yes = {"action": "store_true"}
    command("index", (["root"], {}), (["--module"], {"default": ""}), (["--force"], yes))
    command("search", text, k, (["--vector-only"], yes), (["--keyword-only"], yes), (["--all"], yes), (["--verbose"], yes))
    command("evidence", text, k, (["--intent"], {}))
    command("refs", (["--symbol-id"], {}), (["--name"], {}), (["--direction"], {"default": "incoming"}), (["--edge-type"], {}), k)
    command("read", (["--file"], {}), (["--symbol-id"], {}), (["--start"], {"type": int, "default": 1}), (["--end"], {"type": int}), (["--context"], {"type": int, "default": 0}))
    command("find", (["name"], {}), (["--repo"], {}), (["--package"], {}), k)
    for name in ("status", "repos", "stats", "errors"):
        command(name)
    return top


def run(engine: Engine, given: argparse.Namespace) -> str:
    from strata.operators.lookup import positive_or

    spark, c = engine.spark, given.command
    if c in ("search", "evidence"):
        queries = spark.createDataFrame([(1, given.query)], "query_id long, text string")
        k = positive_or(given.top_k, engine.config.search.k)
        if c == "search":
            options = {"k": k} | ({"exported_only": False} if given.all else {})
            rows = output.as_rows(engine.locate(queries, given.vector_only, given.keyword_only, **options).orderBy("place"))
            return output.results_json(given.query, rows) if given.json else output.results_text(given.query, rows, given.verbose)
        return json.dumps(output.as_rows(engine.context(queries, given.intent, k=k))[0], indent=2, ensure_ascii=False, default=str)
    if c == "index":
        df = engine.index(given.root, given.module, given.force)
    elif c == "refs":
        df = engine.refs(given.symbol_id, given.name, given.direction, given.edge_type, positive_or(given.top_k, 20))
    elif c == "read":
        df = engine.read(given.file, given.symbol_id, given.start, given.end, given.context)
        if not given.json:
            return "\n".join(r["text"] for r in df.collect())
    elif c == "find":
        df = engine.find(given.name, given.repo, given.package, positive_or(given.top_k, 20))
    else:
        df = getattr(engine, c)()
    rows = output.as_rows(df)
    return json.dumps(rows, indent=2, ensure_ascii=False, default=str) if given.json else "\n".join("\t".join(str(v) for v in r.values()) for r in rows)


def main(argv: list[str] | None = None) -> int:
    given = parser().parse_args(argv)
    spark = SparkSession.builder.appName("strata").getOrCreate()
    try:
        config = Config.load(given.config) if given.config else Config()
        output.emit(run(Engine(spark, os.path.expanduser(given.index), config), given), given.output)
        return 0
    except (ValueError, KeyError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
