"""Source texts as tables: files, symbols, references. A syntactic parser; names are resolved in DataFrames."""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import rules

SYMBOLS = "file_path string, package_path string, package_name string, kind string, id string, name string, receiver string, signature string, doc_comment string, line_start int, line_end int, exported boolean"
REFERENCES = "file_path string, package_path string, line int, edge_type string, owner string, target string, alias string"

#: Strings, comments and balanced brackets; braces in strings or comments end nothing.
GRAMMAR = r"""
    (?(DEFINE)
      (?<str>"(?:[^"\\\n]++|\\.)*+"|`[^`]*+`|'(?:[^'\\\n]|\\[^\n]{1,9}?)')
      (?<com>//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)
      (?<par>\((?:[^()"'`/]++|(?&str)|(?&com)|[/"'`]|(?&par))*+\))
      (?<blk>\{(?:[^{}"'`/]++|(?&str)|(?&com)|[/"'`]|(?&blk))*+\})
      (?<sqr>\[(?:[^\[\]"'`/]++|(?&str)|(?&com)|[/"'`]|(?&sqr))*+\])
      (?<typ>[ \t]*+(?:(?:interface|struct)[ \t]*(?&blk)|(?&par)|(?&sqr)|<-|[\w.*]++))
      (?<lead>(?:[ \t]*+(?&com)[ \t]*+\n)*+)
    )
"""
#: A function's declaration without its body.
FUNCTION = r"func\b[ \t]*+(?<recv>(?&par))?+[ \t]*+(?<fname>[^\W\d]\w*+)(?&sqr)?+[ \t]*+(?<params>(?&par))(?<result>(?&typ)*+)"
TOP = regex.compile(
    GRAMMAR
    + r"""
    (?m:^)(?<doc>(?&lead))
    (?: """
    + FUNCTION
    + r"""[ \t]*+(?<body>(?&blk))?+
      | (?<word>type|const|var)\b[ \t]*+(?: (?<group>(?&par)) | (?<spec>[^\n{]*+(?:(?&blk))?+[^\n]*+) )
      | import\b[ \t]*+(?: (?<imports>(?&par)) | (?<import>[^\n]*+) )
      | package[ \t]++(?<package>\w++)
    )
    """,
    regex.X,
)
_SPEC = re.compile(r"^\s*([^\W\d]\w*)(?:\[[^\]]*\])?\s*(=\s*)?(.*)$", re.S)
_CALL = re.compile(r"(?<![\w.])(?:([^\W\d]\w*)\.)?([^\W\d]\w*)\(")
_KEYWORDS = {"if", "for", "switch", "select", "return", "func", "go", "defer", "range", "make", "new", "len", "cap", "append", "copy", "delete", "panic", "recover", "print", "println", "close", "string", "int", "error", "struct", "interface", "map", "chan", "case", "var", "type", "const", "min", "max", "clear"}


def clean_doc(doc: str) -> str:
    lines = [re.sub(r"^\s*(?://+|/\*+|\*+/|\*)\s?", "", x) for x in doc.strip().split("\n")]
    return re.sub(r"\s*\*/\s*$", "", "\n".join(lines)).strip()


def exported(name: str) -> bool:
    return name[:1].isupper()


def _members(block: str) -> list[tuple[int, str]]:
    """(line offset, text) of the members of a struct or interface block, nested blocks kept whole."""
    out, depth, start = [], 0, 0
    inner = block[1:-1]
    for n, line in enumerate(inner.split("\n")):
        text = re.sub(r"//.*$", "", line)
        if depth == 0 and text.strip():
            out.append((n, text.strip().split("`")[0].strip()))
        depth += text.count("{") + text.count("(") - text.count("}") - text.count(")")
    return [(n, t) for n, t in out if t not in ("}", ")", "};")]


def parse_file(path: str, text: str, package_path: str):
    """(symbol rows, reference rows) of one source text."""
    text = text.replace("﻿", "").replace("\r\n", "\n")
    symbols, refs = [], []
    package = ""
    at, line = 0, 1
    total = text.count("\n") + 1

    def add(kind, name, sig, doc, start, end, receiver=None, ident=None, public=None):
        symbols.append((path, package_path, package, kind, ident or f"{package_path}:{kind}:{f'{receiver}.' if receiver else ''}{name}", name, receiver, sig, doc, start, end, exported(name) if public is None else public))

    for m in TOP.finditer(text, concurrent=True):
        begin = m.end("doc")
        line, at = line + text.count("\n", at, begin), begin
        end = line + text.count("\n", begin, m.end())
        doc = clean_doc(m["doc"])
        if m["package"]:
            package = m["package"]
            package_doc = doc
            symbols.append((path, package_path, package, "package", f"pkg:{package_path}", package, None, f"package {package}", package_doc, 1, 1, True))
        elif m["imports"] is not None or m["import"] is not None:
            for alias, imported in re.findall(r'([\w.]+)?\s*"([^"\n]+)"', m["imports"] or m["import"]):
                refs.append((path, package_path, line, "imports", f"pkg:{package_path}", imported, alias or imported.split("/")[-1]))
        elif m["fname"]:
            receiver = None
            if m["recv"]:
                receiver = re.sub(r"\[.*$", "", m["recv"].strip("() ").split()[-1].lstrip("*")) if m["recv"].strip("() ") else None
            name = m["fname"]
            sig = re.sub(r"\s+", " ", f"func {m['recv'] + ' ' if m['recv'] else ''}{name}{m['params']}{m['result']}").strip()
            ident = f"{package_path}:func:{name}@{path}:{line}" if name == "init" and not receiver else None
            kind = "method" if receiver else "func"
            add(kind, name, sig, doc, line, end, receiver, ident)
            body_line = line + text.count("\n", begin, m.start("body")) if m["body"] else end
            quiet = regex.sub(r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|//[^\n]*', lambda x: "\n" * x[0].count("\n"), m["body"] or "")
            for c in _CALL.finditer(quiet):
                if c[2] not in _KEYWORDS:
                    refs.append((path, package_path, body_line + quiet.count("\n", 0, c.start()), "calls", None, f"{c[1]}.{c[2]}" if c[1] else c[2], None))
        elif m["word"]:
            specs = [(line, m["spec"])] if m["spec"] is not None else []
            if m["group"] is not None:
                depth, buf, first = 0, "", 0
                for n, row in enumerate(m["group"][1:-1].split("\n")):
                    bare = re.sub(r"//.*$", "", row)
                    if depth == 0:
                        if buf.strip():
                            specs.append((line + first, buf))
                        buf, first = "", n
                    buf += bare + "\n"
                    depth += sum(bare.count(x) for x in "{([") - sum(bare.count(x) for x in "})]")
                if buf.strip():
                    specs.append((line + first, buf))
            for at_line, spec in specs:
                if m["word"] == "type":
                    s = _SPEC.match(spec)
                    if not s:
                        continue
                    name, rest = s[1], s[3].strip()
                    kind = "struct" if rest.startswith("struct") else "interface" if rest.startswith("interface") else "type"
                    stop = at_line + spec.rstrip().count("\n")
                    add(kind, name, f"type {name} {kind}" if kind != "type" else f"type {name} {rest.split(chr(10))[0]}".strip(), doc, at_line, stop)
                    block = rest[rest.find("{") :] if "{" in rest and kind != "type" else "{}"
                    for k, (off, member) in enumerate(_members(block)):
                        here = at_line + off
                        if kind == "interface":
                            if (f := re.match(r"([^\W\d]\w*)\s*(\(.*)$", member, re.S)) is not None:
                                add("method", f[1], f"{f[1]}{f[2]}", "", here, here, None, f"{package_path}:interface-method:{name}.{f[1]}", True)
                            else:
                                refs.append((path, package_path, here, "embeds", f"{package_path}:{kind}:{name}", member, None))
                        elif kind == "struct":
                            parts = re.match(r"((?:[^\W\d]\w*\s*,\s*)*[^\W\d]\w*)\s+(\S.*)$", member)
                            if parts:
                                for field in re.split(r"\s*,\s*", parts[1]):
                                    add("field", field, f"{field} {parts[2]}", "", here, here, None, f"{package_path}:field:{name}.{field}")
                                target = re.sub(r"^[\[\]*\d]+", "", parts[2].split()[0])
                                if re.fullmatch(r"(?:\w+\.)?[^\W\d]\w*", target):
                                    refs.append((path, package_path, here, "references", f"{package_path}:{kind}:{name}", target, None))
                            else:
                                add("field", member.lstrip("*").split(".")[-1], member, "", here, here, None, f"{package_path}:field:{name}.embedded-{k}", True)
                                refs.append((path, package_path, here, "embeds", f"{package_path}:{kind}:{name}", member.lstrip("*"), None))
                else:
                    names = re.match(r"\s*((?:[^\W\d]\w*\s*,\s*)*[^\W\d]\w*)", spec)
                    for name in re.split(r"\s*,\s*", names[1]) if names else []:
                        if name != "_":
                            add(m["word"], name, f"{m['word']} {name}", doc, at_line, at_line)
    if package:
        heads = sum(1 for s in symbols if s[3] not in ("package", "file"))
        symbols.append((path, package_path, package, "file", f"file:{path}", path.split("/")[-1], None, f"file {path}", f"{heads} symbols", 1, total, True))
    return symbols, refs


def _runner(which: int, columns: list[str]):
    def run(batches):
        for pdf in batches:
            rows = []
            for path, package_path, text in zip(pdf["file_path"], pdf["package_path"], pdf["text"]):
                if isinstance(text, str) and isinstance(path, str) and "package" in text:
                    rows.extend(parse_file(path, text, package_path or "")[which])
            yield pd.DataFrame(rows, columns=columns)

    return run


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def symbols_of(files: DataFrame) -> DataFrame:
    """Symbols of source files (file_path, package_path, text): packages, files, types, functions, methods, fields, constants, variables."""
    return files.select("file_path", "package_path", "text").mapInPandas(_runner(0, _columns(SYMBOLS)), SYMBOLS)


def references_of(files: DataFrame) -> DataFrame:
    """Unresolved references of source files: imports, calls, embedded types, field types."""
    return files.select("file_path", "package_path", "text").mapInPandas(_runner(1, _columns(REFERENCES)), REFERENCES)


def errors_of(files: DataFrame) -> DataFrame:
    """(file_path, error) of source files that give no symbols: unreadable, or without a package clause outside of comments."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["file_path"], pdf["text"]):
                try:
                    if not isinstance(text, str):
                        rows.append((path, "no text"))
                    elif "package" not in text or not parse_file(path, text, "")[0]:
                        rows.append((path, "no package clause"))
                except Exception as e:  # noqa: BLE001  a file the parser cannot take is a row, not a failed run
                    rows.append((path, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file_path", "error"])

    return files.where("file_path is not null").select("file_path", "text").mapInPandas(run, "file_path string, error string")


def package_symbols(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(package_path, package_name, doc_comment, imports, n_files): one row per package, with the comment of its first file that has one and the imports of all."""
    heads = symbols.where("kind = 'package'")
    doc = F.min_by("doc_comment", F.when(F.trim(F.coalesce("doc_comment", F.lit(""))) != "", F.col("file_path")))
    one = heads.groupBy("package_path").agg(F.min_by("package_name", "file_path").alias("package_name"), F.coalesce(doc, F.lit("")).alias("doc_comment"), F.countDistinct("file_path").alias("n_files"))
    imports = refs.where("edge_type = 'imports'").groupBy("package_path").agg(F.array_sort(F.collect_set("target")).alias("imports"))
    return one.join(imports, "package_path", "left").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))


def read_package(spark: SparkSession, root: str, package_path: str, module: str = "") -> DataFrame:
    """``read_repository`` of one package: other folders are not listed."""
    folder = package_path.removeprefix(module).strip("/") if module else package_path.strip("/")
    inside = read_repository(spark, f"{root.rstrip('/')}/{folder}".rstrip("/"), package_path, recursive=False)
    return inside.withColumn("file_path", F.concat_ws("/", F.lit(folder or None), "file_path"))


def read_file(spark: SparkSession, root: str, path: str, module: str = "") -> DataFrame:
    """``read_repository`` of one file."""
    folder = path.rpartition("/")[0]
    package = "/".join(x for x in (module, folder) if x)
    text = spark.read.text(f"{root.rstrip('/')}/{path}", wholetext=True)
    return text.select(F.lit(path).alias("file_path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"), F.lit(package).alias("package_path"))


def read_repository(spark: SparkSession, root: str, module: str = "", tests: bool = True, recursive: bool = True) -> DataFrame:
    """(file_path, package_path, text, modified) of the source files under a root; vendored directories are skipped."""
    root = root.rstrip("/")
    df = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.go").text(root, wholetext=True)
    relative = F.regexp_replace(F.col("_metadata.file_path"), rf"^(?:file:)?/*{re.escape(root.removeprefix('file:').strip('/'))}/", "")
    out = df.select(relative.alias("file_path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))
    folder = F.regexp_replace("file_path", r"/?[^/]+$", "")
    out = out.withColumn("package_path", F.when(folder == "", F.lit(module)).when(F.lit(module) == "", folder).otherwise(F.concat_ws("/", F.lit(module), folder))).where(~rules.skipped(F.col("file_path")))
    return out if tests else out.where(~F.col("file_path").endswith("_test.go"))


def implements_edges(symbols: DataFrame) -> DataFrame:
    """(from_id, to_id): the types of a package that have all methods of one of its interfaces, by name, with value or pointer receiver. Interfaces without methods are left out."""
    from strata.operators.graph import implementations

    scoped = F.concat_ws(".", "package_path", "name").alias("method")
    methods = symbols.where("kind = 'method'")
    parts = F.split(F.substring_index("id", ":", -1), r"\.")
    of_interface = methods.where(F.col("id").contains(":interface-method:")).select(F.concat_ws(":", "package_path", F.lit("interface"), parts[0]).alias("owner"), scoped)
    receivers = symbols.where("kind in ('struct', 'type')").groupBy("package_path", F.col("name").alias("receiver")).agg(F.min("id").alias("owner"))
    of_type = methods.where(~F.col("id").contains(":interface-method:")).join(receivers, ["package_path", "receiver"]).select("owner", scoped)
    return implementations(of_type, of_interface).select(F.col("type_id").alias("from_id"), F.col("interface_id").alias("to_id"))


def resolved_edges(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(from_id, to_id, edge_type, weight, import_path) of references whose target is known in the repository.

    A call starts at the innermost function around its line; an unqualified name is sought in the own package, a
    qualified one in the package imported under that name (alias or last path element); a type is any of struct, interface, type.
    What an imported package of the repository does not show (a variable, a method of a value) is referred to the
    package's own symbol. A name behind a variable is resolved where only one definition of the own package has it.
    """
    from strata.operators.graph import enclosing

    spans = symbols.where("kind in ('func', 'method') and signature like 'func%'").select(F.col("file_path").alias("file"), "line_start", "line_end", "id")
    calls = refs.where("edge_type = 'calls'")
    owners = enclosing(calls.select(F.col("file_path").alias("file"), "line"), spans).select(F.col("file").alias("file_path"), "line", F.col("id").alias("_owner"))
    owned = calls.join(owners, ["file_path", "line"]).withColumn("owner", F.col("_owner")).drop("_owner").unionByName(refs.where("edge_type in ('embeds', 'references')"))
    named = owned.withColumn("_qual", F.when(F.col("target").contains("."), F.split("target", r"\.")[0])).withColumn("_name", F.element_at(F.split("target", r"\."), -1))
    imports = refs.where("edge_type = 'imports'").select("file_path", F.col("target").alias("_import"), F.col("alias").alias("_qual")).distinct()
    located = named.join(imports, ["file_path", "_qual"], "left").withColumn("_package", F.when(F.col("_qual").isNull(), F.col("package_path")).otherwise(F.col("_import")))
    defs = symbols.where("kind in ('func', 'struct', 'interface', 'type') or (kind = 'method' and signature like 'func%')").groupBy(F.col("package_path").alias("_package"), F.col("name").alias("_name")).agg(F.min("id").alias("_first"), F.countDistinct("id").alias("_n"))
    # A qualifier that names no import is a variable: its method is sought in the own package.
    local = located.withColumn("_variable", F.col("_package").isNull()).withColumn("_package", F.coalesce("_package", "package_path"))
    known = symbols.where("kind = 'package'").select(F.col("package_path").alias("_package"), F.col("id").alias("_home")).distinct()
    exact = F.when(~F.col("_variable") | (F.col("_n") == 1), F.col("_first"))
    home = F.when(~F.col("_variable") & F.col("_qual").isNotNull(), F.col("_home"))
    found = local.join(defs, ["_package", "_name"], "left").join(known, "_package", "left").withColumn("to_id", F.coalesce(exact, home)).where("to_id is not null and owner <> to_id")
    weight = F.create_map(*[x for k, v in rules.EDGE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    edges = found.select(F.col("owner").alias("from_id"), "to_id", "edge_type", F.lit(None).cast("string").alias("import_path"))
    packages = symbols.where("kind = 'package'").select("id").distinct()
    imported = refs.where("edge_type = 'imports'").select(F.col("owner").alias("from_id"), F.concat(F.lit("pkg:"), "target").alias("to_id"), "edge_type", F.col("target").alias("import_path"))
    imported = imported.join(packages, imported["to_id"] == packages["id"], "left_semi")
    implemented = implements_edges(symbols).select("from_id", "to_id", F.lit("implements").alias("edge_type"), F.lit(None).cast("string").alias("import_path"))
    return edges.unionByName(imported).unionByName(implemented).distinct().withColumn("weight", weight[F.col("edge_type")])
