"""Mutation, status, card and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.common import table
from strata.functions import rules
from strata.functions.text import human_bytes, path_wanted, repo_file_name
from strata.functions.timeparse import parse_instant
from strata.operators import cards, status, store
from strata.plans import fixed
from strata.plans.sql import CAT, EDG, EMB, layer
from strata.plans.training import _instant
from strata.sources import corpus, gosource

CUT = "2025-06-01 00:00:00"  #: what is older counts as stored, what is newer as delivered
NOW = "2026-06-01 12:00:00"


def _old_new(df):
    old = F.coalesce(F.col("created_at") < F.lit(f"{CUT}+00:00").cast("timestamp"), F.lit(False))
    return df.where(old), df.where(~old)


def upsert_edges(spark, d):
    e = table(spark, d, "edges").where("from_id is not null and to_id is not null").select("from_id", "to_id", "edge_type", "weight", "import_path", "created_at")
    out = store.upsert_edges(*_old_new(e))
    return out.groupBy("edge_type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.count("import_path").alias("with_path"), F.unix_micros(F.min("created_at")).alias("first_created"))


def upsert_vectors(spark, d):
    v = corpus.embeddings(spark, d)
    newer = table(spark, d, "symbol_vectors").where("model = 'code-embed-b'").groupBy("symbol_id").agg(F.lit("renewed").alias("model"), F.array(F.lit(1.0).cast("float"), F.count("*").cast("float")).alias("vector"))
    out = store.upsert_vectors(v.select("symbol_id", "vector", "model"), newer.select("symbol_id", "vector", "model"))
    return out.select("symbol_id", "model", F.size("vector").cast("long").alias("dim"))


def upsert_packages(spark, d):
    p = corpus.packages(corpus.catalog(spark, d)).select(F.col("package_path").alias("path"), "name", "symbol_count")
    old = p.select("path", "name", F.lit(0).cast("long").alias("symbol_count"), F.lit("old-repo").alias("repo_path"), F.lit(1).alias("created_at"), F.lit("x").alias("imported_by")).where(F.col("name") < "m")
    new = p.select("path", "name", "symbol_count", F.lit("new-repo").alias("repo_path"), F.lit(2).alias("created_at"), F.lit(None).cast("string").alias("imported_by"))
    return store.upsert_packages(old, new)


def upsert_repositories(spark, d):
    r = table(spark, d, "repositories").select("id", "root_path", "symbol_count", "created_at")
    new = r.select(F.lit("").alias("id"), F.concat("root_path", F.when(F.col("symbol_count") > 2500, "").otherwise("-copy")).alias("root_path"), (F.col("symbol_count") + 1).alias("symbol_count"), F.lit(f"{CUT}+00:00").cast("timestamp").alias("created_at"))
    return store.upsert_repositories(r, new).withColumn("created_at", F.unix_micros("created_at"))


def insert_symbols(spark, d):
    s = table(spark, d, "symbols").where("id is not null").select("id", "file_path", "line_start", "created_at")
    old = s.where(F.col("created_at") < F.lit(f"{CUT}+00:00").cast("timestamp")).groupBy("id").agg(F.min("file_path").alias("file_path"), F.min("line_start").alias("line_start"), F.min("created_at").alias("created_at"))
    return store.insert_symbols(old, s).select("id", "file_path", "line_start")


def delete_package_cascade(spark, d):
    """Symbols of handler packages go, with their edges and vectors; what is left per kind of row."""
    s = corpus.catalog(spark, d)
    kept = s.where(rules.layer(F.col("package_path")) != "handler")
    core = table(spark, d, "core_symbols").select("id")
    e, v = store.cascade(corpus.merged_edges(spark, d), corpus.embeddings(spark, d), kept.select("id").unionByName(core))
    return e.groupBy("edge_type").agg(F.count("*").alias("n")).unionByName(v.agg(F.lit("vectors").alias("edge_type"), F.count("*").alias("n"))).unionByName(kept.agg(F.lit("symbols").alias("edge_type"), F.count("*").alias("n")))


def delete_edges_of_symbols(spark, d):
    gone = corpus.catalog(spark, d).where("kind in ('field', 'const', 'var')")
    return store.delete_edges_of(corpus.merged_edges(spark, d), gone).groupBy("edge_type").agg(F.count("*").alias("n"))


def delete_vectors_by_prefix(spark, d):
    return store.delete_prefix(corpus.embeddings(spark, d), "symbol_id", "corp.example/a").groupBy("model").agg(F.count("*").alias("n"))


def imported_by_union(spark, d):
    imports = table(spark, d, "edges").where("import_path is not null").select(F.col("import_path").alias("path"), F.regexp_replace(F.regexp_extract("from_id", r"^(?:pkg:)?([^:]+)", 1), "^$", "-").alias("importer")).distinct()
    p = imports.select("path").distinct().withColumn("imported_by", F.array(F.lit("zz"), F.lit("corp.example/none")))
    out = store.add_importer(p, imports)
    return out.select("path", F.size("imported_by").cast("long").alias("n"), F.md5(F.array_join("imported_by", ",").cast("binary")).alias("members_md5"))


def changed_packages(spark, d):
    """Files touched since a fixed instant, by the symbols' modification times."""
    s = corpus.catalog(spark, d)
    files = s.where("kind <> 'file'").select("package_path", F.concat_ws("/", "repo_path", "file_path").alias("file_path"))
    seen = s.where("kind = 'file' or exported").groupBy("package_path", F.concat_ws("/", "repo_path", "file_path").alias("file_path")).agg(F.max(parse_instant(F.col("updated_at"))).alias("modified"))
    return status.changed_packages(files, seen, F.lit(f"{NOW}+00:00").cast("timestamp") - F.expr("INTERVAL 30 DAYS"))


def table_counts(spark, d):
    s = corpus.catalog(spark, d)
    return status.table_counts(s, s.select("package_path").distinct(), corpus.merged_edges(spark, d), corpus.embeddings(spark, d))


def repo_summary(spark, d):
    return status.repository_summary(corpus.catalog(spark, d), corpus.merged_edges(spark, d), corpus.embeddings(spark, d))


def index_status(spark, d):
    return status.index_status(table(spark, d, "repositories"), F.lit(f"{NOW}+00:00").cast("timestamp"))


def repos_list(spark, d):
    """All repositories, latest indexed first, never indexed last."""
    from pyspark.sql import Window

    r = table(spark, d, "repositories").withColumn("at", parse_instant(F.col("last_indexed_at")))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("at"), "root_path"))  # one row per repository
    return r.select(place.cast("long").alias("place"), "root_path", "symbol_count", repo_file_name(F.col("root_path")).alias("store_name"))


def size_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", human_bytes((F.octet_length("text") * 1000).cast("long")).alias("size"))


def path_globs(spark, d):
    """Files by globs and prefixes, exclusions first."""
    s = corpus.catalog(spark, d).select("repo_path", "file_path").distinct()
    return s.where(path_wanted(F.col("file_path"), ["internal/*/*/*.go", "lib/"], ["**_test.go", "internal/util"]))


def package_info(spark, d):
    i = cards.package_info(corpus.catalog(spark, d))
    return i.select("package_path", "n_symbols", "exported_count", "has_interface", "has_struct", "has_method", F.array_join("key_types", ",").alias("key_types"), F.array_join("key_funcs", ",").alias("key_funcs"))


def package_roles(spark, d):
    return cards.package_cards(cards.package_info(corpus.catalog(spark, d))).select("package_path", "role", "responsibilities")


def package_card(spark, d):
    return cards.package_cards(cards.package_info(corpus.catalog(spark, d))).select("package_path", "card")


def symbol_card(spark, d):
    s = corpus.catalog(spark, d)
    c = cards.symbol_cards(s, cards.package_cards(cards.package_info(s)))
    return c.select("id", F.char_length("card").cast("long").alias("chars"), F.md5(F.col("card").cast("binary")).alias("card_md5"))


def repo_stats(spark, d):
    return corpus.catalog(spark, d).groupBy("repo_path").agg(F.countDistinct("package_path").alias("packages"), F.countDistinct("file_path").alias("files"), F.count("*").alias("symbols"), F.count(F.when(F.col("exported"), 1)).alias("exported"))


def _sources(spark, d):
    """Documents that are source texts, as files of a package each."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.where(F.col("text").rlike(r"(?m)^package \w+\s*$")).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/x.go")).alias("file_path"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("package_path"), "text")


def source_symbols(spark, d):
    return gosource.symbols_of(_sources(spark, d)).groupBy("package_path", "kind").agg(F.count("*").alias("n"), F.max("line_end").cast("long").alias("last_line"))


def source_references(spark, d):
    """References found in source texts, by kind and target."""
    return gosource.references_of(_sources(spark, d)).groupBy("edge_type", "target").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("n_files"))


def import_edges(spark, d):
    """Imports of source texts; the standard library's are told by their paths."""
    r = gosource.references_of(_sources(spark, d)).where("edge_type = 'imports'")
    return r.groupBy("target").agg(F.countDistinct("file_path").alias("n_files"), F.max(rules.standard_import(F.col("target"))).alias("standard"))


def package_role_imports(spark, d):
    """Roles of packages by their paths, their imports and what they hold."""
    info = cards.package_info(corpus.catalog(spark, d))
    rows = info.join(corpus.package_imports(spark, d).select(F.col("path").alias("package_path"), "imports"), "package_path", "left")
    rows = rows.withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))
    return rows.select("package_path", rules.card_role(F.col("package_path"), F.col("imports"), F.col("has_interface"), F.col("has_struct"), F.col("has_method")).alias("role"), F.size(F.filter("imports", lambda p: ~rules.standard_import(p))).cast("long").alias("outside"))


QUERIES = {
    f.__name__: f
    for f in (
        package_role_imports,
        upsert_edges, upsert_vectors, upsert_packages, upsert_repositories, insert_symbols, delete_package_cascade, delete_edges_of_symbols, delete_vectors_by_prefix, imported_by_union, changed_packages,
        table_counts, repo_summary, index_status, repos_list, size_text, path_globs, package_info, package_roles, package_card, symbol_card, repo_stats, source_symbols, source_references, import_edges,
    )
}

_PATH = "repo_path || '/' || file_path"
_INFO = f"""WITH {CAT}, info AS (
  SELECT package_path, count(*) AS n_symbols, count(*) FILTER (WHERE exported) AS exported_count, bool_or(kind = 'interface') AS has_interface, bool_or(kind = 'struct') AS has_struct, bool_or(kind = 'method') AS has_method,
    coalesce(list(name ORDER BY file_path, line_start, id) FILTER (WHERE exported AND kind IN ('struct', 'interface', 'type')), []) AS kt,
    coalesce(list(name ORDER BY file_path, line_start, id) FILTER (WHERE exported AND kind IN ('func', 'method') AND ({' OR '.join(f"starts_with(name, '{p}')" for p in fixed.CARD_ENTRY_PREFIXES)})), []) AS kf,
    coalesce(list(name ORDER BY file_path, line_start, id) FILTER (WHERE exported AND kind IN ('func', 'method')), []) AS ef
  FROM cat GROUP BY package_path)"""
_ROLE = (
    "CASE "
    + " ".join(f"WHEN len(list_filter(string_split(lower(package_path), '/'), lambda p: {' OR '.join(f'contains(p, {chr(39)}{w}{chr(39)})' for w in words)})) > 0 THEN '{role}'" for words, _, role in fixed.CARD_ROLES)
    + " WHEN has_interface AND has_struct THEN 'domain logic' WHEN has_method AND NOT has_interface THEN 'business logic' ELSE 'general' END"
)
_ROLE_BY_IMPORTS = (
    "CASE "
    + " ".join(
        f"WHEN len(list_filter(string_split(lower(package_path), '/'), lambda p: {' OR '.join(f'contains(p, {chr(39)}{w}{chr(39)})' for w in words)})) > 0"
        + (f" OR len(list_filter(imports, lambda p: {' OR '.join(f'contains(p, {chr(39)}{w}{chr(39)})' for w in imported)})) > 0" if imported else "")
        + f" THEN '{role}'"
        for words, imported, role in fixed.CARD_ROLES
    )
    + " WHEN has_interface AND has_struct THEN 'domain logic' WHEN has_method AND NOT has_interface THEN 'business logic' ELSE 'general' END"
)
_EACH = "[" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(p, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{text}' END" for words, text in fixed.RESPONSIBILITIES) + "]"
_BYPATH = f"list_filter(flatten(list_transform(string_split(lower(package_path), '/'), lambda p: {_EACH})), lambda x: x IS NOT NULL)"
_DUTIES = f"""CASE WHEN len({_BYPATH}) > 0 THEN array_to_string({_BYPATH}, ', ') WHEN has_interface OR has_struct OR has_method THEN
  array_to_string(list_filter([CASE WHEN has_interface THEN 'interface definitions' END, CASE WHEN has_struct THEN 'data structures' END, CASE WHEN has_method THEN 'business operations' END], lambda x: x IS NOT NULL), ', ') ELSE 'general functionality' END"""
_CARD = f"""pc AS (SELECT package_path, 'Role: ' || {_ROLE} || chr(10) || 'Responsibilities: ' || {_DUTIES} || chr(10) || 'Key Types: ' || CASE WHEN len(kt) > 0 THEN array_to_string(kt, ', ') ELSE 'N/A' END || chr(10)
  || 'Entry Points: ' || CASE WHEN len(kf) > 0 THEN array_to_string(kf, ', ') WHEN len(ef) > 0 THEN array_to_string(ef[1:5], ', ') ELSE 'N/A' END || chr(10) AS card FROM info)"""

#: The source documents hold packages, imports and methods, formatted in the usual way; the SQL reads them line by line.
_SOURCE = """src AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(65279), '') AS t FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(?m)^package \\w+\\s*$')),
ln AS (SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM src))"""
_NO_CALLS = ", ".join(f"'{w}'" for w in "if for switch select return func go defer range make new len cap append copy delete panic recover print println close string int error struct interface map chan case var type const min max clear".split())

ORACLE = {
    "source_symbols": f"""WITH {_SOURCE}
SELECT 'doc/' || doc_id AS package_path, 'package' AS kind, count(*) AS n, 1::BIGINT AS last_line FROM ln WHERE regexp_matches(line, '^package[ \\t]+\\w') GROUP BY doc_id
UNION ALL SELECT 'doc/' || doc_id, 'file', 1, max(n) FROM ln GROUP BY doc_id
UNION ALL SELECT 'doc/' || doc_id, 'method', count(*) FILTER (WHERE starts_with(line, 'func (')), max(n) FILTER (WHERE line = '}}') FROM ln GROUP BY doc_id HAVING count(*) FILTER (WHERE starts_with(line, 'func (')) > 0""",
    "source_references": f"""WITH {_SOURCE},
body AS (SELECT doc_id, replace(regexp_replace(line, '"(?:[^"\\\\]|\\\\.)*"|`[^`]*`|//.*', '', 'g'), '(', '( ') AS line FROM ln WHERE starts_with(line, chr(9))),
called AS (SELECT doc_id, unnest(regexp_extract_all(line, '(?:^|[^\\w.])((?:[A-Za-z_]\\w*\\.)?[A-Za-z_]\\w*)\\(', 1)) AS target FROM body),
specs AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?m)^import[ \\t]*(?:\\([^)]*\\)|[^\\n(]*)')) AS spec FROM src),
every AS (
  SELECT doc_id, 'calls' AS edge_type, target FROM called WHERE string_split(target, '.')[-1] NOT IN ({_NO_CALLS})
  UNION ALL SELECT doc_id, 'imports', unnest(regexp_extract_all(spec, '"([^"\\n]+)"', 1)) FROM specs)
SELECT edge_type, target, count(*) AS n, count(DISTINCT doc_id) AS n_files FROM every GROUP BY edge_type, target""",
    "import_edges": """
WITH src AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(65279), '') AS t FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(?m)^package \\w+\\s*$')),
specs AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?m)^import[ \\t]*(?:\\([^)]*\\)|[^\\n(]*)')) AS spec FROM src),
targets AS (SELECT doc_id, unnest(regexp_extract_all(spec, '"([^"\\n]+)"', 1)) AS target FROM specs)
SELECT target, count(DISTINCT doc_id) AS n_files, bool_or(NOT contains(target, '.') OR contains(target, '/vendor/')) AS standard FROM targets GROUP BY target""",
    "package_role_imports": f"""{_INFO}, {EDG},
im AS (SELECT package_path, list(DISTINCT import_path) AS imports FROM edg JOIN cat ON cat.id = edg.from_id WHERE edge_type = 'imports' AND import_path IS NOT NULL GROUP BY package_path),
r AS (SELECT info.*, coalesce(imports, []) AS imports FROM info LEFT JOIN im USING (package_path))
SELECT package_path, {_ROLE_BY_IMPORTS} AS role, len(list_filter(imports, lambda p: contains(p, '.') AND NOT contains(p, '/vendor/')))::BIGINT AS outside FROM r""",
    "upsert_edges": f"""WITH m AS (SELECT from_id, to_id, edge_type, max(weight) AS weight, arg_min(import_path, CASE WHEN created_at < TIMESTAMPTZ '{CUT}+00' THEN '0' ELSE '1' END || created_at::VARCHAR || import_path) FILTER (WHERE import_path IS NOT NULL) AS import_path, min(created_at) AS created_at
  FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY ALL)
SELECT edge_type, count(*) AS n, sum(weight)::BIGINT AS weight, count(import_path) AS with_path, epoch_us(min(created_at)) AS first_created FROM m GROUP BY edge_type""",
    "upsert_vectors": f"""WITH {EMB}, n AS (SELECT DISTINCT symbol_id FROM symbol_vectors WHERE model = 'code-embed-b' AND symbol_id IS NOT NULL)
SELECT symbol_id, model, len(v)::BIGINT AS dim FROM emb WHERE symbol_id NOT IN (SELECT symbol_id FROM n) UNION ALL SELECT symbol_id, 'renewed', 2 FROM n""",
    "upsert_packages": f"""WITH {CAT}, p AS (SELECT package_path AS path, max(package_name) AS name, count(*) AS symbol_count FROM cat GROUP BY package_path)
SELECT path, name, symbol_count, CASE WHEN name < 'm' THEN 'old-repo' ELSE 'new-repo' END AS repo_path, CASE WHEN name < 'm' THEN 1 ELSE 2 END AS created_at, CASE WHEN name < 'm' THEN 'x' END AS imported_by FROM p""",
    "upsert_repositories": f"""WITH n AS (SELECT root_path || CASE WHEN symbol_count > 2500 THEN '' ELSE '-copy' END AS root_path, symbol_count + 1 AS symbol_count FROM repositories)
SELECT coalesce(r.id, sha1(n.root_path)) AS id, coalesce(n.root_path, r.root_path) AS root_path, coalesce(n.symbol_count, r.symbol_count) AS symbol_count, epoch_us(CASE WHEN r.id IS NOT NULL THEN r.created_at ELSE TIMESTAMPTZ '{CUT}+00' END) AS created_at FROM n FULL JOIN repositories r ON n.root_path = r.root_path""",
    "insert_symbols": f"""WITH o AS (SELECT id, min(file_path) AS file_path, min(line_start) AS line_start FROM symbols WHERE id IS NOT NULL AND created_at < TIMESTAMPTZ '{CUT}+00' GROUP BY id)
SELECT * FROM o UNION ALL SELECT id, file_path, line_start FROM (SELECT id, file_path, line_start, row_number() OVER (PARTITION BY id ORDER BY file_path, line_start) AS rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1 AND id NOT IN (SELECT id FROM o)""",
    "delete_package_cascade": f"""WITH {CAT}, {EDG}, {EMB}, k AS (SELECT id FROM cat WHERE {layer('package_path')} <> 'handler'), a AS (SELECT id FROM k UNION ALL SELECT id FROM core_symbols)
SELECT edge_type, count(*) AS n FROM edg WHERE from_id IN (SELECT id FROM a) AND to_id IN (SELECT id FROM a) GROUP BY edge_type
UNION ALL SELECT 'vectors', count(*) FROM emb WHERE symbol_id IN (SELECT id FROM a) UNION ALL SELECT 'symbols', count(*) FROM k""",
    "delete_edges_of_symbols": f"WITH {CAT}, {EDG}, g AS (SELECT id FROM cat WHERE kind IN ('field', 'const', 'var')) SELECT edge_type, count(*) AS n FROM edg WHERE from_id NOT IN (SELECT id FROM g) AND to_id NOT IN (SELECT id FROM g) GROUP BY edge_type",
    "delete_vectors_by_prefix": f"WITH {EMB} SELECT model, count(*) AS n FROM emb WHERE NOT starts_with(symbol_id, 'corp.example/a') GROUP BY model",
    "imported_by_union": """WITH i AS (SELECT DISTINCT import_path AS path, regexp_replace(regexp_extract(from_id, '^(?:pkg:)?([^:]+)', 1), '^$', '-') AS importer FROM edges WHERE import_path IS NOT NULL
  UNION SELECT DISTINCT import_path, unnest(['zz', 'corp.example/none']) FROM edges WHERE import_path IS NOT NULL)
SELECT path, count(*) AS n, md5(string_agg(importer, ',' ORDER BY importer)) AS members_md5 FROM i GROUP BY path""",
    "changed_packages": f"""WITH {CAT}, s AS (SELECT package_path, {_PATH} AS f, kind, exported, {_instant('updated_at')} AS m FROM cat),
a AS (SELECT DISTINCT package_path, f FROM s WHERE kind <> 'file'), b AS (SELECT package_path, f, max(m) AS m FROM s WHERE kind = 'file' OR exported GROUP BY package_path, f),
j AS (SELECT coalesce(a.package_path, b.package_path) AS package_path, CASE WHEN b.f IS NULL THEN 'missing' WHEN a.f IS NULL THEN 'new' WHEN b.m > TIMESTAMPTZ '{NOW}+00' - INTERVAL 30 DAY THEN 'modified' END AS reason FROM a FULL JOIN b ON a.f = b.f)
SELECT package_path, min(reason) AS reason FROM j WHERE reason IS NOT NULL GROUP BY package_path""",
    "table_counts": f"WITH {CAT}, {EDG}, {EMB} SELECT 'symbols' AS table_name, count(*) AS n FROM cat UNION ALL SELECT 'packages', count(DISTINCT package_path) FROM cat UNION ALL SELECT 'edges', count(*) FROM edg UNION ALL SELECT 'vectors', count(*) FROM emb",
    "repo_summary": f"""WITH {CAT}, {EDG}, {EMB}, s AS (SELECT repo_path, count(*) AS symbol_count, count(DISTINCT package_path) AS package_count FROM cat GROUP BY repo_path),
x AS (SELECT f.repo_path AS r1, t.repo_path AS r2 FROM edg LEFT JOIN cat f ON f.id = from_id LEFT JOIN cat t ON t.id = to_id), y AS (SELECT r1 AS r FROM x UNION ALL SELECT r2 FROM x WHERE r2 IS DISTINCT FROM r1), e AS (SELECT r, count(*) AS n FROM y WHERE r IS NOT NULL GROUP BY r),
v AS (SELECT DISTINCT repo_path FROM emb JOIN cat ON id = symbol_id)
SELECT s.repo_path, symbol_count, package_count, coalesce(n, 0) AS edge_count, v.repo_path IS NOT NULL AS has_embeddings FROM s LEFT JOIN e ON r = s.repo_path LEFT JOIN v ON v.repo_path = s.repo_path""",
    "index_status": f"""WITH a AS (SELECT root_path, has_embeddings, (epoch(TIMESTAMPTZ '{NOW}+00') - floor(epoch({_instant('last_indexed_at')})))::BIGINT AS age_seconds FROM repositories),
b AS (SELECT *, CASE WHEN age_seconds < 60 THEN age_seconds || ' seconds' WHEN age_seconds < 3600 THEN (age_seconds // 60) || ' minutes' WHEN age_seconds < 86400 THEN printf('%.1f hours', age_seconds / 3600.0) ELSE printf('%.1f days', age_seconds / 86400.0) END AS index_age FROM a)
SELECT root_path, age_seconds IS NOT NULL AS indexed, age_seconds, index_age, coalesce(age_seconds > 86400, false) AS is_stale, CASE WHEN age_seconds IS NULL THEN '' ELSE concat_ws(' ',
  CASE WHEN age_seconds > 86400 THEN 'Index is ' || index_age || ' old. Consider re-indexing for latest changes.' WHEN age_seconds > 3600 THEN 'Index is ' || index_age || ' old. Recent changes may not be reflected.' END,
  CASE WHEN NOT coalesce(has_embeddings, false) THEN 'Warning: No embeddings available. Semantic search may be limited.' END) END AS stale_reason FROM b""",
    "repos_list": f"""SELECT row_number() OVER (ORDER BY {_instant('last_indexed_at')} DESC NULLS LAST, root_path) AS place, root_path, symbol_count,
regexp_replace(string_split(regexp_replace(root_path, '/+$', ''), '/')[-1], '[^A-Za-z0-9._-]', '_', 'g') || '-' || substring(sha1(root_path), 1, 12) AS store_name FROM repositories""",
    "size_text": """WITH b AS (SELECT doc_id, strlen(text)::BIGINT * 1000 AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM b""",
    "path_globs": f"""WITH {CAT} SELECT DISTINCT repo_path, file_path FROM cat WHERE NOT (file_path LIKE '%\\_test.go' ESCAPE '\\' OR starts_with(file_path, 'internal/util') OR starts_with(file_path, '**_test.go'))
AND (regexp_matches(file_path, '^internal/[^/]*/[^/]*/[^/]*\\.go$') OR starts_with(file_path, 'lib/'))""",
    "package_info": f"{_INFO} SELECT package_path, n_symbols, exported_count, has_interface, has_struct, has_method, array_to_string(kt, ',') AS key_types, array_to_string(kf, ',') AS key_funcs FROM info",
    "package_roles": f"{_INFO} SELECT package_path, {_ROLE} AS role, {_DUTIES} AS responsibilities FROM info",
    "package_card": f"{_INFO}, {_CARD} SELECT package_path, card FROM pc",
    "symbol_card": f"""{_INFO}, {_CARD}, c AS (SELECT id, 'Signature: ' || coalesce(signature, '') || chr(10) || 'Kind: ' || kind || chr(10) || CASE WHEN coalesce(doc_comment, '') <> '' THEN 'Documentation: ' || doc_comment || chr(10) ELSE '' END
  || 'Package Context:' || chr(10) || card || chr(10) || CASE WHEN kind IN ('method', 'func') AND contains(coalesce(signature, ''), 'error') THEN 'Returns error for failure cases' || chr(10) WHEN kind = 'interface' THEN 'Interface defining behavior contract' || chr(10) WHEN kind = 'struct' THEN 'Data structure' || chr(10) ELSE '' END AS card
  FROM cat JOIN pc USING (package_path)) SELECT id, length(card) AS chars, md5(card) AS card_md5 FROM c""",
    "repo_stats": f"WITH {CAT} SELECT repo_path, count(DISTINCT package_path) AS packages, count(DISTINCT file_path) AS files, count(*) AS symbols, count(*) FILTER (WHERE exported) AS exported FROM cat GROUP BY repo_path",
}
