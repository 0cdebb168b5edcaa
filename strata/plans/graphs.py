"""Lookup, graph and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.common import table
from strata.functions import rules
from strata.functions.text import comment_source
from strata.operators import graph, lookup
from strata.plans import fixed
from strata.plans.sql import CAT, EDG, entry, intent, layer, layer_score, values
from strata.sources import corpus

NAMES = ("ListGraph", "MergeSegment", "ApplyHeader", "FlushSchema", "StoreInvoice", "CompareCard")
INTENT_TEXTS = ((1, "system architecture overview"), (2, "fix the retry bug"), (3, "how to extend the parser"), (4, "订单模块的设计方案"), (5, "实现登录"), (6, "plain words"), (7, "Interface design"))


def _catalog(spark, d):
    return corpus.catalog(spark, d)


def _ends(spark, d):
    """Catalog and shared library together, as end points of edges."""
    core = table(spark, d, "core_symbols").select("id", "name", "kind", "package_path")
    return _catalog(spark, d).select("id", "name", "kind", "package_path").unionByName(core)


def sym_find_by_name(spark, d):
    """Symbols of the stated names, of each the first 20 that the lookup gives."""
    from functools import reduce

    found = [lookup.symbols_by_name(_catalog(spark, d), n) for n in NAMES]
    return reduce(lambda a, b: a.unionByName(b), found).select("name", "package_path", "kind", "id", "repo_path")


def sym_by_package(spark, d):
    """Symbols per package and kind."""
    return _catalog(spark, d).groupBy("package_path", "kind").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def packages_by_repo(spark, d):
    s = _catalog(spark, d).where("repo_path is not null")
    return lookup.packages(s.groupBy("repo_path", F.col("package_path").alias("path")).agg(F.count("*").alias("symbol_count")))


def comment_lines(spark, d):
    """Comments as source lines."""
    return _catalog(spark, d).where("doc_comment is not null").select("id", comment_source(F.col("doc_comment")).alias("formatted"))


def files_by_repo(spark, d):
    return _catalog(spark, d).where("kind = 'file'").select("repo_path", "id", "name", "file_path")


def sym_embeddable(spark, d):
    return _catalog(spark, d).where(F.col("kind").isin(*rules.EMBEDDABLE_KINDS)).select("id", F.concat_ws("\n", F.coalesce("signature", F.lit("")), F.coalesce("doc_comment", F.lit(""))).alias("input_text"))


def sym_tokens(spark, d):
    """Keyword tokens: name and kind."""
    return _catalog(spark, d).select("id", F.array_join(F.array("name", "kind"), " ").alias("keyword_tokens"))


def undocumented(spark, d):
    """Functions, methods and types without a comment, per package."""
    s = _catalog(spark, d).where((F.trim(F.coalesce("doc_comment", F.lit(""))) == "") & F.col("kind").isin("func", "method", "struct", "interface", "type"))
    return s.groupBy("package_path").agg(F.count("*").alias("n"))


def sym_first_per_file(spark, d):
    """At most three undocumented symbols a file, in order of their lines."""
    from pyspark.sql import Window

    s = _catalog(spark, d).where((F.trim(F.coalesce("doc_comment", F.lit(""))) == "") & F.col("kind").isin("func", "method"))
    w = Window.partitionBy("repo_path", "file_path").orderBy("line_start", "id")
    return s.withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 3").select("repo_path", "file_path", "rn", "id")


def _seeds(spark, d):
    return _catalog(spark, d).where(F.col("name").isin(*NAMES)).select("id")


def refs_incoming(spark, d):
    return graph.neighbours(table(spark, d, "core_symbols").select("id"), corpus.merged_edges(spark, d), _ends(spark, d), "incoming", "implements")


def refs_outgoing(spark, d):
    return graph.neighbours(_seeds(spark, d), corpus.merged_edges(spark, d), _ends(spark, d), "outgoing")


def refs_both(spark, d):
    return graph.neighbours(_seeds(spark, d), corpus.merged_edges(spark, d), _ends(spark, d), "both")


def in_subquery_edges(spark, d):
    """Edges of each repository: an end is one of its symbols."""
    ids = _catalog(spark, d).where("kind = 'interface'").select("id")
    e = corpus.merged_edges(spark, d)
    a = e.join(ids, e["from_id"] == ids["id"], "left_semi").unionByName(e.join(ids, e["to_id"] == ids["id"], "left_semi")).distinct()
    return a.groupBy("edge_type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def edge_histogram(spark, d):
    return corpus.merged_edges(spark, d).groupBy("edge_type").agg(F.count("*").alias("n"), F.sum("weight").alias("total_weight"), F.max("weight").alias("max_weight"))


def graph_degree(spark, d):
    return graph.degrees(_ends(spark, d), corpus.merged_edges(spark, d))


def graph_pagerank(spark, d):
    ends = _ends(spark, d)
    calls = corpus.merged_edges(spark, d).where("edge_type = 'calls'")
    return graph.pagerank(ends, calls).select("id", F.round(F.col("pagerank") * 1e6, 4).alias("pagerank_ppm"))


def graph_layer(spark, d):
    s = _catalog(spark, d).select("package_path").distinct().withColumn("layer", rules.layer(F.col("package_path")))
    return s.withColumn("score", rules.layer_score(F.col("layer")))


def graph_entry_points(spark, d):
    s = _catalog(spark, d)
    return s.select("id", rules.entry_point(F.col("name"), F.col("kind"), F.col("exported"), F.col("package_path"), F.col("signature")).alias("is_entry"), rules.card_entry_point(F.col("name")).alias("is_card_entry"))


def graph_khop(spark, d):
    seeds = table(spark, d, "core_symbols").where("kind = 'interface'").select("id")
    return graph.k_hop(seeds, corpus.merged_edges(spark, d).where("edge_type in ('implements', 'embeds')"), 2).select("id", F.col("hop").cast("long").alias("hop"))


def graph_adjacency(spark, d):
    seeds = table(spark, d, "core_symbols").where("kind = 'interface'").select("id")
    a = graph.adjacency(seeds, corpus.merged_edges(spark, d).where("edge_type in ('implements', 'embeds')"), 2)
    return a.select("id", F.array_join("targets", " ").alias("targets"))


def graph_common_callers(spark, d):
    """For the hits of every search query, the source with most edges into them."""
    hits = table(spark, d, "search_hits").where("query_id is not null and symbol_id is not null").select("query_id", "symbol_id").distinct()
    return graph.common_callers(hits, corpus.merged_edges(spark, d))


def call_enclosing_func(spark, d):
    """Second lines of all symbols against the innermost function around them, by file and line."""
    s = _catalog(spark, d).withColumn("file", F.concat_ws("/", "repo_path", "file_path"))
    spans = s.where("kind in ('func', 'method') and line_end >= line_start").select("file", "line_start", "line_end", "id")
    points = s.select("file", (F.col("line_start") + 1).alias("line"))
    return graph.enclosing(points, spans)


def resolve_symbol(spark, d):
    """References built from the edges' targets: the exact symbol, else its package's."""
    parts = F.regexp_extract("to_id", r"^([^:]+):([a-z-]+):(.+)$", 0)
    refs = table(spark, d, "edges").where(parts != "").select(F.regexp_extract("to_id", r"^([^:]+):([a-z-]+):(.+)$", 1).alias("package_path"), F.regexp_extract("to_id", r"^([^:]+):([a-z-]+):(.+)$", 2).alias("kind"), F.regexp_extract("to_id", r"^([^:]+):([a-z-]+):(.+)$", 3).alias("name")).distinct()
    return graph.resolve(refs, _catalog(spark, d))


def _method_sets(spark, d):
    s = _catalog(spark, d).where("kind = 'method'")
    own = s.withColumn("owner", F.concat_ws(":", "package_path", F.split(F.regexp_extract("id", r":(?:interface-)?method:([^:]+)$", 1), r"\.")[0])).withColumn("method", F.col("name"))
    return own.where(~F.col("id").contains(":interface-method:")), own.where(F.col("id").contains(":interface-method:"))


def implements_sets(spark, d):
    types, interfaces = _method_sets(spark, d)
    return graph.implementations(types, interfaces)


def intent_detect(spark, d):
    q = spark.createDataFrame(list(INTENT_TEXTS), "query_id int, text string")
    return q.select(F.col("query_id").cast("long").alias("query_id"), rules.intent(F.col("text")).alias("intent"))


def intent_reorder(spark, d):
    """Symbols by intent score, per intent and kind."""
    s = _catalog(spark, d).withColumn("layer", rules.layer(F.col("package_path")))
    i = F.explode(F.array(*[F.lit(x[0]) for x in rules.INTENTS])).alias("intent")
    s = s.select("kind", "layer", i)
    return s.withColumn("score", F.round(rules.intent_score(F.col("intent"), F.col("layer"), F.col("kind")), 6)).groupBy("intent", "kind", "layer", "score").agg(F.count("*").alias("n"))


def kind_histogram(spark, d):
    return _catalog(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("exported"), 1)).alias("n_exported"))


QUERIES = {
    f.__name__: f
    for f in (
        sym_find_by_name, sym_by_package, files_by_repo, sym_embeddable, sym_tokens, undocumented, sym_first_per_file, refs_incoming, refs_outgoing, refs_both, packages_by_repo, comment_lines, graph_adjacency, in_subquery_edges, edge_histogram, graph_degree, graph_pagerank,
        graph_layer, graph_entry_points, graph_khop, graph_common_callers, call_enclosing_func, resolve_symbol, implements_sets, intent_detect, intent_reorder, kind_histogram,
    )
}

_NAMES = ", ".join(f"'{n}'" for n in NAMES)
_ENDS = "ends AS (SELECT id, name, kind, package_path FROM cat UNION ALL SELECT id, name, kind, package_path FROM core_symbols)"
_REFS = "SELECT e.edge_type, e.from_id, f.name AS from_name, f.kind AS from_kind, e.to_id, t.name AS to_name, t.kind AS to_kind, e.weight FROM edg e JOIN ends f ON e.from_id = f.id JOIN ends t ON e.to_id = t.id"
_PR0 = f"""WITH {CAT}, {EDG}, {_ENDS},
ids AS MATERIALIZED (SELECT DISTINCT id FROM ends), n AS (SELECT count(*)::DOUBLE AS n FROM ids),
ins AS MATERIALIZED (SELECT from_id, to_id FROM edg WHERE edge_type = 'calls' AND from_id IN (SELECT id FROM ids) AND to_id IN (SELECT id FROM ids)),
links AS MATERIALIZED (SELECT from_id, to_id, count(*) OVER (PARTITION BY from_id) AS outdeg FROM ins),
r0 AS MATERIALIZED (SELECT id, 1 / n AS pr FROM ids, n)"""


def _pagerank_sql() -> str:
    steps = [
        f"""r{i} AS MATERIALIZED (SELECT ids.id, 0.15 / n + 0.85 * coalesce(got, 0) AS pr FROM ids CROSS JOIN n
  LEFT JOIN (SELECT to_id, sum(pr / outdeg) AS got FROM links JOIN r{i - 1} ON links.from_id = r{i - 1}.id GROUP BY to_id) s ON s.to_id = ids.id)"""
        for i in range(1, graph.ITERATIONS + 1)
    ]
    return f"{_PR0},\n" + ",\n".join(steps) + f"\nSELECT id, round(pr * 1e6, 4) AS pagerank_ppm FROM r{graph.ITERATIONS}"


_BLANK_DOC = "trim(coalesce(doc_comment, ''), ' ') = ''"
_PARTS = "'^([^:]+):([a-z-]+):(.+)$'"
ORACLE = {
    "sym_find_by_name": f"WITH {CAT} SELECT name, package_path, kind, id, repo_path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY package_path, kind, id) AS rn FROM cat WHERE name IN ({_NAMES})) WHERE rn <= 20",
    "packages_by_repo": f"WITH {CAT} SELECT repo_path, package_path AS path, count(*) AS symbol_count FROM cat WHERE repo_path IS NOT NULL GROUP BY ALL",
    "comment_lines": f"""WITH {CAT}, s AS (SELECT id, string_split(doc_comment, chr(10)) AS l FROM cat WHERE doc_comment IS NOT NULL),
t AS (SELECT id, len(l) AS n, list_transform(l, lambda x: regexp_replace(x, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')) AS l FROM s)
SELECT id, array_to_string(list_transform(list_filter(list_zip(l, range(1, n + 1)), lambda z: z[1] <> '' OR z[2] < n), lambda z: CASE WHEN z[1] = '' THEN '//' ELSE '// ' || z[1] END), chr(10)) AS formatted FROM t""",
    "sym_by_package": f"WITH {CAT} SELECT package_path, kind, count(*) AS n, min(name) AS first_name, max(name) AS last_name FROM cat GROUP BY ALL",
    "files_by_repo": f"WITH {CAT} SELECT repo_path, id, name, file_path FROM cat WHERE kind = 'file'",
    "sym_embeddable": f"WITH {CAT} SELECT id, coalesce(signature, '') || chr(10) || coalesce(doc_comment, '') AS input_text FROM cat WHERE kind IN ('func', 'method', 'struct', 'interface')",
    "sym_tokens": f"WITH {CAT} SELECT id, name || ' ' || kind AS keyword_tokens FROM cat",
    "undocumented": f"WITH {CAT} SELECT package_path, count(*) AS n FROM cat WHERE {_BLANK_DOC} AND kind IN ('func', 'method', 'struct', 'interface', 'type') GROUP BY package_path",
    "sym_first_per_file": f"WITH {CAT} SELECT * FROM (SELECT repo_path, file_path, row_number() OVER (PARTITION BY repo_path, file_path ORDER BY line_start, id) AS rn, id FROM cat WHERE {_BLANK_DOC} AND kind IN ('func', 'method')) WHERE rn <= 3",
    "refs_incoming": f"WITH {CAT}, {EDG}, {_ENDS} {_REFS} WHERE e.edge_type = 'implements' AND e.to_id IN (SELECT id FROM core_symbols)",
    "refs_outgoing": f"WITH {CAT}, {EDG}, {_ENDS} {_REFS} WHERE e.from_id IN (SELECT id FROM cat WHERE name IN ({_NAMES}))",
    "refs_both": f"WITH {CAT}, {EDG}, {_ENDS}, seed AS (SELECT id FROM cat WHERE name IN ({_NAMES})) {_REFS} WHERE e.from_id IN (SELECT id FROM seed) OR e.to_id IN (SELECT id FROM seed)",
    "in_subquery_edges": f"WITH {CAT}, {EDG}, i AS (SELECT id FROM cat WHERE kind = 'interface') SELECT edge_type, count(*) AS n, sum(weight)::BIGINT AS weight FROM edg WHERE from_id IN (SELECT id FROM i) OR to_id IN (SELECT id FROM i) GROUP BY edge_type",
    "edge_histogram": f"WITH {EDG} SELECT edge_type, count(*) AS n, sum(weight)::BIGINT AS total_weight, max(weight) AS max_weight FROM edg GROUP BY edge_type",
    "graph_degree": f"""WITH {CAT}, {EDG}, {_ENDS}, i AS (SELECT to_id AS id, sum(weight)::BIGINT AS w FROM edg GROUP BY to_id), o AS (SELECT from_id AS id, sum(weight)::BIGINT AS w FROM edg GROUP BY from_id)
SELECT id, coalesce(i.w, 0) AS in_degree, coalesce(o.w, 0) AS out_degree, coalesce(i.w, 0) + coalesce(o.w, 0) AS centrality FROM (SELECT DISTINCT id FROM ends) LEFT JOIN i USING (id) LEFT JOIN o USING (id)""",
    "graph_pagerank": _pagerank_sql(),
    "graph_layer": f"WITH {CAT}, p AS (SELECT DISTINCT package_path, {layer('package_path')} AS layer FROM cat) SELECT package_path, layer, ({layer_score('layer')})::DOUBLE AS score FROM p",
    "graph_entry_points": f"WITH {CAT} SELECT id, {entry()} AS is_entry, ({' OR '.join(f'starts_with(name, {chr(39)}{p}{chr(39)})' for p in fixed.CARD_ENTRY_PREFIXES)}) AS is_card_entry FROM cat",
    "graph_khop": f"""WITH {EDG}, e AS (SELECT from_id AS a, to_id AS b FROM edg WHERE edge_type IN ('implements', 'embeds') UNION SELECT to_id, from_id FROM edg WHERE edge_type IN ('implements', 'embeds')),
h0 AS (SELECT id FROM core_symbols WHERE kind = 'interface'), h1 AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h1))
SELECT id, 0::BIGINT AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""",
    "graph_adjacency": f"""WITH {EDG}, e AS (SELECT from_id, to_id FROM edg WHERE edge_type IN ('implements', 'embeds')),
h0 AS (SELECT id FROM core_symbols WHERE kind = 'interface'), x AS (SELECT id FROM h0 UNION SELECT to_id FROM e WHERE from_id IN (SELECT id FROM h0) UNION SELECT from_id FROM e WHERE to_id IN (SELECT id FROM h0))
SELECT id, coalesce((SELECT string_agg(to_id, ' ' ORDER BY to_id) FROM e WHERE from_id = x.id), '') AS targets FROM x WHERE id IN (SELECT from_id FROM e) OR id IN (SELECT to_id FROM e)""",
    "graph_common_callers": f"""WITH {EDG}, h AS (SELECT DISTINCT query_id, symbol_id FROM search_hits WHERE query_id IS NOT NULL AND symbol_id IS NOT NULL),
c AS (SELECT query_id, from_id AS caller_id, count(*) AS n FROM h JOIN edg ON symbol_id = to_id WHERE from_id <> to_id GROUP BY ALL)
SELECT query_id, caller_id, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, caller_id) AS rn FROM c) WHERE rn = 1""",
    "call_enclosing_func": f"""WITH {CAT}, s AS (SELECT *, repo_path || '/' || file_path AS file FROM cat),
p AS (SELECT DISTINCT file, line_start + 1 AS line FROM s), f AS (SELECT file, line_start, line_end, id FROM s WHERE kind IN ('func', 'method') AND line_end >= line_start)
SELECT file, line, id FROM (SELECT p.file, p.line, f.id, row_number() OVER (PARTITION BY p.file, p.line ORDER BY line_end - line_start, f.id) AS rn FROM p JOIN f ON p.file = f.file AND p.line BETWEEN line_start AND line_end) WHERE rn = 1""",
    "resolve_symbol": f"""WITH {CAT}, r AS (SELECT DISTINCT regexp_extract(to_id, {_PARTS}, 1) AS package_path, regexp_extract(to_id, {_PARTS}, 2) AS kind, regexp_extract(to_id, {_PARTS}, 3) AS name FROM edges WHERE regexp_matches(to_id, {_PARTS}))
SELECT r.package_path, r.kind, r.name, coalesce(a.id, b.id) AS target_id FROM r LEFT JOIN cat a ON a.id = r.package_path || ':' || r.kind || ':' || r.name LEFT JOIN cat b ON b.id = 'pkg:' || r.package_path""",
    "implements_sets": f"""WITH {CAT}, m AS (SELECT contains(id, ':interface-method:') AS abstract, package_path || ':' || split_part(regexp_extract(id, ':(?:interface-)?method:([^:]+)$', 1), '.', 1) AS owner, name AS method FROM cat WHERE kind = 'method'),
t AS (SELECT DISTINCT owner, method FROM m WHERE NOT abstract), i AS (SELECT DISTINCT owner, method FROM m WHERE abstract), need AS (SELECT owner, count(*) AS need FROM i GROUP BY owner)
SELECT t.owner AS type_id, i.owner AS interface_id FROM t JOIN i USING (method) JOIN need ON need.owner = i.owner GROUP BY t.owner, i.owner, need HAVING count(*) = need""",
    "intent_detect": f"SELECT query_id::BIGINT AS query_id, {intent('text')} AS intent FROM {values(INTENT_TEXTS, 'query_id, text')}",
    "intent_reorder": f"""WITH {CAT}, s AS (SELECT kind, {layer('package_path')} AS layer, unnest(['design', 'implementation', 'extension']) AS intent FROM cat),
p AS (SELECT *, CASE intent
  WHEN 'design' THEN (CASE WHEN layer = 'service' THEN 1.0 ELSE 0 END) + (CASE WHEN kind = 'interface' THEN 0.8 ELSE 0 END) + (CASE WHEN layer = 'handler' THEN 0.6 ELSE 0 END)
  WHEN 'implementation' THEN (CASE WHEN layer = 'repository' THEN 1.0 ELSE 0 END) + (CASE WHEN layer = 'domain' THEN 0.8 ELSE 0 END) + (CASE WHEN kind <> 'interface' THEN 0.5 ELSE 0 END)
  ELSE (CASE WHEN kind = 'interface' THEN 1.0 ELSE 0 END) + (CASE WHEN layer = 'middleware' THEN 0.8 ELSE 0 END) END AS score FROM s)
SELECT intent, kind, layer, round(score::DOUBLE, 6) AS score, count(*) AS n FROM p GROUP BY ALL""",
    "kind_histogram": f"WITH {CAT} SELECT kind, count(*) AS n, count(*) FILTER (WHERE exported) AS n_exported FROM cat GROUP BY kind",
}
