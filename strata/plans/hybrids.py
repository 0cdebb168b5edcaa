"""Hybrid search and evidence queries over a stated batch of texts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.common import cut, table
from strata.functions import rules
from strata.operators import evidence, fts, graph, search
from strata.plans.sql import CAT, EDG, EMB, QVEC, cos, entry, layer, layer_score, tok
from strata.plans.vectors import query_vectors
from strata.sources import corpus

COLUMNS = ("id", "name", "semantic_text")
#: Expressions of the batch, one per query vector.
TEXTS = ((1, "service method"), (2, "handler OR middleware"), (3, "domain struct"), (4, "repository interface"), (5, "client func"))
#: A larger batch: two words of the cards for each of the first vectors.
WORDS = ("service", "method", "handler", "middleware", "domain", "struct", "repository", "interface", "client", "func")
BATCH = tuple((n + 1, WORDS[n % 10], WORDS[(n + 1 + n // 10) % 10]) for n in range(50))
INTENTS = ((1, "design"), (2, "implementation"), (3, "extension"), (4, ""), (5, "design"))


def arms(spark, d, options: search.Options, texts=TEXTS):
    """Both arms of the stated batch cut at twice k; an arm without weight is empty."""
    o, symbols = options.normalised(), corpus.catalog(spark, d)
    e = corpus.embeddings(spark, d)
    if options.prefilter:
        allowed = symbols.where(options.condition()).select("id")
        e = e.join(allowed, e["symbol_id"] == allowed["id"], "left_semi")
        symbols = symbols.join(allowed, "id", "left_semi")
    v = search.vector_search(e, query_vectors(spark, d, len(texts)), 2 * o.k)
    index = None if options.prefilter else corpus.text_index(spark, d, "symbols", symbols, "id", COLUMNS)
    k = fts.rank_scores(search.top(fts.match(symbols, "id", COLUMNS, texts, index).select(F.col("query_id").cast("long").alias("query_id"), F.col("doc").alias("symbol_id"), "score"), 2 * o.k))
    if not o.vector_weight:
        v = v.limit(0)
    if not o.keyword_weight:
        k = k.limit(0)
    return v, k


def results(spark, d, options: search.Options = search.Options(), with_intent: bool = False) -> DataFrame:
    v, k = arms(spark, d, options)
    symbols = corpus.catalog(spark, d)
    hits = search.hybrid(v, k, symbols, options)
    if options.rank_by_graph:
        hits = cut(hits)  # at most 4k rows a query, which the features need several times
    features = graph.features(hits, corpus.merged_edges(spark, d), symbols) if options.rank_by_graph else None
    intents = spark.createDataFrame(list(INTENTS), "query_id long, intent string") if with_intent else None
    return search.blend(hits, features, options, intents)


def _flat(df, *more):
    return df.select("query_id", F.col("place").cast("long").alias("place"), "symbol_id", F.round("vector", 6).alias("vector"), F.round("keyword", 6).alias("keyword"), F.round("combined", 6).alias("combined"), *more)


PLAIN = search.Options(rank_by_graph=False)


def hybrid_search(spark, d):
    return _flat(results(spark, d, PLAIN))


def hybrid_search_batch(spark, d):
    """Fifty queries at once."""
    v, k = arms(spark, d, PLAIN, [(n, f"{a} {b}") for n, a, b in BATCH])
    return _flat(search.blend(search.hybrid(v, k, corpus.catalog(spark, d), PLAIN), None, PLAIN))


def hybrid_vector_only(spark, d):
    return _flat(results(spark, d, search.Options(keyword_weight=0.0, rank_by_graph=False)))


def hybrid_keyword_only(spark, d):
    return _flat(results(spark, d, search.Options(vector_weight=0.0, rank_by_graph=False)))


FILTERED = search.Options(rank_by_graph=False, exported_only=False, kinds=("func", "method", "struct"), layers=("service", "handler", "domain", "unknown"))


def hybrid_filters(spark, d):
    return _flat(results(spark, d, FILTERED))


def hybrid_package(spark, d):
    """Hits of one package: the one with most symbols."""
    sizes = corpus.catalog(spark, d).groupBy("package_path").count().orderBy(F.desc("count"), "package_path")
    row = sizes.first()
    return _flat(results(spark, d, search.Options(rank_by_graph=False, exported_only=False, k=20, package=row["package_path"] if row else None)))


def hybrid_prefiltered(spark, d):
    """The same filters before the arms are cut, so k results come out where there are as many."""
    from dataclasses import replace

    return _flat(results(spark, d, replace(FILTERED, prefilter=True)))


def hybrid_reasons(spark, d):
    return results(spark, d, PLAIN).select("query_id", "symbol_id", F.array_join("reasons", "; ").alias("reasons"))


def hybrid_graph_rank(spark, d):
    return _flat(results(spark, d), F.round("graph", 6).alias("graph"), F.array_join("reasons", "; ").alias("reasons"))


def hybrid_intent(spark, d):
    return _flat(results(spark, d, search.Options(rank_by_graph=False), True), F.col("intent"), F.round("intent_score", 6).alias("intent_score"))


def graph_pagerank_candidates(spark, d):
    v, k = arms(spark, d, search.Options())
    hits = cut(search.hybrid(v, k, corpus.catalog(spark, d), search.Options()))
    return graph.candidate_pagerank(hits, corpus.merged_edges(spark, d)).withColumn("pagerank", F.round("pagerank", 9))


def graph_score(spark, d):
    """Graph features of every hit of the stored search results, on each query's own graph of calls."""
    hits = table(spark, d, "search_hits").where("query_id is not null and symbol_id is not null").select("query_id", "symbol_id").distinct()
    f = graph.features(hits, corpus.merged_edges(spark, d), corpus.catalog(spark, d))
    return f.select("query_id", "symbol_id", "layer", "is_entry", "is_interface", "in_degree", "out_degree", F.round("pagerank", 9).alias("pagerank"), F.round("graph", 9).alias("graph"))


def _stored_results(spark, d) -> DataFrame:
    """Ranked hits from the stored search results: the best ten of each query by their stored combined score."""
    from pyspark.sql import Window

    h = table(spark, d, "search_hits").where("query_id is not null and symbol_id is not null and combined is not null and not isnan(combined)")
    w = Window.partitionBy("query_id", "symbol_id").orderBy(F.desc_nulls_last("scored_at"), F.desc("combined"))
    h = h.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("query_id", "symbol_id", "combined", F.when(F.col("vector").isNotNull() & ~F.isnan("vector"), F.col("vector")).otherwise(0.0).alias("vector"))
    s = corpus.catalog(spark, d).select(F.col("id").alias("symbol_id"), "name", "kind", "package_path", "signature", "file_path", "line_start", "line_end", "exported", "semantic_text")
    rows = h.join(s, "symbol_id")
    place = Window.partitionBy("query_id").orderBy(F.desc(F.round("combined", 9)), "symbol_id")
    rows = rows.withColumn("place", F.row_number().over(place)).where("place <= 10")
    rows = rows.withColumn("layer", rules.layer(F.col("package_path"))).withColumn("is_entry", rules.entry_point(F.col("name"), F.col("kind"), F.col("exported"), F.col("package_path"), F.col("signature")))
    return rows.withColumn("reasons", rules.hybrid_reasons(F.col("vector"), F.lit(0.0), F.col("exported"), F.col("kind")))


def _with_graph(spark, d) -> DataFrame:
    """The stored results with the graph features of each query's hits."""
    hits = cut(_stored_results(spark, d))
    f = graph.features(hits, corpus.merged_edges(spark, d), corpus.catalog(spark, d))
    return hits.join(f.select("query_id", "symbol_id", "graph", "pagerank"), ["query_id", "symbol_id"])


def evidence_packages(spark, d):
    c = evidence.package_cards(_with_graph(spark, d))
    return c.select("query_id", F.col("card").cast("long").alias("card"), "path", F.round("score", 6).alias("score"), "role", "summary", F.array_join("why", "; ").alias("why"), F.array_join("key_symbols", ", ").alias("key_symbols"))


def evidence_imports(spark, d):
    """Package cards with what their packages import and what imports them."""
    c = evidence.package_cards(_stored_results(spark, d).withColumn("graph", F.lit(0.0)), corpus.package_imports(spark, d))
    return c.select("query_id", F.col("card").cast("long").alias("card"), "path", F.array_join("imports", " ").alias("imports"), F.array_join("imported_by", " ").alias("imported_by"))


def evidence_symbols(spark, d):
    return evidence.symbol_cards(_stored_results(spark, d)).withColumn("place", F.col("place").cast("long"))


def evidence_hints(spark, d):
    hits = _with_graph(spark, d)
    e = corpus.merged_edges(spark, d)
    ends = corpus.catalog(spark, d).select("id", "name", "package_path")
    return evidence.hints(hits, graph.common_callers(hits, e), ends).withColumn("n", F.col("n").cast("long"))


def _with_lines(spark, d):
    return _stored_results(spark, d).withColumn("n_lines", F.when((F.col("line_start") > 0) & (F.col("line_end") >= F.col("line_start")), F.col("line_end") - F.col("line_start") + 1))


def evidence_snippets(spark, d):
    s = evidence.snippets(_with_lines(spark, d), max_lines=60)
    return s.select("query_id", F.col("rank").cast("long").alias("rank"), "symbol_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("kept_lines").cast("long").alias("kept_lines"), F.round("priority", 6).alias("priority"))


def evidence_metadata(spark, d):
    hits = _with_lines(spark, d)
    return evidence.metadata(hits, evidence.snippets(hits, max_lines=60))


def read_lines(spark, d):
    """Lines 3 to 40 of every text, at most 20 of them, numbered."""
    return evidence.read_range(corpus.lines(table(spark, d, "documents")), 3, 40, 20).withColumn("line_no", F.col("line_no").cast("long"))


def read_symbol_lines(spark, d):
    """Texts as files: the span of lines 2-6 of each, joined."""
    lines = corpus.lines(table(spark, d, "documents")).select(F.col("doc_id").cast("string").alias("file_path"), "line_no", "text")
    spans = table(spark, d, "documents").where("text is not null").select(F.lit(1).alias("query_id"), F.col("doc_id").cast("string").alias("symbol_id"), F.col("doc_id").cast("string").alias("file_path"), F.lit(2).alias("line_start"), F.lit(6).alias("line_end"))
    x = evidence.extract_lines(spans, lines)
    return x.select(F.col("symbol_id").cast("long").alias("doc_id"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search, hybrid_search_batch, hybrid_vector_only, hybrid_keyword_only, hybrid_filters, hybrid_package, hybrid_prefiltered, hybrid_reasons, hybrid_graph_rank, hybrid_intent, graph_pagerank_candidates, graph_score,
        evidence_packages, evidence_imports, evidence_symbols, evidence_hints, evidence_snippets, evidence_metadata, read_lines, read_symbol_lines,
    )
}

# ---- the same in SQL ----------------------------------------------------------------------------------------
_TOKS = f"list_concat(list_concat({tok('id')}, {tok('name')}), {tok('semantic_text')})"


def _leaf(q: int, w: str) -> str:
    return f"SELECT {q}::BIGINT AS query_id, '{w}' AS leaf, id, (len(w) - len(list_filter(w, lambda x: x <> '{w}')))::DOUBLE AS tf FROM {{src}} WHERE list_contains(w, '{w}')"


_LEAVES = ((1, "service"), (1, "method"), (2, "handler"), (2, "middleware"), (3, "domain"), (3, "struct"), (4, "repository"), (4, "interface"), (5, "client"), (5, "func"))


def _arms(prefilter: str = "true", vector: str = "true", keyword: str = "true", leaves=None, queries: int = 5) -> str:
    either = "query_id = 2 OR " if leaves is None else ""
    leaves = " UNION ALL ".join(_leaf(q, w).format(src="tk") for q, w in leaves or _LEAVES)
    return f"""WITH {CAT}, {EDG}, {EMB}, {QVEC.replace("LIMIT 5", f"LIMIT {queries}")},
allowed AS (SELECT *, {layer('package_path')} AS layer FROM cat),
pool AS (SELECT * FROM allowed WHERE {prefilter}),
vs AS (SELECT query_id, symbol_id, {cos('e.v', 'q.qv')} AS score FROM emb e JOIN qvec q ON len(e.v) = len(q.qv) WHERE {vector} AND ({prefilter} OR false) IS NOT NULL AND ('{prefilter}' = 'true' OR symbol_id IN (SELECT id FROM pool))),
v AS (SELECT query_id, symbol_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, symbol_id) AS p FROM vs) WHERE p <= 20),
tk AS (SELECT id, {_TOKS} AS w FROM pool), lens AS (SELECT id, len(w)::DOUBLE AS l FROM tk), co AS (SELECT count(*)::DOUBLE AS n_docs, avg(l) AS avg_len FROM lens),
leaf AS ({leaves}), df AS (SELECT query_id, leaf, count(*)::DOUBLE AS n FROM leaf GROUP BY ALL),
part AS (SELECT query_id, id, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len)) AS s FROM leaf JOIN df USING (query_id, leaf) JOIN lens USING (id), co),
ks AS (SELECT query_id, id AS symbol_id, sum(s) AS score FROM part WHERE {keyword} GROUP BY query_id, id HAVING {either}count(*) = 2),
kp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, symbol_id) AS p FROM ks),
k AS (SELECT query_id, symbol_id, 1 - (p - 1) / (count(*) OVER (PARTITION BY query_id))::DOUBLE AS keyword FROM kp WHERE p <= 20),
fused AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.symbol_id, k.symbol_id) AS symbol_id, coalesce(score, 0) AS vector, coalesce(keyword, 0) AS keyword FROM v FULL JOIN k ON v.query_id = k.query_id AND v.symbol_id = k.symbol_id)"""


def _base(where: str, wv: float, wk: float) -> str:
    return f"""hit AS (SELECT f.*, a.* EXCLUDE (id), {wv} * vector + {wk} * keyword AS base FROM fused f JOIN allowed a ON a.id = f.symbol_id WHERE {where}),
r AS (SELECT *, base AS combined, row_number() OVER (PARTITION BY query_id ORDER BY round(base, 9) DESC, symbol_id) AS place FROM hit)"""


_OUT = "SELECT query_id, place, symbol_id, round(vector, 6) AS vector, round(keyword, 6) AS keyword, round(combined, 6) AS combined FROM r WHERE place <= 10"
_WHERE_F = "kind IN ('func', 'method', 'struct') AND layer IN ('service', 'handler', 'domain', 'unknown')"
_HR = """list_filter([CASE WHEN vector > 0.7 THEN 'Strong semantic similarity' WHEN vector > 0.5 THEN 'Moderate semantic similarity' END,
  CASE WHEN keyword > 0.7 THEN 'Exact keyword match' WHEN keyword > 0.5 THEN 'Partial keyword match' END, CASE WHEN exported THEN 'Exported API' END, CASE WHEN kind IN ('func', 'method') THEN 'Executable code' END], lambda x: x IS NOT NULL)"""
_HREASONS = f"CASE WHEN len({_HR}) > 0 THEN {_HR} ELSE ['Match found'] END"


def _pagerank(cand: str) -> str:
    """PageRank on the calls among each query's rows of ``cand`` (query_id, symbol_id)."""
    steps = [
        f"""g{i} AS MATERIALIZED (SELECT c.query_id, c.symbol_id, 0.15 / n + 0.85 * coalesce(got, 0) AS pr FROM {cand} c JOIN gn USING (query_id)
  LEFT JOIN (SELECT l.query_id, l.to_id, sum(pr / outdeg) AS got FROM gl l JOIN g{i - 1} p ON l.query_id = p.query_id AND l.from_id = p.symbol_id GROUP BY ALL) s ON s.query_id = c.query_id AND s.to_id = c.symbol_id)"""
        for i in range(1, graph.ITERATIONS + 1)
    ]
    return f"""gn AS MATERIALIZED (SELECT query_id, count(*)::DOUBLE AS n FROM {cand} GROUP BY query_id),
gl AS MATERIALIZED (SELECT a.query_id, e.from_id, e.to_id, count(*) OVER (PARTITION BY a.query_id, e.from_id) AS outdeg FROM edg e JOIN {cand} a ON a.symbol_id = e.from_id JOIN {cand} b ON b.symbol_id = e.to_id AND a.query_id = b.query_id WHERE e.edge_type = 'calls'),
g0 AS MATERIALIZED (SELECT query_id, symbol_id, 1 / n AS pr FROM {cand} JOIN gn USING (query_id)),
""" + ",\n".join(steps)


_DEG = """gi AS (SELECT to_id AS id, sum(weight)::BIGINT AS w FROM edg GROUP BY to_id), go AS (SELECT from_id AS id, sum(weight)::BIGINT AS w FROM edg GROUP BY from_id)"""
_FEAT = f"""{_DEG}, feat AS (
  SELECT query_id, symbol_id, pr, coalesce(gi.w, 0) AS in_degree, coalesce(go.w, 0) AS out_degree, {layer('a.package_path')} AS layer, {entry('a.name', 'a.kind', 'a.exported', 'a.package_path', 'a.signature')} AS is_entry, a.kind = 'interface' AS is_interface
  FROM g{graph.ITERATIONS} JOIN cat a ON a.id = symbol_id LEFT JOIN gi ON gi.id = symbol_id LEFT JOIN go ON go.id = symbol_id),
scored AS (SELECT *, least(1.0, 0.4 * pr + 0.2 * least(in_degree / 100.0, 1.0) + 0.2 * (CASE WHEN is_entry THEN 1 ELSE 0 END) + 0.1 * (CASE WHEN is_interface THEN 1 ELSE 0 END) + 0.1 * ({layer_score('layer')}))::DOUBLE AS graph FROM feat)"""
_GR = """list_filter([CASE WHEN pr > 0.01 THEN 'Highly connected in call graph' END, CASE WHEN in_degree > 10 THEN 'Frequently called by other code' END, CASE WHEN is_entry THEN 'System entry point' END,
  CASE WHEN is_interface THEN 'Interface definition' END, CASE WHEN layer = 'service' THEN 'service layer' END, CASE WHEN layer = 'handler' THEN 'handler layer' END], lambda x: x IS NOT NULL)"""
_GREASONS = f"CASE WHEN len({_GR}) > 0 THEN {_GR} ELSE ['Graph feature match'] END"

_ROLE = "CASE {c} WHEN 'handler' THEN 'interface/http' WHEN 'service' THEN 'application/business' WHEN 'repository' THEN 'infrastructure/persistence' WHEN 'domain' THEN 'domain/model' WHEN 'middleware' THEN 'infrastructure/middleware' END"
_PATH_ROLE = """CASE WHEN contains(lower(c.package_path), '/handler/') OR contains(lower(c.package_path), '/controller/') THEN 'interface/http'
  WHEN contains(lower(c.package_path), '/service/') OR contains(lower(c.package_path), '/usecase/') THEN 'application/business'
  WHEN contains(lower(c.package_path), '/repository/') OR contains(lower(c.package_path), '/dao/') THEN 'infrastructure/persistence'
  WHEN contains(lower(c.package_path), '/domain/') OR contains(lower(c.package_path), '/entity/') THEN 'domain/model' ELSE 'application' END"""
_STORED = f"""WITH {CAT}, {EDG},
h AS (SELECT query_id, symbol_id, combined, CASE WHEN vector IS NOT NULL AND NOT isnan(vector) THEN vector ELSE 0 END AS vector FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, symbol_id ORDER BY scored_at DESC NULLS LAST, combined DESC) AS rn FROM search_hits WHERE query_id IS NOT NULL AND symbol_id IS NOT NULL AND combined IS NOT NULL AND NOT isnan(combined)) WHERE rn = 1),
j AS (SELECT h.*, c.* EXCLUDE (id), {layer('package_path')} AS layer, {entry()} AS is_entry, row_number() OVER (PARTITION BY query_id ORDER BY round(combined, 9) DESC, symbol_id) AS place FROM h JOIN cat c ON c.id = symbol_id),
hits AS (SELECT *, 0.0 AS keyword FROM j WHERE place <= 10)"""
_STORED_GRAPH = f"""{_STORED}, cand AS MATERIALIZED (SELECT query_id, symbol_id FROM hits), {_pagerank('cand')}, {_FEAT},
ghits AS MATERIALIZED (SELECT h.*, s.graph, s.pr FROM hits h JOIN scored s ON h.query_id = s.query_id AND h.symbol_id = s.symbol_id)"""
_TRUNC = "CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n}) || '...' ELSE {c} END"
_SNIP = f"""{_STORED},
pr AS (SELECT *, line_end - line_start + 1 AS n_lines, combined + (CASE WHEN exported THEN 0.2 ELSE 0 END) + (CASE WHEN is_entry THEN 0.3 ELSE 0 END) AS priority FROM hits WHERE line_start > 0 AND line_end >= line_start),
rk AS (SELECT *, row_number() OVER w AS rank FROM pr WINDOW w AS (PARTITION BY query_id ORDER BY round(priority, 9) DESC, symbol_id)),
cu AS (SELECT *, sum(n_lines) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM rk WHERE rank <= 5),
snip AS (SELECT query_id, rank, symbol_id, n_lines::BIGINT AS n_lines, (CASE WHEN cum <= 60 THEN n_lines WHEN 60 - (cum - n_lines) > 5 THEN 60 - (cum - n_lines) END)::BIGINT AS kept_lines, priority FROM cu)"""
_LINES = "ln AS (SELECT doc_id, generate_subscripts(x, 1) AS line_no, unnest(x) AS text FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM documents WHERE text IS NOT NULL))"

ORACLE = {
    "hybrid_search": f"{_arms()}, {_base('exported', 0.75, 0.25)} {_OUT}",
    "hybrid_search_batch": f"{_arms(leaves=[(n, w) for n, a, b in BATCH for w in (a, b)], queries=len(BATCH))}, {_base('exported', 0.75, 0.25)} {_OUT}",
    "hybrid_vector_only": f"{_arms(keyword='false')}, {_base('exported', 1.0, 0.0)} {_OUT}",
    "hybrid_keyword_only": f"{_arms(vector='false')}, {_base('exported', 0.0, 1.0)} {_OUT}",
    "hybrid_filters": f"{_arms()}, {_base(_WHERE_F, 0.75, 0.25)} {_OUT}",
    "hybrid_prefiltered": f"{_arms(prefilter=_WHERE_F).replace(f'({_WHERE_F} OR false) IS NOT NULL', 'true').replace(f'{chr(39)}{_WHERE_F}{chr(39)} = {chr(39)}true{chr(39)} OR ', '')}, {_base(_WHERE_F, 0.75, 0.25)} {_OUT}",
    "hybrid_reasons": f"{_arms()}, {_base('exported', 0.75, 0.25)} SELECT query_id, symbol_id, array_to_string({_HREASONS}, '; ') AS reasons FROM r WHERE place <= 10",
    "hybrid_graph_rank": f"""{_arms()}, {_base('exported', 0.75, 0.25)}, {_pagerank('hit')}, {_FEAT},
b AS (SELECT hit.query_id, hit.symbol_id, vector, keyword, kind, exported, base * 0.8 + graph * 0.2 AS combined, graph, pr, in_degree, is_entry, is_interface, scored.layer FROM hit JOIN scored ON hit.query_id = scored.query_id AND hit.symbol_id = scored.symbol_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(combined, 9) DESC, symbol_id) AS place FROM b)
SELECT query_id, place, symbol_id, round(vector, 6) AS vector, round(keyword, 6) AS keyword, round(combined, 6) AS combined, round(graph, 6) AS graph, array_to_string(list_concat({_HREASONS}, list_filter({_GREASONS}, lambda x: NOT list_contains({_HREASONS}, x))), '; ') AS reasons FROM o WHERE place <= 10""",
    "hybrid_intent": f"""{_arms()}, {_base('exported', 0.75, 0.25)},
i AS (SELECT hit.*, base AS combined, intent, (CASE intent
  WHEN 'design' THEN (CASE WHEN layer = 'service' THEN 1.0 ELSE 0 END) + (CASE WHEN kind = 'interface' THEN 0.8 ELSE 0 END) + (CASE WHEN layer = 'handler' THEN 0.6 ELSE 0 END)
  WHEN 'implementation' THEN (CASE WHEN layer = 'repository' THEN 1.0 ELSE 0 END) + (CASE WHEN layer = 'domain' THEN 0.8 ELSE 0 END) + (CASE WHEN kind <> 'interface' THEN 0.5 ELSE 0 END)
  WHEN 'extension' THEN (CASE WHEN kind = 'interface' THEN 1.0 ELSE 0 END) + (CASE WHEN layer = 'middleware' THEN 0.8 ELSE 0 END) ELSE 0 END)::DOUBLE AS intent_score
  FROM hit JOIN (VALUES (1, 'design'), (2, 'implementation'), (3, 'extension'), (4, ''), (5, 'design')) AS t(query_id, intent) USING (query_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(combined, 9) DESC, intent_score DESC, symbol_id) AS place FROM i)
SELECT query_id, place, symbol_id, round(vector, 6) AS vector, round(keyword, 6) AS keyword, round(combined, 6) AS combined, intent, round(intent_score, 6) AS intent_score FROM o WHERE place <= 10""",
    "graph_pagerank_candidates": f"{_arms()}, {_base('exported', 0.75, 0.25)}, {_pagerank('hit')} SELECT query_id, symbol_id, round(pr, 9) AS pagerank FROM g{graph.ITERATIONS}",
    "graph_score": f"""WITH {CAT}, {EDG}, cand AS MATERIALIZED (SELECT DISTINCT query_id, symbol_id FROM search_hits WHERE query_id IS NOT NULL AND symbol_id IS NOT NULL), {_pagerank('cand')}, {_FEAT}
SELECT query_id, symbol_id, layer, is_entry, is_interface, in_degree, out_degree, round(pr, 9) AS pagerank, round(graph, 9) AS graph FROM scored""",
    "evidence_packages": f"""{_STORED_GRAPH},
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, package_path ORDER BY place) AS rn,
  list_concat(list_concat(CASE WHEN combined > 0.7 THEN ['High relevance: ' || name] ELSE [] END, CASE WHEN is_entry THEN ['Contains entry points'] ELSE [] END), CASE WHEN layer = 'service' THEN ['Core service layer'] ELSE [] END) AS w FROM ghits),
w2 AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY query_id, package_path ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
kd AS (SELECT query_id, package_path, string_agg(n || ' ' || kind, ' | ' ORDER BY n || ' ' || kind) AS kinds FROM (SELECT query_id, package_path, kind, count(*) AS n FROM hits GROUP BY ALL) GROUP BY ALL),
ky AS (SELECT query_id, package_path, string_agg(name, ', ' ORDER BY rn) AS key_symbols FROM (SELECT *, row_number() OVER (PARTITION BY query_id, package_path ORDER BY rn) AS kn FROM o WHERE exported OR is_entry) WHERE kn <= 5 GROUP BY ALL),
wh AS (SELECT query_id, package_path, array_to_string(flatten(list(w ORDER BY rn)), '; ') AS why FROM w2 WHERE before < 3 GROUP BY ALL),
a AS (SELECT query_id, package_path, sum(combined + (CASE WHEN graph > 0.5 THEN 0.2 ELSE 0 END) + (CASE WHEN is_entry THEN 0.1 ELSE 0 END)) AS score, count(*) AS n, arg_min(layer, rn) FILTER (WHERE layer IN ('handler', 'service', 'repository', 'domain', 'middleware')) AS l, arg_min(coalesce(semantic_text, ''), rn) AS txt FROM o GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, package_path) AS card FROM a)
SELECT c.query_id, card, c.package_path AS path, round(score, 6) AS score, coalesce({_ROLE.format(c='l')}, {_PATH_ROLE}) AS role,
  n || ' symbols | ' || kinds || CASE WHEN txt <> '' THEN ' | ' || {_TRUNC.format(c='txt', n=100)} ELSE '' END AS summary, coalesce(why, '') AS why, coalesce(key_symbols, '') AS key_symbols
FROM c JOIN kd USING (query_id, package_path) LEFT JOIN ky USING (query_id, package_path) LEFT JOIN wh USING (query_id, package_path) WHERE card <= 3""",
    "evidence_imports": f"""{_STORED},
u AS (SELECT DISTINCT package_path AS path, import_path AS target FROM edg JOIN cat ON cat.id = edg.from_id WHERE edge_type = 'imports' AND import_path IS NOT NULL),
im AS (SELECT path, string_agg(target, ' ' ORDER BY target) AS imports FROM u GROUP BY path), ib AS (SELECT target AS path, string_agg(path, ' ' ORDER BY path) AS imported_by FROM u WHERE path <> target GROUP BY target),
a AS (SELECT query_id, package_path AS path, sum(combined + (CASE WHEN is_entry THEN 0.1 ELSE 0 END)) AS score FROM hits GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS card FROM a)
SELECT query_id, card, path, CASE WHEN imports IS NULL AND imported_by IS NULL THEN NULL ELSE coalesce(imports, '') END AS imports, CASE WHEN imports IS NULL AND imported_by IS NULL THEN NULL ELSE coalesce(imported_by, '') END AS imported_by
FROM c LEFT JOIN im USING (path) LEFT JOIN ib USING (path) WHERE card <= 3""",
    "hybrid_package": f"{_arms().replace('p <= 20)', 'p <= 40)').replace('WHERE p <= 20', 'WHERE p <= 40')}, {_base('package_path = (SELECT package_path FROM cat GROUP BY package_path ORDER BY count(*) DESC, package_path LIMIT 1)', 0.75, 0.25)} {_OUT.replace('place <= 10', 'place <= 20')}",
    "evidence_symbols": f"""{_STORED} SELECT query_id, place, symbol_id AS id, name, kind, signature, file_path AS file, line_start AS line, CASE WHEN place <= 3 AND coalesce(semantic_text, '') <> '' THEN {_TRUNC.format(c='semantic_text', n=300)} ELSE '' END AS snippet, array_to_string({_HREASONS}, '; ') AS why FROM hits""",
    "evidence_hints": f"""{_STORED_GRAPH}, cc AS (SELECT query_id, from_id, count(*) AS k FROM hits JOIN edg ON to_id = symbol_id WHERE from_id <> to_id GROUP BY ALL),
t AS (SELECT query_id, from_id, row_number() OVER (PARTITION BY query_id ORDER BY k DESC, from_id) AS rn FROM cc)
SELECT query_id, 1::BIGINT AS n, 'Common caller: ' || name || ' (' || package_path || ')' AS hint FROM t JOIN cat ON id = from_id WHERE t.rn = 1
UNION ALL SELECT query_id, 2, 'Entry points: ' || string_agg(name, ', ' ORDER BY place) FROM hits WHERE is_entry GROUP BY query_id
UNION ALL SELECT query_id, 3, 'Hub: ' || arg_min(name, place) || ' (called by many)' FROM ghits WHERE pr > 0.01 GROUP BY query_id""",
    "evidence_snippets": f"{_SNIP} SELECT query_id, rank, symbol_id, n_lines, kept_lines, round(priority, 6) AS priority FROM snip WHERE kept_lines IS NOT NULL",
    "evidence_metadata": f"""{_SNIP}, m AS (SELECT query_id, count(*) AS total_symbols, arg_min(vector > 0, place) AS has_vector_search FROM hits GROUP BY query_id)
SELECT query_id, total_symbols, has_vector_search, coalesce(t, 0)::BIGINT AS total_lines FROM m LEFT JOIN (SELECT query_id, sum(kept_lines) AS t FROM snip GROUP BY query_id) USING (query_id)""",
    "read_lines": f"""WITH {_LINES}, s AS (SELECT *, least(max(line_no) OVER (PARTITION BY doc_id), 40) AS stop FROM ln)
SELECT doc_id, line_no, printf('%4d', line_no::INT) || chr(9) || text AS text, stop >= 23 AS truncated FROM s WHERE line_no >= 3 AND line_no <= stop AND line_no < 23""",
    "read_symbol_lines": f"WITH {_LINES} SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY line_no)) AS content_md5 FROM ln WHERE line_no BETWEEN 2 AND 6 GROUP BY doc_id",
}
