"""Full-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.common import table
from strata.functions.text import normalize_term, quote_term, sanitize_query, tokens
from strata.operators import fts, synonyms
from strata.plans.sql import CAT, tok, values
from strata.sources import corpus

COLUMNS = ("id", "name", "semantic_text")
RAW = ((1, "how to?"), (2, "a-b"), (3, "http://x"), (4, "foo.bar(baz)"), (5, "  "), (6, "保存 令牌_缓存"), (7, "trailing AND"), (8, "Größe_x"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def fts_tokens(spark, d):
    """Tokens of every document, with their number of different terms."""
    t = _docs(spark, d).select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


def fts_df(spark, d):
    """Document frequencies of all terms."""
    return fts.document_frequencies(fts.postings(_docs(spark, d), "doc_id", ["text"]))


def fts_doc_len(spark, d):
    return fts.doc_lengths(corpus.catalog(spark, d), "id", COLUMNS)


def _index(spark, d):
    return corpus.text_index(spark, d, "documents", _docs(spark, d), "doc_id", ["text"])


def _matches(spark, d, text):
    return fts.match(_docs(spark, d), "doc_id", ["text"], [(1, text)], _index(spark, d)).select(F.col("doc").alias("doc_id"))


def fts_and(spark, d):
    return _matches(spark, d, "shard tariff")


def fts_or(spark, d):
    return _matches(spark, d, "platform OR imprint")


def fts_not(spark, d):
    return _matches(spark, d, "(ledger OR tariff) NOT shard")


def fts_phrase(spark, d):
    return _matches(spark, d, '"session cache"')


def fts_prefix(spark, d):
    return _matches(spark, d, "serialis*")


def fts_underscore(spark, d):
    """A bare word with '_' is the phrase of its parts."""
    return _matches(spark, d, "layer_id")


def fts_column_filter(spark, d):
    symbols = corpus.catalog(spark, d)
    return fts.match(symbols, "id", COLUMNS, [(1, "semantic_text:handler method")], corpus.text_index(spark, d, "symbols", symbols, "id", COLUMNS)).select(F.col("doc").alias("symbol_id"))


def fts_sanitize(spark, d):
    q = spark.createDataFrame(list(RAW), "query_id int, text string")
    return q.select("query_id", sanitize_query(F.col("text")).alias("cleaned"), normalize_term(F.col("text")).alias("norm"), quote_term(F.trim("text")).alias("quoted"))


def fts_retry(spark, d):
    """Texts that are no match expressions are cleaned and tried as words."""
    hits = fts.match(_docs(spark, d), "doc_id", ["text"], [(1, "retry? loop!"), (2, "session-cache"), (3, "trailing AND"), (4, "...")], _index(spark, d))
    return hits.groupBy("query_id").agg(F.count("*").alias("n"))


def fts_bm25_topk(spark, d):
    hits = fts.keyword_search(_docs(spark, d), "doc_id", ["text"], [(1, "shard tariff"), (2, "platform OR imprint"), (3, '"session cache"')], 20, _index(spark, d))
    return hits.select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def fts_rank_score(spark, d):
    hits = fts.rank_scores(fts.keyword_search(_docs(spark, d), "doc_id", ["text"], [(1, "shard tariff"), (2, "platform OR imprint")], 10, _index(spark, d)))
    return hits.select("query_id", F.col("place").cast("long").alias("place"), F.round("keyword", 6).alias("keyword"))


def fts_packages(spark, d):
    """The package index: path and name."""
    p = corpus.packages(corpus.catalog(spark, d))
    return fts.match(p.withColumnRenamed("package_path", "path"), "path", ["path", "name"], [(1, "service OR handler")]).select(F.col("doc").alias("path"))


SYNONYMS = {"storage": ["store", "data-store", "Repo Store"], "令牌": ["token", "session token", "Token"], "handler": ["controller"]}
SYNONYM_TEXTS = ((1, "where is the STORE of a token"), (2, "video-controller"), (3, "令牌 失效"), (4, "nothing known"))


def _synonym_queries(spark):
    return spark.createDataFrame(list(SYNONYM_TEXTS), "query_id int, text string")


def synonym_match(spark, d):
    return synonyms.matched(_synonym_queries(spark), synonyms.groups(spark, SYNONYMS))


def synonym_fts_query(spark, d):
    return synonyms.expand(_synonym_queries(spark), synonyms.groups(spark, SYNONYMS)).select("query_id", "keyword_text")


def synonym_expand_text(spark, d):
    return synonyms.expand(_synonym_queries(spark), synonyms.groups(spark, SYNONYMS)).select("query_id", "vector_text")


def synonym_hits(spark, d):
    """How many documents each synonym query finds once expanded."""
    q = {r["query_id"]: r["keyword_text"] for r in synonyms.expand(_synonym_queries(spark), synonyms.groups(spark, SYNONYMS)).collect()}  # the stated batch
    return fts.match(_docs(spark, d), "doc_id", ["text"], sorted(q.items())).groupBy("query_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (fts_tokens, fts_df, fts_doc_len, fts_and, fts_or, fts_not, fts_phrase, fts_prefix, fts_underscore, fts_column_filter, fts_sanitize, fts_retry, fts_bm25_topk, fts_rank_score, fts_packages, synonym_match, synonym_fts_query, synonym_expand_text, synonym_hits)}

_T = f"t AS (SELECT doc_id, {tok('text')} AS w FROM documents)"
_TERMS = f"WITH {_T}, p AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS term FROM t)"
_BM = f"""{_TERMS},
lens AS (SELECT doc_id, len(w)::DOUBLE AS l FROM t), corpus AS (SELECT count(*)::DOUBLE AS n_docs, avg(l) AS avg_len FROM lens),
leaf AS (
  SELECT 1 AS query_id, 'shard' AS leaf, doc_id FROM p WHERE term = 'shard' UNION ALL SELECT 1, 'tariff', doc_id FROM p WHERE term = 'tariff'
  UNION ALL SELECT 2, 'platform', doc_id FROM p WHERE term = 'platform' UNION ALL SELECT 2, 'imprint', doc_id FROM p WHERE term = 'imprint'
  UNION ALL SELECT 3, 'session cache', a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'session' AND b.term = 'cache'),
tf AS (SELECT query_id, leaf, doc_id, count(*)::DOUBLE AS tf FROM leaf GROUP BY ALL),
df AS (SELECT query_id, leaf, count(*)::DOUBLE AS n FROM tf GROUP BY ALL),
part AS (
  SELECT tf.query_id, tf.leaf, tf.doc_id,
    CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len)) AS s
  FROM tf JOIN df USING (query_id, leaf) JOIN lens USING (doc_id), corpus),
scored AS (SELECT query_id, doc_id, sum(s) AS score, count(*) AS met FROM part GROUP BY ALL HAVING query_id <> 1 OR count(*) = 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM scored)"""


def _norm(c: str) -> str:
    return f"trim(regexp_replace(translate(lower({c}), '_-', '  '), '\\s+', ' ', 'g'))"


_SYN_ROWS = [(c, n, t) for c, a in SYNONYMS.items() for n, t in enumerate([c, *a])]
_SYN = f"""WITH q AS (SELECT * FROM {values(SYNONYM_TEXTS, "query_id, text")}),
g0 AS (SELECT canonical, seq, term, {_norm("term")} AS norm FROM {values(_SYN_ROWS, "canonical, seq, term")}),
g AS (SELECT canonical, arg_min(term, seq) AS term, norm, min(seq) AS seq FROM g0 GROUP BY canonical, norm),
m AS (SELECT DISTINCT query_id, canonical FROM q JOIN g ON contains({_norm("text")}, norm))"""
_CLAUSE = "string_agg(CASE WHEN regexp_matches(term, '[ \\t\\n-]') THEN '\"' || term || '\"' ELSE term END, ' OR ' ORDER BY seq)"
_HAS = lambda w: f"list_contains(w, '{w}')"

ORACLE = {
    "fts_tokens": f"WITH {_T} SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_terms FROM t",
    "fts_df": f"{_TERMS} SELECT term, count(DISTINCT doc_id) AS n FROM p GROUP BY term",
    "fts_doc_len": f"WITH {CAT} SELECT id AS doc, (len({tok('id')}) + len({tok('name')}) + len({tok('semantic_text')}))::BIGINT AS len FROM cat",
    "fts_and": f"WITH {_T} SELECT doc_id FROM t WHERE {_HAS('shard')} AND {_HAS('tariff')}",
    "fts_or": f"WITH {_T} SELECT doc_id FROM t WHERE {_HAS('platform')} OR {_HAS('imprint')}",
    "fts_not": f"WITH {_T} SELECT doc_id FROM t WHERE ({_HAS('ledger')} OR {_HAS('tariff')}) AND NOT {_HAS('shard')}",
    "fts_phrase": f"{_TERMS} SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'session' AND b.term = 'cache'",
    "fts_prefix": f"{_TERMS} SELECT DISTINCT doc_id FROM p WHERE starts_with(term, 'serialis')",
    "fts_underscore": f"{_TERMS} SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'layer' AND b.term = 'id'",
    "fts_column_filter": f"WITH {CAT} SELECT id AS symbol_id FROM cat WHERE list_contains({tok('semantic_text')}, 'handler') AND (list_contains({tok('id')}, 'method') OR list_contains({tok('name')}, 'method') OR list_contains({tok('semantic_text')}, 'method'))",
    "fts_sanitize": f"""SELECT query_id, trim(regexp_replace(text, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')) AS cleaned, {_norm("text")} AS norm,
CASE WHEN regexp_matches(trim(text), '[ \\t\\n-]') THEN '"' || trim(text) || '"' ELSE trim(text) END AS quoted FROM {values(RAW, "query_id, text")}""",
    "fts_retry": f"""WITH {_T} SELECT query_id, count(*) AS n FROM (
SELECT 1 AS query_id FROM t WHERE {_HAS('retry')} AND {_HAS('loop')} UNION ALL SELECT 2 FROM t WHERE {_HAS('session')} AND {_HAS('cache')}
UNION ALL SELECT 3 FROM t WHERE {_HAS('trailing')} AND {_HAS('and')}) GROUP BY query_id""",
    "fts_bm25_topk": f"{_BM} SELECT query_id, doc_id, round(score, 6) AS score FROM placed WHERE place <= 20",
    "fts_rank_score": f"{_BM} SELECT query_id, place, round(1 - (place - 1) / (count(*) OVER (PARTITION BY query_id))::DOUBLE, 6) AS keyword FROM placed WHERE place <= 10 AND query_id <= 2",
    "fts_packages": f"""WITH {CAT}, pk AS (SELECT package_path AS path, max(package_name) AS name FROM cat GROUP BY package_path)
SELECT path FROM pk WHERE len(list_intersect(list_concat({tok('path')}, {tok('name')}), ['service', 'handler'])) > 0""",
    "synonym_match": f"{_SYN} SELECT query_id, canonical FROM m",
    "synonym_fts_query": f"""{_SYN}, c AS (SELECT query_id, canonical, '(' || {_CLAUSE} || ')' AS clause FROM m JOIN g USING (canonical) GROUP BY query_id, canonical),
k AS (SELECT query_id, string_agg(clause, ' AND ' ORDER BY canonical) AS k FROM c GROUP BY query_id)
SELECT query_id, coalesce(k, text) AS keyword_text FROM q LEFT JOIN k USING (query_id)""",
    "synonym_expand_text": f"""{_SYN}, o AS (SELECT query_id, canonical, seq, term, row_number() OVER (PARTITION BY query_id, norm ORDER BY canonical, seq) AS rn FROM m JOIN g USING (canonical)),
v AS (SELECT query_id, string_agg(term, ' ' ORDER BY canonical, seq) AS v FROM o WHERE rn = 1 GROUP BY query_id)
SELECT query_id, CASE WHEN v IS NULL THEN text ELSE text || ' ' || v END AS vector_text FROM q LEFT JOIN v USING (query_id)""",
    "synonym_hits": f"""{_TERMS},
d1 AS (SELECT a.doc_id, a.term || ' ' || b.term AS two FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1),
has AS (SELECT DISTINCT doc_id, term AS x FROM p UNION SELECT DISTINCT doc_id, two FROM d1),
g AS (SELECT * FROM (VALUES ('storage', 'storage'), ('storage', 'store'), ('storage', 'data store'), ('storage', 'repo store'), ('令牌', '令牌'), ('令牌', 'token'), ('令牌', 'session token'), ('handler', 'handler'), ('handler', 'controller')) AS t(grp, x)),
met AS (SELECT DISTINCT grp, doc_id FROM has JOIN g USING (x))
SELECT 1 AS query_id, count(*) AS n FROM (SELECT doc_id FROM met WHERE grp IN ('storage', '令牌') GROUP BY doc_id HAVING count(*) = 2)
UNION ALL SELECT 2, count(*) FROM met WHERE grp = 'handler' UNION ALL SELECT 3, count(*) FROM met WHERE grp = '令牌'
UNION ALL SELECT 4, n FROM (SELECT count(*) AS n FROM t WHERE {_HAS('nothing')} AND {_HAS('known')}) WHERE n > 0""",
}
