"""Registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.common import table
from strata.llm import code_docs, ideal_point, mixing, neighbours, packing, residue
from strata.plans import training


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "symbol_vectors"))


def p1_top10(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.search(table(spark, d, "symbol_vectors")).withColumn("cosine", F.round("cosine", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return code_docs.symbol_pairs(table(spark, d, "symbols")).select("symbol_id")


def p4_symbol_pairs(spark: SparkSession, d: str) -> DataFrame:
    return code_docs.symbol_pairs(table(spark, d, "symbols"))


def p4_file_pairs(spark: SparkSession, d: str) -> DataFrame:
    return code_docs.file_pairs(table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return ideal_point.unanimous(table(spark, d, "search_hits")).select("query_id", "symbol_id")


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ideal_point.ideal_point_ranking(table(spark, d, "search_hits")).select("query_id", "symbol_id", F.round("closeness", 9).alias("closeness"), "position")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "token_budgets"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents"), table(spark, d, "token_budgets")))


def p6_placement(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of the packing, beside the same figures from the texts."""
    return packing.placement_report(packing.pack(table(spark, d, "documents"), table(spark, d, "token_budgets")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.select(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p7_targets(spark: SparkSession, d: str) -> DataFrame:
    """What has to hold of the mix, beside the same figures from the tables."""
    return mixing.target_report(mixing.sized(table(spark, d, "documents")), table(spark, d, "mix_targets")).withColumn("target_share", F.round("target_share", 9))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p8_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return residue.split_residue(table(spark, d, "documents")).select("doc_id", "kept", "reason")


QUERIES = {f.__name__: f for f in (p1_found, p1_top10, p4_found, p4_symbol_pairs, p4_file_pairs, p5_found, p5_ranking, p6_pack, p6_report, p6_placement, p7_mix, p7_report, p7_targets, p8_found, p8_verdicts)}

_USABLE = """
usable AS (
  SELECT symbol_id, model, v FROM (
    SELECT symbol_id, model, vector::DOUBLE[] AS v,
           row_number() OVER (PARTITION BY symbol_id ORDER BY created_at DESC NULLS LAST, model DESC NULLS LAST) AS rn
    FROM symbol_vectors WHERE symbol_id IS NOT NULL)
  WHERE rn = 1 AND model IS NOT NULL AND v IS NOT NULL AND len(v) = 96
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)
"""

#: p1_found has no entry below: its index may miss single pairs, so it is held against this SQL by recall (tests).
P1_EXACT = f"""
WITH {_USABLE},
pairs AS (SELECT a.symbol_id AS s, b.symbol_id AS t, list_cosine_similarity(a.v, b.v) AS c FROM usable a JOIN usable b ON a.model = b.model AND a.symbol_id <> b.symbol_id),
best AS (SELECT s, t, c, row_number() OVER (PARTITION BY s ORDER BY c DESC, t) AS rn FROM pairs)
SELECT DISTINCT least(s, t) AS symbol_a, greatest(s, t) AS symbol_b FROM best WHERE rn <= 10 AND c >= 0.85"""

_PRESENT = """
latest AS (
  SELECT query_id, symbol_id, vector, keyword, graph FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, symbol_id ORDER BY scored_at DESC NULLS LAST) AS rn FROM search_hits WHERE query_id IS NOT NULL AND symbol_id IS NOT NULL)
  WHERE rn = 1),
present AS (
  SELECT query_id, symbol_id, CASE WHEN NOT isnan(vector) THEN vector END AS v, CASE WHEN NOT isnan(keyword) THEN keyword END AS k, CASE WHEN NOT isnan(graph) THEN graph END AS g FROM latest)"""


def _each(text: str) -> str:
    return ", ".join(text.format(c=c) for c in "vkg")


_TEXT = "regexp_matches(text, '[^\\s\\p{Z}\\x{FEFF}]')"
_SOURCE = "regexp_replace(lower(trim(regexp_replace({c}, '[\\s\\x{{A0}}]+', ' ', 'g'))), '[\\s_]+', '-', 'g')"

def _stem(steps: str) -> str:
    """Each word of a list of lower-case words brought to one form: suffix, silent e, doubled consonant, y."""
    ends = (("ies", "y"), ("ied", "y"), ("ying", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""), ("ers", ""), ("er", ""), ("ors", ""), ("or", ""))
    whens = " ".join(f"WHEN ends_with(x, '{e}') AND length(x) >= {len(e) + 3} AND NOT ends_with(x, 'ss') THEN left(x, length(x) - {len(e)}) || '{by}'" for e, by in ends)
    for step in (
        "regexp_replace(x, '[''’].*$', '')",
        f"CASE {whens} ELSE x END",
        "CASE WHEN length(x) > 3 AND ends_with(x, 'e') THEN left(x, length(x) - 1) ELSE x END",
        "CASE WHEN length(x) > 3 AND x[-1] = x[-2] AND NOT contains('aeiou', x[-1]) THEN left(x, length(x) - 1) ELSE x END",
        "CASE WHEN ends_with(x, 'y') THEN left(x, length(x) - 1) || 'i' ELSE x END",
    ):
        steps = f"list_transform({steps}, lambda x: {step})"
    return steps


_NONBLANK = "regexp_matches({c}, '[^\\s\\p{{Z}}\\x{{FEFF}}]')"
_FUNCTION_WORDS = """a an the this that these those it its they them their he she his her we us our you your i me my who whom whose which what
 and or but nor so yet if then else than as at by for from in into of off on onto out over to up with within without under about after before
 between through during until while when where why how because since though although unless whether per via not no only also just too very more most
 less least such same other another any all each every both either neither few many much some several own here there now again once
 is are was were be been being am do does did doing done has have had having can could will would shall should may might must
 let lets itself themselves one ones etc eg ie vs"""
_NOTE = "(?i)^\\s*(?:TODO|FIXME|XXX|HACK|BUG|WIP|TBD)\\b"
_TOOL = "(?i)^\\s*(?:go:\\w+|\\+build\\b|nolint\\b|lint:|nosec\\b|gosec:|revive:|staticcheck:|exhaustive:|noinspection\\b|line\\s+\\S+:\\d+|export\\s+\\w+\\s*$|cgo\\b|#cgo\\b|#include\\b|swagger:|@\\w+|coverage:|golint:|codecov:|Code generated\\b.*DO NOT EDIT)"
_SAYING = f"""
cut AS (
  SELECT *, list_transform(list_transform(list_transform(string_split(regexp_replace(replace(replace(doc, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g'), chr(10)),
    lambda x: regexp_replace(x, '^\\s*(?:/{{2,}}|/\\*+|\\*+/|\\*$|\\*(\\s))[\\s\\x{{A0}}]?', '')), lambda x: regexp_replace(x, '\\s*\\*+/\\s*$', '')), lambda x: regexp_replace(x, '^\\s*/\\*+[\\s\\x{{A0}}]?', '')) AS lines FROM SOURCE),
clean AS (
  SELECT * EXCLUDE (lines), regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(lines, lambda x: NOT regexp_matches(x, '{_TOOL}') AND NOT regexp_matches(x, '{_NOTE}')), lambda x: regexp_replace(x, '[\\s\\x{{A0}}]+$', '')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g') AS description FROM cut),
parts AS (
  SELECT *, length(regexp_replace(description, '[^㐀-鿿豈-﫿]', '', 'g')) AS chinese,
         list_transform(list_filter(regexp_extract_all(regexp_replace(description, '[㐀-鿿豈-﫿]', ' ', 'g'), '\\p{{L}}+(?:[''’]\\p{{L}}+)?'), lambda x: length(x) > 1 OR lower(x) = 'a'), lambda x: lower(x)) AS words,
         list_transform(regexp_extract_all(regexp_replace(coalesce(name, ''), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+'), lambda x: lower(x)) AS own FROM clean),
stems AS (SELECT *, {_stem("words")} AS word_stems, list_concat(list_concat(own, {_stem("own")}), [lower(coalesce(name, ''))]) AS named FROM parts)"""
_SAID = f"""len(list_filter(list_zip(words, word_stems), lambda z: NOT list_contains([{", ".join(f"'{w}'" for w in _FUNCTION_WORDS.split())}], z[1]) AND NOT list_contains(named, z[1]) AND NOT list_contains(named, z[2]))) + chinese / 2 >= 5"""
_PAIRS = f"""
WITH {training.ROWS},
version AS (
  SELECT id, modified, file, min(stored) AS stored, max(name) FILTER (WHERE {_NONBLANK.format(c="name")}) AS name, max(kind) AS kind,
         max(signature) FILTER (WHERE {_NONBLANK.format(c="signature")}) AS signature, max(doc_comment) FILTER (WHERE {_NONBLANK.format(c="doc_comment")}) AS doc
  FROM stored_rows WHERE kind IN ('func', 'method') GROUP BY id, modified, file),
current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY modified DESC NULLS LAST, stored DESC NULLS LAST, file DESC) AS rn FROM version) WHERE rn = 1 AND signature IS NOT NULL AND doc IS NOT NULL),
{_SAYING.replace("SOURCE", "current")},
pairs AS (
  SELECT id AS symbol_id, name, kind, regexp_replace(regexp_replace(signature, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS signature, description FROM stems
  WHERE {_SAID})"""

#: The source documents hold methods formatted in the usual way: the SQL reads them line by line, without brackets to balance.
_FILES = f"""
WITH src AS (SELECT doc_id, file_path, replace(replace(text, chr(13) || chr(10), chr(10)), chr(65279), '') AS t FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '(?m)^func\\b')),
ln AS (SELECT doc_id, file_path, generate_subscripts(x, 1) AS n, unnest(x) AS line FROM (SELECT doc_id, file_path, string_split(t, chr(10)) AS x FROM src)),
marked AS (
  SELECT *, max(CASE WHEN NOT starts_with(ltrim(line), '//') THEN n ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above,
         min(CASE WHEN line = '}}' THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM ln),
heads AS (SELECT * FROM marked WHERE starts_with(line, 'func ')),
docs AS (SELECT h.doc_id, h.n, string_agg(l.line, chr(10) ORDER BY l.n) AS doc FROM heads h JOIN ln l ON l.doc_id = h.doc_id AND l.n > coalesce(h.above, 0) AND l.n < h.n GROUP BY ALL),
bodies AS (SELECT h.doc_id, h.n, string_agg(l.line, chr(10) ORDER BY l.n) AS rest FROM heads h JOIN ln l ON l.doc_id = h.doc_id AND l.n > h.n AND l.n <= h.stop GROUP BY ALL),
current AS (
  SELECT h.doc_id, h.file_path, h.n AS line, nullif(regexp_extract(h.line, '^func \\(\\w+ \\*?(\\w+)', 1), '') AS receiver, regexp_extract(h.line, '^func (?:\\([^)]*\\) )?(\\w+)', 1) AS name,
         regexp_replace(h.line, '\\s*\\{{$', '') AS signature, '{{' || chr(10) || rest AS body, doc
  FROM heads h JOIN docs USING (doc_id, n) JOIN bodies USING (doc_id, n)),
{_SAYING.replace("SOURCE", "current")}
SELECT doc_id, file_path, line, receiver, name, signature, description, body FROM stems WHERE {_SAID}"""

ORACLE = {
    "p4_file_pairs": _FILES,
    "p4_found": f"{_PAIRS} SELECT symbol_id FROM pairs",
    "p4_symbol_pairs": f"{_PAIRS} SELECT * FROM pairs",
    "p1_top10": f"""
WITH {_USABLE},
pairs AS (
  SELECT a.symbol_id, b.symbol_id AS neighbour_id, list_cosine_similarity(a.v, b.v) AS c
  FROM usable a JOIN usable b ON a.model = b.model AND a.symbol_id <> b.symbol_id WHERE ('0x' || substr(md5(a.symbol_id), 1, 8))::BIGINT % 50 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY round(c, 12) DESC, neighbour_id) AS position FROM pairs)
SELECT symbol_id, neighbour_id, round(c, 6) AS cosine, position FROM best WHERE position <= 10""",
    "p6_placement": f"""
SELECT b.budget_name, count(*) AS texts, count(*) AS placed_once, 0::BIGINT AS over_full, 0::BIGINT AS split_needlessly
FROM (SELECT budget_name FROM token_budgets WHERE budget_name IS NOT NULL AND capacity > 0 GROUP BY budget_name) b
CROSS JOIN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND {_TEXT}) d GROUP BY b.budget_name""",
    "p7_targets": f"""
WITH stock AS (SELECT {_SOURCE.format(c="source")} AS source, count(*) AS documents FROM documents WHERE doc_id IS NOT NULL AND {_TEXT} AND source IS NOT NULL GROUP BY 1),
goal AS (SELECT mix_name, {_SOURCE.format(c="source")} AS source, sum(CASE WHEN target_share > 0 THEN target_share ELSE 0 END) AS target_share FROM mix_targets WHERE mix_name IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2)
SELECT g.mix_name, g.source, round(g.target_share, 9) AS target_share, coalesce(s.documents, 0) AS documents, true AS within_repeats, true AS on_budget FROM goal g LEFT JOIN stock s ON g.source = s.source""",
    "p5_ranking": f"""
WITH {_PRESENT},
ends AS (SELECT query_id, {_each("quantile_disc({c}, 0.05) AS lo_{c}, quantile_disc({c}, 0.95) AS hi_{c}")} FROM present GROUP BY query_id),
clipped AS (SELECT p.query_id, p.symbol_id, {_each("CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END AS {c}")} FROM present p JOIN ends e ON p.query_id = e.query_id),
figures AS (SELECT query_id, {_each("sqrt(sum({c} * {c})) AS l_{c}, max({c}) AS b_{c}, min({c}) AS a_{c}")} FROM clipped GROUP BY query_id),
spans AS (
  SELECT c.query_id, c.symbol_id,
         sqrt({" + ".join(f"CASE WHEN l_{c} > 0 THEN power((coalesce({c}, a_{c}) - b_{c}) / l_{c}, 2) ELSE 0 END" for c in "vkg")}) AS far,
         sqrt({" + ".join(f"CASE WHEN l_{c} > 0 THEN power((coalesce({c}, a_{c}) - a_{c}) / l_{c}, 2) ELSE 0 END" for c in "vkg")}) AS near
  FROM clipped c JOIN figures f ON c.query_id = f.query_id),
closeness AS (SELECT query_id, symbol_id, CASE WHEN near > 0 THEN 1 / (1 + far / near) WHEN far > 0 THEN 0.0 ELSE 0.5 END AS closeness FROM spans)
SELECT query_id, symbol_id, round(closeness, 9) AS closeness, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, symbol_id) AS position FROM closeness""",
    "p5_found": f"""
WITH {_PRESENT},
ranked AS (
  SELECT *, rank() OVER (PARTITION BY query_id ORDER BY v DESC NULLS LAST) AS rv, rank() OVER (PARTITION BY query_id ORDER BY k DESC NULLS LAST) AS rk, rank() OVER (PARTITION BY query_id ORDER BY g DESC NULLS LAST) AS rg FROM present)
SELECT query_id, symbol_id FROM ranked WHERE v IS NOT NULL AND k IS NOT NULL AND g IS NOT NULL AND rv <= 10 AND rk <= 10 AND rg <= 10""",
}
