"""Pieces of SQL that the queries' SQL share; they restate the views of sources.corpus and the rule tables."""

from __future__ import annotations

from strata.plans import fixed


def slash(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(trim({c}), '[\\\\/]+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '^/+', '')"


CAT = f"""cat AS (
  SELECT * EXCLUDE (rn) REPLACE ({slash("file_path")} AS file_path) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, updated_at DESC NULLS LAST, file_path DESC, line_start DESC, coalesce(doc_comment, '') DESC, coalesce(signature, '') DESC) AS rn
    FROM symbols WHERE id IS NOT NULL) WHERE rn = 1)"""
EDG = """edg AS (
  SELECT from_id, to_id, edge_type, max(weight) AS weight, arg_min(import_path, id) FILTER (WHERE import_path IS NOT NULL) AS import_path, min(created_at) AS created_at
  FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY from_id, to_id, edge_type)"""
EMB = """emb AS (
  SELECT symbol_id, v, model FROM (
    SELECT symbol_id, vector::DOUBLE[] AS v, model, row_number() OVER (PARTITION BY symbol_id ORDER BY created_at DESC NULLS LAST, model DESC NULLS LAST, dimension DESC) AS rn FROM symbol_vectors WHERE symbol_id IS NOT NULL)
  WHERE rn = 1 AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
#: Query vectors of the stated batch: those of the first symbols by id with a full vector.
QVEC = """qvec AS (SELECT row_number() OVER (ORDER BY symbol_id) AS query_id, v AS qv FROM emb WHERE len(v) = 96 AND len(list_filter(v, lambda x: x <> 0)) > 0 ORDER BY symbol_id LIMIT 5)"""
COS = "CASE WHEN sqrt(list_dot_product(a, a) * list_dot_product(b, b)) = 0 THEN 0.0 ELSE list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) END"


def cos(a: str, b: str) -> str:
    n = f"sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE list_dot_product({a}, {b}) / {n} END"


def fold(c: str) -> str:
    return f"translate(lower({c}), '{fixed.ACCENTED}', '{fixed.PLAIN}')"


def tok(c: str) -> str:
    return f"regexp_extract_all({fold(f'coalesce({c}, {chr(39)}{chr(39)})')}, '[\\p{{L}}\\p{{N}}]+')"


def values(rows, columns: str) -> str:
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(text(x) for x in r) + ')' for r in rows)}) AS t({columns})"


def layer(path: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains(lower({path}), {chr(39)}/{w}/{chr(39)})' for w in words)} THEN '{name}'" for name, words in fixed.LAYERS)
    return f"CASE {whens} ELSE 'unknown' END"


def layer_score(c: str) -> str:
    return f"CASE {c} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in fixed.LAYER_SCORES.items())} ELSE {fixed.OTHER_LAYER_SCORE} END"


def entry(name="name", kind="kind", exported="exported", path="package_path", signature="signature") -> str:
    q = lambda x: f"'{x}'"
    named = f"lower({name}) = 'main' OR " + " OR ".join(f"starts_with(lower({name}), {q(x)})" for x in fixed.ENTRY_NAMES)
    signed = " OR ".join(f"contains(lower(coalesce({signature}, '')), {q(x)})" for x in fixed.ENTRY_SIGNATURES)
    paths = " OR ".join(f"contains(lower({path}), {q(x)})" for x in fixed.ENTRY_PATHS)
    return f"({named} OR ({exported} AND {kind} IN ('func', 'method') AND ({signed})) OR ({exported} AND ({paths})))"


def intent(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({text}), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in fixed.INTENTS) + " ELSE '' END"
