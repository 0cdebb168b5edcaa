"""Registered queries of the general data-processing operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.common import table
from strata.operators import incremental, skew


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changed_symbols(table(spark, d, "symbols"), table(spark, d, "repositories"), table(spark, d, "indexing_jobs")).select("symbol_id")


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changed_symbols(table(spark, d, "symbols"), table(spark, d, "repositories"), table(spark, d, "indexing_jobs"))


def p2_partitions(spark: SparkSession, d: str) -> DataFrame:
    runs = incremental.last_runs(table(spark, d, "repositories"), table(spark, d, "indexing_jobs"))
    return incremental.partition_changes(table(spark, d, "symbols"), runs).groupBy("repo_path").agg(
        F.sum("rows_now").alias("rows_now"), F.sum("rows_then").alias("rows_then"), F.max("changed").alias("changed")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_targets(table(spark, d, "edges")).select("to_id", "edge_type")


def p3_targets(spark: SparkSession, d: str) -> DataFrame:
    return skew.target_totals(table(spark, d, "edges")).drop("heavy")


def p3_callers(spark: SparkSession, d: str) -> DataFrame:
    return skew.callers(table(spark, d, "edges"), table(spark, d, "symbols"), table(spark, d, "core_symbols"))


QUERIES = {f.__name__: f for f in (p2_found, p2_changes, p2_partitions, p3_found, p3_targets, p3_callers)}

_INSTANT = """
CASE
  WHEN trim({c}) ~ '^\\d{{4}}-\\d\\d-\\d\\d' THEN
    try_cast(regexp_replace(regexp_replace(trim({c}), '^(\\d{{4}}-\\d\\d-\\d\\d)[T ](\\d\\d:\\d\\d:\\d\\d)(\\.\\d{{1,6}})?\\d*\\s*(Z|[+-]\\d\\d:?\\d\\d)?(\\s.*)?$', '\\1 \\2\\3\\4'), '^([^Z+]{{10}}[^Z+-]*)$', '\\1Z') AS TIMESTAMPTZ)
  ELSE coalesce(
    try_strptime(trim({c}), '%a %b %d %H:%M:%S %z %Y')::TIMESTAMPTZ,
    try_strptime(regexp_replace(trim({c}), ' UTC (\\d{{4}})$', ' +0000 \\1'), '%a %b %d %H:%M:%S %z %Y')::TIMESTAMPTZ,
    try_strptime(regexp_replace(trim({c}), ' (\\d{{4}})$', ' +0000 \\1'), '%a %b %d %H:%M:%S %z %Y')::TIMESTAMPTZ)
END"""


def _instant(c: str) -> str:
    return _INSTANT.format(c=f"regexp_replace({c}, '\\s+', ' ', 'g')")


_RUNS = f"""
runs AS (
  SELECT r.root_path AS repo_path, CASE WHEN j.repo_id IS NOT NULL THEN j.started ELSE {_instant("r.last_indexed_at")} END AS since
  FROM repositories r LEFT JOIN (SELECT repo_id, max(started_at) FILTER (WHERE status = 'completed')::TIMESTAMPTZ AS started FROM indexing_jobs GROUP BY repo_id) j ON r.id = j.repo_id)"""
ROWS = f"""
stored_rows AS (
  SELECT id, name, repo_path, m AS modified, regexp_replace(regexp_replace(regexp_replace(trim(coalesce(file_path, '')), '[\\\\/]+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '^/+', '') AS file,
         coalesce(created_at::TIMESTAMPTZ, m) AS stored, kind, signature, doc_comment
  FROM (SELECT *, {_instant("updated_at")} AS m FROM symbols WHERE id IS NOT NULL))"""
_CURRENT = """
versions AS (SELECT id, modified, file, min(stored) AS stored, max(repo_path) AS repo_path FROM stored_rows GROUP BY id, modified, file),
current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY modified DESC NULLS LAST, stored DESC NULLS LAST, file DESC) AS rn FROM versions) WHERE rn = 1)"""

ORACLE = {
    "p2_found": f"""
WITH {_RUNS}, {ROWS}, {_CURRENT}
SELECT id AS symbol_id FROM current c LEFT JOIN (SELECT * FROM runs WHERE since IS NOT NULL) r ON c.repo_path = r.repo_path
WHERE r.since IS NULL OR c.stored > r.since""",
    "p2_changes": f"""
WITH {_RUNS}, {ROWS}, {_CURRENT},
run AS (SELECT * FROM runs WHERE since IS NOT NULL),
earlier AS (
  SELECT * FROM (SELECT s.id, s.modified, s.file, row_number() OVER (PARTITION BY s.id ORDER BY s.modified DESC NULLS LAST, s.stored DESC NULLS LAST, s.file DESC) AS rn
  FROM stored_rows s JOIN run r ON s.repo_path = r.repo_path WHERE s.stored <= r.since OR s.stored IS NULL) WHERE rn = 1)
SELECT c.id AS symbol_id, c.repo_path, CASE WHEN r.since IS NULL THEN 'never indexed' WHEN e.id IS NULL THEN 'added'
  WHEN e.modified IS NOT DISTINCT FROM c.modified AND e.file <> c.file THEN 'moved' ELSE 'changed' END AS change
FROM current c LEFT JOIN run r ON c.repo_path = r.repo_path LEFT JOIN earlier e ON c.id = e.id
WHERE r.since IS NULL OR c.stored > r.since""",
    "p2_partitions": f"""
WITH {_RUNS}, {ROWS},
flagged AS (SELECT s.repo_path, CASE WHEN r.since IS NULL THEN false WHEN s.stored IS NULL THEN true ELSE s.stored <= r.since END AS old
  FROM stored_rows s LEFT JOIN (SELECT * FROM runs WHERE since IS NOT NULL) r ON s.repo_path = r.repo_path)
SELECT repo_path, count(*) AS rows_now, count(*) FILTER (WHERE old) AS rows_then, count(*) <> count(*) FILTER (WHERE old) AS changed FROM flagged GROUP BY repo_path""",
    "p3_found": """
WITH t AS (SELECT DISTINCT from_id, to_id, edge_type FROM edges WHERE to_id IS NOT NULL)
SELECT to_id, edge_type FROM t GROUP BY to_id, edge_type HAVING count(*) >= 0.01 * (SELECT count(*) FROM t)""",
    "p3_targets": """
WITH t AS (SELECT from_id, to_id, edge_type, coalesce(max(weight), 0) AS w FROM edges WHERE to_id IS NOT NULL GROUP BY ALL)
SELECT to_id, edge_type, count(*) AS n_callers, sum(w)::BIGINT AS total_weight FROM t GROUP BY to_id, edge_type""",
    "p3_callers": """
WITH t AS (SELECT from_id, to_id, edge_type, coalesce(max(weight), 0)::BIGINT AS weight FROM edges WHERE to_id IS NOT NULL GROUP BY ALL),
s AS (SELECT id, max(kind) AS to_kind, max(package_path) AS to_package FROM (SELECT id, kind, package_path FROM symbols UNION ALL SELECT id, kind, package_path FROM core_symbols) WHERE id IS NOT NULL GROUP BY id)
SELECT t.to_id, t.edge_type, t.from_id, t.weight, s.to_kind, s.to_package FROM t LEFT JOIN s ON t.to_id = s.id""",
}
