"""Counts, repository summaries, index age and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import human_age
from strata.functions.timeparse import parse_instant

STALE_SECONDS, WARN_SECONDS = 24 * 3600, 3600


def table_counts(symbols: DataFrame, packages: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(table_name, n) of the four tables."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in (("symbols", symbols), ("packages", packages), ("edges", edges), ("vectors", vectors))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repository_summary(symbols: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(repo_path, symbol_count, package_count, edge_count, has_embeddings) per repository; an edge counts for its source's repository, or its target's where the source is unknown, and for both if they differ."""
    s = symbols.groupBy("repo_path").agg(F.count("*").alias("symbol_count"), F.countDistinct("package_path").alias("package_count"))
    repo = symbols.select(F.col("id").alias("_id"), F.col("repo_path").alias("_repo"))
    ends = edges.join(repo, F.col("from_id") == F.col("_id"), "left").withColumnRenamed("_repo", "r1").drop("_id")
    ends = ends.join(repo, F.col("to_id") == F.col("_id"), "left").withColumnRenamed("_repo", "r2").drop("_id")
    e = ends.select(F.explode(F.array_distinct(F.array("r1", "r2"))).alias("repo_path")).where("repo_path is not null").groupBy("repo_path").agg(F.count("*").alias("edge_count"))
    v = vectors.join(repo, F.col("symbol_id") == F.col("_id")).groupBy(F.col("_repo").alias("repo_path")).agg(F.lit(True).alias("has_embeddings"))
    return s.join(e, "repo_path", "left").join(v, "repo_path", "left").select("repo_path", "symbol_count", "package_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), F.coalesce("has_embeddings", F.lit(False)).alias("has_embeddings"))


def index_status(repositories: DataFrame, now: Column) -> DataFrame:
    """(root_path, indexed, age_seconds, index_age, is_stale, stale_reason): stale beyond a day, a note beyond an hour, a warning without embeddings."""
    at = parse_instant(F.col("last_indexed_at"))
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.date_trunc("second", at))).cast("long")
    r = repositories.select("root_path", "has_embeddings", age.alias("age_seconds")).withColumn("index_age", human_age(F.col("age_seconds")))
    # The sentences.
    told = F.when(F.col("age_seconds") > STALE_SECONDS, F.concat(F.lit("Index is "), "index_age", F.lit(" old. Consider re-indexing for latest changes."))).when(
        F.col("age_seconds") > WARN_SECONDS, F.concat(F.lit("Index is "), "index_age", F.lit(" old. Recent changes may not be reflected."))
    )
    warn = F.when(~F.coalesce("has_embeddings", F.lit(False)), F.lit("Warning: No embeddings available. Semantic search may be limited."))
    return r.select("root_path", F.col("age_seconds").isNotNull().alias("indexed"), "age_seconds", "index_age", F.coalesce(F.col("age_seconds") > STALE_SECONDS, F.lit(False)).alias("is_stale"), F.when(F.col("age_seconds").isNotNull(), F.concat_ws(" ", told, warn)).otherwise("").alias("stale_reason"))


def changed_packages(files: DataFrame, listing: DataFrame, since: Column) -> DataFrame:
    """(package_path, reason) of packages to extract again: an indexed file is missing, or one was modified since, or is new.

    ``files`` (package_path, file_path) are indexed, ``listing`` (package_path, file_path, modified) is what is there now.
    """
    f, g = files.select("package_path", "file_path").distinct().alias("f"), listing.alias("g")
    both = f.join(g, F.col("f.file_path") == F.col("g.file_path"), "full_outer")
    reason = F.when(F.col("g.file_path").isNull(), "missing").when(F.col("f.file_path").isNull(), "new").when(F.col("g.modified") > since, "modified")
    rows = both.select(F.coalesce("f.package_path", "g.package_path").alias("package_path"), reason.alias("reason")).where("reason is not null")
    return rows.groupBy("package_path").agg(F.min("reason").alias("reason"))


def first_indexed(candidates: DataFrame, repositories: DataFrame) -> DataFrame:
    """(request_id, root_path): of ordered candidate roots (request_id, ordinal, root_path) the first that is indexed with symbols."""
    ok = repositories.where("symbol_count > 0").select("root_path")
    return candidates.join(ok, "root_path", "left_semi").groupBy("request_id").agg(F.min_by("root_path", "ordinal").alias("root_path"))
