"""Lookups of symbols, files and packages with optional filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def positive_or(value: int | None, default: int) -> int:
    """A positive override, else the default."""
    return value if value is not None and value > 0 else default


def symbols_by_name(symbols: DataFrame, name: str, repo: str | None = None, package: str | None = None, limit: int | None = 20) -> DataFrame:
    """Symbols of exactly this name in order of package, kind and name; blank filters do not filter, a blank name is an error, a limit that is not positive is 20."""
    if not name or not name.strip():
        raise ValueError("a name is required")
    rows = symbols.where(F.col("name") == name)
    if repo:
        rows = rows.where(F.col("repo_path") == repo)
    if package:
        rows = rows.where(F.col("package_path") == package)
    return rows.orderBy("package_path", "kind", "name", "id").limit(positive_or(limit, 20))


def symbols_by_package(symbols: DataFrame, package: str) -> DataFrame:
    return symbols.where(F.col("package_path") == package).orderBy("kind", "name", "id")


def symbols_by_repo(symbols: DataFrame, repo: str) -> DataFrame:
    return symbols.where(F.col("repo_path") == repo).orderBy("package_path", "kind", "name", "id")


def files_of(symbols: DataFrame, repo: str) -> DataFrame:
    return symbols.where((F.col("repo_path") == repo) & (F.col("kind") == "file")).orderBy("file_path", "id")


def packages(table: DataFrame, repo: str | None = None, role: str | None = None) -> DataFrame:
    """Packages in order of their paths, of one repository and of one role where given."""
    rows = table
    if repo:
        rows = rows.where(F.col("repo_path") == repo)
    if role:
        rows = rows.where(F.col("role") == role)
    return rows.orderBy("path")


def edges_of_type(edges: DataFrame, edge_type: str) -> DataFrame:
    return edges.where(F.col("edge_type") == edge_type)
