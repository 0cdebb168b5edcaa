"""Mutations of the stored tables as plans: upserts, deletes, cascades; and a small table store on Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows and those new ones whose id is not there yet; among new rows with one id the first by file and line."""
    w = Window.partitionBy("id").orderBy("file_path", "line_start")
    first = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return old.unionByName(first.join(old.select("id"), "id", "left_anti").select(*old.columns))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (from_id, to_id, edge_type) once each: greatest weight, the first import path present, the first creation."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    path = F.when(F.col("import_path").isNotNull(), F.struct("_seq", "created_at", "import_path"))
    return both.groupBy("from_id", "to_id", "edge_type").agg(F.max("weight").alias("weight"), F.min(path)["import_path"].alias("import_path"), F.min("created_at").alias("created_at"))


def latest_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = (), fill: Sequence[str] = ()) -> DataFrame:
    """Upsert by ``keys``: a new row replaces the old one, but for ``keep_old`` (old value stays) and ``fill`` (old value where the new is null)."""
    n, o = new.alias("n"), old.alias("o")
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    joined = n.withColumn("_new", F.lit(True)).join(o.withColumn("_old", F.lit(True)), on, "full_outer")
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()

    def value(c: str) -> Column:
        a, b = F.col(f"n.{c}"), F.col(f"o.{c}")
        if c in keep_old:
            return F.when(is_old, b).otherwise(a)
        if c in fill:
            return F.coalesce(a, b)
        return F.when(is_new, a).otherwise(b)

    return joined.select(*[value(c).alias(c) for c in old.columns])


def upsert_packages(old: DataFrame, new: DataFrame) -> DataFrame:
    return latest_wins(old, new, ["path"], keep_old=["repo_path", "created_at"], fill=["imported_by"])


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """One vector per symbol; empty new vectors are skipped."""
    return latest_wins(old, new.where(F.size("vector") > 0), ["symbol_id"])


def upsert_repositories(old: DataFrame, new: DataFrame) -> DataFrame:
    """A blank id becomes the SHA-1 of the root; a missing root is an error."""
    root = F.when(F.trim(F.coalesce("root_path", F.lit(""))) == "", F.raise_error(F.lit("root_path is required")).cast("string")).otherwise(F.col("root_path"))
    named = new.withColumn("root_path", root).withColumn("id", F.when(F.trim(F.coalesce("id", F.lit(""))) == "", F.sha1(F.col("root_path").cast("binary"))).otherwise(F.col("id")))
    return latest_wins(old, named, ["root_path"], keep_old=["id", "created_at"])


def update_symbols(old: DataFrame, changes: DataFrame) -> DataFrame:
    """New semantic_text and tokens by id, where given."""
    c = changes.select("id", F.col("semantic_text").alias("_text"), F.col("tokens").alias("_tokens"))
    return old.join(c, "id", "left").withColumn("semantic_text", F.coalesce("_text", "semantic_text")).withColumn("tokens", F.coalesce("_tokens", "tokens")).drop("_text", "_tokens")


def delete_by(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not among the one column of ``keys``."""
    k = keys.select(F.col(keys.columns[0]).alias("_k")).distinct()
    return df.join(k, df[column] == k["_k"], "left_anti")


def delete_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).startswith(prefix))


def cascade(edges: DataFrame, vectors: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends and vectors with their symbol among ``symbols``."""
    ids = symbols.select(F.col("id").alias("_id"))
    kept = edges.join(ids, F.col("from_id") == F.col("_id"), "left_semi").join(ids, F.col("to_id") == F.col("_id"), "left_semi")
    return kept, vectors.join(ids, F.col("symbol_id") == F.col("_id"), "left_semi")


def delete_edges_of(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges that touch none of ``symbols`` at either end."""
    ids = symbols.select("id")
    return delete_by(delete_by(edges, ids, "from_id"), ids, "to_id")


def add_importer(packages: DataFrame, imports: DataFrame) -> DataFrame:
    """``imports`` (path, importer) united into packages.imported_by, sorted and without repeats."""
    more = imports.groupBy("path").agg(F.collect_set("importer").alias("_more"))
    none = F.array().cast("array<string>")
    return packages.join(more, "path", "left").withColumn("imported_by", F.array_sort(F.array_union(F.coalesce("imported_by", none), F.coalesce("_more", none)))).drop("_more")


class TableStore:
    """Named Parquet tables under one root, replaced as a whole: a new version is written beside the old one and made current by a rename of a small pointer. Readers see the old or the new version."""

    VERSION = 1

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def versions(self, name: str) -> list[str]:
        p = self._path(f"{self.root}/{name}/_current")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{self.versions(name)[-1].split('@')[1]}")

    def write(self, name: str, df: DataFrame, keep: int = 2) -> None:
        """Makes ``df`` the current version, which may be computed from the old one; all but the last ``keep`` versions are removed."""
        data, old = uuid.uuid4().hex, self.versions(name)
        df.write.parquet(f"{self.root}/{name}/{data}")
        number = int(old[-1].split("@")[0]) + 1 if old else 0
        staged = self._path(f"{self.root}/{name}/_staged-{data}")
        self._fs.create(staged).close()
        self._fs.mkdirs(self._path(f"{self.root}/{name}/_current"))
        if not self._fs.rename(staged, self._path(f"{self.root}/{name}/_current/{number:010d}@{data}")):
            raise OSError(f"{name}: the new version could not be made current")
        for v in old[: -(keep - 1)] if keep > 1 else old:
            self._fs.delete(self._path(f"{self.root}/{name}/_current/{v}"), False)
            self._fs.delete(self._path(f"{self.root}/{name}/{v.split('@')[1]}"), True)

    def size(self) -> int:
        """Bytes of all tables."""
        return int(self._fs.getContentSummary(self._path(self.root)).getLength()) if self._fs.exists(self._path(self.root)) else 0

    def clear(self) -> None:
        self._fs.delete(self._path(self.root), True)
