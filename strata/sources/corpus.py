"""Clean views over the stored tables: the symbol catalog, typed edges, packages, usable embeddings, text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.common import scratch_path, slash_path, table
from strata.functions.vector import usable
from strata.operators import fts


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """One row per symbol id: the delivery stored last."""
    order = [F.desc_nulls_last("created_at"), F.desc_nulls_last("updated_at"), F.desc("file_path"), F.desc("line_start"), F.desc(F.coalesce("doc_comment", F.lit(""))), F.desc(F.coalesce("signature", F.lit("")))]
    rows = table(spark, d, "symbols").where("id is not null")
    one = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_rn = 1").drop("_rn")
    return one.withColumn("file_path", slash_path(F.col("file_path")))


def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    """One row per (from_id, to_id, edge_type): greatest weight, first import path present, first creation."""
    return (
        table(spark, d, "edges")
        .where("from_id is not null and to_id is not null")
        .groupBy("from_id", "to_id", "edge_type")
        .agg(F.max("weight").alias("weight"), F.min_by("import_path", F.when(F.col("import_path").isNotNull(), F.col("id"))).alias("import_path"), F.min("created_at").alias("created_at"))
    )


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """(symbol_id, vector, model): latest vector of each symbol, if it is usable."""
    order = [F.desc_nulls_last("created_at"), F.desc_nulls_last("model"), F.desc("dimension")]
    rows = table(spark, d, "symbol_vectors").where("symbol_id is not null")
    one = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol_id").orderBy(*order))).where("_rn = 1")
    return one.where(usable(F.col("vector"))).select("symbol_id", "vector", "model")


def packages(symbols: DataFrame) -> DataFrame:
    """Counts per package of a catalog."""
    return symbols.groupBy("package_path").agg(
        F.max("package_name").alias("name"), F.countDistinct("file_path").alias("file_count"), F.count("*").alias("symbol_count"), F.sum(F.col("line_end") - F.col("line_start") + 1).alias("line_count")
    )


def package_imports(spark: SparkSession, d: str) -> DataFrame:
    """(path, imports, imported_by): what each package's symbols import by the edges, and the packages that import it."""
    owner = catalog(spark, d).select(F.col("id").alias("from_id"), F.col("package_path").alias("path"))
    used = merged_edges(spark, d).where("edge_type = 'imports' and import_path is not null").join(owner, "from_id").select("path", F.col("import_path").alias("target")).distinct()
    imports = used.groupBy("path").agg(F.array_sort(F.collect_set("target")).alias("imports"))
    by = used.where("path <> target").groupBy(F.col("target").alias("path")).agg(F.array_sort(F.collect_set("path")).alias("imported_by"))
    none = F.array().cast("array<string>")
    return imports.join(by, "path", "full_outer").select("path", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, text) of every text, lines counted from 1."""
    split = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")
    return documents.where("text is not null").select("doc_id", F.posexplode(split).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "text")


_INDEXES: dict[tuple, str] = {}


def text_index(spark: SparkSession, d: str, name: str, docs: DataFrame, id_col: str, columns: Sequence[str]) -> fts.Index:
    """The stored full-text index of a view of a data directory: written to the shared folder when first asked for, read by every later search of the session. A table that was written anew gets a new one."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(d)
    status = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    state = tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in status))
    key = (spark.sparkContext.applicationId, d, name, state)
    if key not in _INDEXES:
        path = scratch_path(spark, f"fts-{name}")
        fts.write_index(docs, id_col, columns, path)
        _INDEXES[key] = path
    return fts.read_index(spark, _INDEXES[key])
