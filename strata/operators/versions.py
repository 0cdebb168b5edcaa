"""Current version of every symbol among repeated, late and moved deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.common import is_blank, slash_path
from strata.functions.timeparse import parse_instant


def stored_rows(symbols: DataFrame) -> DataFrame:
    """``symbols`` with modified (instant of updated_at), file (one spelling of the path) and stored (created_at, else modified); rows without id fall out."""
    modified = parse_instant(F.col("updated_at"))
    return (
        symbols.where("id is not null")
        .withColumn("modified", modified)
        .withColumn("file", slash_path(F.coalesce(F.col("file_path"), F.lit(""))))
        .withColumn("stored", F.coalesce(F.col("created_at"), F.col("modified")))
    )


def current_versions(symbols: DataFrame, *keep: str) -> DataFrame:
    """One row per id: id, modified, file, stored and ``keep`` of its current version.

    A version is the rows of one id with the same modification instant and file; it is stored at its earliest
    delivery. Current is the latest modified (null is oldest), then the one stored last (null first), then the
    last file by name. Of a version's rows, each of ``keep`` takes its greatest non-blank value, so repeated
    deliveries that lost a field don't hide it. Both steps combine before they shuffle, so an id with very many
    rows is no hot spot.
    """
    rows = stored_rows(symbols)
    text = [c for c in keep if dict(rows.dtypes)[c] == "string"]
    best = [F.max(F.when(~is_blank(F.col(c)), F.col(c)) if c in text else F.col(c)).alias(c) for c in keep]
    version = rows.groupBy("id", "modified", "file").agg(F.min("stored").alias("stored"), *best)
    order = F.struct(F.col("modified"), F.col("stored"), F.col("file"))
    one = version.groupBy("id").agg(F.max_by(F.struct("modified", "file", "stored", *keep), order).alias("v"))
    return one.select("id", "v.*")
