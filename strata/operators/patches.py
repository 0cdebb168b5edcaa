"""Comments to be written into sources, as a table of patches; sources themselves are not changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import comment_source, insertion_diff


def comment_patches(symbols: DataFrame, comments: DataFrame) -> DataFrame:
    """(file_path, place, id, line, comment): the formatted ``comments`` (id, comment) before the lines of their symbols, per file from the last line up, so that earlier lines keep their numbers. Blank comments and symbols without a line fall out."""
    c = comments.where(F.trim(F.coalesce("comment", F.lit(""))) != "").select("id", comment_source(F.col("comment")).alias("comment"))
    rows = symbols.where("line_start > 0 and file_path is not null").select("id", "file_path", F.col("line_start").alias("line")).join(c, "id")
    place = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("line"), "id"))
    return rows.select("file_path", place.alias("place"), "id", "line", "comment")


def patch_diffs(patches: DataFrame, files: DataFrame) -> DataFrame:
    """``patches`` with ``diff`` against the text of their file (file_path, text)."""
    lines = files.select("file_path", F.split(F.regexp_replace("text", "\r\n", "\n"), "\n").alias("_lines"))
    joined = patches.join(lines, "file_path")
    return joined.withColumn("diff", insertion_diff(F.col("_lines"), F.col("line") - 2, F.split("comment", "\n"))).drop("_lines")
