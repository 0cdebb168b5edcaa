"""Evidence packs: package cards, symbol cards, relation hints and line-budgeted snippets of search results.

Input are ranked hits: query_id, place, symbol_id, name, kind, package_path, exported, combined, vector, layer,
is_entry, pagerank, semantic_text, file_path, line_start, line_end, signature, reasons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions import rules
from strata.functions.text import truncate

MAX_PACKAGES, MAX_SYMBOLS, MAX_SNIPPETS, MAX_LINES = 3, 10, 5, 200  #: default limits


def _flag(c: str, value: float):
    return F.when(F.coalesce(F.col(c), F.lit(False)), value).otherwise(0.0)


def package_cards(hits: DataFrame, packages: DataFrame | None = None, limit: int = MAX_PACKAGES) -> DataFrame:
    """(query_id, card, path, score, role, summary, why, key_symbols): packages by their hits' scores, best first."""
    graph = F.when(F.coalesce(F.col("graph"), F.lit(0.0)) > 0.5, 0.2).otherwise(0.0)
    w = Window.partitionBy("query_id", "package_path").orderBy("place")
    rows = hits.withColumn("_rn", F.row_number().over(w))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_rn", c.alias("v")))), lambda x: x["v"])
    # The reasons, labels and marks of packs.
    why = F.concat(
        F.when(F.col("combined") > 0.7, F.array(F.concat(F.lit("High relevance: "), "name"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("is_entry"), F.array(F.lit("Contains entry points"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("layer") == "service", F.array(F.lit("Core service layer"))).otherwise(F.array().cast("array<string>")),
    )
    # A hit adds its reasons only while fewer than three are there.
    why_of = lambda lists: F.aggregate(lists, F.array().cast("array<string>"), lambda acc, x: F.when(F.size(acc) >= 3, acc).otherwise(F.concat(acc, x)))
    grouped = rows.groupBy("query_id", "package_path").agg(
        F.sum(F.col("combined") + graph + _flag("is_entry", 0.1)).alias("score"),
        F.min_by("layer", F.when(F.col("layer").isin(*rules.ROLE_OF_LAYER), F.col("_rn"))).alias("_layer"),
        ordered(why).alias("_why"),
        F.slice(F.array_compact(ordered(F.when(F.col("exported") | F.col("is_entry"), F.col("name")))), 1, 5).alias("key_symbols"),
        F.min_by(F.coalesce("semantic_text", F.lit("")), F.col("_rn")).alias("_text"),
        F.count("*").alias("_n"),
    )
    kinds = rows.groupBy("query_id", "package_path", "kind").agg(F.count("*").alias("n")).groupBy("query_id", "package_path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("n").cast("string"), "kind"))), " | ").alias("_kinds"))
    cards = grouped.join(kinds, ["query_id", "package_path"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "package_path"))
    text = F.when(F.col("_text") != "", F.concat(F.lit(" | "), truncate(F.col("_text"), 100))).otherwise("")
    cards = cards.withColumn("card", place).where(F.col("card") <= limit)
    out = cards.select(
        "query_id", "card", F.col("package_path").alias("path"), "score", rules.evidence_role(F.col("package_path"), F.col("_layer")).alias("role"),
        F.concat(F.col("_n").cast("string"), F.lit(" symbols | "), "_kinds", text).alias("summary"), why_of(F.col("_why")).alias("why"), "key_symbols",
    )
    return out if packages is None else out.join(packages.select(F.col("path"), "imports", "imported_by"), "path", "left")


def symbol_cards(hits: DataFrame, limit: int = MAX_SYMBOLS) -> DataFrame:
    """The first hits as cards; the first three carry their text."""
    snippet = F.when((F.col("place") <= 3) & (F.coalesce("semantic_text", F.lit("")) != ""), truncate(F.col("semantic_text"), 300)).otherwise("")
    return hits.where(F.col("place") <= limit).select("query_id", "place", F.col("symbol_id").alias("id"), "name", "kind", "signature", F.col("file_path").alias("file"), F.col("line_start").alias("line"), snippet.alias("snippet"), F.array_join("reasons", "; ").alias("why"))


def hints(hits: DataFrame, callers: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, n, hint): common caller, entry points, first hub."""
    c = callers.join(symbols.select(F.col("id").alias("caller_id"), "name", "package_path"), "caller_id")
    caller = c.select("query_id", F.lit(1).alias("n"), F.concat(F.lit("Common caller: "), "name", F.lit(" ("), "package_path", F.lit(")")).alias("hint"))
    entries = hits.where("is_entry").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ", ").alias("names"))
    entry = entries.select("query_id", F.lit(2).alias("n"), F.concat(F.lit("Entry points: "), "names").alias("hint"))
    hub = hits.where("pagerank > 0.01").groupBy("query_id").agg(F.min_by("name", "place").alias("name")).select("query_id", F.lit(3).alias("n"), F.concat(F.lit("Hub: "), "name", F.lit(" (called by many)")).alias("hint"))
    return caller.unionByName(entry).unionByName(hub)


def extract_lines(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """``hits`` (query_id, symbol_id, file_path, line_start, line_end) with ``content`` from ``lines`` (file_path, line_no, text); hits without readable lines fall out."""
    wanted = hits.where("file_path is not null and line_start > 0 and line_end > 0").select("query_id", "symbol_id", "file_path", "line_start", "line_end")
    met = wanted.join(lines, "file_path").where(F.col("line_no").between(F.col("line_start"), F.col("line_end")))
    return met.groupBy("query_id", "symbol_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("content"))


def snippets(hits: DataFrame, max_snippets: int = MAX_SNIPPETS, max_lines: int = MAX_LINES) -> DataFrame:
    """(query_id, rank, symbol_id, n_lines, kept_lines, priority): the snippets that fit the line budget.

    Hits without lines (``n_lines`` null) are skipped. In order of priority whole snippets are taken while they fit;
    the first that does not is cut to the room left if that is more than five lines, and ends the list. The loop is a
    running sum: only its first overflow can be cut.
    """
    priority = F.col("combined") + _flag("exported", 0.2) + _flag("is_entry", 0.3)
    rows = hits.where("n_lines > 0").withColumn("priority", priority)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("priority", 9)), "symbol_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_snippets)
    rows = rows.withColumn("_cum", F.sum("n_lines").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    room = F.lit(max_lines) - (F.col("_cum") - F.col("n_lines"))
    kept = F.when(F.col("_cum") <= max_lines, F.col("n_lines")).when(room > 5, room)
    return rows.withColumn("kept_lines", kept.cast("int")).where("kept_lines is not null").select("query_id", "rank", "symbol_id", "n_lines", "kept_lines", "priority")


def metadata(hits: DataFrame, picked: DataFrame) -> DataFrame:
    """(query_id, total_symbols, has_vector_search, total_lines): counts over hits and snippets."""
    a = hits.groupBy("query_id").agg(F.count("*").alias("total_symbols"), F.coalesce(F.min_by(F.col("vector") > 0, "place"), F.lit(False)).alias("has_vector_search"))
    b = picked.groupBy("query_id").agg(F.sum("kept_lines").alias("total_lines"))
    return a.join(b, "query_id", "left").withColumn("total_lines", F.coalesce("total_lines", F.lit(0)).cast("long"))


def read_range(lines: DataFrame, start: int = 1, end: int | None = None, max_lines: int = 500) -> DataFrame:
    """Lines start..end of each file of ``lines`` (doc_id, line_no, text), at most ``max_lines``; truncated tells whether that limit ended them."""
    last = F.max("line_no").over(Window.partitionBy("doc_id"))
    stop = F.least(last, F.lit(end)) if end else last
    rows = lines.withColumn("_stop", stop).where((F.col("line_no") >= max(1, start)) & (F.col("line_no") <= F.col("_stop")) & (F.col("line_no") < max(1, start) + max_lines))
    return rows.select("doc_id", "line_no", F.format_string("%4d\t%s", "line_no", "text").alias("text"), (F.col("_stop") >= max(1, start) + max_lines).alias("truncated"))
