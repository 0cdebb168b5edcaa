"""Package facts and semantic cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions import rules


def package_info(symbols: DataFrame) -> DataFrame:
    """(package_path, n_symbols, exported_count, has_interface, has_struct, has_method, key_types, key_funcs, exported_funcs): flags and names of each package, names in order of file and line."""
    order = lambda test, c: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("file_path", "line_start", "id", F.col(c).alias("v"))))), lambda x: x["v"])
    func = F.col("kind").isin("func", "method")
    return symbols.groupBy("package_path").agg(
        F.count("*").alias("n_symbols"),
        F.count(F.when(F.col("exported"), 1)).alias("exported_count"),
        F.max(F.col("kind") == "interface").alias("has_interface"),
        F.max(F.col("kind") == "struct").alias("has_struct"),
        F.max(F.col("kind") == "method").alias("has_method"),
        order(F.col("exported") & F.col("kind").isin("struct", "interface", "type"), "name").alias("key_types"),
        order(F.col("exported") & func & rules.card_entry_point(F.col("name")), "name").alias("key_funcs"),
        order(F.col("exported") & func, "name").alias("exported_funcs"),
    )


def _joined(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("N/A")


def package_cards(info: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(package_path, card). ``imports`` (package_path, imports) adds dependencies; the standard library is left out."""
    none = F.array().cast("array<string>")
    rows = info.withColumn("imports", none) if imports is None else info.join(imports.select("package_path", "imports"), "package_path", "left").withColumn("imports", F.coalesce("imports", none))
    role = rules.card_role(F.col("package_path"), F.col("imports"), F.col("has_interface"), F.col("has_struct"), F.col("has_method"))
    duties = rules.responsibilities(F.col("package_path"), F.col("has_interface"), F.col("has_struct"), F.col("has_method"))
    funcs = F.when(F.size("key_funcs") > 0, F.array_join("key_funcs", ", ")).otherwise(_joined(F.slice("exported_funcs", 1, 5)))
    outside = F.filter("imports", lambda p: ~rules.standard_import(p))
    # The labels of a card and of its notes below.
    card = F.concat(
        F.lit("Role: "), role, F.lit("\nResponsibilities: "), F.array_join(duties, ", "), F.lit("\nKey Types: "), _joined(F.col("key_types")), F.lit("\nEntry Points: "), funcs, F.lit("\n"),
        F.when(F.size(outside) > 0, F.concat(F.lit("Dependencies: "), F.array_join(outside, ", "), F.lit("\n"))).otherwise(""),
    )
    return rows.select("package_path", role.alias("role"), F.array_join(duties, ", ").alias("responsibilities"), card.alias("card"))


def symbol_cards(symbols: DataFrame, cards: DataFrame) -> DataFrame:
    """(id, card): signature, kind, documentation, the package's card (computed once per package) and a note by kind."""
    doc = F.when(F.coalesce("doc_comment", F.lit("")) != "", F.concat(F.lit("Documentation: "), "doc_comment", F.lit("\n"))).otherwise("")
    context = F.when(F.col("_card").isNotNull(), F.concat(F.lit("Package Context:\n"), "_card", F.lit("\n"))).otherwise("")
    signature = F.coalesce("signature", F.lit(""))
    note = (
        F.when(F.col("kind").isin("method", "func") & signature.contains("error"), "Returns error for failure cases\n")
        .when(F.col("kind") == "interface", "Interface defining behavior contract\n")
        .when(F.col("kind") == "struct", "Data structure\n")
        .otherwise("")
    )
    rows = symbols.join(cards.select("package_path", F.col("card").alias("_card")), "package_path", "left")
    return rows.select("id", F.concat(F.lit("Signature: "), signature, F.lit("\nKind: "), "kind", F.lit("\n"), doc, context, note).alias("card"))
