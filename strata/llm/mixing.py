"""Mixing sources to target weights (problem 7).

Method: each document gets a hash-random key, sources are ordered by it in ranges, token counts are summed up by
distributed prefix sums, and each source is cut at its exact budget; a source smaller than its budget is repeated in
epochs. Hash-random keys are uniform, so equal ranges of the key are even without sampling, however large a source;
their number follows the number of rows.

The size of a mix is the largest for which every source meets its share within ``max_repeats`` (the scarcest source
decides), or ``total_tokens`` where given; then a source short of documents is used up and the report shows it.
Targets are normalised over the sources that have documents.

Defined results: null and blank texts and texts of no target's source fall out; a source is compared in lower case
with trimmed ends and '-' for '_' and spaces; targets that are null or not positive count as 0; max_repeats below 1
or null counts as 1; a source without documents is reported with actual share 0; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.common import cut
from strata.llm.tokens import VOCABULARY, token_counts

RANGE_ROWS = 50_000  #: rows of a key range, about: what one task sorts and sums up
BUDGET_SALTS = 16  #: ways in which a source's rows meet its budgets


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " "))), r"[\s_]+", "-")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Budgets: (mix_name, source, target_share, share, max_repeats, available, budget), one row per target."""
    goal = (
        targets.where("mix_name is not null and source is not null")
        .groupBy("mix_name", source_name(F.col("source")).alias("source"))
        .agg(F.sum(F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("max_repeats"))
    )
    stock = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    known = goal.join(stock, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    mix = Window.partitionBy("mix_name")
    usable = F.when(F.col("available") > 0, F.col("target_share")).otherwise(0.0)
    share = known.withColumn("share", F.when(F.sum(usable).over(mix) > 0, usable / F.sum(usable).over(mix)).otherwise(0.0))
    reach = F.when(F.col("share") > 0, F.col("available") * F.col("max_repeats") / F.col("share"))
    total = F.lit(float(total_tokens)) if total_tokens else F.min(reach).over(mix)
    wanted = F.floor(F.col("share") * F.coalesce(total, F.lit(0.0)))
    return share.withColumn("budget", F.least(wanted, F.col("available") * F.col("max_repeats")).cast("long")).select("mix_name", "source", "target_share", "share", "max_repeats", "available", "budget")


def with_prefix(sizes: DataFrame, seed: int = 0, ranges: int | None = None) -> DataFrame:
    """``sizes`` (doc_id, source, tokens) with ``before``: the tokens of the source's documents earlier in hash-random order.

    Ranges are the upper bits of the key, so they follow each other in the order of the key; ``ranges`` is rounded up to a power of two.
    """
    bits = (max(ranges or sizes.count() // RANGE_ROWS, 2) - 1).bit_length()
    keyed = sizes.withColumn("_key", F.xxhash64("doc_id", F.lit(seed))).withColumn("_range", F.shiftright("_key", 64 - bits).cast("long"))
    sums = keyed.groupBy("source", "_range").agg(F.sum("tokens").alias("t"))  # one row per range and source
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("source", "_range", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offset, ["source", "_range"]).select("doc_id", "source", "tokens", (F.col("_offset") + F.col("_inside")).alias("before"))


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of all non-blank texts that have a source, counted once and kept in the shared folder."""
    named = documents.select("doc_id", "source", "text").withColumn("source", source_name(F.col("source"))).where("source is not null and source <> ''")
    return cut(token_counts(named, "source", vocabulary=vocabulary, prompts=False).select("doc_id", "source", F.col("tokens").cast("long").alias("tokens")))


def select(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """(mix_name, source, doc_id, tokens, repeats): how often each document is used in each mix; documents not used have no row.

    A source with budget B and T tokens runs through floor(B/T) full epochs and then takes the documents that start
    before the rest of B and end by it, or by less than half a document beyond it.
    """
    budgets = plan(sizes, targets, total_tokens).where("budget > 0").select("mix_name", "source", "available", "budget", "max_repeats")
    # One row per mix and source: the documents are the large side and meet it by a hash join; a large source is
    # spread by its ranges' salts.
    spread = budgets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(BUDGET_SALTS - 1))))
    rows = with_prefix(sizes, seed).withColumn("_salt", F.pmod(F.hash("doc_id"), F.lit(BUDGET_SALTS))).join(spread, ["source", "_salt"])
    full = F.floor(F.col("budget") / F.col("available"))
    rest = F.col("budget") - full * F.col("available")
    part = (F.col("before") + F.col("tokens") / 2 <= rest) & (rest > 0) & (full < F.col("max_repeats"))
    return rows.withColumn("repeats", (full + F.when(part, 1).otherwise(0)).cast("int")).where("repeats > 0").select("mix_name", "source", "doc_id", "tokens", "repeats")


def report(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """Shares reached: (mix_name, source, target_share, share, max_repeats, available, budget, actual_tokens, actual_share, epochs)."""
    used = select(sizes, targets, total_tokens, seed).groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"))
    joined = plan(sizes, targets, total_tokens).join(used, ["mix_name", "source"], "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    mix = F.sum("actual_tokens").over(Window.partitionBy("mix_name"))
    return joined.withColumn("actual_share", F.when(mix > 0, F.col("actual_tokens") / mix).otherwise(0.0)).withColumn("epochs", F.when(F.col("available") > 0, F.col("actual_tokens") / F.col("available")).otherwise(0.0))


def target_report(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(mix_name, source, target_share, documents, within_repeats, on_budget) of each target: whether no document is used more than max_repeats times and the tokens used are within one document of the budget."""
    used = select(sizes, targets, None, seed).groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.max("repeats").alias("most"))
    stock = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.max("tokens").alias("largest"))
    all_of = plan(sizes, targets).join(used, ["mix_name", "source"], "left").join(stock, "source", "left")
    off = F.abs(F.coalesce("used", F.lit(0)) - F.col("budget"))
    return all_of.select("mix_name", "source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (off <= F.coalesce("largest", F.lit(0))).alias("on_budget"))
