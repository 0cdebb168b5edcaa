"""A few keys holding most records (problem 3).

Method: heavy keys are found by a sketch (counts per hash bucket, two independent hashes: never too small, so no
heavy key is missed), then counted exactly. A join with their attributes broadcasts the heavy keys' rows, of which
there are at most 1/share, and shuffles the remaining keys in the ordinary way; both parts are united. Unless it is
part of the question, the share follows from the number of partitions, so that no task gets much more than its part.

Defined results: rows with a null key never join and have no target; repeated rows of an edge count once, with the
greatest weight (a null weight counts as 0); empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.common import parallelism

SKETCH_WIDTH = 4096  #: least number of buckets per hash


def even_share(rows: DataFrame) -> float:
    """Share of the rows from which on a key is kept apart: a quarter of an even partition."""
    return 1 / (4 * parallelism(rows.sparkSession))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """(from_id, to_id, edge_type, weight), each triple once. The three keys together are spread evenly, whatever the share of one target."""
    return edges.where("to_id is not null").groupBy("from_id", "to_id", "edge_type").agg(F.coalesce(F.max("weight"), F.lit(0)).cast("long").alias("weight"))


def heavy_keys(rows: DataFrame, keys: Sequence[str], share: float, width: int | None = None) -> DataFrame:
    """``keys``, n, total of every key that holds at least ``share`` of ``rows``; at most 1/share rows, exact. The sketch has 8 buckets per key that can be heavy."""
    width = width or max(SKETCH_WIDTH, math.ceil(8 / share))
    first = F.pmod(F.xxhash64(*keys), F.lit(width)).cast("int")
    second = F.pmod(F.hash(*keys), F.lit(width)).cast("int")
    sketched = rows.select(*keys, first.alias("h1"), second.alias("h2"))

    def heavy(h: str) -> DataFrame:
        counts = sketched.groupBy(h).agg(F.count("*").alias("c"))  # at most ``width`` rows
        total = F.sum("c").over(Window.partitionBy())
        return counts.select(h, "c", total.alias("total")).where(F.col("c") >= share * F.col("total"))

    # At most 1/share buckets each, so the broadcasts are bounded.
    one, two = heavy("h1").select("h1", "total"), heavy("h2").select("h2")
    maybe = sketched.join(F.broadcast(one), "h1").join(F.broadcast(two), "h2", "left_semi")
    return maybe.groupBy(*keys).agg(F.count("*").alias("n"), F.first("total").alias("total")).where(F.col("n") >= share * F.col("total"))


def heavy_values(rows: DataFrame, key: str, share: float, width: int = SKETCH_WIDTH) -> list:
    """The at most 1/share values of ``key`` that hold at least ``share`` of ``rows``, on the driver.

    One pass counts the rows per bucket (two hashes, at most 2 ``width`` figures); only if a bucket is that full are its
    keys counted. Null is no value.
    """
    h1, h2 = F.pmod(F.xxhash64(key), F.lit(width)).cast("int"), F.pmod(F.hash(key), F.lit(width)).cast("int")
    known = rows.where(F.col(key).isNotNull()).select(key, h1.alias("h1"), h2.alias("h2"))
    counts = known.groupBy("h1", F.lit(0).alias("w")).agg(F.count("*").alias("n")).unionByName(known.groupBy(F.col("h2").alias("h1"), F.lit(1).alias("w")).agg(F.count("*").alias("n"))).collect()
    total = sum(r["n"] for r in counts) / 2
    full = [[r["h1"] for r in counts if r["w"] == w and r["n"] >= share * total] for w in (0, 1)]
    if not total or not full[0] or not full[1]:
        return []
    maybe = known.where(F.col("h1").isin(full[0]) & F.col("h2").isin(full[1])).groupBy(key).agg(F.count("*").alias("n"))
    return [r[key] for r in maybe.where(F.col("n") >= share * total).collect()]


def skew_join(rows: DataFrame, attributes: DataFrame, key: str, share: float | None = None) -> DataFrame:
    """``rows`` left joined with ``attributes`` on ``key`` (one row per key there) without a task that holds a heavy key.

    Rows of keys with at least ``share`` of all rows meet a broadcast of at most 1/share attribute rows and stay where
    they are; only the rest is shuffled.
    """
    heavy = heavy_keys(rows.where(F.col(key).isNotNull()), [key], share or even_share(rows)).select(key)
    by_key = attributes.where(F.col(key).isNotNull())
    heavy_attributes = by_key.join(F.broadcast(heavy), key, "right")  # one row per heavy key, with nulls where it has no attributes
    hot = rows.join(F.broadcast(heavy_attributes), key)
    cold = rows.join(F.broadcast(heavy), key, "left_anti").join(by_key, key, "left")
    return hot.unionByName(cold.select(*hot.columns))


def spread_join(rows: DataFrame, attributes: DataFrame, key: str, share: float | None = None) -> DataFrame:
    """``rows`` inner joined with ``attributes`` (one row per key). The heavy keys are looked for at once, so ``rows`` should be cheap to read; where there are none this is a plain join."""
    heavy = heavy_values(rows, key, share or even_share(rows))
    if not heavy:
        return rows.join(attributes, key)
    hot = rows.where(F.col(key).isin(heavy)).join(F.broadcast(attributes.where(F.col(key).isin(heavy))), key)
    cold = rows.where(~F.col(key).isin(heavy)).join(attributes, key)
    return hot.unionByName(cold)


def targets(symbols: DataFrame, core_symbols: DataFrame) -> DataFrame:
    """(to_id, to_kind, to_package) of every id, once; of several rows the greatest values."""
    both = symbols.select("id", "kind", "package_path").unionByName(core_symbols.select("id", "kind", "package_path"))
    return both.where("id is not null").groupBy(F.col("id").alias("to_id")).agg(F.max("kind").alias("to_kind"), F.max("package_path").alias("to_package"))


def callers(edges: DataFrame, symbols: DataFrame, core_symbols: DataFrame, share: float | None = None) -> DataFrame:
    """(to_id, edge_type, from_id, weight, to_kind, to_package): the distinct callers of every target with their weights, complete. Removed targets have null attributes."""
    return skew_join(distinct_edges(edges), targets(symbols, core_symbols), "to_id", share)


def target_totals(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """(to_id, edge_type, n_callers, total_weight, heavy) of every target, heavy with at least ``share`` of all distinct edges.

    Heavy targets' edges meet a broadcast of at most 1/share keys where they lie and shuffle one partial sum per task;
    the others are shuffled by their key; both parts are united.
    """
    keys, each = ["to_id", "edge_type"], distinct_edges(edges)
    heavy = heavy_keys(each, keys, share).select(F.col("to_id").alias("_t"), F.col("edge_type").alias("_e"))
    same = (F.col("to_id") == F.col("_t")) & F.col("edge_type").eqNullSafe(F.col("_e"))
    sums = (F.count("*").alias("n_callers"), F.sum("weight").alias("total_weight"))
    hot = each.join(F.broadcast(heavy), same, "left_semi").groupBy(*keys).agg(*sums).withColumn("heavy", F.lit(True))
    cold = each.join(F.broadcast(heavy), same, "left_anti").groupBy(*keys).agg(*sums).withColumn("heavy", F.lit(False))
    return hot.unionByName(cold)


def heavy_targets(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """(to_id, edge_type, n_callers) of the targets with at least ``share`` of all distinct edges: the heavy part of ``target_totals``, the other is not computed."""
    return target_totals(edges, share).where("heavy").select("to_id", "edge_type", "n_callers")
