"""One ranking from several differently-scaled scores (problem 5).

Method: ideal-point ranking. Per query, each score is winsorised at its 5 % and 95 % quantiles and divided by its
length as a vector over the hits; weighted distances to the ideal (best of each score) and the anti-ideal point
(worst of each) give the relative closeness, by which the hits are ordered.

Queries are independent, so ordinary ones take one shuffle by query_id and windows. Queries that hold more than
``share`` of all rows are found by a sketch and take another way: their figures are combined before the shuffle and
joined back over salts, and their hits are ordered in ranges of closeness. Both ways give the same rows.

Defined results: of several scorings of a hit the latest counts (equal instants: the greatest values); null and NaN
scores are absent and stand at the anti-ideal; a constant score moves nothing; hits whose scores move nothing at all
have closeness 0.5; ties in closeness are ordered by symbol_id; rows without query or symbol fall out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.common import parallelism
from strata.operators.skew import heavy_values

SCORES = ("vector", "keyword", "graph")
SALTS = 16  #: ways in which the hits of a heavy query are spread for joins with its figures
STEPS = 64  #: closeness ranges of a heavy query within which hits are ordered
ACCURACY = 10_000  #: of the quantile summary: values of the data, exact up to so many hits a query
OUT = ("query_id", "symbol_id", *SCORES, "closeness", "closeness_rank", "position")


def _present(c: str) -> Column:
    return F.when(F.col(c).isNotNull() & ~F.isnan(c), F.col(c))


def latest_hits(hits: DataFrame) -> DataFrame:
    """(query_id, symbol_id, vector, keyword, graph) of the latest scoring of each hit; absent scores are null."""
    rows = hits.where("query_id is not null and symbol_id is not null").select("query_id", "symbol_id", "scored_at", *[_present(c).alias(c) for c in SCORES])
    latest = Window.partitionBy("query_id", "symbol_id").orderBy(F.desc_nulls_last("scored_at"), *[F.desc_nulls_last(c) for c in SCORES])
    return rows.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").select("query_id", "symbol_id", *SCORES)


def _clip(c: str, low: Column, high: Column) -> Column:
    return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), low), high))


def _closeness(w: Mapping[str, float]) -> Column:
    """From winsorised scores c_, their lengths l_, best b_ and worst a_ values. Written as 1 / (1 + far / near), whose every step is monotonic in floating point: a hit that no score places higher is never closer."""

    def part(c: str, end: str) -> Column:
        span = (F.coalesce(F.col(f"c_{c}"), F.col(f"a_{c}")) - F.col(f"{end}_{c}")) / F.col(f"l_{c}") * w[c]
        return F.when(F.col(f"l_{c}") > 0, span * span).otherwise(0.0)

    far, near = (F.sqrt(sum((part(c, end) for c in SCORES), F.lit(0.0))) for end in ("b", "a"))
    return F.when(near > 0, 1 / (1 + far / near)).when(far > 0, F.lit(0.0)).otherwise(0.5)


def _figures(over) -> list[Column]:
    """Length, best and worst of each winsorised score, aggregated by ``over``."""
    return [
        *[F.sqrt(over(F.sum(F.col(f"c_{c}") * F.col(f"c_{c}")))).alias(f"l_{c}") for c in SCORES],
        *[over(F.max(f"c_{c}")).alias(f"b_{c}") for c in SCORES],
        *[over(F.min(f"c_{c}")).alias(f"a_{c}") for c in SCORES],
    ]


def _ordinary(hits: DataFrame, w: Mapping[str, float], trim: float) -> DataFrame:
    """The ranking with one shuffle: every window below is satisfied by the partitioning by query_id."""
    rows = latest_hits(hits.repartition("query_id"))
    query = Window.partitionBy("query_id")
    ends = rows.select("*", *[F.percentile_approx(c, [trim, 1 - trim], ACCURACY).over(query).alias(f"q_{c}") for c in SCORES])
    clipped = ends.select("query_id", "symbol_id", *SCORES, *[_clip(c, F.col(f"q_{c}")[0], F.col(f"q_{c}")[1]).alias(f"c_{c}") for c in SCORES])
    placed = clipped.select("*", *_figures(lambda x: x.over(query))).select("query_id", "symbol_id", *SCORES, _closeness(w).alias("closeness"))
    # Rank and row number share one sort: hits of one closeness have the rank of the first of them.
    order = query.orderBy(F.desc("closeness"), "symbol_id")
    ranked = placed.withColumn("position", F.row_number().over(order).cast("long"))
    return ranked.withColumn("closeness_rank", F.min("position").over(Window.partitionBy("query_id", "closeness"))).select(*OUT)


def _with_figures(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """Joins figures per query to its hits; each query's figures exist once per salt, so no task gets all hits of a query."""
    many = figures.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("symbol_id"), F.lit(SALTS)).cast("int")).join(many, ["query_id", "_salt"]).drop("_salt")


def _heavy(hits: DataFrame, w: Mapping[str, float], trim: float) -> DataFrame:
    """The ranking of queries with very many hits: no task gets all hits of one."""
    rows = latest_hits(hits)
    ends = rows.groupBy("query_id").agg(*[F.percentile_approx(c, [trim, 1 - trim], ACCURACY).alias(f"q_{c}") for c in SCORES])
    clipped = _with_figures(rows, ends).select("query_id", "symbol_id", *SCORES, *[_clip(c, F.col(f"q_{c}")[0], F.col(f"q_{c}")[1]).alias(f"c_{c}") for c in SCORES])
    figures = clipped.groupBy("query_id").agg(*_figures(lambda x: x))
    placed = _with_figures(clipped, figures).select("query_id", "symbol_id", *SCORES, _closeness(w).alias("closeness"))
    placed = placed.withColumn("step", F.least(F.floor(F.col("closeness") * STEPS), F.lit(STEPS - 1)).cast("int"))
    counts = placed.groupBy("query_id", "step").agg(F.count("*").alias("n"))  # at most STEPS rows a query
    better = Window.partitionBy("query_id").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("query_id", "step", F.coalesce(F.sum("n").over(better), F.lit(0)).alias("before"))
    step = Window.partitionBy("query_id", "step").orderBy(F.desc("closeness"))
    ranked = placed.withColumn("_rn", F.row_number().over(step.orderBy(F.desc("closeness"), "symbol_id"))).withColumn("_rank", F.rank().over(step)).join(offsets, ["query_id", "step"])
    return ranked.withColumn("position", (F.col("_rn") + F.col("before")).cast("long")).withColumn("closeness_rank", (F.col("_rank") + F.col("before")).cast("long")).select(*OUT)


def heavy_queries(hits: DataFrame, share: float | None = None) -> list:
    """The at most 1/share queries with at least ``share`` of all rows (default: a quarter of an even partition)."""
    return heavy_values(hits.where("query_id is not null"), "query_id", share or 1 / (4 * parallelism(hits.sparkSession)))


def _split(hits: DataFrame, heavy: list) -> tuple[DataFrame, DataFrame | None]:
    if not heavy:
        return hits, None
    is_heavy = F.col("query_id").isin(heavy)
    return hits.where(~is_heavy), hits.where(is_heavy)


def ideal_point_ranking(hits: DataFrame, weights: Mapping[str, float] | None = None, trim: float = 0.05, share: float | None = None) -> DataFrame:
    """(query_id, symbol_id, vector, keyword, graph, closeness, closeness_rank, position): every hit in its query, 1 is best; weights are at least 0. Hits of equal closeness share the rank of the first of them."""
    w = {c: float((weights or {}).get(c, 1.0)) for c in SCORES}
    if min(w.values()) < 0:
        raise ValueError("weights are at least 0")
    ordinary, heavy = _split(hits, heavy_queries(hits, share))
    ranked = _ordinary(ordinary, w, trim)
    return ranked if heavy is None else ranked.unionByName(_heavy(heavy, w, trim))


def best_of_each(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, k-th best present value of each score, null where there are fewer): a value is among the k best iff it is not less. Each task passes on at most k values a query and score."""
    long = rows.select("query_id", F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("value")) for c in SCORES])).alias("x")).select("query_id", "x.score", "x.value").where("value is not null")
    top = long.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id", "score").orderBy(F.desc("value")))).where(F.col("_rn") <= k)
    return top.groupBy("query_id").agg(*[F.min(F.when(F.col("score") == c, F.col("value"))).alias(f"t_{c}") for c in SCORES])


def unanimous(hits: DataFrame, k: int = 10, share: float | None = None) -> DataFrame:
    """The hits that every score places among the k best of their query (equal values share the better place).

    The ranking supplies them: a hit is closer than another only if some score places it higher, so a hit with fewer
    than k hits above it in each of the three scores has rank 3 (k - 1) + 1 at most. The hits down to that rank are
    then checked exactly against the k-th best value of each score.
    """
    w = {c: 1.0 for c in SCORES}
    depth = len(SCORES) * (k - 1) + 1
    ordinary, heavy = _split(hits, heavy_queries(hits, share))
    # The partitioning by query still holds after the ranking: the places in each score cost no further shuffle.
    each = _ordinary(ordinary, w, 0.05).select("*", *[F.rank().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(c))).alias(f"r_{c}") for c in SCORES])
    found = each.where(F.col("closeness_rank") <= depth)
    for c in SCORES:
        found = found.where(F.col(c).isNotNull() & (F.col(f"r_{c}") <= k))
    found = found.select(*OUT)
    if heavy is None:
        return found
    ranked = _heavy(heavy, w, 0.05)
    few = _with_figures(ranked.where(F.col("closeness_rank") <= depth), best_of_each(latest_hits(heavy), k))
    for c in SCORES:
        few = few.where(F.col(c).isNotNull() & (F.col(c) >= F.coalesce(F.col(f"t_{c}"), F.col(c))))
    return found.unionByName(few.select(*OUT))
