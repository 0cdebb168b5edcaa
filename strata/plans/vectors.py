"""Vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.common import cut, table
from strata.functions.vector import cosine_similarity, cosine_to_distance, distance_to_score, l2_distance
from strata.operators import search
from strata.plans.sql import CAT, EMB, QVEC, cos
from strata.sources import corpus


def query_vectors(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    """The stated batch: the vectors of the first ``n`` symbols by id that have a full vector."""
    full = corpus.embeddings(spark, d).where((F.size("vector") == 96) & F.exists("vector", lambda x: x != 0))
    first = full.orderBy("symbol_id").limit(n)
    # Few rows from a scan of all vectors: kept, as their number is checked before they are joined.
    return cut(first.select(F.row_number().over(Window.orderBy("symbol_id")).cast("long").alias("query_id"), "vector"))


def every_fiftieth(spark: SparkSession, d: str) -> DataFrame:
    """The whole asked batch: every full vector whose hashed symbol_id is divisible by 50, named by that id."""
    full = corpus.embeddings(spark, d).where((F.size("vector") == 96) & F.exists("vector", lambda x: x != 0))
    hashed = F.conv(F.substring(F.md5("symbol_id"), 1, 8), 16, 10).cast("long")
    return cut(full.where(hashed % 50 == 0).select(F.col("symbol_id").alias("query_id"), "vector"))


def _round(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), 6))
    return df


def vec_cosine_topk(spark, d):
    hits = search.vector_search(corpus.embeddings(spark, d), query_vectors(spark, d), 10)
    return _round(hits.select("query_id", "symbol_id", F.col("place").cast("long").alias("place"), "score", "distance"), "score", "distance")


def vec_l2_topk(spark, d):
    hits = search.vector_search(corpus.embeddings(spark, d), query_vectors(spark, d), 10, "l2")
    return _round(hits.select("query_id", "symbol_id", F.col("place").cast("long").alias("place"), "score", "distance"), "score", "distance")


def vec_cosine_topk_batch(spark, d):
    hits = search.vector_search(corpus.embeddings(spark, d), every_fiftieth(spark, d), 10)
    return _round(hits.select("query_id", "symbol_id", F.col("place").cast("long").alias("place"), "score", "distance"), "score", "distance")


def vec_l2_topk_batch(spark, d):
    hits = search.vector_search(corpus.embeddings(spark, d), every_fiftieth(spark, d), 10, "l2")
    return _round(hits.select("query_id", "symbol_id", F.col("place").cast("long").alias("place"), "score", "distance"), "score", "distance")


def vec_topk_filtered(spark, d):
    hits = search.vector_search_filtered(corpus.embeddings(spark, d), corpus.catalog(spark, d), query_vectors(spark, d), 10, F.col("exported") & F.col("kind").isin("func", "method"))
    return _round(hits.select("query_id", "symbol_id", F.col("place").cast("long").alias("place"), "score"), "score")


def vec_topk_symbols(spark, d):
    """Details are fetched after the cut; a hit without symbol keeps nulls."""
    hits = search.vector_search(corpus.embeddings(spark, d), query_vectors(spark, d), 10)
    s = corpus.catalog(spark, d).select("id", "name", "kind")
    return hits.join(s, hits["symbol_id"] == s["id"], "left").select("query_id", F.col("place").cast("long").alias("place"), "symbol_id", "name", "kind")


def vec_pairwise_score(spark, d):
    """Consecutive embeddings by id, in both metrics and as scores."""
    e = table(spark, d, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("va")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("vb"))
    p = a.join(b, "vec_id")
    p = p.select("vec_id", cosine_similarity(F.col("va"), F.col("vb")).alias("cosine"), l2_distance(F.col("va"), F.col("vb")).alias("l2"))
    p = p.withColumn("cosine_distance", cosine_to_distance(F.col("cosine"))).withColumn("l2_score", distance_to_score(F.col("l2")))
    return _round(p, "cosine", "l2", "cosine_distance", "l2_score")


def vec_dim_check(spark, d):
    """Stored dimension against the vector's length."""
    v = table(spark, d, "symbol_vectors")
    size = F.when(F.col("vector").isNotNull(), F.size("vector"))
    return v.groupBy("model").agg(F.count("*").alias("n"), F.count(F.when(size.isNull(), 1)).alias("missing"), F.count(F.when(size == 0, 1)).alias("empty"), F.count(F.when(size == F.col("dimension"), 1)).alias("agree"), F.count(F.when(size != F.col("dimension"), 1)).alias("disagree"))


def vec_has_symbol(spark, d):
    """Symbols with and without a usable vector, per kind."""
    s, e = corpus.catalog(spark, d).select("id", "kind"), corpus.embeddings(spark, d).select(F.col("symbol_id").alias("id"))
    has = s.join(e, "id", "left_semi").groupBy("kind").agg(F.count("*").alias("with_vector"))
    return s.groupBy("kind").agg(F.count("*").alias("n")).join(has, "kind", "left").select("kind", "n", F.coalesce("with_vector", F.lit(0)).alias("with_vector"))


QUERIES = {f.__name__: f for f in (vec_cosine_topk, vec_l2_topk, vec_cosine_topk_batch, vec_l2_topk_batch, vec_topk_filtered, vec_topk_symbols, vec_pairwise_score, vec_dim_check, vec_has_symbol)}

_C = cos("e.v", "q.qv")
_L2 = "sqrt(list_sum(list_transform(list_zip(e.v, q.qv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_TOP = f"""WITH {EMB}, {QVEC},
s AS (SELECT query_id, symbol_id, {_C} AS score FROM emb e JOIN qvec q ON len(e.v) = len(q.qv)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, symbol_id) AS place FROM s)"""

#: The same over every fiftieth vector by its hashed id.
_Q50 = """qvec AS (SELECT symbol_id AS query_id, v AS qv FROM emb WHERE len(v) = 96 AND len(list_filter(v, lambda x: x <> 0)) > 0 AND ('0x' || substr(md5(symbol_id), 1, 8))::BIGINT % 50 = 0)"""

ORACLE = {
    "vec_cosine_topk": f"{_TOP} SELECT query_id, symbol_id, place, round(score, 6) AS score, round(1 - score, 6) AS distance FROM r WHERE place <= 10",
    "vec_l2_topk": f"""WITH {EMB}, {QVEC},
s AS (SELECT query_id, symbol_id, {_L2} AS distance FROM emb e JOIN qvec q ON len(e.v) = len(q.qv)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + distance), 9) DESC, symbol_id) AS place FROM s)
SELECT query_id, symbol_id, place, round(1 / (1 + distance), 6) AS score, round(distance, 6) AS distance FROM r WHERE place <= 10""",
    "vec_topk_filtered": f"""{_TOP.replace("WITH ", f"WITH {CAT}, ", 1)},
f AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, symbol_id) AS p FROM r JOIN cat ON cat.id = r.symbol_id WHERE r.place <= 20 AND exported AND kind IN ('func', 'method'))
SELECT query_id, symbol_id, p AS place, round(score, 6) AS score FROM f WHERE p <= 10""",
    "vec_topk_symbols": f"""{_TOP.replace("WITH ", f"WITH {CAT}, ", 1)} SELECT query_id, place, symbol_id, name, kind FROM r LEFT JOIN cat ON cat.id = r.symbol_id WHERE place <= 10""",
    "vec_pairwise_score": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, {cos("a.v", "b.v")} AS c, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS l FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(c, 6) AS cosine, round(l, 6) AS l2, round(1 - c, 6) AS cosine_distance, round(1 / (1 + l), 6) AS l2_score FROM p""",
    "vec_dim_check": """SELECT model, count(*) AS n, count(*) FILTER (WHERE vector IS NULL) AS missing, count(*) FILTER (WHERE len(vector) = 0) AS empty,
count(*) FILTER (WHERE len(vector) = dimension) AS agree, count(*) FILTER (WHERE len(vector) <> dimension) AS disagree FROM symbol_vectors GROUP BY model""",
    "vec_has_symbol": f"WITH {CAT}, {EMB} SELECT kind, count(*) AS n, count(e.symbol_id) AS with_vector FROM cat LEFT JOIN (SELECT DISTINCT symbol_id FROM emb) e ON cat.id = e.symbol_id GROUP BY kind",
}
ORACLE |= {f"{name}_batch": ORACLE[name].replace(QVEC, _Q50) for name in ("vec_cosine_topk", "vec_l2_topk")}
