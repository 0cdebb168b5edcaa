"""Vector search and hybrid fusion for batches of queries.

A batch is a table (query_id, vector, ...) of queries and meets every row, in one pass: a small one is broadcast, a
larger one, of any size, is spread in blocks that meet blocks of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructType

from strata.common import parallelism
from strata.functions import rules
from strata.functions.vector import cosine_similarity, distance_to_score, l2_distance, usable

MAX_BATCH = 10_000  #: queries of one batch of texts, which the driver embeds
SMALL_BATCH = 8  #: vectors of a batch that is broadcast and scored row by row; larger ones meet the rows in blocks
BLOCK, SLICE = 4096, 256  #: vectors of a block; queries scored at a time


def checked_batch(queries: DataFrame) -> DataFrame:
    """The batch marked for broadcast, once its size is known to be small."""
    if queries.limit(MAX_BATCH + 1).count() > MAX_BATCH:
        raise ValueError(f"more than {MAX_BATCH} queries in one batch")
    return F.broadcast(queries)


def _larger(queries: DataFrame, n: int) -> bool:
    return queries.limit(n + 1).count() > n


def _pairs(embeddings: DataFrame, queries: DataFrame, metric: str, small: bool) -> DataFrame:
    q = queries.select("query_id", F.col("vector").alias("query_vector"))
    e = embeddings.select("symbol_id", "vector")
    same = F.size("vector") == F.size("query_vector")
    if small:
        pairs = e.join(F.broadcast(q), same)
    else:  # vectors spread by salts that every query visits, as all of them may have one length
        salts = parallelism(embeddings.sparkSession)
        e = e.withColumn("salt", F.pmod(F.xxhash64("symbol_id"), F.lit(salts)))
        q = q.withColumn("q_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pairs = e.join(q, same & (F.col("salt") == F.col("q_salt")))
    if metric == "cosine":
        score = cosine_similarity(F.col("vector"), F.col("query_vector"))
        return pairs.select("query_id", "symbol_id", score.alias("score")).withColumn("distance", 1 - F.col("score"))
    distance = l2_distance(F.col("vector"), F.col("query_vector"))
    return pairs.select("query_id", "symbol_id", distance.alias("distance")).withColumn("score", distance_to_score(F.col("distance")))


def score_all(embeddings: DataFrame, queries: DataFrame, metric: str = "cosine") -> DataFrame:
    """(query_id, symbol_id, score, distance) of every vector of the query's length; others are skipped."""
    return _pairs(embeddings, queries, metric, not _larger(queries, MAX_BATCH))


def _packer(batches):
    """mapInArrow function: rows of (id, vector) to blocks (dim, ids, block) of vectors of one length, as doubles."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            lengths = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                rows = part.filter(pa.array(lengths == dim))
                x = rows.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), ids, pa.array([x.tobytes()], pa.binary())], names=["dim", "ids", "block"])


def _bounds(q: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of all pairs, from one matrix product; they cover its rounding."""
    dots, slack = q @ x.T, 4 * (q.shape[1] + 4) * np.finfo(np.float64).eps
    qq, xx = np.einsum("ij,ij->i", q, q)[:, None], np.einsum("ij,ij->i", x, x)[None, :]
    if metric == "cosine":
        norm = np.sqrt(qq * xx)
        c = np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0)
        return c - slack, c + slack
    d2, e = qq + xx - 2 * dots, slack * (qq + xx)
    return 1 / (1 + np.sqrt(np.maximum(d2 + e, 0))), 1 / (1 + np.sqrt(np.maximum(d2 - e, 0)))


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Score and distance of the pairs (q[i], x[i])."""
    if metric == "cosine":
        norm = np.sqrt(np.einsum("ij,ij->i", q, q) * np.einsum("ij,ij->i", x, x))
        score = np.divide(np.einsum("ij,ij->i", q, x), norm, out=np.zeros(len(q)), where=norm > 0)
        return score, 1 - score
    distance = np.sqrt(np.einsum("ij,ij->i", q - x, q - x))
    return 1 / (1 + distance), distance


def _best(k: int, metric: str, digits: int, query_type: pa.DataType, symbol_type: pa.DataType):
    """mapInArrow function: rows of (qids, qblock, ids, block, dim) to all hits of a block that can be among a query's k best.

    Hits that equal the k-th best at ``digits`` stay; of hits of one score the k with the smallest ids are enough.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qids, qblock, ids, block, dim = (batch.column(c)[i].as_py() for c in range(5))
                order = sorted(range(len(ids)), key=ids.__getitem__)
                ids = [ids[j] for j in order]
                x, q = np.frombuffer(block).reshape(-1, dim)[order], np.frombuffer(qblock).reshape(-1, dim)
                n = len(x) - min(k, len(x))
                for at in range(0, len(q), SLICE):
                    part = q[at : at + SLICE]
                    low, high = _bounds(part, x, metric)
                    rows, cols = np.nonzero(high >= np.partition(low, n, axis=1)[:, n, None] - 1.01 * 10.0**-digits)
                    found = [_scores(part[rows[s : s + 16384]], x[cols[s : s + 16384]], metric) for s in range(0, len(rows), 16384)]
                    score, distance = (np.concatenate(y) for y in zip(*found))
                    line = np.lexsort((cols, -score, rows))
                    rows, cols, score, distance = rows[line], cols[line], score[line], distance[line]
                    new = np.r_[True, (rows[1:] != rows[:-1]) | (score[1:] != score[:-1])]
                    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
                    few = place < k
                    out = [pa.array([qids[at + j] for j in rows[few]], query_type), pa.array([ids[j] for j in cols[few]], symbol_type), pa.array(score[few]), pa.array(distance[few])]
                    yield pa.RecordBatch.from_arrays(out, names=["query_id", "symbol_id", "score", "distance"])

    return run


def block_hits(embeddings: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", digits: int = 9) -> DataFrame:
    """(query_id, symbol_id, score, distance): of ``score_all`` those hits that ``top`` can keep, for a batch of any size. Neither side is gathered or broadcast; rows without a usable vector are skipped."""
    salts = parallelism(embeddings.sparkSession)
    query_type, symbol_type = queries.schema["query_id"].dataType, embeddings.schema["symbol_id"].dataType

    def packed(df, key, of):
        schema = StructType().add("dim", IntegerType()).add("ids", ArrayType(of)).add("block", BinaryType())
        return df.where(usable(F.col("vector"))).select(key, F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_packer, schema)

    data = packed(embeddings.where("symbol_id is not null"), "symbol_id", symbol_type).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
    asked = packed(queries, "query_id", query_type).select("dim", F.col("ids").alias("qids"), F.col("block").alias("qblock"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("salt"))
    met = data.join(asked.hint("shuffle_merge"), ["dim", "salt"]).select("qids", "qblock", "ids", "block", "dim")
    hit = StructType().add("query_id", query_type).add("symbol_id", symbol_type).add("score", DoubleType()).add("distance", DoubleType())
    return met.mapInArrow(_best(k, metric, digits, to_arrow_type(query_type), to_arrow_type(symbol_type)), hit)


def top(hits: DataFrame, k: int, by: str = "score", key: str = "symbol_id", digits: int = 9) -> DataFrame:
    """The k best hits of each query with their ``place``, ties (at ``digits``) by ``key``; tasks pass on at most k rows a query."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col(by), digits)), key)
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def vector_search(embeddings: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k best vectors of each query, for a batch of any size."""
    large = _larger(queries, SMALL_BATCH)
    return top(block_hits(embeddings, queries, k, metric) if large else _pairs(embeddings, queries, metric, True), k)


def vector_search_filtered(embeddings: DataFrame, symbols: DataFrame, queries: DataFrame, k: int, condition: Column) -> DataFrame:
    """Over-fetches 2k, then filters on the symbol, then stops at k: may give fewer than k. Hits without symbol fall out."""
    twice = vector_search(embeddings, queries, 2 * k).drop("place")
    return top(twice.join(symbols, twice["symbol_id"] == symbols["id"]).where(condition).select("query_id", "symbol_id", "score", "distance"), k)


@dataclass(frozen=True)
class Options:
    """Options of a hybrid search; weights in [0, 1]."""

    k: int = 10
    vector_weight: float = 0.6
    keyword_weight: float = 0.2
    graph_weight: float = 0.2
    exported_only: bool = True
    kinds: tuple[str, ...] = ()
    layers: tuple[str, ...] = ()
    package: str | None = None
    rank_by_graph: bool = True
    prefilter: bool = False  #: filter before the arms' cut instead of after it

    def __post_init__(self):
        for w in (self.vector_weight, self.keyword_weight, self.graph_weight):
            if not 0 <= w <= 1:
                raise ValueError("weights lie between 0 and 1")

    def normalised(self) -> Options:
        """Vector and keyword weights brought to sum 1; if both are 0 only vectors count."""
        total = self.vector_weight + self.keyword_weight
        return replace(self, vector_weight=self.vector_weight / total if total else 1.0, keyword_weight=self.keyword_weight / total if total else 0.0)

    def condition(self) -> Column:
        out = F.lit(True)
        if self.exported_only:
            out = out & F.col("exported")
        if self.kinds:
            out = out & F.col("kind").isin(*self.kinds)
        if self.package:
            out = out & (F.col("package_path") == self.package)
        if self.layers:
            out = out & rules.layer(F.col("package_path")).isin(*self.layers)
        return out


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """(query_id, symbol_id, vector, keyword): both arms by symbol, a missing side scores 0."""
    v = vector_hits.select("query_id", "symbol_id", F.col("score").alias("vector"))
    k = keyword_hits.select("query_id", "symbol_id", "keyword")
    return v.join(k, ["query_id", "symbol_id"], "full_outer").select("query_id", "symbol_id", F.coalesce("vector", F.lit(0.0)).alias("vector"), F.coalesce("keyword", F.lit(0.0)).alias("keyword"))


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, symbols: DataFrame, options: Options) -> DataFrame:
    """Fused, filtered hits with their base score; hits without symbol fall out. Symbols are fetched after both arms are cut."""
    o = options.normalised()
    fused = fuse(vector_hits, keyword_hits)
    details = symbols.select(F.col("id").alias("symbol_id"), "name", "kind", "package_path", "signature", "file_path", "line_start", "line_end", "exported", "semantic_text")
    rows = fused.join(details, "symbol_id").where(o.condition())
    return rows.withColumn("base", o.vector_weight * F.col("vector") + o.keyword_weight * F.col("keyword")).withColumn("reasons", rules.hybrid_reasons(F.col("vector"), F.col("keyword"), F.col("exported"), F.col("kind")))


def blend(hits: DataFrame, features: DataFrame | None, options: Options, intents: DataFrame | None = None) -> DataFrame:
    """Combined score and final order: combined, then the intent's score, then the id."""
    rows = hits
    if features is not None:
        f = features.select("query_id", "symbol_id", "pagerank", "in_degree", "out_degree", "layer", "is_entry", "graph")
        rows = rows.join(f, ["query_id", "symbol_id"], "left").withColumn("combined", F.col("base") * (1 - options.graph_weight) + F.coalesce("graph", F.lit(0.0)) * options.graph_weight)
        more = rules.graph_reasons(F.col("pagerank"), F.col("in_degree"), F.col("is_entry"), F.col("kind") == "interface", F.col("layer"))
        rows = rows.withColumn("reasons", rules.merge_reasons(F.col("reasons"), more))
    else:
        rows = rows.withColumn("combined", F.col("base")).withColumn("layer", rules.layer(F.col("package_path")))
    if intents is not None:
        rows = rows.join(F.broadcast(intents.select("query_id", "intent")), "query_id", "left").withColumn("intent_score", rules.intent_score(F.col("intent"), F.col("layer"), F.col("kind")))
    else:
        rows = rows.withColumn("intent_score", F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("combined", 9)), F.desc("intent_score"), "symbol_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= options.k)
