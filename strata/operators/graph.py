"""Graph operators over typed, weighted edges: degrees, PageRank, neighbourhoods, call resolution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.common import cut
from strata.functions import rules
from strata.operators import skew

DAMPING, ITERATIONS = 0.85, 20  #: fixed values of the ranking


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """(key, in_degree, out_degree, centrality): sums of weights over all edge types, 0 where there are none. Sums combine before the shuffle, so a heavy target is one row per task."""
    inbound = edges.groupBy(F.col("to_id").alias(key)).agg(F.sum("weight").alias("in_degree"))
    outbound = edges.groupBy(F.col("from_id").alias(key)).agg(F.sum("weight").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select(key).distinct().join(inbound, key, "left").join(outbound, key, "left").select(key, zero("in_degree"), zero("out_degree")).withColumn("centrality", F.col("in_degree") + F.col("out_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, key: str = "id", cut_every: int = 5) -> DataFrame:
    """(key, pagerank) over the whole graph of ``edges`` between ``nodes``; no dangling mass is redistributed.

    Contributions are summed per target before they are shuffled; the lineage is cut every few rounds.
    """
    ids = cut(nodes.select(key).distinct())
    n = ids.count()
    inside = edges.select("from_id", "to_id").join(ids.select(F.col(key).alias("from_id")), "from_id", "left_semi").join(ids.select(F.col(key).alias("to_id")), "to_id", "left_semi")
    outdeg = inside.groupBy("from_id").agg(F.count("*").alias("outdeg"))
    links = cut(inside.join(outdeg, "from_id"))
    ranks = ids.withColumn("pagerank", F.lit(1.0 / max(n, 1)))
    for i in range(ITERATIONS):
        sent = links.join(ranks, links["from_id"] == ranks[key]).groupBy("to_id").agg(F.sum(F.col("pagerank") / F.col("outdeg")).alias("got"))
        ranks = ids.join(sent, ids[key] == sent["to_id"], "left").select(ids[key], (F.lit((1 - DAMPING) / max(n, 1)) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("pagerank"))
        if (i + 1) % cut_every == 0:
            ranks = cut(ranks)
    return ranks


def _rank_group(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes, own = np.unique(pdf["symbol_id"].to_numpy(dtype=str), return_inverse=True)
    n, targets = len(nodes), pdf["to_id"].to_numpy(dtype=object)
    linked = np.array([isinstance(t, str) for t in targets], bool)
    to = np.searchsorted(nodes, targets[linked].astype(str)) if linked.any() else np.zeros(0, int)
    here = (to < n) & (nodes[np.minimum(to, n - 1)] == targets[linked].astype(str)) if linked.any() else np.zeros(0, bool)
    f, t = own[linked][here], to[here]
    share = 1.0 / np.maximum(np.bincount(f, minlength=n), 1)
    rank = np.full(n, 1.0 / n)
    for _ in range(ITERATIONS):
        rank = (1 - DAMPING) / n + DAMPING * np.bincount(t, weights=(rank * share)[f], minlength=n)
    return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "symbol_id": nodes.astype(object), "pagerank": rank})


def candidate_pagerank(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, symbol_id, pagerank) on the graph of calls among each query's candidates; a query has at most a few dozen, so one call ranks it."""
    calls = edges.where("edge_type = 'calls'").select("from_id", "to_id")
    # Only edges with both ends among the candidates leave the join.
    src = candidates.select("query_id", "symbol_id")
    dst = candidates.select(F.col("query_id").alias("q2"), F.col("symbol_id").alias("t2"))
    inside = src.join(calls, F.col("symbol_id") == F.col("from_id")).join(dst, (F.col("query_id") == F.col("q2")) & (F.col("to_id") == F.col("t2"))).select("query_id", "symbol_id", "to_id")
    rows = inside.unionByName(src.withColumn("to_id", F.lit(None).cast("string")))
    return rows.groupBy("query_id").applyInPandas(_rank_group, f"query_id {dict(candidates.dtypes)['query_id']}, symbol_id string, pagerank double")


def features(candidates: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Graph features and score of (query_id, symbol_id) candidates."""
    c = candidates.select("query_id", "symbol_id").distinct()
    ids = c.select(F.col("symbol_id").alias("id"))
    near = edges.join(ids.distinct(), edges["to_id"] == F.col("id"), "left_semi").unionByName(edges.join(ids.distinct(), edges["from_id"] == F.col("id"), "left_semi")).distinct()
    d = degrees(ids, near)
    pr = candidate_pagerank(c, edges)
    s = symbols.select("id", "name", "kind", "exported", "package_path", "signature")
    rows = c.join(s, c["symbol_id"] == s["id"]).drop("id").join(pr, ["query_id", "symbol_id"]).join(d, F.col("symbol_id") == d["id"]).drop("id")
    rows = rows.withColumn("layer", rules.layer(F.col("package_path"))).withColumn("is_entry", rules.entry_point(F.col("name"), F.col("kind"), F.col("exported"), F.col("package_path"), F.col("signature"))).withColumn("is_interface", F.col("kind") == "interface")
    return rows.withColumn("graph", rules.graph_score(F.col("pagerank"), F.col("in_degree"), F.col("is_entry"), F.col("is_interface"), F.col("layer")))


def neighbours(ids: DataFrame, edges: DataFrame, symbols: DataFrame, direction: str = "incoming", edge_type: str | None = None) -> DataFrame:
    """Edges at the given ids with both end points' details; edges whose end is missing fall out, each edge once."""
    if direction not in ("incoming", "outgoing", "both"):
        raise ValueError("direction is incoming, outgoing or both")
    if edge_type is not None and edge_type not in rules.EDGE_WEIGHTS:
        raise ValueError(f"edge type is one of {', '.join(rules.EDGE_WEIGHTS)}")
    e = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    want = ids.select("id").distinct()
    parts = {"incoming": [("to_id",)], "outgoing": [("from_id",)], "both": [("to_id",), ("from_id",)]}[direction]
    found = None
    for (end,) in parts:
        this = e.join(want, e[end] == want["id"], "left_semi")
        found = this if found is None else found.unionByName(this)
    found = found.dropDuplicates(["from_id", "to_id", "edge_type"])
    ends = symbols.select("id", "name", "kind")
    f = ends.select(F.col("id").alias("from_id"), F.col("name").alias("from_name"), F.col("kind").alias("from_kind"))
    t = ends.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"), F.col("kind").alias("to_kind"))
    # A given id with very many edges: those meet its details without a shuffle.
    if direction != "outgoing":
        found = cut(found)
        named = skew.spread_join(found, t, "to_id").join(f, "from_id")
    else:
        named = found.join(f, "from_id").join(t, "to_id")
    return named.select("edge_type", "from_id", "from_name", "from_kind", "to_id", "to_name", "to_kind", "weight")


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes within ``hops`` undirected steps of the seeds, each at its nearest hop."""
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b")))
    seen = frontier = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        nxt = both.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = cut(nxt.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(frontier)
    return seen


def adjacency(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(id, targets): of every node that a walk of ``hops`` undirected steps from the seeds expands and that has an edge, its outgoing neighbours in order, each once per edge type; empty for nodes with incoming edges only."""
    expanded = k_hop(seeds, edges, hops - 1).select("id") if hops > 0 else seeds.select("id").limit(0)
    out = edges.join(expanded, F.col("from_id") == F.col("id"), "left_semi").groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_list("to_id")).alias("targets"))
    known = edges.join(expanded, F.col("to_id") == F.col("id"), "left_semi").select(F.col("to_id").alias("id")).distinct()
    return out.join(known, "id", "full_outer").select("id", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def common_callers(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, caller_id, n): the source with most edges into a query's hits, itself excluded, ties by id."""
    e = hits.select("query_id", "symbol_id").join(edges.where("from_id <> to_id"), F.col("symbol_id") == F.col("to_id")).groupBy("query_id", "from_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "from_id")
    return e.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("query_id", F.col("from_id").alias("caller_id"), "n")


def enclosing(points: DataFrame, spans: DataFrame, bin_lines: int = 64) -> DataFrame:
    """(file, line, id): the innermost span of ``spans`` (file, line_start, line_end, id) around each of ``points`` (file, line).

    A range join as an equi-join: a span stands in every bin of lines it touches, a point in its own.
    """
    s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("line_start") / bin_lines), F.floor(F.col("line_end") / bin_lines))))
    p = points.select("file", "line").distinct().withColumn("_bin", F.floor(F.col("line") / bin_lines))
    met = p.join(s, ["file", "_bin"]).where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    return met.groupBy("file", "line").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("size"), "id")).alias("m")).select("file", "line", F.col("m.id").alias("id"))


def resolve(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """``references`` (package_path, kind, name) with ``target_id``: the exact symbol, else its package's symbol, else null."""
    ids = symbols.select("id")
    exact = F.concat_ws(":", "package_path", "kind", "name")
    r = references.withColumn("_exact", exact).withColumn("_pkg", F.concat(F.lit("pkg:"), F.col("package_path")))
    a, b = ids.select(F.col("id").alias("_exact"), F.lit(True).alias("_e")), ids.select(F.col("id").alias("_pkg"), F.lit(True).alias("_p"))
    return r.join(a, "_exact", "left").join(b, "_pkg", "left").withColumn("target_id", F.when(F.col("_e"), F.col("_exact")).when(F.col("_p"), F.col("_pkg"))).drop("_exact", "_pkg", "_e", "_p")


def implementations(type_methods: DataFrame, interface_methods: DataFrame) -> DataFrame:
    """(type_id, interface_id) where the type's methods (owner, method) contain all of the interface's. Interfaces without methods are left out.

    Candidates are the types with an interface's rarest method, so methods that most types have pair nothing up.
    """
    t = type_methods.select(F.col("owner").alias("type_id"), "method").distinct()
    i = interface_methods.select(F.col("owner").alias("interface_id"), "method").distinct()
    owners = t.groupBy("method").agg(F.count("*").alias("n"))
    rarest = i.join(owners, "method", "left").groupBy("interface_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "method"))["method"].alias("method"), F.count("*").alias("need"))
    candidates = t.join(rarest, "method").select("type_id", "interface_id", "need")
    have = candidates.join(i, "interface_id").join(t, ["type_id", "method"]).groupBy("type_id", "interface_id", "need").agg(F.count("*").alias("have"))
    return have.where("have = need").select("type_id", "interface_id")
