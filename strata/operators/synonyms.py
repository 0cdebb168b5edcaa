"""Synonym groups: matching, expansion of match expressions and of texts to embed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.text import normalize_term, quote_term

MAX_GROUPS = 10_000  #: groups of one dictionary; they are broadcast


def groups(spark: SparkSession, entries: Mapping[str, Sequence[str]]) -> DataFrame:
    """(canonical, seq, term, norm): the terms of each group, trimmed, blanks dropped, one per normalised form (first spelling wins), canonical first."""
    if len(entries) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} synonym groups")
    rows = [(c, n, t) for c, aliases in entries.items() for n, t in enumerate([c, *aliases]) if t is not None]
    df = spark.createDataFrame(rows, "canonical string, seq int, term string").withColumn("term", F.trim("term")).withColumn("norm", normalize_term(F.col("term"))).where("norm <> ''")
    w = Window.partitionBy("canonical", "norm").orderBy("seq")
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def matched(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, canonical) of the groups of which the normalised query text contains a term."""
    q = queries.select("query_id", normalize_term(F.col("text")).alias("_q"))
    return q.join(F.broadcast(terms), F.col("_q").contains(F.col("norm"))).select("query_id", "canonical").distinct()


def expand(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, text, keyword_text, vector_text): matched groups as ``(a OR "b c") AND (d)`` in place of the text, and the text followed by all their terms, groups in order of their canonical form. Unmatched queries keep their text."""
    hit = matched(queries, terms).join(F.broadcast(terms), "canonical")
    per_group = hit.groupBy("query_id", "canonical").agg(F.array_sort(F.collect_list(F.struct("seq", "term", "norm"))).alias("t"))
    clause = F.concat(F.lit("("), F.array_join(F.transform("t", lambda x: quote_term(x["term"])), " OR "), F.lit(")"))
    per_query = per_group.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("canonical", clause.alias("clause"), F.transform("t", lambda x: F.struct(x["norm"].alias("norm"), x["term"].alias("term"))).alias("terms")))).alias("g"))
    flat = F.flatten(F.transform("g", lambda x: x["terms"]))
    # One spelling per normalised form over all groups, the first.
    unique = F.aggregate(flat, F.array().cast("array<struct<norm:string,term:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["norm"] == x["norm"]), acc).otherwise(F.concat(acc, F.array(x))))
    out = per_query.select("query_id", F.array_join(F.transform("g", lambda x: x["clause"]), " AND ").alias("_k"), F.array_join(F.transform(unique, lambda x: x["term"]), " ").alias("_v"))
    joined = queries.select("query_id", "text").join(out, "query_id", "left")
    return joined.select("query_id", "text", F.coalesce("_k", "text").alias("keyword_text"), F.when(F.col("_v").isNotNull(), F.concat_ws(" ", "text", "_v")).otherwise(F.col("text")).alias("vector_text"))


def load_yaml(path: str) -> dict[str, list[str]]:
    """Groups of a synonyms file: canonical names with a list of aliases each; a missing file gives none. Reads the plain subset (mapping of lists, inline or by dashes)."""
    import os
    import re

    if not os.path.exists(path):
        return {}
    out: dict[str, list[str]] = {}
    current = None
    clean = lambda s: s.strip().strip("\"'")
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = re.sub(r"(^|\s)#.*$", "", line.rstrip("\n"))
            if not line.strip():
                continue
            if m := re.match(r"\s*-\s+(.*)$", line):
                if current is not None:
                    out[current].append(clean(m[1]))
            elif m := re.match(r"\s*([^:]+):\s*(\[(.*)\])?\s*$", line):
                name = clean(m[1])
                if m[2] is None and name in ("synonyms", "groups"):
                    continue
                current = name
                out[current] = [clean(x) for x in m[3].split(",") if x.strip()] if m[2] else []
    return out
