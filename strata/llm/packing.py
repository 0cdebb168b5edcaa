"""Filling fixed-capacity containers with items (problem 6).

Method: vector bin packing with the dot-product heuristic. An item demands tokens, one segment and loss-bearing
tokens; a container has a limit for each. A container is filled with the fitting item whose demand has the largest
dot product with the room that is left (both as shares of the limits), until nothing fits; then the next is opened.
Items of equal demand are interchangeable and kept as one class, so a step costs the number of classes.

Texts are spread evenly over shards by a hash; each shard is packed by itself. Containers left with more than
``SLACK`` of their tokens unused are opened again and their items packed together in a second round, with as many
containers of the first round as fit a shard.

Defined results: null and blank texts are in no container; a text that alone exceeds the capacity is split, into
pieces that each fill a container and a rest that is packed like any other item; any other text stays whole. A limit
of segments or loss tokens never splits a text: a text beyond the loss limit gets a container of its own. Repeated rows
are packed each; budgets that are null or not positive are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.common import cut
from strata.llm.tokens import VOCABULARY, token_counts

SHARD_ITEMS = 3072  #: items that one call packs, about
SLACK = 0.06
MAX_BUDGETS = 64
TOKENS_PER_SEGMENT = 32  #: default: a container of capacity c takes c / 32 segments, attention masks grow with them
LOSS_SHARE = 0.95  #: default: of a container's capacity at most this share bears loss, the rest is left to prompts

PLACED = "budget_name string, capacity int, container string, doc_id long, piece int, tokens int, loss_tokens int, place int"


def fill(tokens: np.ndarray, loss: np.ndarray, capacity: int, max_segments: int, max_loss: int) -> list[list[int]]:
    """Containers as lists of item indices, by the dot-product heuristic."""
    order = np.lexsort((np.arange(len(tokens)), loss, tokens))
    t, l = tokens[order].astype(np.int64), loss[order].astype(np.int64)
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (l[1:] != l[:-1])
    start = np.flatnonzero(new)
    left = np.diff(np.append(start, len(t)))  # items left of each class
    taken = np.zeros(len(start), np.int64)
    t, l = t[start], l[start]
    # An empty container has the same room each time, so the order in which items open containers is fixed.
    opening = np.argsort(-(t / capacity + l / max_loss), kind="stable")
    at, alive = 0, np.arange(len(start))  # classes with items left, in order of tokens
    out: list[list[int]] = []
    while len(alive):
        while not left[opening[at]]:
            at += 1
        room_t, room_n, room_l, one, c = capacity, max_segments, max_loss, [], int(opening[at])
        open_for = None
        while c >= 0:
            one.append(int(order[start[c] + taken[c]]))
            taken[c] += 1
            left[c] -= 1
            room_t, room_n, room_l = room_t - int(t[c]), room_n - 1, room_l - int(l[c])
            if not left[c]:
                alive = np.delete(alive, np.searchsorted(alive, c))
                if open_for is not None:
                    open_for = np.delete(open_for, np.searchsorted(open_for, c))
            if room_t <= 0 or room_n <= 0 or room_l < 0:
                break
            # Room only shrinks: what does not fit now never fits this container.
            pool = alive if open_for is None else open_for
            pool = pool[: np.searchsorted(t[pool], room_t, side="right")]
            open_for = pool[l[pool] <= room_l]
            # The dot product of demand and room as shares of the limits; the segment's part is the same for all items.
            score = t[open_for] * (room_t / capacity**2) + l[open_for] * (room_l / max_loss**2)
            c = int(open_for[int(score.argmax())]) if len(open_for) else -1
        out.append(one)
    return out


def _pack_shard(round_no: int, tokens_per_segment: int, loss_share: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "loss_tokens", "doc_id", "piece"], ascending=False, kind="stable").reset_index(drop=True)
        capacity = int(pdf["capacity"].iloc[0])
        bins = fill(pdf["tokens"].to_numpy(), pdf["loss_tokens"].to_numpy(), capacity, max(1, capacity // tokens_per_segment), max(1, int(capacity * loss_share)))
        container = np.empty(len(pdf), dtype=object)
        place = np.zeros(len(pdf), np.int32)
        for n, members in enumerate(bins):
            for p, i in enumerate(members):
                container[i] = f"{key[0]}/{round_no}-{key[1]}-{n}"
                place[i] = p
        return pdf.assign(container=container, place=place)[["budget_name", "capacity", "container", "doc_id", "piece", "tokens", "loss_tokens", "place"]]

    return run


def _shards(n_items: int) -> int:
    return max(1, round(n_items / SHARD_ITEMS))


def items(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_name, capacity, doc_id, piece, tokens, loss_tokens): whole texts, or pieces of texts beyond the capacity."""
    caps = budgets.where("budget_name is not null and capacity > 0").groupBy("budget_name").agg(F.max("capacity").alias("capacity"))
    # Budgets are named by the user, at most MAX_BUDGETS; each applies to every text, so a text carries them all.
    named = caps.orderBy("budget_name").limit(MAX_BUDGETS + 1).collect()
    if len(named) > MAX_BUDGETS:
        raise ValueError(f"more than {MAX_BUDGETS} budgets")
    if not named:
        return sizes.limit(0).select(F.lit("").alias("budget_name"), F.lit(1).alias("capacity"), "doc_id", F.lit(0).alias("piece"), "tokens", "loss_tokens")
    each = F.explode(F.array(*[F.struct(F.lit(r["budget_name"]).alias("budget_name"), F.lit(r["capacity"]).alias("capacity")) for r in named]))
    pairs = sizes.withColumn("_b", each).select("_b.*", *sizes.columns)
    piece = F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / F.col("capacity")).cast("int"))).alias("piece")
    cut_up = pairs.select("budget_name", "capacity", "doc_id", F.col("tokens").alias("_t"), F.col("loss_tokens").alias("_l"), piece)
    size = F.least(F.col("capacity"), F.col("_t") - F.col("piece") * F.col("capacity"))
    # Loss-bearing tokens are the last ones of a text.
    loss = F.greatest(F.lit(0), F.least(size, F.col("_l") - F.greatest(F.lit(0), F.col("_t") - F.col("piece") * F.col("capacity") - size)))
    return cut_up.select("budget_name", "capacity", "doc_id", "piece", size.cast("int").alias("tokens"), loss.cast("int").alias("loss_tokens"))


def pack(documents: DataFrame, budgets: DataFrame, vocabulary: str = VOCABULARY, tokens_per_segment: int = TOKENS_PER_SEGMENT, loss_share: float = LOSS_SHARE) -> DataFrame:
    """(budget_name, capacity, container, doc_id, piece, tokens, loss_tokens, place): every item of every budget in exactly one container.

    A container of capacity c takes at most c tokens, c / ``tokens_per_segment`` items and c * ``loss_share`` loss-bearing tokens.
    """
    sizes = cut(token_counts(documents, vocabulary=vocabulary))
    every = items(sizes, budgets)
    full = F.col("tokens") == F.col("capacity")
    filled = every.where(full).select("budget_name", "capacity", F.concat_ws("/", "budget_name", F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string"))).alias("container"), "doc_id", "piece", "tokens", "loss_tokens", F.lit(0).alias("place"))
    rest = every.where(~full)
    n = sizes.count()
    shard: Column = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(_shards(n))).cast("int")
    spread = lambda df, by: df.withColumn("shard", by).groupBy("budget_name", "shard")
    first = cut(spread(rest, shard).applyInPandas(_pack_shard(1, tokens_per_segment, loss_share), PLACED))
    used = first.groupBy("container").agg(F.sum("tokens").alias("used"), F.max("capacity").alias("c"))
    poor = used.where(F.col("used") < (1 - SLACK) * F.col("c")).select("container", F.lit(True).alias("poor"))
    marked = first.join(poor, "container", "left")
    good = marked.where("poor is null").drop("poor")
    again = marked.where("poor").drop("poor", "container", "place")
    # Only the poorly filled containers' items are left; their number sets the shards of the second round.
    left = again.groupBy("budget_name").count().agg(F.max("count")).first()[0] or 0
    shard2 = F.pmod(F.xxhash64("doc_id", "piece", F.lit(2)), F.lit(_shards(left))).cast("int")
    second = spread(again, shard2).applyInPandas(_pack_shard(2, tokens_per_segment, loss_share), PLACED)
    return filled.unionByName(good.select(*filled.columns)).unionByName(second.select(*filled.columns))


def fill_report(packed: DataFrame) -> DataFrame:
    """(budget_name, capacity, containers, items, tokens, filled, least_containers): the share of all room that is used, and the number of containers no packing can go below."""
    per = packed.groupBy("budget_name", "capacity", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = per.groupBy("budget_name", "capacity").agg(F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"))
    return total.withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity"))).withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity")))


def placement_report(packed: DataFrame) -> DataFrame:
    """(budget_name, texts, placed_once, over_full, split_needlessly): what has to hold for every packing. A text is placed once if its pieces are numbered through and each is in one container."""
    texts = packed.groupBy("budget_name", "doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("piece").alias("pieces"), F.max("piece").alias("last"), F.sum("tokens").alias("t"), F.max("capacity").alias("capacity")
    )
    needed = F.ceil(F.col("t") / F.col("capacity"))
    once = (F.col("n") == F.col("pieces")) & (F.col("last") + 1 == F.col("n"))
    by_text = texts.groupBy("budget_name").agg(F.count("*").alias("texts"), F.count(F.when(once, 1)).alias("placed_once"), F.count(F.when(F.col("n") > needed, 1)).alias("split_needlessly"))
    full = packed.groupBy("budget_name", "container").agg(F.sum("tokens").alias("t"), F.max("capacity").alias("c")).groupBy("budget_name").agg(F.count(F.when(F.col("t") > F.col("c"), 1)).alias("over_full"))
    return by_text.join(full, "budget_name").select("budget_name", "texts", "placed_once", "over_full", "split_needlessly")
