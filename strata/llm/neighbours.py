"""Most similar vectors for every vector (problem 1).

Method: collision-counting hashing. A vector has a place in each of ARRAYS single-projection arrays, in steps of the
finest radius. Around each vector (the query) a window of the same radius is laid in every array; another vector
collides with it in an array if it lies inside. Virtual rehashing expands the radius (RADII steps); vectors that
collide in at least as many arrays as the threshold of a radius are verified by their exact cosine. Queries that have
their k best within a radius are not expanded further. Radii and thresholds follow from ``min_cosine`` alone.

Windows in the arrays are not read off one after the other, since at cosine 0.85 distances differ by a factor of 2.4
only, and a window wide enough for such a pair holds a third of all rows: counting them one by one would cost more than
comparing all pairs. So only rows that share a cell are counted: each vector lies in the cells of all pairs among the
``windows`` sorted arrays in whose sparse ends it stands farthest out. The number of these arrays grows with the square
root of the rows, so that cells stay small, and ``windows`` grows as slowly as a simulation of pairs of ``min_cosine``
asks for, to keep the share of them that meet at RECALL or above at every size. ``search`` has no index and is exact.

A cell that holds very many rows (near-copies) is taken out: its rows are compared exactly in blocks that are spread
over tasks, and each block passes on the k best of each row only. Cells with a known share are seen in the fitted
sample, others when they are met; known ones that share rows are compared as one.

The centre and the known heavy cells are fitted on a sample of at most FIT_ROWS vectors; every vector is indexed.

Defined results: per symbol the row with the latest created_at counts (null is oldest; ties by content); it is unusable,
and the symbol falls out, if its vector is null, not of ``dim`` values, has a null, NaN or infinite value or is all
zero, or if its model is null. ``dimension`` and other columns are ignored. Exact copies are searched once and get
their neighbours by membership, so a vector repeated very often is no hot spot. Ties: smaller symbol_id first.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.common import cut, parallelism

ARRAYS = 48  #: arrays in which collisions are counted
RADII = (1, 2, 4)  #: window radii in steps, smallest first
LEVELS = 16  #: steps of an array, 4 bits each
WIDTH = 1.8  #: widest radius as a multiple of the distance at ``min_cosine``; there the counts of wanted and other pairs differ most
MISSED = 0.01  #: share of pairs at a radius's distance that its threshold may miss
RECALL = 0.95  #: share of pairs of ``min_cosine`` that have to share a cell
GROUP = 40  #: rows expected in a cell
MIN_CELL_ARRAYS = 48
MAX_WINDOWS = 24
FIT_ROWS = 8192
HOT_CELL = 4096  #: rows of a cell beyond which it is compared in blocks
HOT_SEEN = 16  #: rows of the fitted sample in a cell, from which on its share is known
BLOCK = 2048
MAX_MEAN = 0.3  #: squared length of the mean beyond which vectors are not centred
SEED = 20240229


def _usable(dim: int):
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("vector", lambda x: x != 0)
    return F.col("model").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") == dim) & finite & some


def usable_vectors(vectors: DataFrame, dim: int = 96) -> DataFrame:
    """(id, symbol_id, model, vector): the row that counts of every symbol with a usable vector; id is a hash of symbol_id, by which the rows are partitioned."""
    rows = vectors.where("symbol_id is not null").select(F.xxhash64("symbol_id").alias("id"), "symbol_id", "model", F.col("vector").cast("array<float>").alias("vector"), "created_at")
    latest = Window.partitionBy("id", "symbol_id").orderBy(F.desc_nulls_last("created_at"), F.desc_nulls_last("model"), F.desc_nulls_last(F.xxhash64("vector")))
    one = rows.repartition("id").withColumn("_rn", F.row_number().over(latest)).where("_rn = 1")
    return one.where(_usable(dim)).select("id", "symbol_id", "model", "vector")


def points_and_members(vectors: DataFrame, dim: int = 96) -> tuple[DataFrame, DataFrame]:
    """The rows as points (id, model, vector), id a hash of model and vector, and (id, symbol_id) of the symbols with a usable vector.

    Exact copies are one point. Points of rows that no longer count are among them and have no symbols. Members need no
    vectors to be shuffled.
    """
    rows = vectors.where("symbol_id is not null").select("symbol_id", "model", F.col("vector").cast("array<float>").alias("vector"), "created_at")
    rows = rows.withColumn("id", F.xxhash64("model", "vector")).withColumn("good", _usable(dim))
    latest = F.max(F.struct("created_at", "model", F.xxhash64("vector").alias("h"), "id", "good")).alias("l")
    members = rows.groupBy("symbol_id").agg(latest).where("l.good").select("l.id", "symbol_id")
    return rows.where("good").select("id", "model", "vector"), members


def _verifier(least: float, dim: int):
    """mapInArrow function: rows of (a, b, va, vb) to (a, b, cosine), exact in double precision, where the cosine is at least ``least``."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64) for i in (2, 3))
            x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
            c = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            good = pa.array(c >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(c[c >= least])], names=["a", "b", "cosine"])

    return run


def distance_at(cosine: float) -> float:
    """Distance of two unit vectors."""
    return math.sqrt(max(2 - 2 * cosine, 1e-6))


def step_for(min_cosine: float) -> float:
    """Width of a step: the widest radius is WIDTH times the distance at ``min_cosine``."""
    return WIDTH * distance_at(min_cosine) / RADII[-1]


def places(z: np.ndarray, step: float) -> np.ndarray:
    """Steps (0 to LEVELS - 1) of projections in their arrays; what lies outside stands in the last step."""
    return np.clip(np.floor(z / step) + LEVELS // 2, 0, LEVELS - 1).astype(np.int8)


@functools.cache
def thresholds(min_cosine: float, arrays: int = ARRAYS, pairs: int = 20_000) -> tuple[int, ...]:
    """For each radius, the collisions that all but MISSED of the pairs have whose distance is in proportion to it (the widest: pairs of ``min_cosine``). By simulation, as projections of any pair are normal with its distance."""
    rng = np.random.default_rng(SEED + 2)
    out = []
    for radius in RADII:
        d = distance_at(min_cosine) * radius / RADII[-1]
        x = rng.standard_normal((pairs, arrays))
        y = (1 - d * d / 2) * x + math.sqrt(max(0.0, 1 - (1 - d * d / 2) ** 2)) * rng.standard_normal((pairs, arrays))
        step = step_for(min_cosine)
        met = (np.abs(places(x, step) - places(y, step)) <= radius).sum(axis=1)
        out.append(int(np.sort(met)[int(MISSED * pairs)]))
    return tuple(out)


def cell_arrays(n: int, windows: int) -> int:
    """Number of arrays whose ends make cells for ``n`` rows: two ends each, ``windows`` ends per row, GROUP rows per pair of ends."""
    return max(MIN_CELL_ARRAYS, math.ceil(windows / 2 * math.sqrt(max(n, 1) / GROUP)))


@functools.cache
def shared_cells(arrays: int, cosine: float, pairs: int = 800) -> tuple[float, ...]:
    """For 0, 1, 2, ... windows, the share of pairs of this cosine that share at least two ends, hence a cell; by simulation."""
    rng = np.random.default_rng(SEED + 3)
    most = min(MAX_WINDOWS, arrays - 1)
    met = np.zeros(most + 1)
    for _ in range(0, pairs, 100):
        x = rng.standard_normal((100, arrays), dtype=np.float32)
        y = cosine * x + math.sqrt(1 - cosine * cosine) * rng.standard_normal((100, arrays), dtype=np.float32)
        place = [np.argsort(np.argsort(-np.abs(z), axis=1), axis=1) for z in (x, y)]
        later = np.where(np.sign(x) == np.sign(y), np.maximum(*place), arrays)  # windows from which on both have this end
        second = np.partition(later, 1, axis=1)[:, 1]
        for w in range(most + 1):
            met[w] += (second < w).sum()
    return tuple(met / pairs)


@functools.cache
def windows_for(n: int, min_cosine: float) -> int:
    """The fewest windows with which RECALL of the pairs of ``min_cosine`` share a cell among ``n`` rows."""
    w = 2
    while w < MAX_WINDOWS and shared_cells(min(_rounded(cell_arrays(n, w)), 20_000), min_cosine)[w] < RECALL:
        w += 1
    return w


def _rounded(arrays: int) -> int:
    """Up to a quarter more, so that few simulations serve all sizes."""
    power = 2.0 ** math.floor(math.log2(arrays))
    return int(next(power * f for f in (1, 1.25, 1.5, 1.75, 2) if power * f >= arrays))


def _unit(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("vector"))
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """What is fitted: centre and spread of the cells' arrays, and the heavy cells that the sample shows, each with its group."""

    def __init__(self, n: int, dim: int, min_cosine: float, windows: int | None = None, hot_cell: int = HOT_CELL):
        self.n, self.dim, self.step, self.hot_cell = n, dim, step_for(min_cosine), hot_cell
        self.windows = windows or windows_for(n, min_cosine)
        self.arrays = cell_arrays(n, self.windows)
        self.mean, self.spread, self.hot = np.zeros(dim, np.float32), np.ones(self.arrays, np.float32), {}

    def fit(self, vectors: DataFrame) -> Index:
        every = max(1, self.n // (FIT_ROWS // 2))
        good = F.col("vector").isNotNull() & (F.size("vector") == self.dim) & F.col("model").isNotNull() & (F.pmod(F.xxhash64("symbol_id", F.lit(1)), F.lit(every)) == 0)
        sample = vectors.where(good).select(F.hash("model").alias("model32"), F.col("vector").cast("array<float>").alias("vector")).limit(FIT_ROWS).toArrow()
        rows = [(m, np.array(v, dtype=np.float64)) for m, v in zip(sample.column("model32").to_pylist(), sample.column("vector").to_pylist()) if None not in v]
        rows = [(m, v / np.linalg.norm(v)) for m, v in rows if np.isfinite(v).all() and v.any()]
        if not rows:
            return self
        rows = list({(m, v.tobytes()): (m, v) for m, v in rows}.values())  # exact copies are indexed once
        x = np.array([v for _, v in rows], dtype=np.float32)
        mean = x.mean(axis=0)
        if mean @ mean <= MAX_MEAN:  # if all vectors point one way: without their mean, similar ones would be far apart
            self.mean = mean
        spread = ((x - self.mean) @ _projections(self.dim, self.arrays)).std(axis=0)
        spread[~(spread > 1e-6)] = 1.0
        self.spread = spread.astype(np.float32)
        cells = self.cells(x, np.array([m for m, _ in rows], np.int64))
        seen = {c: k for c, k in Counter(cells.ravel().tolist()).items() if k >= HOT_SEEN and k * self.n / len(rows) >= self.hot_cell}
        self.hot = _merged(seen, [[c for c in row if c in seen] for row in cells.tolist()])
        return self

    def cells(self, x: np.ndarray, model: np.ndarray) -> np.ndarray:
        """The cells of unit vectors: a row of as many keys as there are pairs of windows."""
        pairs = list(combinations(range(self.windows), 2))
        a = _projections(self.dim, self.arrays) / self.spread
        keys = np.empty((len(x), len(pairs)), np.int64)
        for at in range(0, len(x), 4096):
            z = (x[at : at + 4096] - self.mean) @ a
            far = np.argpartition(-np.abs(z), self.windows, axis=1)[:, : self.windows]
            ends = np.sort(far * 2 + (np.take_along_axis(z, far, 1) > 0), axis=1).astype(np.int64)
            for k, (i, j) in enumerate(pairs):
                keys[at : at + 4096, k] = ends[:, i] * (2 * self.arrays) + ends[:, j]
        return keys ^ (model[:, None] << 32)


def _merged(seen: dict[int, int], rows: list[list[int]]) -> dict[int, int]:
    """For each heavy cell the group in which its rows are compared. The cells of one crowd of vectors hold much the same rows: cells that share rows become one group where comparing that once costs less than comparing each cell."""
    parent = {c: c for c in seen}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    for row in rows:
        for c in row[1:]:
            parent[root(c)] = root(row[0])
    together = Counter(root(row[0]) for row in rows if row)
    apart = Counter()
    for c, k in seen.items():
        apart[root(c)] += k * k
    return {c: root(c) if together[root(c)] ** 2 <= apart[root(c)] else c for c in seen}


def _projections(dim: int, arrays: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, arrays), dtype=np.float32)


def _hasher(index: Index):
    """mapInArrow function: rows of (id, model32, vector) to (id, keys, code, hot): the cells, the places in the counted arrays (4 bits each), and the groups of the known heavy cells, which are left out of the keys."""

    def run(batches):
        counted = np.random.default_rng(SEED + 1).standard_normal((index.dim, ARRAYS), dtype=np.float32)
        heavy = np.array(sorted(index.hot), dtype=np.int64)
        groups = np.array([index.hot[c] for c in heavy.tolist()], dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(np.sort(np.unique(batch.column(0).to_numpy(), return_index=True)[1])))  # exact copies
            x = _unit(batch, index.dim)
            keys = index.cells(x, batch.column(1).to_numpy().astype(np.int64))
            spots = places((x - index.mean) @ counted, index.step).astype(np.uint8)
            code = np.ascontiguousarray(spots[:, ::2] << 4 | spots[:, 1::2])
            light, of, hot = np.ones(keys.shape, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)
                light = heavy[at] != keys
                row, cell = np.nonzero(~light)
                of, hot = np.unique(np.stack([row, groups[at[row, cell]]]), axis=1)
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, count.cumsum()].astype(np.int32)), pa.array(values)) for count, values in ((light.sum(axis=1), keys[light]), (np.bincount(of, minlength=len(x)), hot))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists[0], pa.array([r.tobytes() for r in code], pa.binary()), lists[1]],
                names=["id", "keys", "code", "hot"],
            )

    return run


def _counter(limits: tuple[int, ...], hot_cell: int):
    """mapInArrow function over rows sorted by key and id: (a, b, radius) of the pairs of each cell whose collisions reach the threshold of a radius (the least such); (id, key, 0) of the rows of a cell beyond ``hot_cell`` rows.

    Rows o places apart are compared as whole columns, for o = 1, 2, ... until no cell has so many rows. A cell's rows
    may spread over batches; only the last, unfinished cell is carried along, and no more than ``hot_cell`` rows of it.
    """

    def pairs(key, ident, spots):
        left = np.arange(len(key) - 1)
        for o in range(1, len(key)):
            left = left[left < len(key) - o]
            left = left[key[left] == key[left + o]]
            if not len(left):
                return
            for at in range(0, len(left), 65536):
                i = left[at : at + 65536]
                apart = np.abs(spots[i] - spots[i + o])
                some = (apart <= RADII[-1]).view(np.uint64).sum(axis=1)  # eight arrays at a time: their counts stand side by side
                wide = some.view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.uint8) >= limits[-1]
                i, apart = i[wide], apart[wide]
                radius = np.full(len(i), RADII[-1])
                for r, least in list(zip(RADII, limits))[-2::-1]:
                    radius[(apart <= r).sum(axis=1, dtype=np.uint8) >= least] = r
                a, b = ident[i], ident[i + o]
                yield batch_of(np.minimum(a, b), np.maximum(a, b), radius)

    def batch_of(a, b, radius):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(radius.astype(np.int32))], names=["a", "b", "radius"])

    def run(batches):
        kept, hot = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            spots = np.stack([code >> 4, code & 15], axis=2).reshape(batch.num_rows, -1).astype(np.int8)
            columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), spots]
            if kept is not None:
                columns = [np.concatenate(x) for x in zip(kept, columns)]
            new = np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])]
            columns = [c[new] for c in columns]  # exact copies from other batches
            key = columns[0]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            large = np.repeat((size > hot_cell) | (key[start] == hot if hot is not None else False), size)
            if large.any():
                yield batch_of(columns[1][large], key[large], np.zeros(large.sum(), np.int32))
                hot = key[-1] if large[-1] else hot
                columns = [c[~large] for c in columns]
                key = columns[0]
            done = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from pairs(*[c[:done] for c in columns])
            kept = [c[done:] for c in columns]
        if kept is not None and len(kept[0]):
            yield from pairs(*kept)

    return run


def counted_pairs(hashed: DataFrame, limits: tuple[int, ...], hot_cell: int = HOT_CELL) -> DataFrame:
    """(a, b, radius) as ``_counter`` gives them, once each with the least radius, kept in the shared folder."""
    keyed = hashed.select(F.explode("keys").alias("key"), "id", "code").repartition("key").sortWithinPartitions("key", "id")
    met = keyed.mapInArrow(_counter(limits, hot_cell), "a long, b long, radius int").where("a <> b or radius = 0")
    return cut(met.groupBy("a", "b").agg(F.min("radius").alias("radius")))


def _block_pairs(k: int, least: float, dim: int):
    """applyInArrow function: of two blocks of a heavy cell, each row's pairs with its k + 1 best rows of the other."""

    def best(x, y, u, v, out):
        for at in range(0, len(x), 512):
            s = u[at : at + 512] @ v.T
            n = s.shape[1] - min(k + 2, s.shape[1])
            rows, cols = np.nonzero((s >= np.partition(s, n, axis=1)[:, n, None] - 1e-5) & (s >= least - 1e-5))
            out.append((x[at + rows], y[cols]))

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, models = table.column("id").to_numpy(), np.array(table.column("model").to_pylist(), dtype=object)
        raw = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("vector").chunks]).reshape(-1, dim).astype(np.float64)
        raw /= np.abs(raw).max(axis=1, keepdims=True)
        raw /= np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
        low = raw.astype(np.float32)
        left, right, out = np.flatnonzero(side <= 1), np.flatnonzero(side != 1), []  # 0 stands on both sides
        if len(left) and len(right):
            best(left, right, low[left], low[right], out)
            best(right, left, low[right], low[left], out)
        i, j = (np.concatenate([o[n] for o in out]) if out else np.array([], np.int64) for n in (0, 1))
        one = np.unique(np.stack([np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)], axis=1)[(ids[i] != ids[j]) & (models[i] == models[j])], axis=0)
        i, j = one[:, 0], one[:, 1]
        c = np.concatenate([np.einsum("ij,ij->i", raw[i[o : o + 65536]], raw[j[o : o + 65536]]) for o in range(0, len(i), 65536)] or [np.array([])])
        good = c >= least
        return pa.table({"a": ids[i[good]], "b": ids[j[good]], "cosine": c[good]})

    return run


def heavy_pairs(members: DataFrame, vectors: DataFrame, k: int, least: float, dim: int) -> DataFrame:
    """(a, b, cosine): exactly the pairs of rows of one heavy cell (cell, id) of which one is among the other's k best of the cell. Cells are cut into blocks and each pair of blocks is a task's work."""
    blocks = members.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(vectors, "id").join(blocks, "cell").withColumn("x", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2)
    placed = spread.select("cell", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), side.alias("side"), "id", "model", "vector")
    return placed.groupBy("cell", "i", "j").applyInArrow(_block_pairs(k, least, dim), "a long, b long, cosine double")


def similar_vectors(vectors: DataFrame, k: int = 10, min_cosine: float = 0.85, dim: int = 96, windows: int | None = None, hot_cell: int = HOT_CELL) -> DataFrame:
    """(symbol_id, neighbour_id, cosine): of every symbol, those of its k most similar symbols of the same model that have at least ``min_cosine``.

    Single pairs are missed, most of them near ``min_cosine`` (figures in the README). ``search`` has no bound and misses none.
    """
    n = vectors.count()
    rows, members = points_and_members(vectors, dim)
    index = Index(n, dim, min_cosine, windows, hot_cell).fit(vectors)
    hashed = rows.select("id", F.hash("model").alias("model32"), "vector").mapInArrow(_hasher(index), "id long, keys array<long>, code binary, hot array<long>")
    met = counted_pairs(hashed, thresholds(min_cosine), hot_cell)
    pairs = met.where("radius > 0")
    points = rows.dropDuplicates(["id"])  # combined before the shuffle, so a vector repeated very often is no hot spot

    def verified(some: DataFrame) -> DataFrame:
        left = points.select(F.col("id").alias("a"), F.col("model").alias("ma"), F.col("vector").alias("va"))
        right = points.select(F.col("id").alias("b"), F.col("model").alias("mb"), F.col("vector").alias("vb"))
        # Models are compared by a function, as another join key would shuffle all vectors once more.
        both = some.select("a", "b").join(left, "a").join(right, "b").where(F.array_contains(F.array("ma"), F.col("mb")))
        return both.select("a", "b", "va", "vb").mapInArrow(_verifier(min_cosine, dim), "a long, b long, cosine double")

    # Virtual rehashing: the widest windows are only expanded for queries without k neighbours in narrower ones.
    near = cut(verified(pairs.where(F.col("radius") < RADII[-1])))
    inner = distance_at(min_cosine) * RADII[-2] / RADII[-1]
    within = near.where(F.col("cosine") >= 1 - inner * inner / 2).select(F.explode(F.array("a", "b")).alias("q")).groupBy("q").agg(F.count("*").alias("n"))
    full = within.where(F.col("n") >= k).select("q", F.lit(True).alias("full"))
    wide = pairs.where(F.col("radius") == RADII[-1])
    for end in ("a", "b"):
        wide = wide.join(full.select(F.col("q").alias(end), F.col("full").alias(f"f{end}")), end, "left")
    found = near.unionByName(verified(wide.where("fa is null or fb is null")))
    late = met.where("radius = 0").select(F.col("b").alias("cell"), F.col("a").alias("id"))
    crowds = [late] if late.limit(1).count() else []
    if index.hot:
        crowds.append(hashed.select(F.explode("hot").alias("cell"), "id"))
    if crowds:
        crowd = functools.reduce(DataFrame.unionByName, crowds).distinct()
        found = found.unionByName(heavy_pairs(crowd, points, k, min_cosine, dim)).dropDuplicates(["a", "b"])
    both = found.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("c2"), "cosine"), F.struct(F.col("b").alias("c"), F.col("a").alias("c2"), "cosine"))).alias("p")).select("p.*")
    # Of the symbols of one point at most the k + 1 first can be among anyone's k most similar.
    few = members.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("symbol_id"))).where(F.col("_rn") <= k + 1).select(F.col("id").alias("c2"), F.col("symbol_id").alias("neighbour_id"))
    out = both.join(few, "c2").select("c", "neighbour_id", "cosine")
    inside = few.select(F.col("c2").alias("c"), "neighbour_id", F.lit(1.0).alias("cosine"))
    best = Window.partitionBy("c").orderBy(F.desc("cosine"), "neighbour_id")
    of_point = out.unionByName(inside).withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k + 1)
    # Each symbol takes its point's list without itself.
    own = of_point.join(members.select(F.col("id").alias("c"), "symbol_id"), "c").where("symbol_id <> neighbour_id")
    # A symbol that isn't in its point's list (its copies with smaller ids fill it) sees one entry too many.
    return own.withColumn("_after", F.row_number().over(Window.partitionBy("c", "symbol_id").orderBy("_rn"))).where(F.col("_after") <= k).select("symbol_id", "neighbour_id", "cosine")


def similar_pairs(vectors: DataFrame, k: int = 10, min_cosine: float = 0.85, dim: int = 96) -> DataFrame:
    """(symbol_a, symbol_b), smaller first: pairs of at least ``min_cosine`` of which one is among the other's k most similar."""
    found = similar_vectors(vectors, k, min_cosine, dim)
    return found.select(F.least("symbol_id", "neighbour_id").alias("symbol_a"), F.greatest("symbol_id", "neighbour_id").alias("symbol_b")).distinct()


def _packer(dim: int, rows: int, copies: int = 0):
    """mapInArrow function: packs rows of (symbol_id, model, vector) into blocks of one model: ``ids``, and ``at``, the vector of each id in the block.

    With ``copies``, exact copies share one vector in the block, and of each only the ``copies`` smallest ids are kept.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                models = part.column(part.schema.get_field_index("model")).to_pylist()
                ids = part.column(part.schema.get_field_index("symbol_id")).to_pylist()
                x = part.column(part.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
                for model in dict.fromkeys(models):
                    pick = sorted((i for i, m in enumerate(models) if m == model), key=ids.__getitem__)
                    place: dict[bytes, int] = {}
                    count: dict[bytes, int] = {}
                    kept, at, lines = [], [], []
                    for i in pick:
                        v = x[i].tobytes() if copies else i
                        if v not in place:
                            place[v] = len(lines)
                            lines.append(i)
                        count[v] = count.get(v, 0) + 1
                        if not copies or count[v] <= copies:
                            kept.append(ids[i])
                            at.append(place[v])
                    yield pa.RecordBatch.from_arrays([pa.array([model]), pa.array([kept]), pa.array([at], pa.list_(pa.int32())), pa.array([x[lines].tobytes()], pa.binary())], names=["model", "ids", "at", "block"])

    return run


def _units(block: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a block, their largest value 1, as doubles; and their unit vectors in single precision."""
    x = np.frombuffer(block, np.float32).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]).astype(np.float32)


def _scanner(dim: int, k: int):
    """mapInPandas function: the hits of a block of vectors that can be among a query's k most similar, itself left out.

    Single precision only sorts out: every vector within its rounding of the (k + 1)-th best is scored in double.
    """
    margin = 4 * (dim + 4) * float(np.finfo(np.float32).eps)

    def run(batches):
        for pdf in batches:
            for qids, qblock, ids, at, block in zip(pdf["qids"], pdf["qblock"], pdf["ids"], pdf["at"], pdf["block"]):
                (q, q1), (x, x1) = _units(qblock, dim), _units(block, dim)
                qq, xx = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
                qids, ids, at = np.asarray(qids, dtype=object), np.asarray(ids, dtype=object), np.asarray(at)
                by = np.argsort(at, kind="stable")  # the ids of each vector, smallest first
                first = np.searchsorted(at[by], np.arange(len(x) + 1))
                n = len(x) - min(k + 1, len(x))
                for start in range(0, len(q), 256):
                    s = q1[start : start + 256] @ x1.T
                    rows, cols = np.nonzero(s >= np.partition(s, n, axis=1)[:, n, None] - margin)
                    rows += start
                    exact = np.concatenate([np.einsum("ij,ij->i", q[rows[o : o + 16384]], x[cols[o : o + 16384]]) for o in range(0, len(rows), 16384)]) / np.sqrt(qq[rows] * xx[cols])
                    size = first[cols + 1] - first[cols]
                    which = by[np.repeat(first[cols], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                    rows, exact = np.repeat(rows, size), np.repeat(exact, size)
                    line = np.lexsort((which, -exact, rows))  # ids are sorted, so their places order them
                    rows, which, exact = rows[line], which[line], exact[line]
                    few = np.arange(len(rows)) - np.searchsorted(rows, rows) < k + 1
                    yield pd.DataFrame({"symbol_id": qids[rows[few]], "neighbour_id": ids[which[few]], "cosine": exact[few]}).query("symbol_id != neighbour_id")

    return run


def search(vectors: DataFrame, k: int = 10, dim: int = 96, every: int = 50) -> DataFrame:
    """(symbol_id, neighbour_id, cosine, position): the k most similar symbols of each query, against all rows and with no bound on similarity.

    Queries are the rows whose symbol_id, hashed by MD5, is divisible by ``every`` (1 for all). All rows are
    verified, in blocks. Query blocks are
    spread over as many salts as there are partitions; neither side is gathered or broadcast. Exact copies are searched
    once a block and get their places by id.
    """
    spark = vectors.sparkSession
    usable = usable_vectors(vectors, dim)
    salts = parallelism(spark)
    data = usable.mapInArrow(_packer(dim, 8192, k + 1), "model string, ids array<string>, at array<int>, block binary").withColumn("salt", F.pmod(F.hash(F.col("ids")[0]), F.lit(salts)))
    queries = usable.where(F.conv(F.substring(F.md5("symbol_id"), 1, 8), 16, 10).cast("long") % every == 0).mapInArrow(_packer(dim, 2048), "model string, ids array<string>, at array<int>, block binary")
    queries = queries.select("model", F.col("ids").alias("qids"), F.col("block").alias("qblock"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    scored = data.join(queries.hint("shuffle_merge"), ["model", "salt"]).select("qids", "qblock", "ids", "at", "block").mapInPandas(_scanner(dim, k), "symbol_id string, neighbour_id string, cosine double")
    place = F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("cosine"), "neighbour_id"))
    return scored.withColumn("position", place).where(F.col("position") <= k)
