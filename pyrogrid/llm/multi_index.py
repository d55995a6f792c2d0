"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised with its own small codebook; a pair of centroids
is a cell. A query walks the cells in the order of their summed distance with a heap. It first
takes the nearest cells that hold `FIRST` entries; these give its k-th distance so far. Of all
other cells it leaves out only those that can't hold anything nearer: every cell knows how near
and how far its entries lie from its two centroids, which bounds their distance from the query
from below. All entries of visited cells are reranked with exact distances, so the result is the
exact one and the number of cells follows the data instead of a fixed limit.

Codebooks are fitted on at most `FIT_ROWS` vectors (those with the smallest hashes); every vector
is indexed. Equal vectors are one entry with its k + 1 smallest ids, which is all a result can
need, so copies cost nothing. Queries meet entries in blocks of bounded size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid.staging import checkpoint

FIT_ROWS = 20_000
CENTROIDS = 128
FIRST = 1000
BLOCK = 8192
# Share by which a bound may be off by rounding.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points ** 2).sum(1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(1), 0)


def fit_half(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd rounds from k distinct rows."""
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = squared(points, centres).argmin(1)
        counts = np.bincount(nearest, minlength=k)
        for d in range(points.shape[1]):
            sums = np.bincount(nearest, points[:, d], minlength=k)
            centres[counts > 0, d] = sums[counts > 0] / counts[counts > 0]
    return centres


def halves(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (matrix.shape[1] + 1) // 2
    return matrix[:, :cut], matrix[:, cut:]


def offsets(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances from differences, so that small ones keep their digits."""
    return np.sqrt(((points - centres) ** 2).sum(-1))


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough, far) -> list[tuple[int, int]]:
    """Cells by growing first[i] + second[j] until `far(sum)` or `enough(entries so far)`.

    A heap holds the frontier: a pair is opened once its neighbours with a smaller place in
    either half were taken. Empty cells are passed over.
    """
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    frontier = [(first[by_first[0]] + second[by_second[0]], 0, 0)]
    taken, seen, cells = 0, [0] * len(first), []
    while frontier:
        total, a, b = heapq.heappop(frontier)
        if far(total) or enough(taken):
            break
        i, j = int(by_first[a]), int(by_second[b])
        if counts[i, j]:
            cells.append((i, j))
            taken += counts[i, j]
        seen[a] = b + 1
        if a + 1 < len(first) and seen[a + 1] == b and (b == 0 or seen[a + 1] > b - 1):
            heapq.heappush(frontier, (first[by_first[a + 1]] + second[by_second[b]], a + 1, b))
        if b + 1 < len(second) and (a == 0 or seen[a - 1] > b + 1):
            heapq.heappush(frontier, (first[by_first[a]] + second[by_second[b + 1]], a, b + 1))
    return cells


class MultiIndex:
    """Codebooks, cell counts and per half the least and largest residual of each cell's entries:
    all of a size set by CENTROIDS."""

    def __init__(self, books, counts=None, rings=None):
        self.books, self.counts, self.rings = books, counts, rings

    def distances(self, matrix: np.ndarray) -> list[np.ndarray]:
        return [squared(part, book) for part, book in zip(halves(matrix), self.books)]

    def may_hold(self, vector: np.ndarray, kth: float) -> np.ndarray:
        """Which cells may hold an entry within `kth` of the vector: in each half the triangle
        inequality bounds the distance of a cell's entries from below."""
        least = np.zeros(self.counts.shape)
        for part, book, (near, far), axis in zip(halves(vector[None]), self.books, self.rings, (1, 0)):
            away = np.expand_dims(offsets(part, book), axis)
            gap = np.maximum(away - far, near - away) - SLACK * (away + far)
            least += np.maximum(gap, 0) ** 2
        return (self.counts > 0) & (least <= kth ** 2 * (1 + SLACK))


def as_matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64") if len(column) else np.zeros((0, 1))


def build(vectors: DataFrame, k: int) -> tuple[MultiIndex, DataFrame]:
    """The index of (vec_id, vector): model, and entries (i, j, key, vector, ids)."""
    key = F.sha2(F.concat_ws(",", F.transform("vector", lambda x: x.cast("string"))), 256)
    group = Window.partitionBy("key").orderBy("vec_id")
    # The row-number limit is applied before the shuffle too, so a vector with any number of
    # copies sends at most k + 1 ids per task.
    few = (vectors.withColumn("key", key).withColumn("nth", F.row_number().over(group))
           .where(F.col("nth") <= k + 1).groupBy("key")
           .agg(F.min_by("vector", "vec_id").alias("vector"),
                F.array_sort(F.collect_list("vec_id")).alias("ids")))
    few = checkpoint(few)
    sample = few.select("vector").orderBy(F.xxhash64("key")).limit(FIT_ROWS).toPandas()
    total = few.count()
    if not total:
        return MultiIndex(None), few
    size = int(min(CENTROIDS, max(4, np.ceil(np.sqrt(total / 32)))))
    model = MultiIndex([fit_half(part, size) for part in halves(as_matrix(sample["vector"]))])

    def assign(batches):
        for batch in batches:
            matrix = as_matrix(batch["vector"])
            i, j = (d.argmin(1) for d in model.distances(matrix))
            first, second = halves(matrix)
            yield batch.assign(i=i, j=j, r1=offsets(first, model.books[0][i]),
                               r2=offsets(second, model.books[1][j]))

    kind = dict(few.dtypes)
    entries = checkpoint(few.mapInPandas(
        assign, f"key string, vector {kind['vector']}, ids {kind['ids']}, i int, j int, r1 double, r2 double"))
    cells = entries.groupBy("i", "j").agg(
        F.count("*").alias("n"), *[f(r).alias(name + r) for r in ("r1", "r2")
                                   for name, f in (("near_", F.min), ("far_", F.max))]).toPandas()
    counts = np.zeros((len(model.books[0]), len(model.books[1])), "int64")
    counts[cells["i"], cells["j"]] = cells["n"]
    rings = np.zeros((2, 2, *counts.shape))
    for half, r in enumerate(("r1", "r2")):
        for side, name in enumerate(("near_", "far_")):
            rings[half, side, cells["i"], cells["j"]] = cells[name + r]
    model.counts, model.rings = counts, rings
    return model, entries.drop("r1", "r2")


def cells_of(queries: DataFrame, model: MultiIndex, further: bool) -> DataFrame:
    """(key, vector, i, js): cells to visit, one row per first centroid.

    The nearest cells that hold FIRST entries or, if `further`, all other cells that may hold
    something nearer than the query's `kth` distance.
    """
    def run(batches):
        for batch in batches:
            first, second = model.distances(as_matrix(batch["vector"]))
            rows = []
            for n, (key, vector) in enumerate(zip(batch["key"], batch["vector"])):
                start = walk(first[n], second[n], model.counts, lambda t: t >= FIRST, lambda s: False)
                if further:
                    rest = model.may_hold(np.asarray(vector, "float64"), batch["kth"].iloc[n])
                    for cell in start:
                        rest[cell] = False
                    start = np.argwhere(rest).tolist()
                by_first: dict[int, list[int]] = {}
                for i, j in start:
                    by_first.setdefault(i, []).append(j)
                rows += [(key, vector, i, js) for i, js in by_first.items()]
            yield pd.DataFrame(rows, columns=["key", "vector", "i", "js"])

    kind = dict(queries.dtypes)["vector"]
    return queries.mapInPandas(run, f"key string, vector {kind}, i int, js array<int>")


def rerank(visits: DataFrame, entries: DataFrame, model: MultiIndex, n_queries: int, k: int) -> DataFrame:
    """(key, vec_id, score): the k + 1 nearest entries' ids per query and block.

    Entries of a first centroid lie in blocks of about BLOCK; so do the queries.
    """
    per_first = np.ceil(model.counts.sum(1) / BLOCK).astype(int).clip(1)
    blocks = F.element_at(F.array(*[F.lit(int(n)) for n in per_first]), F.col("i") + 1)
    query_blocks = int(np.ceil(n_queries / BLOCK)) or 1
    left = (visits.withColumn("q", F.pmod(F.xxhash64("key"), F.lit(query_blocks).cast("long")))
            .withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long")))))
    right = (entries.withColumn("e", F.pmod(F.xxhash64("key", F.lit(1)), blocks.cast("long")))
             .withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long")))))

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(asked) and len(held):
            matrix, second = as_matrix(held["vector"]), held["j"].to_numpy()
            ids = held["ids"].to_numpy()
            wanted = np.zeros(model.counts.shape[1], bool)
            for key, vector, js in zip(asked["key"], asked["vector"], asked["js"]):
                wanted[:] = False
                wanted[js] = True
                at = np.flatnonzero(wanted[second])
                score = np.sqrt(((matrix[at] - np.asarray(vector, "float64")) ** 2).sum(1))
                if len(at) > k + 1:
                    limit = np.partition(score, k)[k]
                    at, score = at[score <= limit], score[score <= limit]
                near = sorted((s, v) for s, n in zip(score, at) for v in ids[n])[:k + 1]
                rows += [(key, v, s) for s, v in near]
        return pd.DataFrame(rows, columns=["key", "vec_id", "score"])

    where = ["i", "e", "q"]
    return left.groupBy(*where).cogroup(right.groupBy(*where)).applyInPandas(
        run, "key string, vec_id long, score double")


def nearest(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = 10, is_query: Column | None = None, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query, nearest first.

    Queries are the rows where `is_query` holds (by default ids divisible by 100), candidates all
    rows but the query's own; ties go to smaller ids. Vectors that are not usable, rows without
    an id and vectors of another length than most take no part. Equal vectors with different ids
    are candidates for each other; repeated rows of one id count once. Fewer candidates than k
    give them all, an empty table no rows. Other columns are not read.
    """
    asks = F.col(id_col) % 100 == 0 if is_query is None else is_query
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"),
                          asks.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vector") == (length["d"] if length else 0))
    model, entries = build(rows.dropDuplicates(["vec_id"]).select("vec_id", "vector"), k)
    key = F.sha2(F.concat_ws(",", F.transform("vector", lambda x: x.cast("string"))), 256)
    asked = checkpoint(rows.where("asks").select("vec_id", key.alias("key"), "vector").dropDuplicates(["vec_id"]))
    if model.books is None:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
                            F.lit(0.0).alias("score")).where("false")
    queries = asked.groupBy("key").agg(F.first("vector").alias("vector"))
    n_queries = queries.count()
    near = checkpoint(nearest(rerank(cells_of(queries, model, False), entries, model, n_queries, k),
                              ["key"], k + 1))
    bounds = near.groupBy("key").agg(F.max("score").alias("kth"), F.count("*").alias("n"))
    open_end = F.when(F.col("n") > k, F.col("kth")).otherwise(F.lit(float("inf")))
    further = queries.join(bounds, "key").select("key", "vector", open_end.alias("kth"))
    more = rerank(cells_of(further, model, True), entries, model, n_queries, k)
    found = checkpoint(nearest(near.drop("rank").unionByName(more), ["key"], k + 1))
    pairs = asked.select(F.col("vec_id").alias("query_id"), "key").join(found.drop("rank"), "key")
    return nearest(pairs.where("query_id <> vec_id"), ["query_id"], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
