"""Hard negatives: for an anchor and each of its nearest rows of the same label, rows of another
label that score nearly as high.

Vectors become integers, so all scores are exact inner products. Anchors and candidates meet in
blocks of bounded size; a block of scores is the product of an anchor tile and a candidate tile,
multiplied by Strassen's recursion (seven products of half the size instead of eight, odd sizes
padded with zeros). Of each block only the best few per anchor go on: a first pass keeps the
positives, a second one those in the window below each positive. Such lists merge by keeping the
best of both, inside a task from tile to tile and between tasks by a ranking of a few rows each.

The anchors are a stated share of the rows, so all work grows with anchors times rows; nothing of
it is kept besides the lists.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyrogrid.staging import checkpoint

SCALE = 256
# Window below a positive score, in per cent of it.
LEAST = 80
# Rows of an anchor block, of a group of candidates, and of a tile of it.
ANCHORS, CANDIDATES, TILE = 1024, 4096, 1024
# Largest side that is multiplied directly.
LEAF = 32

_LONG = np.iinfo("int64")


def leaf_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of integer matrices; through floating point where every sum is a whole number
    that it can hold."""
    if a.dtype == object or not a.size or not b.size:
        return a @ b
    most = max(-int(a.min()), int(a.max())) * max(-int(b.min()), int(b.max())) * a.shape[1]
    if most < 1 << 53:
        return (a.astype("float64") @ b.astype("float64")).astype("int64")
    return a @ b


def grown(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The matrix with zeros added up to a size."""
    if a.shape == (rows, columns):
        return a
    out = np.zeros((rows, columns), a.dtype)
    out[:a.shape[0], :a.shape[1]] = a
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b by Strassen's recursion, down to a side of `leaf`."""
    rows, columns = a.shape[0], b.shape[1]
    if min(rows, a.shape[1], columns) <= leaf:
        return leaf_product(a, b)
    y, k, x = (-(-size // 2) for size in (rows, a.shape[1], columns))
    a, b = grown(a, 2 * y, 2 * k), grown(b, 2 * k, 2 * x)
    a11, a12, a21, a22 = a[:y, :k], a[:y, k:], a[y:, :k], a[y:, k:]
    b11, b12, b21, b22 = b[:k, :x], b[:k, x:], b[k:, :x], b[k:, x:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * y, 2 * x), m1.dtype)
    out[:y, :x] = m1 + m4 - m5 + m7
    out[:y, x:] = m3 + m5
    out[y:, :x] = m2 + m4
    out[y:, x:] = m1 - m2 + m3 + m6
    return out[:rows, :columns]


def whole_numbers(vectors: pd.Series) -> np.ndarray:
    """floor(SCALE * x) of all components; shorter vectors are filled up with zeros. Components
    beyond 2^62 make the matrix one of Python integers."""
    wide = max(map(len, vectors), default=0)
    matrix = np.zeros((len(vectors), wide))
    for row, vector in zip(matrix, vectors):
        row[:len(vector)] = vector
    with np.errstate(over="ignore"):
        scaled = np.floor(matrix * SCALE)
    if not np.abs(scaled).max(initial=0) < 1 << 62:
        exact = [[math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE for x in row] for row in matrix.tolist()]
        return np.array(exact, object).reshape(matrix.shape)
    return scaled.astype("int64")


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of a and b; what exceeds 64 bits counts as the nearest long."""
    wide = max(a.shape[1], b.shape[1])
    a, b = (grown(m, len(m), wide) for m in (a, b))

    def most(m):
        return max(-int(m.min(initial=0)), int(m.max(initial=0)))
    if most(a) * most(b) * max(wide, 1) <= _LONG.max:
        return strassen(a, b.T).astype("int64")
    exact = strassen(a.astype(object), b.T.astype(object))
    return np.clip(exact, int(_LONG.min), int(_LONG.max)).astype("int64")


def in_window(block: np.ndarray, top: np.ndarray) -> np.ndarray:
    """LEAST * top <= 100 * block <= 100 * top, in Python integers where longs are too short."""
    if max(np.abs(m.astype("float64")).max(initial=0) for m in (block, top)) > _LONG.max // 128:
        block, top = block.astype(object), top.astype(object)
    return ((100 * block <= 100 * top) & (100 * block >= LEAST * top)).astype(bool)


class Best:
    """For each of several keys the k best (score, id), higher scores first, ties by smaller id.

    Lists made from parts of the rows merge by `add`.
    """

    def __init__(self, k: int):
        self.k = k
        self.key, self.score, self.id = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int64")

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, ids = np.concatenate([self.key, key]), np.concatenate([self.id, ids])
        score = np.concatenate([self.score, score])
        # ~x is -x - 1 and can't overflow.
        order = np.lexsort((ids, ~score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.searchsorted(key, key)
        best = np.arange(len(key)) - first < self.k
        self.key, self.score, self.id = key[best], score[best], ids[best]

    def add_block(self, block: np.ndarray, allowed: np.ndarray, ids: np.ndarray, key: np.ndarray) -> None:
        """Row n of a block of scores belongs to key[n], column m to ids[m]."""
        if block.shape[1] > 4 * self.k:
            # Only what reaches the k-th best of its row can be in the list; ties stay.
            masked = np.where(allowed, block, _LONG.min)
            at = block.shape[1] - self.k
            allowed = allowed & (block >= np.partition(masked, at, axis=1)[:, at:at + 1])
        row, column = np.nonzero(allowed)
        self.add(key[row], block[row, column], ids[column])


def tiles(held: pd.DataFrame):
    """Vectors, ids and labels of the candidates, a tile at a time."""
    for low in range(0, len(held), TILE):
        part = held.iloc[low:low + TILE]
        yield whole_numbers(part["vector"]), part["vec_id"].to_numpy("int64"), part["label"].to_numpy("int64")


def best_positives(k: int):
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        anchors, labels = asked["vec_id"].to_numpy("int64"), asked["label"].to_numpy("int64")
        matrix, best = whole_numbers(asked["vector"]), Best(k)
        rows = np.arange(len(anchors))
        for vectors, ids, other in tiles(held):
            same = (labels[:, None] == other) & (anchors[:, None] != ids)
            best.add_block(scores(matrix, vectors), same, ids, rows)
        return pd.DataFrame({"anchor_id": anchors[best.key], "positive_id": best.id, "positive_score": best.score})
    return run


def best_in_windows(k: int):
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        anchors, labels = asked["vec_id"].to_numpy("int64"), asked["label"].to_numpy("int64")
        matrix = whole_numbers(asked["vector"])
        counts = np.array([len(p) for p in asked["positives"]], "int64")
        most = int(counts.max(initial=0))
        best = [Best(k) for _ in range(most)]
        nth = [np.flatnonzero(counts > n) for n in range(most)]
        found = [[asked["positives"].iloc[row][n] for row in rows] for n, rows in enumerate(nth)]
        for vectors, ids, other in tiles(held):
            block = scores(matrix, vectors)
            differs = labels[:, None] != other
            for n, rows in enumerate(nth):
                top = np.array([p["positive_score"] for p in found[n]], "int64")[:, None]
                best[n].add_block(block[rows], differs[rows] & in_window(block[rows], top), ids, np.arange(len(rows)))
        out = []
        for n, rows in enumerate(nth):
            key = best[n].key
            out.append(pd.DataFrame({
                "anchor_id": anchors[rows[key]],
                "positive_id": np.array([p["positive_id"] for p in found[n]], "int64")[key],
                "positive_score": np.array([p["positive_score"] for p in found[n]], "int64")[key],
                "negative_id": best[n].id, "negative_score": best[n].score}))
        return pd.concat(out) if out else pd.DataFrame(
            {c: np.zeros(0, "int64") for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")})
    return run


def met(anchors: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """Result of run(anchor block, group of candidates) for all pairs of such."""
    blocks = -(-anchors.count() // ANCHORS) or 1
    groups = -(-rows.count() // CANDIDATES) or 1

    def part(number: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(number).cast("long")).cast("int")

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    left = anchors.withColumn("block", part(blocks, 1)).withColumn("part", every(groups))
    right = rows.withColumn("part", part(groups, 2)).withColumn("block", every(blocks))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, schema)


def ranked(found: DataFrame, keys: list[str], score: str, other: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), other)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def takes_part(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & label.isNotNull()


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, is_anchor: Column | None = None,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows where `is_anchor` holds (by default ids divisible by 100). Rows without
    an id, a label or a vector, or with a null or non-finite component take no part; zero vectors
    do. Vectors of different lengths meet as if the shorter one ended in zeros. Repeated rows of
    one id count once, by the smallest label and vector. Ties go to smaller ids; fewer rows than
    asked for give all. A negative positive score has an empty window, one of zero a window of zeros.
    Scores beyond 64 bits count as the nearest long. An empty table gives no rows; other columns
    are not read.
    """
    asks = F.col(id_col) % 100 == 0 if is_anchor is None else is_anchor
    wide = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.where(takes_part(wide, F.col(label_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    one = F.min(F.struct("label", "vector", "asks"))
    rows = checkpoint(rows.groupBy("vec_id").agg(one.alias("row")).select("vec_id", "row.*"))
    # Columns of their own, so that the two sides of a cogroup can be told apart.
    anchors = rows.where("asks").select(*[F.col(c).alias(c) for c in ("vec_id", "label", "vector")])
    rows = rows.drop("asks")
    near = met(anchors, rows, best_positives(positives), "anchor_id long, positive_id long, positive_score long")
    near = checkpoint(ranked(near, ["anchor_id"], "positive_score", "positive_id", positives))
    lists = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    found = met(anchors.join(lists, "vec_id"), rows, best_in_windows(negatives),
                "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        "negative_score")
