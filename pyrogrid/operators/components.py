"""Connected components of a sparse mask.

Tiles are labelled independently. Components that meet across a tile edge give the edges
of a much smaller graph, which is merged by an iterated join. The id of a component is
the position ``y * width + x`` of its first pixel, whatever the partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType

from ..staging import checkpoint, spread
from .tiles import TILE, div, frame_keys, own_pixels, tiled, with_halo

FORWARD = {4: [(0, 1), (1, 0)], 8: [(0, 1), (1, 0), (1, 1), (1, -1)]}


def first_pixel_labels(y: np.ndarray, x: np.ndarray, connectivity: int) -> np.ndarray:
    """Index of the first pixel, in scan order, of each pixel's component."""
    stride = int(x.max()) + 2
    code = y.astype(np.int64) * stride + x
    order = np.argsort(code)
    code, xs = code[order], x[order]
    ends = []
    for dy, dx in FORWARD[connectivity]:
        target = code + dy * stride + dx
        at = np.minimum(np.searchsorted(code, target), len(code) - 1)
        hit = (code[at] == target) & (xs + dx >= 0)
        ends.append((np.flatnonzero(hit), at[hit]))
    a = np.concatenate([e[0] for e in ends])
    b = np.concatenate([e[1] for e in ends])
    root = np.arange(len(code))
    while True:
        low = np.minimum(root[a], root[b])
        hooked = root.copy()
        np.minimum.at(hooked, root[a], low)
        np.minimum.at(hooked, root[b], low)
        while True:
            jumped = hooked[hooked]
            if np.array_equal(jumped, hooked):
                break
            hooked = jumped
        if np.array_equal(hooked, root):
            break
        root = hooked
    labels = np.empty_like(root)
    labels[order] = order[root]
    return labels


def _tile_labels(connectivity: int):
    """Labels of whole tiles, many tiles per Arrow batch."""
    @F.pandas_udf(ArrayType(LongType()))
    def label(ys: pd.Series, xs: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for y, x, width in zip(ys, xs, widths):
            first = first_pixel_labels(y, x, connectivity)
            out.append(y[first].astype(np.int64) * width + x[first])
        return pd.Series(out)
    return label


def _tile_edges(labelled: DataFrame, keys, connectivity: int, tile: int) -> DataFrame:
    """Pairs of labels whose pixels touch across a tile edge."""
    last = tile - 1
    rim = labelled.where(
        (F.col("y") % tile).isin(0, last) | (F.col("x") % tile).isin(0, last)
    ).select(*keys, "y", "x", "comp_id")
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
                      for dy, dx in FORWARD[connectivity]])
    ahead = (rim.withColumn("s", F.explode(steps))
             .withColumn("ny", F.col("y") + F.col("s.dy"))
             .withColumn("nx", F.col("x") + F.col("s.dx"))
             .where((F.col("nx") >= 0)
                    & ((div("y", tile) != div("ny", tile)) | (div("x", tile) != div("nx", tile))))
             .select(*keys, F.col("ny").alias("y"), F.col("nx").alias("x"),
                     F.col("comp_id").alias("a")))
    return (ahead.join(rim.withColumnRenamed("comp_id", "b"), [*keys, "y", "x"])
            .where("a <> b").select(*keys, "a", "b").distinct())


def _merge(edges: DataFrame, keys) -> DataFrame:
    """Smallest label reachable from each label: (keys, id, root).

    Each round contracts the graph: every label points to its smallest neighbour, pointers are
    followed to the end by doubling, and edges are rewritten to the new labels and deduplicated.
    Of the labels that still have an edge at most half are left, however long the chains.
    """
    both = edges.select(*keys, "a", "b").unionByName(
        edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpoint(both)
    roots = checkpoint(both.select(*keys, F.col("a").alias("id")).distinct()
                       .withColumn("root", F.col("id")))
    # Every round joins each label that still has an edge to another, so the loop ends.
    while True:
        low = (both.groupBy(*keys, "a").agg(F.min("b").alias("b"))
               .select(*keys, F.col("a").alias("root"), F.least("a", "b").alias("next")))
        low, moving = checkpoint(low), True
        while moving:
            hop = low.select(*keys, F.col("root").alias("next"), F.col("next").alias("after"))
            jumped = checkpoint(low.select(*keys, "root", "next").join(hop, [*keys, "next"]).select(
                *keys, "root", F.col("after").alias("next"), (F.col("after") != F.col("next")).alias("moved")))
            moving = not jumped.where("moved").isEmpty()
            low = jumped.drop("moved")
        roots = checkpoint(roots.join(low, [*keys, "root"], "left")
                           .select(*keys, "id", F.coalesce("next", "root").alias("root")))
        for end in ("a", "b"):
            both = (both.join(low.withColumnRenamed("root", end), [*keys, end], "left")
                    .withColumn(end, F.coalesce("next", end)).drop("next"))
        both = checkpoint(both.where("a <> b").distinct())
        if both.isEmpty():
            return roots


def components(mask: DataFrame, connectivity: int = 4, tile: int = TILE,
               keys: list[str] | None = None) -> DataFrame:
    """Add ``comp_id`` to every pixel of a sparse mask."""
    keys = keys or frame_keys(mask)
    mask = tiled(mask, tile)
    unit = [*keys, "ty", "tx"]
    rest = [c for c in mask.columns if c not in unit]
    # One row per tile: its size is bounded by the tile, its label array by its pixels.
    cells = (spread(mask, *unit).groupBy(*unit)
             .agg(F.collect_list(F.struct(*rest)).alias("cells"), F.max("width").alias("w")))
    ids = cells.withColumn("ids", _tile_labels(connectivity)("cells.y", "cells.x", "w"))
    labelled = checkpoint(
        ids.select(*unit, F.explode(F.arrays_zip("cells", "ids")).alias("p"))
        .select(*[F.col(c) if c in unit else F.col(f"p.cells.{c}").alias(c) for c in mask.columns],
                F.col("p.ids").alias("comp_id")))
    edges = _tile_edges(labelled, keys, connectivity, tile)
    if edges.isEmpty():
        return labelled
    roots = _merge(edges, keys).withColumnRenamed("id", "comp_id")
    return (labelled.join(roots, [*keys, "comp_id"], "left")
            .withColumn("comp_id", F.coalesce("root", "comp_id"))
            .select(*labelled.columns))


def with_boundary(mask: DataFrame, tile: int = TILE) -> DataFrame:
    """Flag pixels that lack one of their four neighbours (or lie on the frame edge)."""
    keys = frame_keys(mask)
    near = with_halo(mask, 1, tile)

    def beside(axis, across):
        w = Window.partitionBy(*keys, "ty", "tx", across).orderBy(axis)
        return ((F.coalesce(F.lag(axis).over(w) == F.col(axis) - 1, F.lit(False)))
                & (F.coalesce(F.lead(axis).over(w) == F.col(axis) + 1, F.lit(False))))
    flagged = near.withColumn("_row", beside("x", "y")).withColumn("_col", beside("y", "x"))
    return (own_pixels(flagged, tile)
            .withColumn("boundary", ~(F.col("_row") & F.col("_col"))).drop("_row", "_col"))
