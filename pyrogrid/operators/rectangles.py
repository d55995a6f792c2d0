"""Measures of rectangles: summed-area tables and span extrema, tile by tile.

A tile answers every rectangle that touches it in constant time, whatever the rectangle's size: sums
come from the four corners of a two-dimensional prefix sum, the least and the largest value from
four overlapping squares of a power-of-two size. Rectangles are cut at tile edges and their parts
put together by an aggregation, so the work grows with pixels plus parts, never with pixels times
rectangles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .tiles import div, tiled

TILE = 256
# Parts of rectangles that one tile answers together.
TOGETHER = 1 << 16
PART = "array<struct<px:bigint,low:bigint,high:bigint,s:bigint,ss:bigint>>"


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums over all cells above and left, with a row and a column of zeros in front."""
    out = np.zeros((values.shape[0] + 1, values.shape[1] + 1), "int64")
    np.cumsum(np.cumsum(values, axis=0), axis=1, out=out[1:, 1:])
    return out


def corner_sums(table: np.ndarray, y1, y2, x1, x2) -> np.ndarray:
    return table[y2, x2] - table[y1, x2] - table[y2, x1] + table[y1, x1]


def span_extremes(values: np.ndarray, pick, y1, y2, x1, x2) -> np.ndarray:
    """Least (or largest) value of each rectangle [y1, y2) x [x1, x2), none of them empty.

    Tables of growing power-of-two spans are made by doubling, first along the rows, then along
    the columns, as far as rectangles ask for them.
    """
    level_y, level_x = (np.frexp(b - a)[1] - 1 for a, b in ((y1, y2), (x1, x2)))
    out = np.empty(len(y1), values.dtype)
    rows = values
    for kx in range(int(level_x.max(initial=-1)) + 1):
        if kx:
            half = 1 << (kx - 1)
            rows = pick(rows[:, :-half], rows[:, half:])
        here = level_x == kx
        spans = rows
        for ky in range(int(level_y[here].max(initial=-1)) + 1):
            if ky:
                half = 1 << (ky - 1)
                spans = pick(spans[:-half], spans[half:])
            at = np.flatnonzero(here & (level_y == ky))
            if len(at):
                top, left = y1[at], x1[at]
                bottom, right = y2[at] - (1 << ky), x2[at] - (1 << kx)
                out[at] = pick(pick(spans[top, left], spans[top, right]), pick(spans[bottom, left], spans[bottom, right]))
    return out


def _measures(tile: int):
    @F.pandas_udf(PART)
    def measure(ys: pd.Series, xs: pd.Series, vs: pd.Series, y1s: pd.Series, y2s: pd.Series,
                x1s: pd.Series, x2s: pd.Series) -> pd.Series:
        out = []
        for y, x, v, *box in zip(ys, xs, vs, y1s, y2s, x1s, x2s):
            y, x = y % tile, x % tile
            value = np.zeros((int(y.max()) + 1, int(x.max()) + 1), "int64")
            there = np.zeros(value.shape, bool)
            value[y, x], there[y, x] = v, True
            # Parts reach to the tile's edge, pixels perhaps not.
            y1, y2, x1, x2 = (np.minimum(side, size) for side, size in zip(
                box, (value.shape[0], value.shape[0], value.shape[1], value.shape[1])))
            sums = [corner_sums(prefix_sums(t), y1, y2, x1, x2) for t in (there, value, value * value)]
            full = sums[0] > 0
            inside = [side[full] for side in (y1, y2, x1, x2)]
            low, high = np.zeros(len(y1), "int64"), np.zeros(len(y1), "int64")
            ends = np.iinfo("int64")
            low[full] = span_extremes(np.where(there, value, ends.max), np.minimum, *inside)
            high[full] = span_extremes(np.where(there, value, ends.min), np.maximum, *inside)
            out.append([{"px": n, "low": a, "high": b, "s": s, "ss": ss} for n, a, b, s, ss in zip(
                *(c.tolist() for c in (sums[0], low, high, sums[1], sums[2])))])
        return pd.Series(out)
    return measure


def rectangle_sums(pixels: DataFrame, boxes: DataFrame, source: str = "v", tile: int = TILE) -> DataFrame:
    """px, min_v, max_v, s and ss (sum of squares) per rectangle (roi_id, frame_id, x1, x2, y1, y2)
    with x1 < x2 and y1 < y2, half open. Rectangles without a pixel have no row; those of one id
    and frame are counted together."""
    unit = ["frame_id", "ty", "tx"]

    def cover(lo, hi):
        return F.explode(F.sequence(div(F.greatest(F.col(lo), F.lit(0)), tile), div(F.col(hi) - 1, tile)))

    def within(c, t):
        return F.least(F.greatest(F.col(c) - F.col(t) * tile, F.lit(0)), F.lit(tile)).cast("int").alias(c)
    parts = (boxes.where("x2 > 0 and y2 > 0").withColumn("ty", cover("y1", "y2")).withColumn("tx", cover("x1", "x2"))
             .select("roi_id", *unit, within("x1", "tx"), within("x2", "tx"), within("y1", "ty"), within("y2", "ty")))
    # A tile that very many rectangles touch answers them in several rows.
    loads = parts.groupBy(*unit).agg(F.ceil(F.count("*") / TOGETHER).alias("chunks"))
    asked = (parts.join(loads, unit).withColumn("chunk", F.pmod(F.xxhash64("roi_id", "x1", "x2", "y1", "y2"), F.col("chunks")))
             .groupBy(*unit, "chunk").agg(F.collect_list(F.struct("roi_id", "x1", "x2", "y1", "y2")).alias("rois")))
    cells = (tiled(pixels, tile).groupBy(*unit)
             .agg(F.collect_list(F.struct("y", "x", F.col(source).cast("long").alias("v"))).alias("cells")))
    found = cells.join(asked, unit).withColumn("found", _measures(tile)(
        "cells.y", "cells.x", "cells.v", "rois.y1", "rois.y2", "rois.x1", "rois.x2"))
    each = found.select("frame_id", F.explode(F.arrays_zip(F.col("rois.roi_id").alias("roi_id"), "found")).alias("r"))
    kind = pixels.schema[source].dataType
    return (each.select("r.roi_id", "frame_id", "r.found.*").where("px > 0").groupBy("roi_id", "frame_id").agg(
        F.sum("px").alias("px"), F.min("low").cast(kind).alias("min_v"), F.max("high").cast(kind).alias("max_v"),
        F.sum("s").alias("s"), F.sum("ss").alias("ss")))
