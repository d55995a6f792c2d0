"""Smoothing and grey morphology, tile by tile.

A tile and a halo around it become one array, and tiles of one shape are taken together; each
operator is a few passes over them, in constant work per pixel whatever the kernel. A kernel size
is a number or a column (the same for all pixels of a frame), so frames of different formats take
one plan together. Rows pass through Python sorted by tile, so a worker holds the tiles of one
batch of rows, or one larger tile.

Windows are clipped at the frame edge. Frames must be dense (every pixel present).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from . import sliding
from .tiles import integers, numbered, stacks, whole_tiles, with_halo

TILE = 256
_HALO = "_k"
_ARROW = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


def _by_tile(pixels: DataFrame, k: int | str | Column, halo: Column, tile: int, source: str,
             steps, out: dict[str, str]) -> DataFrame:
    """The pixels with new columns (name -> type) from steps(array of tiles, kernel, frame edge).

    ``halo`` is how far a pixel's results see, as an expression of the kernel ``_k``.
    """
    kernel = F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k
    rows = pixels.drop("ty", "tx", *out)
    unit = [*(c for c in ("frame_id", "run_id") if c in rows.columns), "ty", "tx"]
    near = with_halo(rows.withColumn(_HALO, kernel.cast("int")), halo, tile).sortWithinPartitions(*unit)
    names, kinds = rows.columns, {name: pa.type_for_alias(_ARROW.get(kind, kind)) for name, kind in out.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells, first in whole_tiles(batches, unit):
            y, x, ty, tx, ks, height, width = integers(cells, "y", "x", "ty", "tx", _HALO, "height", "width")
            v, number = cells.column(source).to_numpy(), numbered(first, len(y))
            tops, lefts = (np.minimum.reduceat(at, first) for at in (y, x))
            spans = [np.maximum.reduceat(at, first) - least + 1 for at, least in ((y, tops), (x, lefts))]
            found: list = [None] * len(out)
            # Tiles of one shape are one array.
            for (high, wide, size), same in stacks(*spans, ks[first]):
                place = np.full(len(first), -1)
                place[same] = np.arange(len(same))
                held = np.flatnonzero(place[number] >= 0)
                at = place[number[held]], y[held] - tops[number[held]], x[held] - lefts[number[held]]
                values = np.zeros((len(same), high, wide), v.dtype)
                values[at] = v[held]
                lines = [np.arange(high) + tops[same][:, None], np.arange(wide) + lefts[same][:, None]]
                ends = [(line == 0) | (line == last[first][same][:, None] - 1) for line, last in zip(lines, (height, width))]
                for n, a in enumerate(steps(values, size, ends[0][:, :, None] | ends[1][:, None, :])):
                    if found[n] is None:
                        found[n] = np.empty(len(y), a.dtype)
                    found[n][held] = a[at]
            own = pa.array((y // tile == ty) & (x // tile == tx))
            done = cells.select(names).filter(own)
            for name, column in zip(out, found):
                done = done.append_column(name, pa.array(column, from_pandas=True).cast(kinds[name]).filter(own))
            yield from done.to_batches()

    schema = StructType([*rows.schema.fields, *StructType.fromDDL(", ".join(f"{n} {kind}" for n, kind in out.items()))])
    return near.mapInArrow(run, schema)


def _kind(pixels: DataFrame, source: str) -> str:
    return pixels.schema[source].dataType.simpleString()


def _radius(times: int = 1, more: int = 0) -> Column:
    return F.floor(F.col(_HALO) / 2).cast("int") * times + more


def box_blur(pixels: DataFrame, tile: int = TILE, out: str = "blur") -> DataFrame:
    """3x3 mean, truncated; edge pixels are copied."""
    return _by_tile(pixels, 3, _radius(), tile, "v", lambda v, k, edge: [sliding.blurred(v, edge)], {out: "int"})


def dilate(pixels: DataFrame, k, source: str = "v", out: str = "dilated", tile: int = TILE) -> DataFrame:
    return _by_tile(pixels, k, _radius(), tile, source,
                    lambda v, k, edge: [sliding.square(v, k // 2, np.maximum)], {out: _kind(pixels, source)})


def erode(pixels: DataFrame, k, source: str = "v", out: str = "eroded", tile: int = TILE) -> DataFrame:
    return _by_tile(pixels, k, _radius(), tile, source,
                    lambda v, k, edge: [sliding.square(v, k // 2, np.minimum)], {out: _kind(pixels, source)})


def opening(pixels: DataFrame, k, source: str = "v", out: str = "opened", tile: int = TILE) -> DataFrame:
    return _by_tile(pixels, k, _radius(2), tile, source,
                    lambda v, k, edge: [sliding.opened(v, k // 2)], {out: _kind(pixels, source)})


def closing(pixels: DataFrame, k, source: str = "v", out: str = "closed", tile: int = TILE) -> DataFrame:
    return _by_tile(pixels, k, _radius(2), tile, source,
                    lambda v, k, edge: [sliding.closed(v, k // 2)], {out: _kind(pixels, source)})


def top_hat(pixels: DataFrame, k, source: str = "v", out: str = "tophat", tile: int = TILE) -> DataFrame:
    """What an opening removes, never negative."""
    return _by_tile(pixels, k, _radius(2), tile, source, lambda v, k, edge: [
        np.maximum(v - sliding.opened(v, k // 2), 0)], {out: _kind(pixels, source)})


def blur_and_top_hat(pixels: DataFrame, k, tile: int = TILE) -> DataFrame:
    """Both steps under one halo, hence one shuffle."""
    def steps(v, k, edge):
        smooth = sliding.blurred(v, edge)
        return [smooth, np.maximum(smooth - sliding.opened(smooth, k // 2), 0)]
    return _by_tile(pixels, k, _radius(2, 1), tile, "v", steps, {"blur": "int", "tophat": "int"})


def masked_top_hat(pixels: DataFrame, k, mask: str = "mask", source: str = "v",
                   out: str = "diff", tile: int = TILE) -> DataFrame:
    """Top-hat over the whole frame, then cleared outside the mask."""
    hat = top_hat(pixels, k, source, "_hat", tile)
    return hat.withColumn(out, F.when(F.col(mask), F.col("_hat")).otherwise(0)).drop("_hat")


def top_hat_ellipse(pixels: DataFrame, k, source: str = "v", out: str = "tophat",
                    tile: int = TILE) -> DataFrame:
    """Top-hat with an elliptic element."""
    def steps(v, k, edge):
        eroded = sliding.ellipse(v, k, np.minimum)
        return [np.maximum(v - sliding.ellipse(eroded, k, np.maximum), 0)]
    return _by_tile(pixels, k, _radius(2), tile, source, steps, {out: _kind(pixels, source)})
