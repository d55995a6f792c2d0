"""Bounded working units: square tiles of a frame, with a halo where needed.

No operator ever groups by the frame alone for pixel work. A frame is cut into tiles
of ``tile`` pixels per side; a stencil of reach ``halo`` sees copies of the pixels
next to its tile, so one shuffle by (frame, tile) serves any number of windows and a
single huge frame spreads over the cluster like many small ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

TILE = 1024
# Cells that a worker takes in one pass; small tiles are taken together, a larger one by itself.
CELLS = 1 << 18


def frame_keys(df: DataFrame) -> list[str]:
    return [c for c in ("frame_id", "run_id") if c in df.columns]


def div(value: Column | str, by: int) -> Column:
    """Integer division of a non-negative integer column."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(by)).cast("int")


def tiled(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    if "ty" in pixels.columns:
        return pixels
    return pixels.withColumns({"ty": div("y", tile), "tx": div("x", tile)})


def with_halo(pixels: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """Copy each pixel to every tile that lies within ``halo`` of it."""
    def reach(pos, size):
        return F.explode(F.sequence(
            div(F.greatest(F.col(pos) - halo, F.lit(0)), tile),
            div(F.least(F.col(pos) + halo, F.col(size) - 1), tile)))
    return (pixels.drop("ty", "tx")
            .withColumn("ty", reach("y", "height"))
            .withColumn("tx", reach("x", "width"))
            .repartition(*frame_keys(pixels), "ty", "tx"))


def own_pixels(haloed: DataFrame, tile: int = TILE) -> DataFrame:
    return haloed.where((F.col("ty") == div("y", tile)) & (F.col("tx") == div("x", tile)))


def stacks(*sizes: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places of tiles with the same sizes (height and width first), of CELLS cells together."""
    kinds = np.stack(sizes, 1)
    for kind in np.unique(kinds, axis=0):
        same = np.flatnonzero((kinds == kind).all(axis=1))
        step = max(1, CELLS // int(kind[0] * kind[1]))
        for n in range(0, len(same), step):
            yield [int(size) for size in kind], same[n:n + step]


def whole_tiles(batches: Iterator[pa.RecordBatch], unit: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by tile as tables of whole tiles, with the first row of each tile."""
    def key(batch, row):
        return [batch.column(c)[row].as_py() for c in unit]

    def firsts(table):
        new = np.zeros(max(table.num_rows - 1, 0), bool)
        for c in unit:
            column = table.column(c)
            here, before = column.slice(1), column.slice(0, len(new))
            new |= pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
            new |= pc.not_equal(pc.is_null(here), pc.is_null(before)).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(batch, 0) != last:
            yield pa.Table.from_batches(held), np.zeros(1, "int64")
            held = []
        last, at = key(batch, batch.num_rows - 1), firsts(batch)
        if len(at) > 1:
            # The last tile may go on in the next batch.
            yield pa.Table.from_batches([*held, batch.slice(0, at[-1])]), np.concatenate(
                [[0], at[1:-1] + sum(b.num_rows for b in held)])
            held = []
        held.append(batch.slice(at[-1]))
    if held:
        yield pa.Table.from_batches(held), np.zeros(1, "int64")


def integers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy().astype("int64") for c in names]


def numbered(first: np.ndarray, rows: int) -> np.ndarray:
    """The number of each row's tile, from the first rows of tiles."""
    return np.repeat(np.arange(len(first)), np.diff([*first, rows]))


def attach(pixels: DataFrame, per_frame: DataFrame, tile: int = TILE,
           how: str = "inner") -> DataFrame:
    """Join per-frame values to pixels tile by tile.

    The per-frame row is repeated for each tile of its frame, so the join key is never
    hotter than one tile and pixels already shuffled by tile stay where they are. Spark
    itself turns this into a broadcast when the per-frame side measures small enough.
    """
    keys = [k for k in frame_keys(per_frame) if k in pixels.columns]

    def every(size):
        return F.explode(F.sequence(F.lit(0), div(F.col(size) - 1, tile)))
    per_tile = (per_frame.withColumn("ty", every("height")).withColumn("tx", every("width"))
                .drop("height", "width"))
    return tiled(pixels, tile).join(per_tile, [*keys, "ty", "tx"], how)
