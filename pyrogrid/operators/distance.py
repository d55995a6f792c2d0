"""Chamfer 3-4 distance and the eroded body mask.

Each tile is solved on its own. Where a frame has several tiles, tiles first pass the values on
their rims to their neighbours until nothing changes; only rims travel, since what lies inside a
tile has told its rim already. A last pass over the pixels takes the final rims around each tile,
which gives the exact distance for a frame of any size. A worker holds the tiles of one batch of
rows, or one larger tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..staging import checkpoint, keep, spread
from .segmentation import binarise, frame_levels
from .tiles import TILE, attach, frame_keys, integers, numbered, stacks, tiled, whole_tiles

STRAIGHT, DIAGONAL = 3, 4
NO_BACKGROUND = 2 ** 30
RIM = ("top", "bottom", "left", "right")


def sweep_down(d: np.ndarray) -> None:
    """Relax every row from the row above and from its left, top to bottom, in place."""
    ramp = np.arange(d.shape[-1], dtype=d.dtype) * STRAIGHT
    for y in range(d.shape[-2]):
        row = d[..., y, :]
        if y:
            up = d[..., y - 1, :]
            np.minimum(row, up + STRAIGHT, out=row)
            np.minimum(row[..., 1:], up[..., :-1] + DIAGONAL, out=row[..., 1:])
            np.minimum(row[..., :-1], up[..., 1:] + DIAGONAL, out=row[..., :-1])
        row[...] = np.minimum.accumulate(row - ramp, axis=-1) + ramp


def chamfer(start: np.ndarray) -> np.ndarray:
    """Shortest 3-4 path cost from start values over full rectangles (last two axes)."""
    d = start.astype(np.int32)
    sweep_down(d)
    sweep_down(d[..., ::-1, ::-1])
    return np.minimum(d, NO_BACKGROUND)


def _sides(ty, tx, height, width, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Heights and widths of tiles."""
    return np.minimum(height - ty * tile, tile), np.minimum(width - tx * tile, tile)


def _receive(start: np.ndarray, messages) -> None:
    """Rims of the tiles around one, laid around its cells. A message holds the direction it came in."""
    for m in messages:
        rows = {1: 0, -1: -1, 0: slice(1, -1)}[m["dy"]]
        start[rows, {1: 0, -1: -1, 0: slice(1, -1)}[m["dx"]]] = m["dist3"] if m["dy"] == 0 or m["dx"] == 0 else m["dist3"][0]


def _solved(pixels: pa.Table, first: np.ndarray, tile: int, around: dict):
    """(tiles, their rows, distances of their cells, places of the rows among these) for tiles of
    one shape each; ``around`` holds the rims around a tile by its number."""
    y, x, ty, tx, height, width = integers(pixels, "y", "x", "ty", "tx", "height", "width")
    back = ~pixels.column("fg").to_pandas().to_numpy(dtype=bool)
    number = numbered(first, len(y))
    sides = _sides(ty[first], tx[first], height[first], width[first], tile)
    for (high, wide), same in stacks(*sides):
        place = np.full(len(first), -1)
        place[same] = np.arange(len(same))
        rows = np.flatnonzero(place[number] >= 0)
        at = place[number[rows]], y[rows] % tile, x[rows] % tile
        start = np.full((len(same), high + 2, wide + 2), NO_BACKGROUND, dtype=np.int32)
        dark = back[rows]
        start[at[0][dark], at[1][dark] + 1, at[2][dark] + 1] = 0
        for n, t in enumerate(same):
            _receive(start[n], around.get(t, ()))
        yield same, rows, chamfer(start)[:, 1:-1, 1:-1], at


def _rim(d: np.ndarray) -> dict[str, np.ndarray]:
    return {"top": d[:, 0], "bottom": d[:, -1], "left": d[:, :, 0], "right": d[:, :, -1]}


def _first_rims(unit: list[str], tile: int):
    """Distances on the rims of tiles, of the background inside."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pixels, first in whole_tiles(batches, unit):
            tiles = pixels.select([*unit, "height", "width"]).take(first)
            for same, _, d, _ in _solved(pixels, first, tile, {}):
                rim = _rim(d)
                table = tiles.take(same)
                for side in RIM:
                    table = table.append_column(side, pa.array(list(rim[side]), pa.list_(pa.int32())))
                moved = d.min(axis=(1, 2)) < NO_BACKGROUND
                yield from table.append_column("moved", pa.array(moved)).combine_chunks().to_batches()
    return run


def _next_rims(tile: int):
    """Rims after the messages that reached them; tiles without messages stay."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sides = _sides(*(batch[c].to_numpy("int64") for c in ("ty", "tx", "height", "width")), tile)
            for (high, wide), same in stacks(*sides):
                tiles = batch.iloc[same]
                start = np.full((len(same), high + 2, wide + 2), NO_BACKGROUND, dtype=np.int32)
                before = {side: np.stack(tiles[side].to_list()) for side in RIM}
                for side, inner in _rim(start[:, 1:-1, 1:-1]).items():
                    inner[...] = before[side]
                for n, messages in enumerate(tiles["messages"]):
                    _receive(start[n], () if messages is None else messages)
                after = _rim(chamfer(start)[:, 1:-1, 1:-1])
                moved = np.zeros(len(same), bool)
                for side in RIM:
                    moved |= (after[side] < before[side]).any(axis=1)
                yield tiles.drop(columns="messages").assign(
                    **{side: list(after[side]) for side in RIM}, moved=moved)
    return run


def _messages(rims: DataFrame, unit: list[str], tile: int) -> DataFrame:
    """What tiles tell the eight around them, by receiving tile."""
    def corner(side, place):
        return F.array(F.element_at(side, place))
    parts = {(-1, 0): F.col("top"), (1, 0): F.col("bottom"), (0, -1): F.col("left"), (0, 1): F.col("right"),
             (-1, -1): corner("top", 1), (-1, 1): corner("top", -1), (1, -1): corner("bottom", 1), (1, 1): corner("bottom", -1)}
    told = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), part.alias("dist3"))
                               for (dy, dx), part in parts.items()]))
    return (rims.withColumn("message", told)
            .withColumn("ty", F.col("ty") + F.col("message.dy")).withColumn("tx", F.col("tx") + F.col("message.dx"))
            .where((F.col("ty") >= 0) & (F.col("tx") >= 0)
                   & (F.col("ty") * tile < F.col("height")) & (F.col("tx") * tile < F.col("width")))
            .groupBy(*unit).agg(F.collect_list("message").alias("messages")))


def _last_pass(unit: list[str], names: list[str], tile: int):
    """The rows with their distances; rows with messages hold the rims around their tile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pixels, first in whole_tiles(batches, unit):
            around = {}
            if "messages" in pixels.column_names:
                number = numbered(first, pixels.num_rows)
                told = pc.is_valid(pixels.column("messages")).to_numpy()
                held = dict(zip(number[told], pixels.column("messages").filter(pa.array(told)).to_pylist()))
                pixels = pixels.filter(pa.array(~told))
                tiles, first = np.unique(number[~told], return_index=True)
                around = {n: held.get(t, ()) for n, t in enumerate(tiles)}
            if pixels.num_rows:
                dist3 = np.empty(pixels.num_rows, np.int32)
                for _, rows, d, at in _solved(pixels, first, tile, around):
                    dist3[rows] = d[at]
                yield from pixels.select(names).append_column("dist3", pa.array(dist3)).to_batches()
    return run


def _final_rims(pixels: DataFrame, unit: list[str], tile: int) -> DataFrame:
    """The rims around every tile, when no rim changes any more."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.select(*unit, "height", "width").schema)
    schema = f"{kinds}, " + ", ".join(f"{side} array<int>" for side in RIM) + ", moved boolean"
    cells = spread(pixels.select(*unit, "y", "x", "fg", "height", "width"), *unit).sortWithinPartitions(*unit)
    rims = checkpoint(cells.mapInArrow(_first_rims(unit, tile), schema))
    while not (moved := rims.where("moved")).isEmpty():
        both = rims.drop("moved").unionByName(_messages(moved, unit, tile), allowMissingColumns=True)
        # Keys may be null, which a join would not match. Places without pixels have no rim.
        met = both.groupBy(*unit).agg(
            *[F.max(c).alias(c) for c in ("height", "width")],
            *[F.first(c, True).alias(c) for c in (*RIM, "messages")]).where("top is not null")
        rims = checkpoint(met.mapInPandas(_next_rims(tile), schema))
    return _messages(rims, unit, tile)


def wider_than(frames: DataFrame, tile: int) -> bool:
    """Whether any row of a table with height and width exceeds a tile."""
    return not frames.where((F.col("height") > tile) | (F.col("width") > tile)).isEmpty()


def distance(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Add ``dist3``, three times the distance of each ``fg`` pixel to the background.

    Outside the frame is not background; a frame without background holds
    ``NO_BACKGROUND``. Whether tiles have to exchange rims is read from the data.
    """
    pixels = tiled(pixels, tile)
    unit = [*frame_keys(pixels), "ty", "tx"]
    rows = pixels
    if wider_than(pixels, tile):
        many = pixels.where((F.col("height") > tile) | (F.col("width") > tile))
        rows = pixels.unionByName(_final_rims(many, unit, tile), allowMissingColumns=True)
    schema = StructType([*pixels.schema.fields, StructField("dist3", IntegerType())])
    return spread(rows, *unit).sortWithinPartitions(*unit).mapInArrow(
        _last_pass(unit, pixels.columns, tile), schema)


def erode_by_distance(pixels: DataFrame, factor: float, out: str = "mask",
                      tile: int = TILE) -> DataFrame:
    """Keep pixels at least ``factor`` of the frame's largest distance deep."""
    if factor <= 0:
        raise ValueError("factor must be positive")
    keys = frame_keys(pixels)
    deepest = pixels.groupBy(*keys).agg(
        F.max("dist3").alias("max_dist3"), F.max("height").alias("height"),
        F.max("width").alias("width"))
    limit = F.lit(float(factor)) * (F.col("max_dist3") / 3.0)
    kept = (F.col("max_dist3") > 0) & (F.col("dist3") / 3.0 >= limit)
    return attach(pixels, deepest, tile).withColumn(out, kept).drop("max_dist3")


def body_mask(pixels: DataFrame, source: str = "v", otsu_min: int = 35, otsu_max: int = 50,
              factor: float = 0.05, tile: int = TILE) -> DataFrame:
    """Otsu, binarise, distance, adaptive erosion; keeps the distance before erosion."""
    levels = keep(frame_levels(pixels, source, otsu_min, otsu_max))
    fg = binarise(pixels, levels, source, tile=tile)
    return erode_by_distance(keep(distance(fg, tile)), factor, tile=tile)
