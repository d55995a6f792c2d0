"""Any table with two coordinates as dense pixel frames; packed frames and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.tiles import TILE, div
from ..staging import spread


def row_ends(frames: DataFrame, *more: str, block: int = TILE) -> DataFrame:
    """A row for each block of columns of every row of frames given by height and width: ``x`` is
    the column after the block's last one.

    Rows are generated and spread before blocks, so one huge frame is not one task.
    """
    bands = F.sequence(F.lit(0), div(F.col("height") - 1, TILE))
    rows = F.sequence(F.col("band") * TILE,
                      F.least((F.col("band") + 1) * TILE, F.col("height")) - 1)
    blocks = F.sequence(F.lit(0), div(F.col("width") - 1, block))
    return (frames.select("frame_id", "height", "width", *more, F.explode(bands).alias("band"))
            .select("frame_id", "height", "width", *more, F.explode(rows).alias("y"))
            .repartition("frame_id", "y")
            .select("frame_id", "y", F.explode(blocks).alias("block"), "height", "width", *more)
            .withColumn("x", F.least((F.col("block") + 1) * block, F.col("width"))))


def rasterize(df: DataFrame, frame: Column, y: Column, x: Column, weight: Column,
              height, width, block: int = TILE) -> DataFrame:
    """Sum integer weights per cell and scale each frame by its own largest cell.

    v is the weight as a share of the frame's largest, in 0..255; cells without rows and
    cells of negative weight are 0. ``height`` and ``width`` are numbers or columns; rows
    outside the grid (or without a frame, row or column) are left out. Frames are those of
    the rows inside. Partial sums run before the shuffle.

    Cells without rows arise last: each cell of a row, and the end of each block of columns,
    fills the gap before it. Only cells with rows are ever held in a table or sorted.
    """
    def size(n):
        return n if isinstance(n, Column) else F.lit(n)

    cells = (df.select(frame.alias("frame_id"), y.cast("int").alias("y"),
                       x.cast("int").alias("x"), weight.cast("long").alias("w"))
             .groupBy("frame_id", "y", "x").agg(F.greatest(F.sum("w"), F.lit(0)).alias("w"))
             .withColumns({"height": size(height).cast("int"), "width": size(width).cast("int")})
             .where("frame_id is not null and y >= 0 and y < height and x >= 0 and x < width"))
    frames = cells.groupBy("frame_id").agg(
        F.max("w").alias("top"), F.max("height").alias("height"), F.max("width").alias("width"))
    ends = row_ends(frames, "top", block=block).select(
        "frame_id", "y", "block", "x", F.lit(None).cast("long").alias("w"), "height", "width", "top")
    # Few rows may stand for many cells, hence the fixed number of partitions.
    marks = spread(ends.unionByName(
        cells.select("frame_id", "y", div("x", block).alias("block"), "x", "w"), allowMissingColumns=True),
        "frame_id", "y", "block")
    part = Window.partitionBy("frame_id", "y", "block")
    before = F.coalesce(F.lag("x").over(part.orderBy("x")), F.col("block") * block - 1)
    own = F.max(F.struct("height", "width", "top")).over(part)
    # Ends, which have no weight, lie one beyond the last column.
    last = F.when(F.col("w").isNull(), F.col("x") - 1).otherwise(F.col("x"))
    full = (marks.select("frame_id", "y", "w", own.alias("own"), before.alias("before"), last.alias("last"))
            .where("before < last")
            .select("frame_id", "y", "w", "own", "last", F.explode(F.sequence(F.col("before") + 1, F.col("last"))).alias("x")))
    w = F.when(F.col("x") == F.col("last"), F.coalesce("w", F.lit(0))).otherwise(0)
    v = F.when(F.col("own.top") > 0, F.floor(w * 255 / F.col("own.top"))).otherwise(0)
    return full.select("frame_id", "y", "x", v.cast("int").alias("v"), "own.height", "own.width")


def explode_frames(frames: DataFrame, *arrays: str) -> DataFrame:
    """One row per pixel of packed row-major frames."""
    names = arrays or ("px",)
    others = [c for c in frames.columns if c not in names]
    zipped = F.arrays_zip(*[F.col(n) for n in names])
    at = frames.select(*others, F.posexplode(zipped).alias("pos", "cell"))
    return at.select(
        "frame_id", F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"),
        (F.col("pos") % F.col("width")).cast("int").alias("x"),
        *[F.col(f"cell.{n}").cast("int").alias("v" if n == "px" else n) for n in names],
        *[c for c in others if c != "frame_id"])


def assemble_frames(pixels: DataFrame, source: str = "v") -> DataFrame:
    """Packed frames from pixels: rows are built first, then joined in order.

    A packed frame is one value by definition; use it for frames of image size.
    """
    line = pixels.groupBy("frame_id", "y").agg(
        F.array_sort(F.collect_list(F.struct("x", F.col(source).cast("short").alias("v"))))
        .alias("cells"), F.max("height").alias("height"), F.max("width").alias("width"))
    lines = line.select("frame_id", "y", F.col("cells.v").alias("vs"), "height", "width")
    return (lines.groupBy("frame_id")
            .agg(F.array_sort(F.collect_list(F.struct("y", "vs"))).alias("rows"),
                 F.max("height").alias("height"), F.max("width").alias("width"))
            .select("frame_id", "height", "width", F.flatten("rows.vs").alias("px"),
                    F.lit("ok").alias("status")))
