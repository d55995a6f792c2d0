"""Left/right, zone, region-of-interest and point measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.temperature import to_celsius
from . import rectangles
from .tiles import TILE, attach, frame_keys

ZONES = ("fore", "mid", "heel")


def side() -> Column:
    return F.when(F.col("x") < F.floor(F.col("width") / 2), "left").otherwise("right")


def _mean(s, n):
    return F.when(F.col(n) > 0, F.col(s).cast("double") / F.col(n))


def side_means(pixels: DataFrame, mask: str = "mask", source: str = "v") -> DataFrame:
    """Count, sum and mean of the masked pixels left and right of the middle column."""
    inside = F.col(mask)
    left = inside & (side() == "left")
    right = inside & (side() == "right")
    v = F.col(source).cast("long")
    sums = pixels.groupBy(*frame_keys(pixels)).agg(
        F.count_if(left).alias("left_px"), F.count_if(right).alias("right_px"),
        F.sum(F.when(left, v)).alias("s_left"), F.sum(F.when(right, v)).alias("s_right"))
    return sums.select(*frame_keys(pixels), "left_px", "right_px",
                       _mean("s_left", "left_px").alias("left_mean"),
                       _mean("s_right", "right_px").alias("right_mean"))


def asymmetry(pixels: DataFrame, t_min: float = 20.0, t_max: float = 40.0,
              threshold_c: float = 2.2, mask: str = "mask", source: str = "v",
              zero_form: bool = False) -> DataFrame:
    """Side means in degrees and their difference.

    ``zero_form`` reports 0.0 instead of NULL where a side holds no tissue.
    """
    means = side_means(pixels, mask, source)
    span = F.greatest(F.lit(1.0), F.lit(float(t_max - t_min)))
    left = F.lit(float(t_min)) + F.col("left_mean") / 255.0 * span
    right = F.lit(float(t_min)) + F.col("right_mean") / 255.0 * span
    both = (F.col("left_px") > 0) & (F.col("right_px") > 0)
    delta = F.abs(left - right)
    hot = F.coalesce(delta > F.lit(float(threshold_c)), F.lit(False))

    def shown(c):
        value = F.when(both, F.bround(c, 2))
        return F.coalesce(value, F.lit(0.0)) if zero_form else value
    status = (F.when((F.col("left_px") == 0) & (F.col("right_px") == 0), "no_tissue")
              .when(~both, "one_sided").when(hot, "asymmetric").otherwise("symmetric"))
    return means.select(*frame_keys(means), shown(left).alias("left_mean_c"),
                        shown(right).alias("right_mean_c"), shown(delta).alias("delta_c"),
                        (both & hot).alias("is_asymmetric"), status.alias("status"))


def raw_delta(pixels: DataFrame, limit: float = 15.0, mask: str = "mask",
              source: str = "v") -> DataFrame:
    """Difference of side means in grey levels against its own limit."""
    delta = F.abs(F.col("left_mean") - F.col("right_mean"))
    return side_means(pixels, mask, source).withColumn("delta", delta).withColumn(
        "status", F.when(delta.isNull(), "no_data").when(delta >= limit, "asymmetric")
        .otherwise("symmetric"))


def side_boxes(pixels: DataFrame, mask: str = "mask") -> DataFrame:
    """Bounding box of the masked pixels on each side."""
    return (pixels.where(F.col(mask)).withColumn("side", side())
            .groupBy(*frame_keys(pixels), "side")
            .agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"),
                 F.max("y").alias("y1"), F.max("height").alias("height"),
                 F.max("width").alias("width")))


def zones(pixels: DataFrame, mask: str = "mask", source: str = "v",
          tile: int = TILE) -> DataFrame:
    """Mean per side and zone. Each side is cut in three by the height of its box; the
    last row of the box belongs to no zone; a zone without pixels has mean 0."""
    boxes = side_boxes(pixels, mask)
    keys = frame_keys(pixels)
    spans = boxes.groupBy(*keys).agg(
        F.max("height").alias("height"), F.max("width").alias("width"),
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"_{s}_{c}")
          for s in ("left", "right") for c in ("y0", "y1")])

    def pick(c):
        return F.when(side() == "left", F.col(f"_left_{c}")).otherwise(F.col(f"_right_{c}"))
    y0, y1 = pick("y0"), pick("y1")
    third = F.floor((y1 - y0) / 3)
    zone = (F.when(F.col("y") < y0 + third, "fore").when(F.col("y") < y0 + 2 * third, "mid")
            .when(F.col("y") < y1, "heel"))
    found = (attach(pixels.where(F.col(mask)), spans, tile)
             .select(*keys, side().alias("side"), zone.alias("zone"), F.col(source).alias("v"))
             .where("zone is not null").groupBy(*keys, "side", "zone")
             .agg(F.count("*").alias("px"), F.sum(F.col("v").cast("long")).alias("s")))
    every = boxes.select(*keys, "side", F.explode(F.array(*map(F.lit, ZONES))).alias("zone"))
    zero = F.lit(0).cast("long")
    return every.join(found, [*keys, "side", "zone"], "left").select(
        *keys, "side", "zone", F.coalesce("px", zero).alias("px"),
        F.coalesce(_mean("s", "px"), F.lit(0.0)).alias("mean_v"))


def zone_deltas(zone_table: DataFrame) -> DataFrame:
    """Difference per zone of frames that have both sides, with its class."""
    # 15 and 10 grey levels.
    delta = F.abs(F.col("left") - F.col("right"))
    keys = frame_keys(zone_table)
    return (zone_table.groupBy(*keys, "zone").pivot("side", ["left", "right"])
            .agg(F.max("mean_v"))
            .where("left is not null and right is not null")
            .select(*keys, "zone", F.col("left").alias("left_mean"),
                    F.col("right").alias("right_mean"), delta.alias("delta"),
                    F.when(delta >= 15, "asymmetric").when(delta >= 10, "borderline")
                    .otherwise("symmetric").alias("class")))


def largest_zone_delta(zone_table: DataFrame) -> DataFrame:
    """Largest zone difference per frame; a missing side counts as 0."""
    keys = frame_keys(zone_table)

    def mean_of(s):
        return F.coalesce(F.max(F.when(F.col("side") == s, F.col("mean_v"))), F.lit(0.0))
    per_zone = zone_table.groupBy(*keys, "zone").agg(
        F.abs(mean_of("left") - mean_of("right")).alias("d"))
    return per_zone.groupBy(*keys).agg(F.max("d").alias("max_zone_delta"))


def roi_stats(pixels: DataFrame, rois: DataFrame, source: str = "v",
              tile: int = rectangles.TILE) -> DataFrame:
    """Min, max, mean and spread of rectangles given by two corners, half open.

    Every tile that a rectangle touches answers in constant time from its summed-area table.
    Rectangles thinner than two pixels are ignored.
    """
    box = rois.select("roi_id", "frame_id",
                      F.least("x1", "x2").alias("x1"), F.greatest("x1", "x2").alias("x2"),
                      F.least("y1", "y2").alias("y1"), F.greatest("y1", "y2").alias("y2"))
    sums = rectangles.rectangle_sums(pixels, box.where("x2 - x1 >= 2 and y2 - y1 >= 2"), source, tile)
    mean = _mean("s", "px")
    return sums.select("roi_id", "frame_id", "px", "min_v", "max_v", mean.alias("mean_v"),
                       F.sqrt(F.greatest(_mean("ss", "px") - mean * mean, F.lit(0.0)))
                       .alias("std_v"))


def probe_points(pixels: DataFrame, points: DataFrame, frames: DataFrame, t_min: float = 20.0,
                 t_max: float = 40.0, hot: str = "hot", source: str = "v") -> DataFrame:
    """Value, temperature and hot flag at points; coordinates are pulled into the frame.

    ``frames`` gives height and width per frame.
    """
    def inside(pos, size):
        return F.least(F.greatest(F.col(pos), F.lit(0)), F.col(size) - 1).alias(pos)
    at = points.join(frames.select("frame_id", "height", "width"), "frame_id").select(
        "point_id", "frame_id", inside("y", "height"), inside("x", "width"))
    return at.join(pixels.select("frame_id", "y", "x", F.col(source).alias("v"),
                                 F.col(hot).alias("is_hotspot")), ["frame_id", "y", "x"]) \
        .withColumn("celsius", to_celsius(F.col("v"), t_min, t_max))
