"""Histogram, Otsu level and body threshold, all from at most 256 rows per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tiles import TILE, attach, frame_keys


def histogram(pixels: DataFrame, source: str = "v") -> DataFrame:
    """Pixels per grey value. Partial counts keep the shuffle at <= 256 rows per task."""
    return (pixels.groupBy(*frame_keys(pixels), F.col(source).alias("v"))
            .agg(F.count("*").alias("n"), F.max("height").alias("height"),
                 F.max("width").alias("width")))


def otsu(hist: DataFrame) -> DataFrame:
    """Level of the largest between-class variance; the lowest wins, flat frames give 0."""
    keys = frame_keys(hist)
    frame = Window.partitionBy(*keys)
    upto = frame.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)

    def real(c):
        return c.cast("double")
    sums = hist.select(
        *keys, "v", "n", "height", "width",
        F.sum("n").over(upto).alias("w_bg"),
        F.sum(F.col("v") * F.col("n")).over(upto).alias("s_bg"),
        F.sum("n").over(frame).alias("w"),
        F.sum(F.col("v") * F.col("n")).over(frame).alias("s"))
    w_fg = F.col("w") - F.col("w_bg")
    gap = real(F.col("s_bg")) / F.col("w_bg") - real(F.col("s") - F.col("s_bg")) / w_fg
    variance = F.when(w_fg > 0, real(F.col("w_bg")) * real(w_fg) * (gap * gap)).otherwise(0.0)
    best = F.max(F.struct(variance.alias("variance"), (-F.col("v")).alias("minus_v")))
    return (sums.groupBy(*keys)
            .agg(best.alias("best"), F.min("v").alias("v_min"), F.max("v").alias("v_max"),
                 F.max("height").alias("height"), F.max("width").alias("width"))
            .withColumn("otsu", F.when(F.col("best.variance") > 0, -F.col("best.minus_v"))
                        .otherwise(0).cast("int"))
            .drop("best"))


def body_level(otsu_level: Column, v_min: Column, v_max: Column,
               otsu_min: int = 35, otsu_max: int = 50) -> Column:
    """Half the Otsu level, or near the minimum in low contrast; kept in a fixed band."""
    span = v_max - v_min
    level = F.when(span < 30, F.floor(v_min + F.lit(0.3) * span)) \
        .otherwise(F.floor(otsu_level / 2))
    return F.least(F.greatest(level, F.lit(otsu_min)), F.lit(otsu_max)).cast("int")


def frame_levels(pixels: DataFrame, source: str = "v", otsu_min: int = 35,
                 otsu_max: int = 50) -> DataFrame:
    return levels_from_counts(histogram(pixels, source), otsu_min, otsu_max)


def levels_from_counts(hist: DataFrame, otsu_min: int = 35, otsu_max: int = 50) -> DataFrame:
    levels = otsu(hist)
    return levels.withColumn("body_threshold", body_level(
        F.col("otsu"), F.col("v_min"), F.col("v_max"), otsu_min, otsu_max))


def binarise(pixels: DataFrame, levels: DataFrame, source: str = "v", out: str = "fg",
             tile: int = TILE) -> DataFrame:
    joined = attach(pixels, levels.select(
        *frame_keys(levels), "height", "width", "body_threshold"), tile)
    return joined.withColumn(out, F.col(source) > F.col("body_threshold")) \
        .drop("body_threshold")


def normalise(pixels: DataFrame, source: str = "v", out: str = "norm",
              tile: int = TILE) -> DataFrame:
    """Stretch each frame to 0..255, truncating; flat frames become 0."""
    keys = frame_keys(pixels)
    ends = pixels.groupBy(*keys).agg(
        F.min(source).alias("_lo"), F.max(source).alias("_hi"),
        F.max("height").alias("height"), F.max("width").alias("width"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span == 0, 0).otherwise(
        F.floor((F.col(source) - F.col("_lo")) * 255.0 / span)).cast("int")
    return attach(pixels, ends, tile).withColumn(out, scaled).drop("_lo", "_hi")
