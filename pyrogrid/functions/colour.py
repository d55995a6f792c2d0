"""False-colour overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Highlight colour (blue, green, red), weight of the image and of the highlight.
HIGHLIGHT_BGR = (85, 0, 255)
IMAGE_WEIGHT = 0.3
HIGHLIGHT_WEIGHT = 0.7


def grey_palette(spark) -> DataFrame:
    v = F.col("id").cast("int")
    return spark.range(256).select(
        F.lit("grey").alias("palette"), v.alias("v"), v.alias("b"), v.alias("g"), v.alias("r"))


def overlay(pixels: DataFrame, palettes: DataFrame, hot: str = "hot",
            palette: str = "grey") -> DataFrame:
    """Colour each pixel by the named palette and blend the highlight over hot pixels.

    ``palettes`` may hold several palettes; a grey value that the named one lacks stays grey.
    """
    colours = palettes.where(F.col("palette") == palette).select("v", "b", "g", "r")
    coloured = pixels.join(colours, "v", "left").withColumns(
        {n: F.coalesce(n, "v") for n in "bgr"})

    def blend(name, top):
        mixed = F.bround(F.col(name) * F.lit(IMAGE_WEIGHT) + F.lit(HIGHLIGHT_WEIGHT) * F.lit(float(top)), 0).cast("int")
        return F.when(F.col(hot), mixed).otherwise(F.col(name))
    return coloured.withColumns({n: blend(n, t) for n, t in zip("bgr", HIGHLIGHT_BGR)})
