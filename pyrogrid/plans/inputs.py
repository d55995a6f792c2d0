"""The given tables as frames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..operators.distance import body_mask
from ..params import Params
from ..sources.raster import explode_frames, rasterize
from .detect import Detection, detect_hotspots

# Rasters of tables are small and noisy, so the geometric rules are loosened.
RASTER = Params(run_id="raster", sigma_k=1.0, tophat_factor=0.1, dist_erosion_factor=0.01,
                min_circularity=0.01, lower_cutoff_y=1.0, min_dist_abs=0.0, min_area_abs=2,
                border_margin=0)
RASTER_NO_MARGIN = replace(RASTER, border_margin=-1)


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hundredths(c):
    return F.round(F.col(c) * 100).cast("long")


def events_raster(spark, folder) -> DataFrame:
    """Frame per event type, days by hours."""
    events = table(spark, folder, "events").select("ts", "event_type", "value")
    return rasterize(events, F.col("event_type"), F.dayofmonth("ts") - 1, F.hour("ts"),
                     hundredths("value"), 31, 24)


def lineitem_raster(spark, folder) -> DataFrame:
    """Frame per line number, suppliers by quantity."""
    items = table(spark, folder, "lineitem").select(
        "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, folder, "supplier").agg((F.max("s_suppkey") + 1).cast("int"))
    return rasterize(items, F.col("l_linenumber").cast("string"), F.col("l_suppkey"),
                     F.col("l_quantity") - 1, hundredths("l_extendedprice"), rows.scalar(), 50)


def embedding_frames(spark, folder) -> DataFrame:
    """Each vector as a packed 8 x 8 frame, stretched to 0..255."""
    e = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("frame_id"), F.lit(8).alias("height"),
        F.lit(8).alias("width"), "embedding")
    low = F.array_min("embedding").cast("double")
    span = F.array_max("embedding").cast("double") - low
    return e.select("frame_id", "height", "width", F.transform(
        "embedding", lambda c: F.when(span == 0, 0).otherwise(
            F.floor((c.cast("double") - low) * 255.0 / span)).cast("short")).alias("px"))


def embedding_pixels(spark, folder) -> DataFrame:
    return explode_frames(embedding_frames(spark, folder))


def enlarged_frames(spark, folder, factor: int = 4) -> DataFrame:
    """Embedding frames with every cell blown up to factor x factor pixels."""
    def wide(line):
        return F.flatten(F.transform(line, lambda v: F.array_repeat(v, factor)))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: wide(F.slice("px", y * 8 + 1, 8)))
    return embedding_frames(spark, folder).select(
        "frame_id", (F.col("height") * factor).alias("height"),
        (F.col("width") * factor).alias("width"),
        F.flatten(F.flatten(F.transform(rows, lambda r: F.array_repeat(r, factor)))).alias("px"))


RASTERS = {"events": events_raster, "lineitem": lineitem_raster, "embeddings": embedding_pixels}


def masked(spark, folder, raster: str) -> DataFrame:
    """Pixels with distance and body mask of the raw grey values."""
    return body_mask(RASTERS[raster](spark, folder), factor=RASTER.dist_erosion_factor)


def detected(spark, folder, raster: str, params=RASTER) -> Detection:
    return detect_hotspots(RASTERS[raster](spark, folder), params)
