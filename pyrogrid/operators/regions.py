"""Measures of connected components, geometric filter, hotspot tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..params import Params
from .components import components, with_boundary
from .ranking import places
from .tiles import TILE, div, frame_keys, tiled


def region_stats(mask: DataFrame, border_margin: int = 10, connectivity: int = 4,
                 depth: str = "dist3", value: str = "v",
                 tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(labelled pixels, one row per component) of a sparse mask."""
    labelled = components(with_boundary(mask, tile), connectivity, tile)
    return labelled, measure(labelled, border_margin, depth, value)


def measure(labelled: DataFrame, border_margin: int = 10, depth: str = "dist3",
            value: str = "v") -> DataFrame:
    keys = frame_keys(labelled)
    m = F.col("border_margin") if "border_margin" in labelled.columns else F.lit(border_margin)
    touches = ((F.col("x") <= m) | (F.col("y") <= m) | (F.col("x") >= F.col("width") - 1 - m)
               | (F.col("y") >= F.col("height") - 1 - m))

    def total(c):
        return F.sum(F.col(c).cast("long"))
    return with_shape(labelled.groupBy(*keys, "comp_id").agg(
        F.count("*").alias("area"), F.count_if("boundary").alias("perimeter"),
        F.bool_or(touches).alias("touches_border"), F.max(depth).alias("max_dist3"),
        total("y").alias("s_y"), total("x").alias("s_x"), total(value).alias("s_v"),
        F.max(value).alias("max_v"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"),
        F.max("y").alias("y1"), F.max("height").alias("height"), F.max("width").alias("width")))


def with_shape(regions: DataFrame) -> DataFrame:
    """Centre, mean and circularity from the sums of a region."""
    def mean(total):
        return F.col(total).cast("double") / F.col("area")
    return regions.withColumns({
        "centroid_y": mean("s_y"), "centroid_x": mean("s_x"), "mean_v": mean("s_v"),
        "circularity": F.lit(4.0 * math.pi) * F.col("area") / (F.col("perimeter") * F.col("perimeter"))
    }).drop("s_y", "s_x", "s_v")


def reject_reasons(regions: DataFrame, variant: str = "native") -> DataFrame:
    """First rule a region breaks, NULL if none.

    Needs the run's parameters and ``body_px`` as columns. ``variant="bbox"`` tests the
    area before the border, and scales the depth limit by the frame width.
    """
    size = F.col("width") if variant == "bbox" else F.least("height", "width")
    depth_limit = F.greatest(F.col("min_dist_abs"), F.col("min_dist_factor") * size)
    area_limit = F.greatest(F.col("min_area_abs").cast("double"),
                            F.col("min_area_factor") * F.col("body_px"))
    rules = {
        "position": F.col("centroid_y") > F.col("height") * F.col("lower_cutoff_y"),
        "border": F.col("touches_border"),
        "depth": F.col("max_dist3") / 3.0 < depth_limit,
        "area": F.col("area") < area_limit,
        "shape": F.col("circularity") < F.col("min_circularity")}
    order = (["position", "area", "border", "depth", "shape"] if variant == "bbox"
             else ["position", "border", "depth", "area", "shape"])
    reason = F.lit(None).cast("string")
    for name in reversed(order):
        reason = F.when(rules[name], name).otherwise(reason)
    return regions.withColumn("reject_reason", reason)


RULE_COLUMNS = ("min_area_factor", "min_circularity", "lower_cutoff_y", "min_dist_factor",
                "min_dist_abs", "min_area_abs")


def filter_regions(regions: DataFrame, bodies: DataFrame, params: Params | None = None,
                   variant: str = "native") -> DataFrame:
    """Regions with ``reject_reason``; ``bodies`` holds ``body_px`` per frame."""
    keys = frame_keys(bodies)
    columns = ["body_px"]
    if params is not None:
        bodies = bodies.withColumns({c: F.lit(getattr(params, c)) for c in RULE_COLUMNS})
    columns += RULE_COLUMNS
    joined = regions.join(bodies.select(*keys, *columns), keys)
    return reject_reasons(joined, variant).drop(*columns)


def kept_pixels(labelled: DataFrame, judged: DataFrame) -> DataFrame:
    keys = frame_keys(judged)
    kept = judged.where(F.col("reject_reason").isNull()).select(*keys, "comp_id")
    return labelled.join(kept, [*keys, "comp_id"], "left_semi")


def fill_holes(kept: DataFrame, regions: DataFrame, tile: int = TILE) -> DataFrame:
    """Pixels of kept regions plus everything they enclose.

    Per region, the rest of its bounding box falls into components; those that do not
    reach the rim of the box are holes. Boxes are spread row by row before columns.
    """
    keys = frame_keys(kept)
    region = [*keys, "comp_id"]
    boxes = kept.select(*region).distinct().join(
        regions.select(*region, "x0", "y0", "x1", "y1", "height", "width"), region)
    rows = (boxes.where((F.col("x1") - F.col("x0") > 1) & (F.col("y1") - F.col("y0") > 1))
            .withColumn("band", F.explode(F.sequence(div("y0", tile), div("y1", tile))))
            .withColumn("y", F.explode(F.sequence(
                F.greatest(F.col("y0"), F.col("band") * tile),
                F.least(F.col("y1"), (F.col("band") + 1) * tile - 1))))
            .repartition(*region, "y"))
    cells = rows.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("band")
    rest = (cells.join(kept.select(*region, "y", "x"), [*region, "y", "x"], "left_anti")
            .withColumnRenamed("comp_id", "region_id"))
    holes = components(rest, 4, tile, [*keys, "region_id"])
    open_ended = ((F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1"))
                  | (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1")))
    hole = [*keys, "region_id", "comp_id"]
    closed = holes.groupBy(*hole).agg(F.bool_or(open_ended).alias("o")).where("not o").drop("o")
    inner = holes.join(closed, hole, "left_semi").select(
        *keys, F.col("region_id").alias("comp_id"), "y", "x")
    return kept.select(*region, "y", "x").unionByName(inner)


def hotspot_table(regions: DataFrame) -> DataFrame:
    """Components ranked by area, ties by first pixel; a frame with any number of regions is ranked
    by many tasks."""
    keys = frame_keys(regions)
    ranked = places(regions.withColumn("_largest", -F.col("area")), keys, ["_largest", "comp_id"], "rank")
    return ranked.select(
        *keys, F.col("rank").cast("int").alias("rank"), "comp_id", "area", "mean_v", "max_v",
        F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"),
                 (F.col("x1") - F.col("x0") + 1).alias("w"),
                 (F.col("y1") - F.col("y0") + 1).alias("h")).alias("bbox"),
        "centroid_y", "centroid_x", severity(F.col("area"), F.col("mean_v")).alias("severity"))


def severity(area, mean_v):
    # Limits in pixels and grey levels.
    return (F.when((area >= 150) | (mean_v >= 180), "relevant")
            .when((area >= 50) | (mean_v >= 140), "borderline").otherwise("minor"))


def finding(hotspot_px):
    # Fixed value: 150 pixels.
    return (F.when(hotspot_px == 0, "normal").when(hotspot_px < 150, "borderline")
            .otherwise("clinical"))


def hotspot_summary(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """Per frame: number, largest area, unweighted mean of means; frames without any stay."""
    keys = frame_keys(frames)
    per_frame = regions.groupBy(*keys).agg(
        F.count("*").alias("hotspots"), F.max("area").alias("largest_area"),
        F.sum("area").alias("hotspot_px"), F.avg("mean_v").alias("mean_of_means"))
    zero = F.lit(0).cast("long")
    return (frames.select(*keys).join(per_frame, keys, "left")
            .select(*keys, F.coalesce("hotspots", zero).alias("hotspots"),
                    F.coalesce("largest_area", zero).alias("largest_area"),
                    F.coalesce("hotspot_px", zero).alias("hotspot_px"),
                    F.coalesce("mean_of_means", F.lit(0.0)).alias("mean_of_means"))
            .withColumn("finding", finding(F.col("hotspot_px"))))
