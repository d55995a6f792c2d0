"""Rule-based triage, batch summary and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.temperature import as_text, to_delta, to_unit
from .regions import finding
from .tiles import frame_keys


def triage_symmetry(hotspot_px: DataFrame, deltas: DataFrame, zone_delta: DataFrame) -> DataFrame:
    """Class from hot pixels, side difference and largest zone difference (grey levels)."""
    # 15 and 10 grey levels, 150 pixels.
    keys = frame_keys(hotspot_px)
    joined = (hotspot_px.select(*keys, "hotspot_px")
              .join(deltas.select(*keys, "delta"), keys, "left")
              .join(zone_delta.select(*keys, "max_zone_delta"), keys, "left")
              .withColumn("delta", F.coalesce("delta", F.lit(0.0)))
              .withColumn("max_zone_delta", F.coalesce("max_zone_delta", F.lit(0.0))))
    d, z, h = F.col("delta"), F.col("max_zone_delta"), F.col("hotspot_px")
    return joined.withColumn(
        "status", F.when((d >= 15) | (h >= 150) | (z >= 15), "clinical")
        .when((d >= 10) | (h > 0) | (z >= 10), "borderline").otherwise("normal"))


def symmetry_deltas(side_means: DataFrame) -> DataFrame:
    """Side difference for triage: an empty side counts as 0."""
    def mean(c):
        return F.coalesce(F.col(c), F.lit(0.0))
    return side_means.select(*frame_keys(side_means),
                             F.abs(mean("left_mean") - mean("right_mean")).alias("delta"))


def triage_general(summary: DataFrame) -> DataFrame:
    """Class from hot pixels alone, with component count and largest area."""
    return summary.select(*frame_keys(summary), "hotspot_px", "hotspots", "largest_area",
                          finding(F.col("hotspot_px")).alias("status"))


def batch_summary(triaged: DataFrame, mode: str = "symmetry", unit: str = "C",
                  t_min: float = 20.0, t_max: float = 40.0) -> DataFrame:
    """One text row per frame."""
    keys = frame_keys(triaged)
    if mode == "symmetry":
        def text(c):
            return as_text(to_delta(F.col(c), unit, t_min, t_max), unit)
        first, second = text("delta"), text("max_zone_delta")
    else:
        first = F.format_string("%d px", F.col("hotspots"))
        second = F.format_string("%d px", F.col("largest_area"))
    return triaged.select(*keys, F.format_string("%d px", F.col("hotspot_px")).alias("hotspots"),
                          first.alias("delta"), second.alias("zone_delta"), "status")


def report_rows(surface: DataFrame, deltas: DataFrame, zone_table: DataFrame,
                summary: DataFrame, unit: str = "C", t_min: float = 20.0,
                t_max: float = 40.0) -> DataFrame:
    """All measures of a frame in display units.

    Every input holds at most a few rows per frame, so the joins are between small
    per-frame tables.
    """
    keys = frame_keys(surface)

    def shown(c):
        return to_unit(F.col(c), unit, t_min, t_max)

    def gap(c):
        return to_delta(c, unit, t_min, t_max)
    wide = zone_table.groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when((F.col("side") == s) & (F.col("zone") == z), F.col("mean_v"))),
                   F.lit(0.0)).alias(f"{s}_{z}")
        for s in ("left", "right") for z in ("fore", "mid", "heel")])
    joined = (surface.join(deltas, keys, "left").join(wide, keys, "left")
              .join(summary.select(*keys, "hotspots", "largest_area", "finding"), keys, "left"))
    zone_columns = [shown(f"{s}_{z}").alias(f"{s}_{z}")
                    for s in ("left", "right") for z in ("fore", "mid", "heel")]
    zone_gaps = [gap(F.abs(F.col(f"left_{z}") - F.col(f"right_{z}"))).alias(f"delta_{z}")
                 for z in ("fore", "mid", "heel")]
    return joined.select(
        *keys, "body_px", "hotspot_px", "hotspot_percent", shown("mean_v").alias("mean"),
        gap(F.col("std_v")).alias("std"), shown("intensity_threshold").alias("threshold"),
        shown("max_v").alias("max"), shown("left_mean").alias("left_mean"),
        shown("right_mean").alias("right_mean"), gap(F.col("delta")).alias("delta"),
        F.col("status").alias("symmetry"), *zone_columns, *zone_gaps,
        "hotspots", "largest_area", "finding")
