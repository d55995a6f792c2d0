"""Evaluation and batch runs over frames, and over the image files of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.temperature import calibrate
from ..operators import packed, regional as rg, regions as reg, triage as tri
from ..params import Params
from ..sources.images import BATCH, EVALUATION, read_images
from ..sources.raster import assemble_frames
from ..sources.sinks import write_steps
from ..staging import keep
from .detect import Detection, detect_frames


def _with_status(frames: DataFrame, results: DataFrame) -> DataFrame:
    """Keep a row for every file; files without a result carry their read status."""
    read = frames.select("frame_id", F.col("status").alias("_read"))
    return (read.join(results, "frame_id", "left")
            .withColumn("status", F.when(F.col("_read") != "ok", F.col("_read"))
                        .otherwise(F.col("status"))).drop("_read"))


def evaluate_frames(frames: DataFrame, params: Params = Params()) -> DataFrame:
    """Dimensions, body and hotspot pixels and coverage per frame.

    ``frames`` has a read status; rows other than ``ok`` keep it and get no measures. The body
    is taken from the unsmoothed image here.
    """
    good = frames.where("status = 'ok' and height > 0 and width > 0").drop("status")
    hot = detect_frames(good, params).frame_stats.select("frame_id", "hotspot_px")
    share = F.when(F.col("body_px") > 0, F.col("hotspot_px") / F.col("body_px") * 100.0)
    rows = packed.raw_bodies(good, params).join(hot, "frame_id").select(
        "frame_id", "width", "height", "body_px", "hotspot_px",
        F.bround(F.coalesce(share, F.lit(0.0)), 2).alias("coverage_percent"),
        F.when(F.col("body_px") > 0, "ok").otherwise("empty_body_mask").alias("status"))
    return _with_status(frames, rows)


def evaluate_folder(spark: SparkSession, path: str, params: Params = Params()) -> DataFrame:
    """``evaluate_frames`` over the image files of a folder."""
    return evaluate_frames(keep(read_images(spark, path, EVALUATION)), params)


def _offset(frames: DataFrame, offset_c: float, p: Params) -> DataFrame:
    if not offset_c:
        return frames
    shifted = F.transform("px", lambda v: calibrate(
        v.cast("int"), F.lit(float(offset_c)), F.lit(p.temp_min_c), F.lit(p.temp_max_c))
        .cast("short"))
    return frames.withColumn("px", shifted)


def _grey(flag: str):
    return F.when(F.col(flag), 255).otherwise(0)


def batch_frames(frames: DataFrame, params: Params = Params(), mode: str = "symmetry",
                 temp_offset: float = 0.0, unit: str = "C", population: str = "body",
                 out: str | None = None) -> DataFrame:
    """One summary row per frame; step images go to ``out`` if given.

    ``frames`` has a read status; rows other than ``ok`` keep it and get no measures.
    ``population="nonzero_diff"`` takes side and zone means over pixels with a difference
    instead of the body.
    """
    good = _offset(frames.where("status = 'ok'").drop("status"), temp_offset, params)
    found = detect_frames(good, params)
    px = found.flagged()
    if out is not None:
        write_steps(step_frames(found), out)
    stats = found.frame_stats.drop("run_id")
    if mode == "symmetry":
        mask = "mask" if population == "body" else "_population"
        px = px.withColumn("_population", F.col("diff") > 0)
        triaged = tri.triage_symmetry(
            stats, tri.symmetry_deltas(rg.side_means(px, mask)),
            rg.largest_zone_delta(rg.zones(px, mask)))
    else:
        hot = found.hot.drop("comp_id", "boundary", "run_id")
        _, spots = reg.region_stats(hot, params.border_margin, 8)
        triaged = tri.triage_general(reg.hotspot_summary(stats, spots))
    summary = tri.batch_summary(triaged, mode, unit, params.temp_min_c, params.temp_max_c)
    empty = stats.where("status <> 'ok'").select("frame_id", F.col("status").alias("_empty"))
    summary = (summary.join(empty, "frame_id", "left")
               .withColumn("status", F.coalesce("_empty", "status")).drop("_empty"))
    return _with_status(frames, summary)


def run_batch(spark: SparkSession, path: str, params: Params = Params(), **options) -> DataFrame:
    """``batch_frames`` over the image files of a folder."""
    return batch_frames(keep(read_images(spark, path, BATCH)), params, **options)


def step_pixels(found: Detection) -> DataFrame:
    """Grey values of each processing step: frame_id, step, y, x, v, height, width."""
    px = found.flagged().join(found.difference().select("frame_id", "y", "x", "diff_norm"),
                              ["frame_id", "y", "x"])
    steps = F.array(*[F.struct(F.lit(n).alias("step"), c.cast("int").alias("v")) for n, c in {
        "original": F.col("v"), "mask": _grey("mask"), "hotspots": _grey("hot"),
        "difference": F.col("diff_norm")}.items()])
    return (px.select("frame_id", "y", "x", "height", "width", F.explode(steps).alias("s"))
            .select("frame_id", "s.step", "y", "x", "s.v", "height", "width"))


def step_frames(found: Detection) -> dict[str, DataFrame]:
    """Packed frames of each processing step."""
    cells = step_pixels(found)
    return {n: assemble_frames(cells.where(F.col("step") == n))
            for n in ("original", "mask", "hotspots", "difference")}
