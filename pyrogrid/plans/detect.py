"""Hotspot detection over many frames, from pixels or from packed frames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import odd_kernel
from ..operators import neighbourhood, packed
from ..operators.distance import distance, erode_by_distance
from ..operators.regions import filter_regions, kept_pixels, region_stats, with_shape
from ..operators.segmentation import binarise, frame_levels, normalise
from ..operators.threshold import cut, gauss_statistics, mad_statistics, moments, outliers
from ..operators.tiles import TILE
from ..params import Params, as_list, with_run_of, with_runs
from ..sources.raster import explode_frames
from ..staging import keep, spread


@dataclass
class Detection:
    """Results of one detection; ``release`` frees the held stage tables."""
    pixels: DataFrame        # every pixel: v, blur, dist3, mask, diff (and run_id, see below)
    frame_stats: DataFrame   # one row per frame and run
    regions: DataFrame       # every raw component with its reject reason
    raw: DataFrame           # raw outlier pixels with comp_id
    hot: DataFrame           # pixels of kept components
    runs: list = field(default_factory=list)
    held: list = field(default_factory=list)

    # Runs with the same image stages share one copy of ``pixels``. Where runs differ in them,
    # every run has its own copy, told apart by ``run_id``.

    def release(self):
        for df in self.held:
            df.unpersist()

    def difference(self, tile: int = TILE) -> DataFrame:
        """Difference image stretched to 0..255 per frame (and run, where runs differ)."""
        return normalise(self.pixels, "diff", "diff_norm", tile)

    def flagged(self) -> DataFrame:
        """Every pixel with a ``hot`` column, once per run if there are several."""
        keys, pixels = ["frame_id", "y", "x"], self.pixels
        if len(self.runs) > 1:
            keys = ["frame_id", "run_id", "y", "x"]
            pixels = per_run(pixels, self.runs)
        marks = self.hot.select(*keys, F.lit(True).alias("hot"))
        return pixels.join(marks, keys, "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def per_run(pixels: DataFrame, runs: list[str]) -> DataFrame:
    """A copy of the pixels for each run, unless they have one already."""
    if "run_id" in pixels.columns:
        return pixels
    return pixels.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in runs])))


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


def _thresholds(gauss_of, mad_of, runs: list[Params]) -> DataFrame:
    """Threshold, baseline and parameters per frame and run."""
    parts = []
    gauss = [p for p in runs if not p.use_mad]
    mad = [p for p in runs if p.use_mad]
    if gauss:
        parts.append(with_runs(gauss_statistics(gauss_of())
                               .withColumn("mad_is_zero", F.lit(None).cast("boolean")), gauss))
    if mad:
        parts.append(with_runs(mad_of(), mad))
    return cut(_union(parts), "sigma_k")


def _judge(staged, levels, deepest, thresholds, labelled, regions, runs, held) -> Detection:
    judged = filter_regions(regions, thresholds)
    hot = kept_pixels(labelled, judged)
    keys = ["frame_id", "run_id"]
    # Counts come from the region rows, so pixels are not read again.
    counts = judged.groupBy(*keys).agg(
        F.sum("area").alias("raw_px"),
        F.sum(F.when(F.col("reject_reason").isNull(), F.col("area"))).alias("hotspot_px"))
    zero = F.lit(0).cast("long")
    stats = (with_runs(levels, runs).select(*keys, "height", "width", "tophat_factor", "otsu",
                                            "body_threshold")
             .join(deepest, "frame_id")
             .join(thresholds.select(*keys, "body_px", "diff_threshold", "baseline",
                                     "mad_is_zero"), keys, "left")
             .join(counts, keys, "left")
             .select(*keys, "height", "width", "otsu", "body_threshold",
                     F.coalesce("body_px", zero).alias("body_px"), "max_dist3",
                     odd_kernel(F.col("height"), F.col("width"), F.col("tophat_factor"))
                     .alias("kernel"), "diff_threshold", "baseline", "mad_is_zero",
                     F.coalesce("raw_px", zero).alias("raw_px"),
                     F.coalesce("hotspot_px", zero).alias("hotspot_px"),
                     F.when(F.col("body_px").isNull(), "empty_body_mask").otherwise("ok")
                     .alias("status")))
    spot = [*keys, "y", "x", "v", "blur", "dist3", "diff", "height", "width", "boundary", "comp_id"]
    return Detection(staged, stats, judged, labelled.select(*spot), hot.select(*spot),
                     [p.run_id for p in runs], held)


def _with_hats(pixels: DataFrame, factor: float, kernel: int | None, tile: int) -> DataFrame:
    """Blur and top-hat; the kernel is a column, so frames of all formats share one plan."""
    k = kernel if kernel is not None else odd_kernel(F.col("height"), F.col("width"), factor)
    return neighbourhood.blur_and_top_hat(pixels, k, min(tile, neighbourhood.TILE))


def _merge(found: list[Detection]) -> Detection:
    if len(found) == 1:
        return found[0]
    names = ("frame_stats", "regions", "raw", "hot")
    pixels = _union([per_run(d.pixels.drop("ty", "tx"), d.runs) for d in found])
    return Detection(pixels, *[_union([getattr(d, n).drop("ty", "tx") for d in found]) for n in names],
                     runs=[r for d in found for r in d.runs], held=[df for d in found for df in d.held])


def _by_stage(params) -> list[list[Params]]:
    groups: dict = {}
    for p in as_list(params):
        groups.setdefault(p.stage_key, []).append(p)
    return list(groups.values())


def image_stages(pixels: DataFrame, runs: list[Params], tile: int = TILE,
                 kernel: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """What runs with equal image stages share, and their thresholds: pixels with blur, distance,
    mask and difference; levels per frame; thresholds per frame and run; tables held meanwhile."""
    p = runs[0]
    hats = keep(_with_hats(pixels, p.tophat_factor, kernel, tile))
    levels = keep(frame_levels(hats, "blur", p.otsu_min, p.otsu_max))
    deep = keep(distance(binarise(hats, levels, "blur", tile=tile), tile))
    staged = erode_by_distance(deep, p.dist_erosion_factor, tile=tile).withColumn(
        "diff", F.when(F.col("mask"), F.col("tophat")).otherwise(0)).drop("fg", "tophat")
    masked = staged.where("mask")
    thresholds = keep(_thresholds(lambda: moments(masked, "diff", "blur"),
                                  lambda: mad_statistics(masked, "diff", "blur"), runs))
    return staged, levels, thresholds, [hats, levels, deep, thresholds]


def detect_hotspots(pixels: DataFrame, params=Params(), tile: int = TILE,
                    kernel: int | None = None) -> Detection:
    """Blur, body mask, masked top-hat, threshold and geometric filter on dense pixels.

    ``params`` is one run or several; runs that differ only in later steps share the
    image stages. With several stage settings, ``pixels`` of the result holds one copy
    per run.
    """
    found = []
    for runs in _by_stage(params):
        staged, levels, thresholds, held = image_stages(pixels, runs, tile, kernel)
        # Thresholds are never negative, so pixels without difference cannot pass.
        raw = outliers(staged.where("diff > 0"), thresholds, "diff", "blur", tile,
                       carry=("border_margin",))
        deepest = staged.groupBy("frame_id").agg(F.max("dist3").alias("max_dist3"))
        labelled, regions = region_stats(raw, depth="dist3", value="v", tile=tile)
        found.append(_judge(staged, levels, deepest, thresholds, labelled, regions, runs,
                            held))
    return _merge(found)


def detect_frames(frames: DataFrame, params=Params(), tile: int = TILE) -> Detection:
    """The same detection on packed frames, of any size that one row can hold.

    Everything that needs only a frame happens in one pass over the rows; the rows are spread
    once, and only values per frame and component are shuffled afterwards. Outlier pixels (``raw``
    and ``hot``) and image stages (``pixels``) are made when they are read. Rows without pixels are
    reported with the status ``empty_frame``.
    """
    has_pixels = (F.col("height") > 0) & (F.col("width") > 0)
    small = spread(frames.where(has_pixels), "frame_id")
    nothing = frames.where(~F.coalesce(has_pixels, F.lit(False)))
    found = []
    for runs in _by_stage(params):
        passed = keep(packed.detected(small, runs))
        per_run = passed.where(F.col("comp_id").isNull()).drop(*packed._names(packed.REGIONS))
        names = F.array(*[F.lit(p.run_id) for p in runs])
        keys = ["frame_id", "run_id"]
        measured = with_run_of(per_run, runs).drop("run")
        spot = [*keys, "y", "x", "v", "blur", "dist3", "diff", "height", "width", "boundary", "comp_id"]
        labelled = keep(packed.outlier_pixels(small, runs).withColumn("run_id", names[F.col("run")]).select(*spot))
        regions = with_shape(passed.where(F.col("comp_id").isNotNull()).select(
            "frame_id", names[F.col("run")].alias("run_id"), "height", "width",
            *[c for c in packed._names(packed.REGIONS) if c != "deepest"], F.col("deepest").alias("max_dist3")))
        thresholds = measured.where(F.col("body_px").isNotNull())
        dense = explode_frames(packed.staged(small, runs[0]), "px", "blur", "dist3", "diff", "mask") \
            .withColumn("mask", F.col("mask") == 1)
        levels = measured.where(F.col("run_id") == runs[0].run_id).select(
            "frame_id", "height", "width", "otsu", "body_threshold")
        deepest = measured.where(F.col("run_id") == runs[0].run_id).select("frame_id", "max_dist3")
        part = _judge(dense, levels, deepest, thresholds, labelled, regions, runs, [passed, labelled])
        missing = with_runs(nothing.select("frame_id", "height", "width"), runs).select(
            *keys, "height", "width", F.lit("empty_frame").alias("status"))
        part.frame_stats = part.frame_stats.unionByName(missing, allowMissingColumns=True)
        found.append(part)
    return _merge(found)
