"""Many runs over the same frames that differ in threshold and rules: regions and metrics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.component_tree import level_regions
from ..operators.evaluation import rates
from ..operators.regions import filter_regions
from ..operators.tiles import TILE
from ..params import Params
from .detect import _by_stage, image_stages


@dataclass
class Sweep:
    regions: DataFrame       # every component of every run, with its reject reason
    metrics: DataFrame | None  # counts and rates per frame and run, if there is a truth


def sweep(pixels: DataFrame, params: list[Params], truth: DataFrame | Column | None = None,
          tile: int = TILE, kernel: int | None = None) -> Sweep:
    """Regions of all runs from one component tree per frame and baseline.

    Metrics come from counts that the regions carry: how many of a region's pixels lie in the body
    and in the truth, a table (frame_id, y, x) or a condition on the pixels. No pixel is repeated
    for a run.
    """
    parts = []
    for runs in _by_stage(params):
        staged, levels, thresholds, _ = image_stages(pixels, runs, tile, kernel)
        if isinstance(truth, Column):
            staged = staged.withColumn("hit", F.col("mask") & F.coalesce(truth, F.lit(False)))
        elif truth is not None:
            marks = truth.select("frame_id", "y", "x", F.lit(True).alias("hit")).distinct()
            staged = (staged.join(marks, ["frame_id", "y", "x"], "left")
                      .withColumn("hit", F.col("mask") & F.coalesce("hit", F.lit(False))))
        counts = ("mask", "hit") if truth is not None else ()
        found = level_regions(staged, thresholds, img="blur", counts=counts, tile=tile)
        judged = filter_regions(found, thresholds)
        parts.append((judged.drop(*counts), _metrics(staged, levels, judged, runs) if counts else None))
    regions, metrics = zip(*parts)

    def union(tables):
        return reduce(lambda a, b: a.unionByName(b), tables)
    return Sweep(union(regions), union(metrics) if truth is not None else None)


def _metrics(staged: DataFrame, levels: DataFrame, judged: DataFrame, runs: list[Params]) -> DataFrame:
    keys = ["frame_id", "run_id"]
    expected = staged.groupBy("frame_id").agg(F.count_if("hit").alias("expected"))
    kept = judged.where("reject_reason is null").groupBy(*keys).agg(
        F.sum("mask").alias("found"), F.sum("hit").alias("tp"))
    zero = F.lit(0).cast("long")
    size = F.col("height").cast("long") * F.col("width")
    every = levels.select("frame_id", "height", "width").withColumn(
        "run_id", F.explode(F.array(*[F.lit(p.run_id) for p in runs])))
    counted = (every.join(expected, "frame_id").join(kept, keys, "left")
               .select(*keys, F.coalesce("tp", zero).alias("tp"),
                       (F.coalesce("found", zero) - F.coalesce("tp", zero)).alias("fp"), "expected", size.alias("size"))
               .withColumn("fn", F.col("expected") - F.col("tp"))
               .withColumn("tn", F.col("size") - F.col("tp") - F.col("fp") - F.col("fn"))
               .drop("size", "expected"))
    return rates(counted)
