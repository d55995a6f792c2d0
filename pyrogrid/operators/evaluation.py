"""Comparison of masks and of pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..staging import checkpoint
from .tiles import div, frame_keys

# Rows and columns of a mask's bitmap: the number of bits that the built-in bitmaps hold.
BITMAP = (128, 256)


def rates(counts: DataFrame) -> DataFrame:
    """Ratios from tp, fp, fn, tn; an empty denominator counts as 1. Four decimals."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, F.bround(top.cast("double") / bottom, 4)).otherwise(1.0)
    return counts.withColumns({
        "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp),
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "dice": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn)})


def bitmaps(mask: DataFrame, keys: list[str]) -> DataFrame:
    """A sparse mask as packed bitmaps (``bits``) of tiles of BITMAP pixels, (by, bx) each. Pixels
    are set before the shuffle already; one that is listed twice counts once."""
    height, width = BITMAP
    spot = (F.col("y") % height * width + F.col("x") % width).cast("long")
    return (mask.withColumns({"by": div("y", height), "bx": div("x", width)})
            .groupBy(*keys, "by", "bx").agg(F.bitmap_construct_agg(spot).alias("bits")))


def both(a: DataFrame, b: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """Bits that are set in both tables of bitmaps: ``a`` by ``keys``, ``b`` by ``shared`` of them."""
    pairs = a.join(b.withColumnRenamed("bits", "_bits"), [*shared, "by", "bx"])
    return (pairs.select(*keys, "by", "bx", F.explode(F.array("bits", "_bits")).alias("bits"))
            .groupBy(*keys, "by", "bx").agg(F.bitmap_and_agg("bits").alias("bits")))


def set_bits(maps: DataFrame, keys: list[str], name: str) -> DataFrame:
    return maps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))


def confusion_metrics(predicted: DataFrame, truth: DataFrame, frames: DataFrame,
                      body: DataFrame | None = None) -> DataFrame:
    """Counts and rates per frame (and run) from sparse masks.

    ``frames`` lists every frame and run with height and width; both masks are cut to
    ``body`` if given, while true negatives count the whole frame. Masks meet as bitmaps, one row
    for thousands of pixels, and the truth is never repeated pixel by pixel for a run: misses are
    what it holds beyond the hits.
    """
    keys = frame_keys(frames)
    # Bitmaps are small and read several times; what they are made from may be costly.
    found, wanted = checkpoint(bitmaps(predicted, keys)), checkpoint(bitmaps(truth, ["frame_id"]))
    per_truth = ["frame_id"]
    if body is not None:
        per_truth = [k for k in frame_keys(body) if k in keys]
        inside = checkpoint(bitmaps(body, per_truth))
        found = both(found, inside, keys, per_truth)
        wanted = both(inside, wanted, per_truth, ["frame_id"])
    hits = both(found, wanted, keys, per_truth)
    zero = F.lit(0).cast("long")
    size = F.col("height").cast("long") * F.col("width")
    counted = (frames.select(*keys, "height", "width")
               .join(set_bits(found, keys, "found"), keys, "left").join(set_bits(hits, keys, "tp"), keys, "left")
               .join(set_bits(wanted, per_truth, "expected"), per_truth, "left")
               .select(*keys, F.coalesce("tp", zero).alias("tp"),
                       (F.coalesce("found", zero) - F.coalesce("tp", zero)).alias("fp"),
                       F.coalesce("expected", zero).alias("expected"), size.alias("size"))
               .withColumn("fn", F.col("expected") - F.col("tp"))
               .withColumn("tn", F.col("size") - F.col("tp") - F.col("fp") - F.col("fn"))
               .drop("size", "expected"))
    return rates(counted)


def compare_frames(a: DataFrame, b: DataFrame, tolerance: float, column: str = "v") -> DataFrame:
    """Per frame: shared and unshared pixels, largest difference, pixels out of tolerance."""
    keys = [*frame_keys(a), "y", "x"]
    both = (a.select(*keys, F.col(column).alias("va"))
            .join(b.select(*keys, F.col(column).alias("vb")), keys, "full"))
    gap = F.abs(F.col("va") - F.col("vb"))
    return both.groupBy(*frame_keys(a)).agg(
        F.count(gap).alias("shared_px"), F.count_if(gap.isNull()).alias("unshared_px"),
        F.max(gap).alias("largest_gap"), F.count_if(gap > tolerance).alias("over_tolerance")) \
        .withColumn("equal", (F.col("unshared_px") == 0) & (F.col("over_tolerance") == 0))
