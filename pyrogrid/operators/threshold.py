"""Outlier thresholds and surface statistics, taken from exact integer sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .segmentation import histogram
from .tiles import TILE, attach, frame_keys, tiled

# Normal-consistency factor of the MAD, bounds of a threshold.
MAD_SCALE = 1.4826
LOWEST, HIGHEST = 0.0, 254.0


def _sizes(df):
    return [F.max("height").alias("height"), F.max("width").alias("width")]


def _sum(column):
    return F.sum(F.col(column).cast("long"))


def moments(mask: DataFrame, diff: str = "diff", img: str = "v") -> DataFrame:
    """Count, sums and sum of squares per frame of the pixels inside a mask."""
    d = F.col(diff).cast("long")
    return mask.groupBy(*frame_keys(mask)).agg(
        F.count("*").alias("n"), F.sum(d).alias("s_diff"), F.sum(d * d).alias("ss_diff"),
        _sum(img).alias("s_img"), *_sizes(mask))


def _ratio(a, b):
    return F.col(a).cast("double") / F.col(b)


def moments_from_counts(diff_hist: DataFrame, img_hist: DataFrame) -> DataFrame:
    """The same sums from histograms of the masked pixels."""
    keys = frame_keys(diff_hist)
    d, n = F.col("v").cast("long"), F.col("n")
    img = img_hist.groupBy(*keys).agg(F.sum(d * n).alias("s_img"))
    return diff_hist.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.sum(d * n).alias("s_diff"), F.sum(d * d * n).alias("ss_diff"),
        *_sizes(diff_hist)).join(img, keys)


def gauss_statistics(sums: DataFrame, sample: bool = False) -> DataFrame:
    """centre, sigma, baseline per frame from its moments; population sigma unless ``sample``."""
    mu = _ratio("s_diff", "n")
    if sample:
        spread = (F.col("ss_diff") - F.col("s_diff").cast("double") * F.col("s_diff") / F.col("n"))
        variance = F.when(F.col("n") > 1, spread / (F.col("n") - 1))
    else:
        variance = _ratio("ss_diff", "n") - mu * mu
    return sums.select(
        *frame_keys(sums), "height", "width", F.col("n").alias("body_px"),
        mu.alias("centre"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sigma"),
        _ratio("s_img", "n").alias("baseline"))


def median(hist: DataFrame, lower: bool = False, value: str = "v") -> DataFrame:
    """Median per frame from a histogram; the lower middle value if ``lower``."""
    keys = frame_keys(hist)
    if not lower:
        return hist.groupBy(*keys).agg(
            F.percentile(value, F.lit(0.5), F.col("n")).alias("median"),
            F.sum("n").alias("n"), *_sizes(hist))
    frame = Window.partitionBy(*keys)
    upto = frame.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (hist.withColumn("_upto", F.sum("n").over(upto))
            .withColumn("_all", F.sum("n").over(frame))
            .where(F.col("_upto") * 2 >= F.col("_all"))
            .groupBy(*keys).agg(F.min(value).cast("double").alias("median"),
                                F.max("_all").alias("n"), *_sizes(hist)))


def mad_statistics(masked: DataFrame, diff: str = "diff", img: str = "v",
                   lower: bool = False) -> DataFrame:
    """Median, scaled median absolute deviation and median baseline per frame."""
    return mad_from_counts(histogram(masked, diff), histogram(masked, img), lower)


def mad_from_counts(diff_hist: DataFrame, img_hist: DataFrame, lower: bool = False) -> DataFrame:
    keys = frame_keys(diff_hist)
    centre = median(diff_hist, lower).select(
        *keys, F.col("median").alias("centre"), F.col("n").alias("body_px"), "height", "width")
    off = (diff_hist.join(centre.select(*keys, "centre"), keys)
           .withColumn("dev", F.abs(F.col("v") - F.col("centre"))))
    mad = median(off, lower, "dev").select(*keys, F.col("median").alias("mad"))
    base = median(img_hist, lower).select(*keys, F.col("median").alias("baseline"))
    return centre.join(mad, keys).join(base, keys).select(
        *keys, "height", "width", "body_px", "centre",
        (F.lit(MAD_SCALE) * F.col("mad")).alias("sigma"), "baseline",
        (F.col("mad") == 0).alias("mad_is_zero"))


def cut(statistics: DataFrame, sigma_k, clamp: bool = True) -> DataFrame:
    """centre + k sigma as ``diff_threshold``."""
    k = F.col(sigma_k) if isinstance(sigma_k, str) else F.lit(float(sigma_k))
    level = F.col("centre") + k * F.col("sigma")
    if clamp:
        level = F.least(F.greatest(level, F.lit(LOWEST)), F.lit(HIGHEST))
    return statistics.withColumn("diff_threshold", level)


def outlier_threshold(pixels: DataFrame, sigma_k: float = 3.0, use_mad: bool = False,
                      mask: str = "mask", diff: str = "diff", img: str = "v",
                      variant: str = "native") -> DataFrame:
    """Threshold and baseline per frame over the masked pixels.

    ``variant="accelerator"`` uses the sample sigma, the lower median and no clamp.
    """
    masked = pixels.where(mask)
    other = variant == "accelerator"
    stats = (mad_statistics(masked, diff, img, other) if use_mad
             else gauss_statistics(moments(masked, diff, img), other))
    return cut(stats, sigma_k, clamp=not other)


def outliers(pixels: DataFrame, thresholds: DataFrame, diff: str = "diff", img: str = "v",
             tile: int = TILE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pixels above both threshold and baseline, anywhere in the frame.

    ``thresholds`` may hold several runs per frame. ``carry`` names further columns of it
    to keep on the pixels.
    """
    joined = attach(tiled(pixels, tile), thresholds.select(
        *frame_keys(thresholds), "height", "width", "diff_threshold", "baseline", *carry), tile)
    return joined.where((F.col(diff) > F.col("diff_threshold"))
                        & (F.col(img) > F.col("baseline"))) \
        .drop("diff_threshold", "baseline")


def intensity_histogram(masked: DataFrame, bins: int = 128, t_min: float = 20.0,
                        t_max: float = 40.0, source: str = "v") -> DataFrame:
    """Equal bins between the frame's extremes, in degrees; the last bin is closed.

    Works on grey-value counts, so the number of pixels does not matter. A flat frame is
    centred in a one-degree range.
    """
    keys = frame_keys(masked)
    hist = histogram(masked, source)
    ends = hist.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("hi") == F.col("lo")
    place = F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int")
    span = F.lit(t_max - t_min) / F.lit(255.0)
    width = F.when(flat, F.lit(1.0 / bins)).otherwise(
        (F.col("hi") - F.col("lo")) * span / F.lit(bins))
    first = F.lit(t_min) + F.col("lo") * span - F.when(flat, F.lit(0.5)).otherwise(0.0)
    return (hist.join(ends, keys)
            .withColumn("bin", F.when(flat, bins // 2)
                        .otherwise(F.least(place, F.lit(bins - 1))))
            .groupBy(*keys, "bin", "lo", "hi").agg(F.sum("n").alias("px"))
            .select(*keys, "bin", (first + F.col("bin") * width).alias("from_c"),
                    (first + (F.col("bin") + 1) * width).alias("to_c"), "px"))


def surface_statistics(pixels: DataFrame, sigma_k: float = 3.0, mask: str = "mask",
                       hot: str = "hot", source: str = "v") -> DataFrame:
    """Mean, spread and display threshold of the body, and the share of hot pixels.

    A frame without a body keeps its row: no means, no share, status ``empty_body_mask``.
    """
    v = F.when(F.col(mask), F.col(source).cast("long"))
    sums = pixels.groupBy(*frame_keys(pixels)).agg(
        F.count(v).alias("body_px"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"),
        F.max(F.when(F.col(mask), F.col(source))).alias("max_v"), F.count_if(F.col(hot)).alias("hotspot_px"))
    some = F.col("body_px") > 0
    mean = F.when(some, _ratio("s", "body_px"))
    spread = F.when(some, _ratio("ss", "body_px")) - mean * mean
    # greatest() skips nulls, so the guard stays outside.
    sd = F.when(some, F.sqrt(F.greatest(spread, F.lit(0.0))))
    return sums.select(
        *frame_keys(pixels), "body_px", mean.alias("mean_v"), sd.alias("std_v"),
        (mean + F.lit(float(sigma_k)) * sd).alias("intensity_threshold"), "max_v", "hotspot_px",
        F.when(some, F.col("hotspot_px") / F.col("body_px") * 100.0).alias("hotspot_percent"),
        F.when(some, "ok").otherwise("empty_body_mask").alias("body_status"))


def coverage(pixels: DataFrame, mask: str = "mask", hot: str = "hot") -> DataFrame:
    """Hot share of the body in percent, two decimals, with dimensions and status."""
    share = F.when(F.col("body_px") > 0,
                   F.col("hotspot_px") / F.col("body_px") * 100.0).otherwise(0.0)
    return (pixels.groupBy(*frame_keys(pixels))
            .agg(F.count_if(F.col(mask)).alias("body_px"),
                 F.count_if(F.col(hot)).alias("hotspot_px"), *_sizes(pixels))
            .withColumn("coverage_percent", F.bround(share, 2))
            .withColumn("status", F.when(F.col("body_px") > 0, "ok")
                        .otherwise("empty_body_mask")))


def coverage_summary(per_frame: DataFrame) -> DataFrame:
    return per_frame.agg(F.count("*").alias("frames"),
                         F.avg("coverage_percent").alias("mean_coverage"),
                         F.max("coverage_percent").alias("max_coverage"))
