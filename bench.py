"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from pyrogrid.plans.catalogue import QUERIES
from pyrogrid.plans.detect import detect_frames, detect_hotspots
from pyrogrid.plans.inputs import RASTER_NO_MARGIN, enlarged_frames, lineitem_raster
from pyrogrid.staging import release_kept

HEADLINE = ["raster_lineitem", "box_blur", "top_hat", "otsu_levels", "distance", "body_mask",
            "gauss_threshold", "roi_stats", "zones", "packed_blur_top_hat", "detect_frames_enlarged",
            "detect_hotspots"]
# Blown-up frames of the throughput run: 80 x 80 pixels each.
FACTOR = 10


def sink(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # Both paths once outside the timings: JVM, Python workers, compiled code.
    frames = enlarged_frames(spark, folder, FACTOR).persist()
    n = frames.count()
    pixels = n * (8 * FACTOR) ** 2
    for name in ("packed_blur_top_hat", "detect_hotspots"):
        sink(QUERIES[name](spark, folder))
    sink(detect_frames(frames.limit(200), RASTER_NO_MARGIN).frame_stats)
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        sink(QUERIES[name](spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
    release_kept()
    start = time.perf_counter()
    sink(detect_frames(frames, RASTER_NO_MARGIN).frame_stats)
    took = time.perf_counter() - start
    times["detect_throughput"] = round(took, 3)
    release_kept()
    # The pixel path on a raster that is made beforehand.
    raster = lineitem_raster(spark, folder).persist()
    cells = raster.count()
    start = time.perf_counter()
    sink(detect_hotspots(raster, RASTER_NO_MARGIN).frame_stats)
    tiled = time.perf_counter() - start
    times["detect_pixels"] = round(tiled, 3)
    release_kept()
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder).removeprefix("sf"),
        "throughput_frames": n, "throughput_pixels_per_sec": round(pixels / took),
        "ms_per_400x400_frame": round(took / pixels * 160000 * 1000, 3),
        "ms_per_400x400_pixel_path": round(tiled / cells * 160000 * 1000, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
