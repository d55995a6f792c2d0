import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import pixels, scenario
from pyrogrid.operators import evaluation as ev
from pyrogrid.params import Params
from pyrogrid.plans.detect import detect_frames, detect_hotspots
from pyrogrid.schemas import TRUTH
from pyrogrid.sources.raster import assemble_frames

NAMES = ["normal", "ulcer", "fasciitis", "noise", "multi", "bimodal"]
RUNS = [Params(run_id="gauss"), Params(run_id="mad", use_mad=True)]

# frame, run: body, threshold, baseline, raw, kept, tp, fp, tn
EXPECTED = {
    ("normal", "gauss"): (45472, 0, 85, 0, 0, 0, 0, 160000),
    ("normal", "mad"): (45472, 0, 85, 0, 0, 0, 0, 160000),
    ("ulcer", "gauss"): (45472, 15.317519, 85.272299, 145, 145, 113, 32, 159855),
    ("ulcer", "mad"): (45472, 0, 85, 169, 169, 113, 56, 159831),
    ("fasciitis", "gauss"): (45472, 17.045106, 85.343090, 185, 185, 149, 36, 159815),
    ("fasciitis", "mad"): (45472, 0, 85, 213, 213, 149, 64, 159787),
    ("noise", "gauss"): (45472, 1.021221, 85.006729, 18, 0, 0, 0, 160000),
    ("noise", "mad"): (45472, 0, 85, 18, 0, 0, 0, 160000),
    ("multi", "gauss"): (45472, 22.374699, 85.561752, 294, 294, 230, 64, 159706),
    ("multi", "mad"): (45472, 0, 85, 342, 342, 230, 112, 159658),
    ("bimodal", "gauss"): (38626, 18.923687, 85.364237, 145, 145, 113, 32, 159855),
    ("bimodal", "mad"): (38626, 0, 85, 169, 169, 113, 56, 159831),
}
RATES = {("ulcer", "gauss"): (1.0, 0.9998, 0.7793, 0.8760),
         ("fasciitis", "gauss"): (1.0, 0.9998, 0.8054, 0.8922),
         ("multi", "gauss"): (1.0, 0.9996, 0.7823, 0.8779),
         ("multi", "mad"): (1.0, 0.9993, 0.6725, 0.8042),
         ("fasciitis", "mad"): (1.0, 0.9996, 0.6995, 0.8232),
         ("bimodal", "mad"): (1.0, 0.9996, 0.6686, 0.8014),
         ("noise", "gauss"): (1.0, 1.0, 1.0, 1.0)}


@pytest.mark.parametrize("path", ["windows", "packed"])
def test_scenarios(spark, path):
    frames = {n: scenario(n) for n in NAMES}
    px = pixels(spark, {n: f[0] for n, f in frames.items()})
    truth = spark.createDataFrame(pd.concat([
        pd.DataFrame(np.argwhere(f[1]), columns=["y", "x"]).assign(frame_id=n)[
            ["frame_id", "y", "x"]] for n, f in frames.items()]), TRUTH)
    if path == "windows":
        found = detect_hotspots(px, RUNS)
    else:
        found = detect_frames(assemble_frames(px), RUNS)
    stats = {(r.frame_id, r.run_id): r for r in found.frame_stats.collect()}
    metrics = {(r.frame_id, r.run_id): r for r in ev.confusion_metrics(
        found.hot, truth, found.frame_stats, found.pixels.where("mask")).collect()}
    for key, want in EXPECTED.items():
        s, m = stats[key], metrics[key]
        assert (s.otsu, s.body_threshold, s.max_dist3, s.kernel, s.status) == (37, 35, 180, 21, "ok")
        got = (s.body_px, round(s.diff_threshold, 6), round(s.baseline, 6), s.raw_px,
               s.hotspot_px, m.tp, m.fp, m.tn)
        assert got == want, key
        assert m.fn == 0
        if key in RATES:
            assert (m.sensitivity, m.specificity, m.precision, m.dice) == RATES[key]
    assert stats["ulcer", "mad"].mad_is_zero
    reasons = {r.reject_reason for r in found.regions.where("frame_id = 'noise'").collect()}
    assert reasons == {"area"}
    found.release()


def test_mixed_sizes_tiles_and_empty_frame(spark):
    parity = np.zeros((300, 300), int)
    parity[50:250, 50:250] = 80
    parity[100:110, 100:110] = 190
    parity[180:188, 180:188] = 150
    frames = {"parity": parity, "dark": np.zeros((40, 50), int)}
    px = pixels(spark, frames)
    packed = assemble_frames(px)
    for found in (detect_hotspots(px, tile=128), detect_frames(packed)):
        got = {r.frame_id: r for r in found.frame_stats.collect()}
        p = got["parity"]
        assert (p.body_px, p.kernel, round(p.diff_threshold, 6), p.hotspot_px) == (
            36864, 15, 17.817793, 228)
        assert found.regions.where("reject_reason is null").count() == 2
        assert (got["dark"].status, got["dark"].hotspot_px) == ("empty_body_mask", 0)
        found.release()


def test_spot_larger_than_kernel_is_invisible(spark):
    a = np.zeros((480, 640), int)
    a[100:380, 80:560] = 120
    a[150:230, 200:320] = 185
    found = detect_frames(assemble_frames(pixels(spark, {"f": a})), Params(min_circularity=0.01))
    s = found.frame_stats.first()
    assert (s.body_px, s.kernel, s.raw_px) == (125424, 25, 0)


def test_runs_with_different_stages(spark):
    img, _ = scenario("ulcer")
    runs = [Params(run_id="a"), Params(run_id="b", tophat_factor=0.02),
            Params(run_id="c", sigma_k=5.0)]
    found = detect_frames(assemble_frames(pixels(spark, {"f": img})), runs)
    got = {r.run_id: (r.kernel, r.raw_px) for r in found.frame_stats.collect()}
    single = {}
    for p in runs:
        s = detect_hotspots(pixels(spark, {"f": img}), p).frame_stats.first()
        single[p.run_id] = (s.kernel, s.raw_px)
    assert got == single
    assert got["a"][0] == 21 and got["b"][0] == 9


def test_joint_runs_equal_single_runs(spark):
    """Runs whose body, kernel or levels differ must not see each other's pixels."""
    img, truth = scenario("ulcer")
    truth_px = pixels(spark, {"f": np.asarray(truth, int)}).where("v > 0").select("frame_id", "y", "x")
    truth_px = truth_px.union(truth_px.limit(5))
    runs = [Params(run_id="a", dist_erosion_factor=0.05), Params(run_id="b", dist_erosion_factor=0.9),
            Params(run_id="c", tophat_factor=0.02, sigma_k=2.0), Params(run_id="d", otsu_min=60, otsu_max=90),
            Params(run_id="e", sigma_k=4.0)]
    for detect, source in ((detect_frames, assemble_frames(pixels(spark, {"f": img}))),
                           (detect_hotspots, pixels(spark, {"f": img}))):
        def rates(found):
            rows = ev.confusion_metrics(found.hot, truth_px, found.frame_stats, found.pixels.where("mask"))
            return {r.run_id: (r.tp, r.fp, r.fn, r.tn) for r in rows.collect()}

        joint, single = detect(source, runs), {}
        for p in runs:
            single |= rates(detect(source, p))
        assert rates(joint) == single
        flagged = joint.flagged()
        assert flagged.groupBy("frame_id", "run_id", "y", "x").count().where("count > 1").isEmpty()
        hot = {r.run_id: r.n for r in flagged.groupBy("run_id").agg(F.count_if("hot").alias("n")).collect()}
        assert hot == {r.run_id: r.hotspot_px for r in joint.frame_stats.collect()}
        assert set(joint.difference().select("run_id").distinct().toPandas()["run_id"]) == set("abcde")


def test_packed_pass_equals_pixel_path(spark):
    rng = np.random.default_rng(5)
    frames = {str(i): rng.integers(0, 256, (17 + i % 3, 23)) // (1 + i % 4) for i in range(9)}
    px = pixels(spark, frames)
    runs = [Params(run_id="g", sigma_k=0.5, border_margin=0, lower_cutoff_y=1.0),
            Params(run_id="m", sigma_k=1.0, use_mad=True, border_margin=-1)]
    left, right = detect_hotspots(px, runs, tile=8), detect_frames(assemble_frames(px), runs)
    for name in ("frame_stats", "regions", "raw", "hot"):
        a, b = getattr(left, name), getattr(right, name)
        columns = [c for c in a.columns if c not in ("ty", "tx")]
        assert sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect())), name


def test_rows_without_pixels_are_reported(spark):
    frames = spark.createDataFrame([("none", 0, 0, []), ("null", None, None, None), ("ok", 3, 3, [9] * 9)],
                                   "frame_id string, height int, width int, px array<smallint>")
    got = {r.frame_id: r.status for r in detect_frames(frames).frame_stats.collect()}
    assert got["none"] == got["null"] == "empty_frame" and got["ok"] != "empty_frame"


def test_equal_masks(spark):
    mask = spark.range(100).select(
        F.lit("f").alias("frame_id"), (F.col("id") / 10 + 10).cast("int").alias("y"),
        (F.col("id") % 10 + 10).cast("int").alias("x"))
    frames = spark.createDataFrame([("f", 100, 100), ("empty", 5, 5)],
                                   "frame_id string, height int, width int")
    for r in ev.confusion_metrics(mask, mask, frames).collect():
        assert (r.sensitivity, r.specificity, r.precision, r.dice, r.iou) == (1.0,) * 5
        assert r.fp == r.fn == 0


def test_compare_frames(spark):
    a = pixels(spark, {"f": np.arange(12).reshape(3, 4)})
    b = a.withColumn("v", F.when(F.col("x") == 0, F.col("v") + 3).otherwise(F.col("v")))
    assert ev.compare_frames(a, b, 4).first().equal
    row = ev.compare_frames(a, b.where("y < 2"), 2).first()
    assert (row.shared_px, row.unshared_px, row.over_tolerance, row.equal) == (8, 4, 2, False)
