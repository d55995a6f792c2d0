import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import array, naive_distance, naive_labels, naive_window, pixels
from pyrogrid.operators import (
    components as comp, distance as dst, neighbourhood as nb, packed, regional as rg, sliding,
    regions as reg, segmentation as seg, threshold as thr)

def lines():
    """A flat line, a single peak, a radius beyond the line, and random lines."""
    rng = np.random.default_rng(31)
    peak = np.full(12, 40)
    peak[6] = 222
    return [(np.full(6, 17), 2), (peak, 3), (np.array([8, 90]), 5),
            *[(rng.integers(0, 256, n), r) for n, r in ((11, 1), (14, 2), (20, 4))]]


def test_window_vectors(spark):
    for radius in {r for _, r in lines()}:
        frames = {str(i): np.array([v]) for i, (v, r) in enumerate(lines()) if r == radius}
        df = nb.dilate(nb.erode(pixels(spark, frames), 2 * radius + 1, tile=4),
                       2 * radius + 1, tile=4)
        for name, a in frames.items():
            for column, pick in (("eroded", np.min), ("dilated", np.max)):
                assert (array(df, column, a.shape, name)
                        == naive_window(a, 2 * radius + 1, pick)).all()


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(7).integers(0, 256, (23, 31))


@pytest.mark.parametrize("tile", [8, 512])
def test_morphology_across_tiles(spark, noise, tile):
    k = 5
    df = pixels(spark, {"f": noise})
    eroded = naive_window(noise, k, np.min)
    opened = naive_window(eroded, k, np.max)
    closed = naive_window(naive_window(noise, k, np.max), k, np.min)
    df = nb.top_hat(nb.closing(nb.opening(df, k, tile=tile), k, tile=tile), k, tile=tile)
    assert (array(df, "opened", noise.shape) == opened).all()
    assert (array(df, "closed", noise.shape) == closed).all()
    assert (array(df, "tophat", noise.shape) == noise - opened).all()
    assert (opened <= noise).all() and (noise <= closed).all()
    again = nb.opening(df, k, source="opened", out="again", tile=tile)
    assert (array(again, "again", noise.shape) == opened).all()


@pytest.mark.parametrize("tile", [7, 512])
def test_blur_and_ellipse(spark, noise, tile):
    df = nb.top_hat_ellipse(nb.box_blur(pixels(spark, {"f": noise}), tile), 5, tile=tile)
    blur = noise.copy()
    for y in range(1, 22):
        for x in range(1, 30):
            blur[y, x] = noise[y - 1:y + 2, x - 1:x + 2].sum() // 9
    assert (array(df, "blur", noise.shape) == blur).all()
    assert (packed.blur_frame(noise) == blur).all()
    cells = [(dy, dx) for dy, c in sliding.chords(5).items() for dx in range(-c, c + 1)]

    def stencil(a, pick):
        return np.array([[pick([a[y + dy, x + dx] for dy, dx in cells
                                if 0 <= y + dy < 23 and 0 <= x + dx < 31])
                          for x in range(31)] for y in range(23)])
    assert (array(df, "tophat", noise.shape) == noise - stencil(stencil(noise, min), max)).all()


@pytest.mark.parametrize("tile", [5, 512])
def test_distance(spark, tile):
    rng = np.random.default_rng(3)
    frames = {"sparse": rng.random((19, 17)) < 0.97, "dense": rng.random((9, 30)) < 0.6,
              "full": np.ones((11, 6), bool), "empty": np.zeros((4, 4), bool),
              "thin": np.array([[True], [True], [False], [True]])}
    one = np.ones((13, 16), bool)
    one[12, 15] = False
    frames["corner"] = one
    df = pixels(spark, frames).withColumn("fg", F.col("v") == 1)
    got = dst.distance(df, tile)
    for name, fg in frames.items():
        assert (array(got, "dist3", fg.shape, name) == naive_distance(fg)).all(), name


@pytest.mark.parametrize("connectivity,tile", [(4, 6), (8, 6), (8, 512)])
def test_components(spark, connectivity, tile):
    rng = np.random.default_rng(11)
    snake = np.zeros((13, 13), bool)
    snake[::2] = True
    snake[1::4, -1] = True
    snake[3::4, 0] = True
    masks = {"a": rng.random((12, 15)) < 0.55, "b": rng.random((5, 17)) < 0.4, "snake": snake,
             "all": np.ones((12, 12), bool)}
    df = pixels(spark, masks).where("v = 1")
    got = comp.components(df.repartition(3), connectivity, tile).toPandas()
    for name, mask in masks.items():
        want = naive_labels(mask, connectivity)
        mine = got[got.frame_id == name]
        assert len(mine) == mask.sum()
        assert (mine.comp_id.to_numpy() == want[mine.y, mine.x]).all()


def test_fill_holes_and_ranking(spark):
    a = np.zeros((30, 30), int)
    a[3:12, 3:12] = 1
    a[5:10, 5:10] = 0
    a[7, 7] = 1                     # inside the ring, a region of its own
    a[20:22, 20:22] = 1
    a[20:22, 25:27] = 1
    df = pixels(spark, {"f": a}).where("v = 1").withColumn("dist3", F.lit(9))
    for tile in (512, 8):
        labelled, regions = reg.region_stats(df, 0, 8, tile=tile)
        rows = {r.comp_id: r for r in regions.collect()}
        ring = rows[3 * 30 + 3]
        # 32 outer and 20 inner pixels: the four inner corners have all their neighbours.
        assert (ring.area, ring.perimeter) == (56, 52)
        filled = reg.fill_holes(labelled, regions, tile)
        assert filled.where(f"comp_id = {3 * 30 + 3}").count() == 81
        assert filled.count() == 81 + 1 + 4 + 4
        ranks = [(r["rank"], r.comp_id, r.area) for r in
                 reg.hotspot_table(regions).orderBy("rank").collect()]
        assert ranks == [(1, 93, 56), (2, 620, 4), (3, 625, 4), (4, 217, 1)]


def test_reject_reasons(spark):
    a = np.zeros((60, 60), int)
    a[0:4, 0:4] = 1      # border
    a[50:54, 30:34] = 1  # low
    a[20:22, 20:22] = 1  # small
    a[12, 12:52] = 1     # thin
    a[25:33, 30:38] = 1  # kept
    df = pixels(spark, {"f": a}).where("v = 1").withColumn("dist3", F.lit(90))
    from pyrogrid.params import Params
    p = Params(min_area_abs=10, border_margin=2, min_circularity=0.5)
    _, regions = reg.region_stats(df, p.border_margin)
    bodies = spark.createDataFrame([("f", 100)], "frame_id string, body_px long")
    got = {(r.y0, r.x0): r.reject_reason
           for r in reg.filter_regions(regions, bodies, p).collect()}
    assert got == {(0, 0): "border", (50, 30): "position", (20, 20): "area", (12, 12): "shape",
                   (25, 30): None}
    shallow = regions.withColumn("max_dist3", F.lit(3))
    got = {r.reject_reason for r in reg.filter_regions(shallow, bodies, p).collect()}
    assert got == {"border", "position", "depth"}


def test_otsu_edges(spark):
    two = np.full((6, 6), 10)
    two[:, 3:] = 200
    frames = {"flat": np.full((4, 5), 90), "two": two, "zero": np.zeros((1, 7), int)}
    got = {r.frame_id: (r.otsu, r.body_threshold)
           for r in seg.frame_levels(pixels(spark, frames)).collect()}
    assert got == {"flat": (0, 50), "two": (10, 35), "zero": (0, 35)}
    norm = seg.normalise(pixels(spark, frames))
    assert array(norm, "norm", (4, 5), "flat").max() == 0
    assert set(array(norm, "norm", (6, 6), "two").ravel()) == {0, 255}
    # Nothing above the level: no body. Nothing below it: the whole frame.
    mask = {r.frame_id: r.n for r in dst.body_mask(pixels(spark, frames)).groupBy("frame_id")
            .agg(F.count_if("mask").alias("n")).collect()}
    assert mask == {"flat": 20, "two": 18, "zero": 0}


def test_asymmetry(spark):
    a = np.zeros((100, 200), int)
    a[20:80, 20:80] = 85
    a[20:80, 120:180] = 160
    one_side = a.copy()
    one_side[:, 100:] = 0
    df = pixels(spark, {"both": a, "left": one_side, "none": np.zeros((5, 5), int)}) \
        .withColumn("mask", F.col("v") > 0)
    got = {r.frame_id: r for r in rg.asymmetry(df).collect()}
    assert (got["both"].left_mean_c, got["both"].right_mean_c, got["both"].delta_c,
            got["both"].is_asymmetric) == (26.67, 32.55, 5.88, True)
    assert (got["left"].status, got["left"].delta_c) == ("one_sided", None)
    assert got["none"].status == "no_tissue"
    zero = {r.frame_id: r for r in rg.asymmetry(df, zero_form=True).collect()}
    assert (zero["left"].left_mean_c, zero["left"].is_asymmetric) == (0.0, False)


def test_zones_leave_last_row_out(spark):
    a = np.zeros((20, 10), int)
    for y in range(3, 14):
        a[y, 1:4] = 50 + y
    df = pixels(spark, {"f": a}).withColumn("mask", F.col("v") > 0)
    table = rg.zones(df, tile=6)
    got = {(r.side, r.zone): (r.px, r.mean_v) for r in table.collect()}
    assert got == {("left", "fore"): (9, 54.0), ("left", "mid"): (9, 57.0),
                   ("left", "heel"): (12, 60.5)}
    assert rg.zone_deltas(table).count() == 0
    assert rg.largest_zone_delta(table).first().max_zone_delta == 60.5


def test_roi_and_points(spark, noise):
    df = pixels(spark, {"f": noise}).withColumn("hot", F.col("v") > 250)
    rois = spark.createDataFrame(
        [("swap", "f", 20, 15, 4, 3), ("thin", "f", 4, 4, 5, 20), ("edge", "f", -3, -3, 3, 40)],
        "roi_id string, frame_id string, x1 int, y1 int, x2 int, y2 int")
    got = {r.roi_id: r for r in rg.roi_stats(df, rois, tile=8).collect()}
    part = noise[3:15, 4:20]
    assert set(got) == {"swap", "edge"}
    assert (got["swap"].px, got["swap"].min_v, got["swap"].max_v) == (
        part.size, part.min(), part.max())
    assert got["swap"].mean_v == pytest.approx(part.mean())
    assert got["swap"].std_v == pytest.approx(part.std())
    assert got["edge"].px == noise[:, :3].size
    points = spark.createDataFrame([("a", "f", -5, 99), ("b", "f", 4, 7)],
                                   "point_id string, frame_id string, y int, x int")
    size = spark.createDataFrame([("f", 23, 31)], "frame_id string, height int, width int")
    hit = {r.point_id: (r.y, r.x, r.v) for r in rg.probe_points(df, points, size).collect()}
    assert hit == {"a": (0, 30, noise[0, 30]), "b": (4, 7, noise[4, 7])}


def test_histogram_of_flat_and_wide_body(spark, noise):
    frames = {"flat": np.full((3, 3), 77), "wide": noise}
    got = thr.intensity_histogram(pixels(spark, frames)).toPandas()
    flat = got[got.frame_id == "flat"]
    assert list(zip(flat.bin, flat.px)) == [(64, 9)]
    wide = got[got.frame_id == "wide"].set_index("bin").px
    celsius = 20 + noise.ravel() / 255 * 20
    counts, _ = np.histogram(noise.ravel(), 128)
    assert wide.sum() == celsius.size
    assert wide.reindex(range(128), fill_value=0).tolist() == counts.tolist()


def test_places_in_groups_of_any_size(spark):
    from pyrogrid.operators.ranking import places
    rows = [("big", i * 7919 % 5000) for i in range(5000)] + [(f"g{i % 90}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "frame_id string, n int")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = places(df, ["frame_id"], ["n"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    groups = {}
    for name, n in sorted(rows):
        groups.setdefault(name, []).append(n)
    assert {(r["frame_id"], r["n"], r["place"]) for r in found} == {
        (name, n, i + 1) for name, ns in groups.items() for i, n in enumerate(ns)}
