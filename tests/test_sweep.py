from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frames import naive_distance, naive_labels, pixels
from pyrogrid.operators import component_tree as ct, distance as dst, neighbourhood as nb, sliding, tiles
from pyrogrid.params import Params

LOOSE = Params(sigma_k=1.0, tophat_factor=0.1, dist_erosion_factor=0.01, min_circularity=0.01,
               lower_cutoff_y=1.0, min_dist_abs=0.0, min_area_abs=2, border_margin=0)


def brute_regions(diff, img, threshold, baseline, margin, connectivity, extra):
    mask = (diff > threshold) & (img > baseline)
    labels = naive_labels(mask, connectivity)
    height, width = mask.shape
    out = []
    for label in np.unique(labels[mask]):
        ys, xs = np.nonzero(mask & (labels == label))
        inside = set(zip(ys.tolist(), xs.tolist()))
        walls = sum(any((y + dy, x + dx) not in inside for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))
                    for y, x in inside)
        out.append((int(ys[0] * width + xs[0]), len(ys), walls,
                    bool(min(ys.min(), xs.min(), height - 1 - ys.max(), width - 1 - xs.max()) <= margin),
                    int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max()), int(img[ys, xs].max()),
                    int(extra[ys, xs].sum())))
    return sorted(out)


@pytest.mark.parametrize("tile, connectivity", [(512, 4), (6, 4), (5, 8), (1, 4)])
def test_regions_of_all_thresholds(spark, tile, connectivity):
    draw = np.random.default_rng(tile)
    frames, rows, wanted = {}, [], {}
    for name, (h, w) in {"a": (13, 17), "b": (9, 8), "c": (3, 3)}.items():
        img = draw.integers(1, 60, (h, w))
        diff = np.where(draw.random((h, w)) < 0.2, 0, draw.integers(0, 12, (h, w)))
        extra = draw.random((h, w)) < 0.5
        frames[name] = (img, diff, extra)
        for run, t, base, margin in (("r0", 0.0, 5.0, 0), ("r1", 3.5, 5.0, 1), ("r2", 3.5, 5.0, -1), ("r3", 8.0, 5.0, 0),
                                     ("m", 2.0, 30.0, 0), ("none", 99.0, 5.0, 0)):
            rows.append((name, run, h, w, t, base, margin))
            wanted[name, run] = brute_regions(diff, img, t, base, margin, connectivity, extra)
    px = spark.createDataFrame(
        [(n, y, x, int(img[y, x]), int(diff[y, x]), bool(extra[y, x]), 7, *img.shape)
         for n, (img, diff, extra) in frames.items() for y in range(img.shape[0]) for x in range(img.shape[1])],
        "frame_id string, y int, x int, v int, diff int, mark boolean, dist3 int, height int, width int")
    limits = spark.createDataFrame(rows, "frame_id string, run_id string, height int, width int, "
                                         "diff_threshold double, baseline double, border_margin int")
    found = {}
    for r in ct.level_regions(px, limits, connectivity=connectivity, counts=("mark",), tile=tile).collect():
        found.setdefault((r["frame_id"], r["run_id"]), []).append((
            r["comp_id"], r["area"], r["perimeter"], r["touches_border"], r["x0"], r["y0"], r["x1"], r["y1"],
            r["max_v"], r["mark"]))
        assert r["max_dist3"] == 7 and r["height"] == frames[r["frame_id"]][0].shape[0]
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in wanted.items() if v}


@pytest.mark.parametrize("tile", [7, 512])
def test_kernel_as_a_column(spark, tile):
    """Frames of different formats in one plan, kernels larger than the frame among them."""
    draw = np.random.default_rng(tile)
    frames = {"a": draw.integers(0, 256, (21, 30)), "b": draw.integers(0, 256, (9, 40)), "c": draw.integers(0, 256, (5, 4))}
    kernels = {"a": 5, "b": 9, "c": 13}
    size = F.element_at(F.create_map(*[F.lit(x) for pair in kernels.items() for x in pair]), F.col("frame_id"))
    df = pixels(spark, frames).withColumn("k", size)
    done = nb.top_hat(nb.dilate(nb.erode(df, "k", tile=tile), F.col("k"), tile=tile), "k", tile=tile).collect()
    for name, a in frames.items():
        r = kernels[name] // 2
        for column, wanted in (("eroded", sliding.square(a, r, np.minimum)), ("dilated", sliding.square(a, r, np.maximum)),
                               ("tophat", a - sliding.opened(a, r))):
            got = np.zeros_like(a)
            for row in done:
                if row["frame_id"] == name:
                    got[row["y"], row["x"]] = row[column]
            assert (got == wanted).all(), (name, column)


def test_sliding_extremes_equal_slices():
    draw = np.random.default_rng(8)
    for size in (1, 2, 7, 40):
        a = draw.integers(-9, 9, (size, 5)).astype("float64" if size == 7 else "int32")
        for r in (0, 1, 3, 20, 60):
            for pick, plain in ((np.minimum, np.min), (np.maximum, np.max)):
                wanted = np.array([plain(a[max(0, i - r):i + r + 1], axis=0) for i in range(size)])
                assert (sliding.slide(a, r, pick, 0) == wanted).all()
                assert (sliding.slide(a.T, r, pick, 1) == wanted.T).all()


def test_many_tiles_are_taken_in_one_pass():
    """The rows of a batch of small tiles come in two tables a level, whatever the number of tiles."""
    draw, size, cells = np.random.default_rng(3), 4, []
    for n in range(150):
        level = draw.integers(0, 4, (size, size))
        level[0, 0] = 3
        floor = np.minimum.reduce([np.pad(level, 1)[a:a + size, b:b + size] for a, b in ((0, 1), (2, 1), (1, 0), (1, 2))])
        y, x = np.nonzero(level)
        cells.append({"frame_id": f"f{n % 3}" if n % 5 else None, "baseline": float(n % 7), "ty": n, "tx": 1, "height": 900,
                      "width": 9, "y": y + n * size, "x": x + size, "level": level[y, x], "floor": floor[y, x],
                      "v": draw.integers(0, 9, len(y)), "dist3": draw.integers(0, 9, len(y)), "mark": draw.integers(0, 2, len(y))})
    grown, single = (ct._trees(["mark"], 4, size)(iter(parts)) for parts in (
        [pd.DataFrame(cells)], [pd.DataFrame([cell]) for cell in cells]))
    grown = list(grown)
    assert len(grown) == 6
    grown, single = (pd.concat(parts).fillna({"frame_id": ""}) for parts in (grown, single))
    columns = list(grown.columns)
    assert grown.sort_values(columns).values.tolist() == single.sort_values(columns).values.tolist()


@pytest.mark.parametrize("tile", [2, 5, 64])
def test_tiles_across_batches(spark, tile):
    """Batches end anywhere in a tile; all but the three keys and the mask go along unread."""
    draw = np.random.default_rng(tile)
    frames = {"a": draw.random((23, 11)) < 0.97, "b": draw.random((4, 30)) < 0.9, "full": np.ones((7, 9), bool)}
    px = spark.createDataFrame(
        [(n, y, x, bool(fg[y, x]), *fg.shape, None if x % 3 else f"{y}", [y, x]) for n, fg in frames.items()
         for y in range(fg.shape[0]) for x in range(fg.shape[1])],
        "frame_id string, y int, x int, fg boolean, height int, width int, note string, place array<int>")
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(limit, "7")
    try:
        rows = dst.distance(px.repartition(3), tile).collect()
        blurred = nb.box_blur(px.withColumn("v", F.col("y") * 7 % 11 + F.col("x")), tile=tile).collect()
    finally:
        spark.conf.unset(limit)
    assert len(rows) == len(blurred) == sum(fg.size for fg in frames.values())
    wanted = {n: naive_distance(fg) for n, fg in frames.items()}
    assert all(r["dist3"] == wanted[r["frame_id"]][r["y"], r["x"]] and r["place"] == [r["y"], r["x"]]
               and r["note"] == (None if r["x"] % 3 else str(r["y"])) for r in rows)
    for r in blurred:
        y, x, (h, w) = r["y"], r["x"], frames[r["frame_id"]].shape
        near = [a * 7 % 11 + b for a in (y - 1, y, y + 1) for b in (x - 1, x, x + 1)]
        assert r["blur"] == (near[4] if y in (0, h - 1) or x in (0, w - 1) else sum(near) // 9)


def test_whole_tiles_keep_rows_of_null_keys_together():
    keys = [(None, 0)] * 5 + [("a", 0)] * 4 + [("a", 1)] + [("b", 1)] * 6
    for size in (1, 2, 3, 7, 20):
        batches = [pa.RecordBatch.from_pydict({"frame_id": pa.array([k for k, _ in keys[n:n + size]], "string"),
                                               "ty": [t for _, t in keys[n:n + size]]}) for n in range(0, 16, size)]
        found = []
        for table, first in tiles.whole_tiles(iter(batches), ["frame_id", "ty"]):
            ends = [*first[1:], table.num_rows]
            found += [[(r["frame_id"], r["ty"]) for r in table.slice(a, b - a).to_pylist()] for a, b in zip(first, ends)]
        assert found == [[(None, 0)] * 5, [("a", 0)] * 4, [("a", 1)], [("b", 1)] * 6]
