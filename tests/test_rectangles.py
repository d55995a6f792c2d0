import numpy as np
import pytest

from pyrogrid.operators import rectangles as rc, regional as rg


def brute(image, there, boxes):
    out = []
    for roi, x1, x2, y1, y2 in boxes:
        x1, x2, y1, y2 = min(x1, x2), max(x1, x2), min(y1, y2), max(y1, y2)
        if x2 - x1 < 2 or y2 - y1 < 2:
            continue
        part = image[max(y1, 0):max(y2, 0), max(x1, 0):max(x2, 0)][there[max(y1, 0):max(y2, 0), max(x1, 0):max(x2, 0)]]
        if part.size:
            out.append((roi, part.size, int(part.min()), int(part.max()), float(part.mean()), float(part.std())))
    return sorted(out)


@pytest.mark.parametrize("tile, together", [(256, 1 << 16), (8, 5), (7, 1 << 16)])
def test_rectangles_across_tiles(spark, monkeypatch, tile, together):
    monkeypatch.setattr(rc, "TOGETHER", together)
    draw = np.random.default_rng(3)
    image = draw.integers(0, 256, (37, 29))
    # One pixel in ten is missing.
    there = draw.random(image.shape) > 0.1
    there[20:26, 3:12] = False
    boxes = [(f"r{n}", *draw.integers(-6, 40, 4).tolist()) for n in range(120)]
    boxes += [("all", 0, 29, 0, 37), ("beyond", 60, 90, 60, 90), ("left", -9, -2, 0, 5), ("gap", 4, 10, 21, 25)]
    px = spark.createDataFrame([("a", int(y), int(x), int(image[y, x]), 37, 29) for y, x in np.argwhere(there)],
                               "frame_id string, y int, x int, v int, height int, width int")
    rois = spark.createDataFrame([(r, "a", *b) for r, *b in boxes] + [("none", "b", 0, 9, 0, 9)],
                                 "roi_id string, frame_id string, x1 int, x2 int, y1 int, y2 int")
    got = sorted(tuple(r) for r in rg.roi_stats(px, rois, tile=tile).select(
        "roi_id", "px", "min_v", "max_v", "mean_v", "std_v").collect())
    wanted = brute(image, there, boxes)
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in wanted])


def test_span_extremes_equal_slices():
    draw = np.random.default_rng(5)
    values = draw.integers(-50, 50, (33, 70))
    y, x = np.sort(draw.integers(0, 34, (2, 500)), axis=0), np.sort(draw.integers(0, 71, (2, 500)), axis=0)
    some = (y[0] < y[1]) & (x[0] < x[1])
    box = y[0][some], y[1][some], x[0][some], x[1][some]
    for pick, name in ((np.minimum, "min"), (np.maximum, "max")):
        found = rc.span_extremes(values, pick, *box)
        assert found.tolist() == [getattr(values[a:b, c:d], name)() for a, b, c, d in zip(*box)]
    assert rc.span_extremes(values, np.minimum, *[np.zeros(0, "int64")] * 4).tolist() == []
