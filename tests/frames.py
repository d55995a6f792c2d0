"""Helpers that turn arrays into pixel tables and back, and plain reference loops."""

import tempfile

import numpy as np
import pandas as pd

from pyrogrid.schemas import PIXELS


def pixels(spark, frames):
    parts = []
    for name, a in frames.items():
        h, w = a.shape
        y, x = np.indices(a.shape)
        parts.append(pd.DataFrame({
            "frame_id": name, "y": y.ravel(), "x": x.ravel(), "v": a.ravel().astype(int),
            "height": h, "width": w}))
    # A file, since a large literal table would be compared row by row with cached plans.
    path = f"{tempfile.mkdtemp(prefix='pyrogrid-test-')}/pixels.parquet"
    pd.concat(parts).astype({c: "int32" for c in ("y", "x", "v", "height", "width")}) \
        .to_parquet(path, index=False)
    return spark.read.schema(PIXELS).parquet(path)


def array(df, column, shape, frame="f"):
    pdf = df.where(df.frame_id == frame).select("y", "x", column).toPandas()
    out = np.full(shape, -1, dtype=int)
    out[pdf.y, pdf.x] = pdf[column].astype(int)
    assert len(pdf) == out.size
    return out


def naive_window(a, k, pick):
    r = k // 2
    out = np.zeros_like(a)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            out[y, x] = pick(a[max(y - r, 0):y + r + 1, max(x - r, 0):x + r + 1])
    return out


def naive_distance(fg):
    bg = np.argwhere(~fg)
    out = np.zeros(fg.shape, dtype=int)
    for y, x in np.argwhere(fg):
        if len(bg) == 0:
            out[y, x] = 2 ** 30
        else:
            d = np.abs(bg - (y, x))
            out[y, x] = (3 * d.max(1) + d.min(1)).min()
    return out


def naive_labels(mask, connectivity):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    if connectivity == 8:
        steps += [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    out = np.full(mask.shape, -1, dtype=int)
    for y, x in np.argwhere(mask):
        if out[y, x] >= 0:
            continue
        todo, label = [(y, x)], y * mask.shape[1] + x
        out[y, x] = label
        while todo:
            cy, cx = todo.pop()
            for dy, dx in steps:
                ny, nx = cy + dy, cx + dx
                if (0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx]
                        and out[ny, nx] < 0):
                    out[ny, nx] = label
                    todo.append((ny, nx))
    return out


def scenario(name):
    """Noise-free frame and truth of a named scenario."""
    yy, xx = np.indices((400, 400))
    img = np.zeros((400, 400), dtype=int)
    truth = np.zeros((400, 400), dtype=bool)
    img[40:240, 60:180] = 85
    img[40:240, 220:340] = 85

    def disc(cy, cx, r, value):
        spot = (yy - cy) ** 2 + (xx - cx) ** 2 <= r * r
        img[spot] = value
        truth[spot] = True
    if name == "ulcer":
        disc(100, 120, 6, 195)
    elif name == "fasciitis":
        disc(200, 280, 7, 190)
    elif name == "noise":
        img[80, 100], img[150, 300] = 240, 245
    elif name == "multi":
        disc(70, 110, 5, 190)
        disc(160, 270, 7, 200)
    elif name == "bimodal":
        img[180:240, 60:180] = 35
        disc(100, 120, 6, 210)
    return img, truth
