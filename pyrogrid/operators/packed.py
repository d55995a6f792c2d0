"""Whole detection steps on packed frames: one row per image, no pixel-level shuffle.

Spark spreads the rows; one pass over a stack of frames does everything that needs only
the frame itself: smoothing, top-hat, levels, distance, body, thresholds, outliers, their
components and the measures of these. Only values per frame and per component leave it; outlier
pixels have a pass of their own, for those who ask for them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import odd_kernel_of
from ..params import Params
from .components import first_pixel_labels
from .distance import NO_BACKGROUND, chamfer
from .threshold import HIGHEST, LOWEST, MAD_SCALE

# Pixels worked on at once; a larger frame is a stack of its own.
STACK = 1 << 22


def slide(a: np.ndarray, radius: int, pick, fill: int, axis: int) -> np.ndarray:
    """Window minimum or maximum, clipped at the ends, by doubling spans."""
    a = np.moveaxis(a, axis, 0)
    size, n = 2 * radius + 1, a.shape[0]
    edge = np.full((radius, *a.shape[1:]), fill, dtype=a.dtype)
    m, span = np.concatenate([edge, a, edge]), 1
    while span * 2 <= size:
        m = pick(m[:-span], m[span:])
        span *= 2
    return np.moveaxis(pick(m[:n], m[size - span:size - span + n]), 0, axis)


def blur_frame(a: np.ndarray) -> np.ndarray:
    out = a.copy()
    if min(a.shape[-2:]) > 2:
        lines = a[..., :-2, :] + a[..., 1:-1, :] + a[..., 2:, :]
        out[..., 1:-1, 1:-1] = (lines[..., :-2] + lines[..., 1:-1] + lines[..., 2:]) // 9
    return out


def top_hat_frame(a: np.ndarray, k: int) -> np.ndarray:
    r, o = k // 2, a
    for pick, fill in ((np.minimum, 255), (np.maximum, 0)):
        o = slide(slide(o, r, pick, fill, -1), r, pick, fill, -2)
    return np.maximum(a - o, 0)


def _same_size(batches):
    """Rows of one frame size at a time, so that a step works on a stack of frames."""
    for batch in batches:
        for (h, w), rows in batch.groupby(["height", "width"]):
            step = max(1, STACK // (h * w))
            for start in range(0, len(rows), step):
                part = rows.iloc[start:start + step]
                yield part, np.stack(part["px"].to_list()).astype(np.int16).reshape(-1, h, w)


def _flat(stack: np.ndarray) -> list:
    return list(stack.reshape(len(stack), -1))


def _counts(stack: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Pixels per grey value of each frame, inside the mask if given."""
    # Values of one frame after those of another, in the smallest type that tells them apart.
    code = stack.astype(np.int32) + np.arange(0, 256 * len(stack), 256, dtype=np.int32)[:, None, None]
    code = code.ravel() if mask is None else code[mask]
    return np.bincount(code, minlength=256 * len(stack)).reshape(-1, 256)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def otsu_levels(counts: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Otsu level and body threshold of each row of grey value counts."""
    v = np.arange(256)
    back, total = counts.cumsum(1), counts.sum(1, keepdims=True)
    s_back, s_total = (counts * v).cumsum(1), (counts * v).sum(1, keepdims=True)
    front = total - back
    split = (back > 0) & (front > 0)
    gap = (s_back / np.where(split, back, 1)) - ((s_total - s_back) / np.where(split, front, 1))
    variance = np.where(split, back.astype(float) * front * (gap * gap), 0.0)
    otsu = np.where(variance.max(1) > 0, variance.argmax(1), 0)
    low, high = (counts > 0).argmax(1), 255 - (counts[:, ::-1] > 0).argmax(1)
    level = np.where(high - low < 30, np.floor(low + 0.3 * (high - low)), otsu // 2)
    return otsu, np.minimum(np.maximum(level, p.otsu_min), p.otsu_max).astype(int)


def weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    upto, at = counts[order].cumsum(), values[order]
    n = upto[-1]
    low, high = (at[np.searchsorted(upto, k, side="right")] for k in ((n - 1) // 2, n // 2))
    return float(low) if low == high else 0.5 * low + 0.5 * high


def frame_threshold(diff: np.ndarray, img: np.ndarray, p: Params) -> tuple:
    """body_px, centre, sigma, baseline, mad_is_zero, diff_threshold from the counts of one
    frame's body; all None without a body."""
    n, v = int(diff.sum()), np.arange(256)
    if not n:
        return (None,) * 6
    if p.use_mad:
        centre = weighted_median(v, diff)
        mad = weighted_median(np.abs(v - centre), diff)
        sigma, base, zero = MAD_SCALE * mad, weighted_median(v, img), mad == 0
    else:
        centre = int((diff * v).sum()) / n
        variance = int((diff * v * v).sum()) / n - centre * centre
        sigma, base, zero = float(np.sqrt(max(variance, 0.0))), int((img * v).sum()) / n, None
    level = min(max(centre + p.sigma_k * sigma, LOWEST), HIGHEST)
    return n, centre, sigma, base, zero, level


def bodies(px: np.ndarray, p: Params, smooth: bool = True) -> dict:
    """Image stages of a stack of frames of one size."""
    blur = blur_frame(px) if smooth else px
    hat = top_hat_frame(blur, odd_kernel_of(*px.shape[1:], p.tophat_factor))
    otsu, level = otsu_levels(_counts(blur), p)
    dist3 = chamfer(np.where(blur > level[:, None, None], NO_BACKGROUND, 0))
    deepest = dist3.max(axis=(1, 2))
    limit = p.dist_erosion_factor * (deepest / 3.0)
    mask = (dist3 / 3.0 >= limit[:, None, None]) & (deepest > 0)[:, None, None]
    return {"blur": blur, "tophat": hat, "otsu": otsu, "body_threshold": level, "dist3": dist3,
            "max_dist3": deepest, "mask": mask, "diff": np.where(mask, hat, 0)}


def spots(px: np.ndarray, stage: dict, level: np.ndarray, base: np.ndarray) -> tuple[dict, np.ndarray]:
    """Outlier pixels of a stack with their component and whether they lie on its edge; and for
    each pixel the place of its component's first one."""
    n, h, w = px.shape
    found = (stage["diff"] > level[:, None, None]) & (stage["blur"] > base[:, None, None])
    at, y, x = np.nonzero(found)
    # A free line between frames keeps their components apart.
    label = first_pixel_labels(at * (h + 1) + y, x, 4) if len(at) else at
    ringed = np.pad(found, ((0, 0), (1, 1), (1, 1)))
    inner = (ringed[at, y, x + 1] & ringed[at, y + 2, x + 1]
             & ringed[at, y + 1, x] & ringed[at, y + 1, x + 2])
    return {"at": at, "y": y, "x": x, "v": px[at, y, x], "blur": stage["blur"][at, y, x],
            "dist3": stage["dist3"][at, y, x], "diff": stage["diff"][at, y, x],
            "comp_id": y[label].astype(np.int64) * w + x[label], "boundary": ~inner}, label


def components_of(pixels: dict, label: np.ndarray, height: int, width: int, margin: int) -> dict:
    """Measures of the components of a stack's outlier pixels, ``at`` included."""
    first, inverse = np.unique(label, return_inverse=True)
    size = len(first)
    y, x, v, dist3 = (pixels[c].astype(np.int64) for c in ("y", "x", "v", "dist3"))
    edge = np.minimum(np.minimum(x, width - 1 - x), np.minimum(y, height - 1 - y))

    def total(values):
        # Exact, as sums stay far below 2^53.
        return np.bincount(inverse, values, size).astype(np.int64)

    def extreme(pick, values):
        out = values[first].copy()
        pick.at(out, inverse, values)
        return out
    return {"at": pixels["at"][first], "comp_id": pixels["comp_id"][first], "area": np.bincount(inverse, minlength=size),
            "perimeter": total(pixels["boundary"]), "touches_border": extreme(np.minimum, edge) <= margin,
            "deepest": extreme(np.maximum, dist3), "s_y": total(y), "s_x": total(x), "s_v": total(v),
            "max_v": extreme(np.maximum, v), "x0": extreme(np.minimum, x), "y0": extreme(np.minimum, y),
            "x1": extreme(np.maximum, x), "y1": extreme(np.maximum, y)}


MEASURES = ("otsu int, body_threshold int, max_dist3 int, body_px long, centre double, "
            "sigma double, baseline double, mad_is_zero boolean, diff_threshold double")
REGIONS = ("comp_id long, area long, perimeter long, touches_border boolean, deepest int, s_y long, s_x long, "
           "s_v long, max_v int, x0 int, y0 int, x1 int, y1 int")
SPOTS = "y int, x int, v int, blur int, dist3 int, diff int, comp_id long, boundary boolean"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _runs_over(rows: pd.DataFrame, px: np.ndarray, runs: list[Params]):
    """(run number, run, frame columns, image stages, thresholds, outlier pixels, their labels)."""
    stage = bodies(px, runs[0])
    diff, img = _counts(stage["tophat"], stage["mask"]), _counts(stage["blur"], stage["mask"])
    ids = rows[["frame_id", "height", "width"]].reset_index(drop=True)
    for number, p in enumerate(runs):
        cuts = pd.DataFrame([frame_threshold(d, i, p) for d, i in zip(diff, img)],
                            columns=_names(MEASURES)[3:])
        known = cuts["body_px"].notna().to_numpy()
        level, base = (np.where(known, cuts[c].astype(float), np.inf)
                       for c in ("diff_threshold", "baseline"))
        yield number, p, ids, stage, cuts, *spots(px, stage, level, base)


def detected(frames: DataFrame, runs: list[Params]) -> DataFrame:
    """Rows (frame_id, height, width, run) of two kinds, for runs with the same image stages:
    one per frame and run with its measures, and one per component (``comp_id`` is set)."""
    def run(batches):
        for rows, px in _same_size(batches):
            for number, p, ids, stage, cuts, pixels, label in _runs_over(rows, px, runs):
                yield pd.concat([ids.assign(run=number, otsu=stage["otsu"],
                                            body_threshold=stage["body_threshold"],
                                            max_dist3=stage["max_dist3"]), cuts,
                                 pd.DataFrame(None, ids.index, _names(REGIONS))], axis=1)
                found = components_of(pixels, label, *px.shape[1:], p.border_margin)
                at = found.pop("at")
                yield ids.iloc[at].reset_index(drop=True).assign(
                    run=number, **dict.fromkeys(_names(MEASURES)), **found)
    source = frames.select("frame_id", "height", "width", F.col("px").cast("array<short>"))
    return source.mapInPandas(run, f"{_fields(source.drop('px'))}, run int, {MEASURES}, {REGIONS}")


def outlier_pixels(frames: DataFrame, runs: list[Params]) -> DataFrame:
    """Rows (frame_id, height, width, run) with an outlier pixel and its component each."""
    def run(batches):
        for rows, px in _same_size(batches):
            for number, _, ids, _, _, pixels, _ in _runs_over(rows, px, runs):
                at = pixels.pop("at")
                yield ids.iloc[at].reset_index(drop=True).assign(run=number, **pixels)
    source = frames.select("frame_id", "height", "width", F.col("px").cast("array<short>"))
    return source.mapInPandas(run, f"{_fields(source.drop('px'))}, run int, {SPOTS}")


def staged(frames: DataFrame, p: Params) -> DataFrame:
    """Packed ``blur``, ``dist3``, ``diff`` and ``mask`` of every frame."""
    def run(batches):
        for rows, px in _same_size(batches):
            stage = bodies(px, p)
            yield rows.assign(**{c: _flat(stage[c]) for c in ("blur", "dist3", "diff")},
                              mask=_flat(stage["mask"].astype(np.int16)))
    source = frames.select("frame_id", "height", "width", F.col("px").cast("array<short>"))
    return source.mapInPandas(run, _fields(source) + ", blur array<short>, dist3 array<int>, "
                                                     "diff array<short>, mask array<short>")


def raw_bodies(frames: DataFrame, p: Params) -> DataFrame:
    """Pixels of the body of every frame, taken from the image as it is."""
    def run(batches):
        for rows, px in _same_size(batches):
            inside = bodies(px, p, smooth=False)["mask"].sum(axis=(1, 2))
            yield rows[["frame_id", "height", "width"]].assign(body_px=inside)
    source = frames.select("frame_id", "height", "width", F.col("px").cast("array<short>"))
    return source.mapInPandas(run, f"{_fields(source.drop('px'))}, body_px long")


def with_blur_and_top_hat(frames: DataFrame, tophat_factor: float = 0.05) -> DataFrame:
    """Add packed ``blur`` and ``tophat``. The kernel follows each frame's own size."""
    def run(batches):
        for rows, px in _same_size(batches):
            blur = blur_frame(px)
            k = odd_kernel_of(*blur.shape[1:], tophat_factor)
            yield rows.assign(blur=_flat(blur), tophat=_flat(top_hat_frame(blur, k)))
    source = frames.select("frame_id", "height", "width", F.col("px").cast("array<short>"))
    return source.mapInPandas(run, _fields(source) + ", blur array<short>, tophat array<short>")
