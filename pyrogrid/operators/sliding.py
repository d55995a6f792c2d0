"""Sliding extrema, means and elements on arrays of tiles (the last two axes are a tile's rows and
columns), in constant work per cell."""

from __future__ import annotations

import math

import numpy as np


def neutral(kind: np.dtype, pick) -> float | int:
    """What never wins against a value."""
    if kind.kind == "f":
        return np.inf if pick is np.minimum else -np.inf
    ends = np.iinfo(kind)
    return ends.max if pick is np.minimum else ends.min


def slide(values: np.ndarray, radius: int, pick, axis: int) -> np.ndarray:
    """Extreme of each cell's 2 * radius + 1 neighbours on a line, clipped at its ends.

    The line is cut into blocks of that length; every window is the end of one block and the
    beginning of the next, whose extremes are running ones, so the radius does not matter.
    """
    if radius == 0:
        return values
    size, length = values.shape[axis], 2 * radius + 1
    blocks = -(-(size + 2 * radius) // length)
    lines = np.moveaxis(values, axis, 0)
    padded = np.full((blocks * length, *lines.shape[1:]), neutral(values.dtype, pick), values.dtype)
    padded[radius:radius + size] = lines
    cut = padded.reshape(blocks, length, *lines.shape[1:])
    before = pick.accumulate(cut, axis=1).reshape(padded.shape)
    after = pick.accumulate(cut[:, ::-1], axis=1)[:, ::-1].reshape(padded.shape)
    return np.moveaxis(pick(after[:size], before[length - 1:length - 1 + size]), 0, axis)


def square(values: np.ndarray, radius: int, pick) -> np.ndarray:
    return slide(slide(values, radius, pick, -1), radius, pick, -2)


def opened(values: np.ndarray, radius: int) -> np.ndarray:
    return square(square(values, radius, np.minimum), radius, np.maximum)


def closed(values: np.ndarray, radius: int) -> np.ndarray:
    return square(square(values, radius, np.maximum), radius, np.minimum)


def blurred(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """3 x 3 means, truncated; cells on the frame's edge are copied."""
    framed = np.pad(values.astype("int64"), [(0, 0)] * (values.ndim - 2) + [(1, 1)] * 2)
    rows = framed[..., :-2] + framed[..., 1:-1] + framed[..., 2:]
    return np.where(edge, values, (rows[..., :-2, :] + rows[..., 1:-1, :] + rows[..., 2:, :]) // 9).astype(values.dtype)


def chords(k: int) -> dict[int, int]:
    """Half width of an elliptic k x k element for each row offset."""
    r = k // 2
    return {dy: round(r * math.sqrt((r * r - dy * dy) / (r * r))) if r else 0
            for dy in range(-r, r + 1)}


def ellipse(values: np.ndarray, k: int, pick) -> np.ndarray:
    """Extreme over an elliptic element: one sliding row extreme for each distinct chord."""
    size = values.shape[-2]
    out = np.full(values.shape, neutral(values.dtype, pick), values.dtype)
    for chord in set(chords(k).values()):
        rows = slide(values, chord, pick, -1)
        for dy, own in chords(k).items():
            if own == chord and abs(dy) < size:
                low, high = max(0, -dy), min(size, size - dy)
                out[..., low:high, :] = pick(out[..., low:high, :], rows[..., low + dy:high + dy, :])
    return out
