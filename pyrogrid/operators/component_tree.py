"""Components of all thresholds of a sweep at once: a max-tree with measures for each node.

The regions above a threshold lie inside those above a lower one, so the regions of all thresholds
of a frame form a tree. A pixel's level is the number of thresholds it exceeds. Every tile builds
its part of the tree once, from the highest level down: a level adds its own pixels and joins the
nodes above it, whose measures are already summed; many small tiles are taken in one pass. Nodes
that meet across a tile edge are merged level by level. Pixels are neither repeated nor labelled for each threshold; what leaves a tile is
one row per node, and the pixels of its rim.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..staging import checkpoint, spread
from .components import FORWARD, _merge
from .regions import with_shape
from .tiles import CELLS, TILE, attach, div, own_pixels, tiled, with_halo

TREE = ["frame_id", "baseline"]
SUMS = ("area", "perimeter", "s_y", "s_x", "s_v")
LEAST, MOST = ("x0", "y0", "edge"), ("x1", "y1", "max_v", "max_dist3")


def levels(pixels: DataFrame, thresholds: DataFrame, diff: str = "diff", img: str = "v",
           tile: int = TILE) -> DataFrame:
    """The pixels above some threshold and above the baseline, with their level; one row for each
    baseline of their frame. Runs with equal baselines share it."""
    ladders = thresholds.groupBy(*TREE).agg(
        F.array_sort(F.collect_set("diff_threshold")).alias("cuts"),
        F.max("height").alias("height"), F.max("width").alias("width"))
    level = F.size(F.filter("cuts", lambda c: c < F.col(diff)))
    # Thresholds are never negative, so pixels without difference exceed none.
    return (attach(tiled(pixels, tile).where(F.col(diff) > 0), ladders, tile)
            .where(F.col(img) > F.col("baseline")).withColumn("level", level)
            .where("level > 0").drop("cuts"))


def with_floor(levelled: DataFrame, tile: int = TILE) -> DataFrame:
    """Adds ``floor``, the lowest level among the four neighbours (0 outside): on the levels above
    it a pixel lies on the boundary of its region."""
    near = with_halo(levelled, 1, tile)

    def lowest(axis, across):
        w = Window.partitionBy(*TREE, "ty", "tx", across).orderBy(axis)
        return [F.when(shift(axis).over(w) == F.col(axis) + step, shift("level").over(w)).otherwise(0)
                for shift, step in ((F.lag, -1), (F.lead, 1))]
    flagged = near.withColumn("_row", F.least(*lowest("x", "y"))).withColumn("_col", F.least(*lowest("y", "x")))
    return own_pixels(flagged, tile).withColumn("floor", F.least("_row", "_col")).drop("_row", "_col")


def neighbours(y: np.ndarray, x: np.ndarray, connectivity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that touch; pixels are given in scan order."""
    stride = int(x.max()) + 2
    code = y * stride + x
    ends = []
    for dy, dx in FORWARD[connectivity]:
        target = code + dy * stride + dx
        at = np.minimum(np.searchsorted(code, target), len(code) - 1)
        hit = (code[at] == target) & (x + dx >= 0)
        ends.append((np.flatnonzero(hit), at[hit]))
    return np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends])


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the pairs are joined; the root of a component is its first pixel."""
    while True:
        x, y = root[a], root[b]
        open_ends = x != y
        if not open_ends.any():
            return root
        a, b, x, y = a[open_ends], b[open_ends], x[open_ends], y[open_ends]
        low = np.minimum(x, y)
        root = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped


def tile_tree(level: np.ndarray, floor: np.ndarray, pairs, values: dict[str, np.ndarray], rim: np.ndarray):
    """(level, roots of its nodes, their measures, roots of the rim pixels) from the top down.

    ``values`` holds the pixels' own measures without the perimeter.
    """
    a, b = pairs
    weight = np.minimum(level[a], level[b])
    root = np.arange(len(level))
    open_walls = floor < level
    nodes, held = np.zeros(0, "int64"), {c: np.zeros(0, "int64") for c in (*values, "perimeter")}
    for now in range(int(level.max()), 0, -1):
        at = weight == now
        root = joined(root, a[at], b[at])
        fresh = np.flatnonzero(level == now)
        walls, gone = np.flatnonzero((level == now) & open_walls), np.flatnonzero((floor == now) & open_walls)
        place = np.concatenate([root[fresh], root[nodes]])
        fresh_nodes, inverse = np.unique(place, return_inverse=True)
        out = {}
        for name, own in values.items():
            both = np.concatenate([own[fresh], held[name]])
            if name in LEAST:
                out[name] = np.full(len(fresh_nodes), np.iinfo("int64").max)
                np.minimum.at(out[name], inverse, both)
            elif name in MOST:
                out[name] = np.full(len(fresh_nodes), np.iinfo("int64").min)
                np.maximum.at(out[name], inverse, both)
            else:
                out[name] = np.zeros(len(fresh_nodes), "int64")
                np.add.at(out[name], inverse, both)
        out["perimeter"] = np.zeros(len(fresh_nodes), "int64")
        np.add.at(out["perimeter"], inverse[len(fresh):], held["perimeter"])
        for pixels, step in ((walls, 1), (gone, -1)):
            np.add.at(out["perimeter"], np.searchsorted(fresh_nodes, root[pixels]), step)
        nodes, held = fresh_nodes, out
        yield now, nodes, held, root[rim[level[rim] >= now]]


def _trees(counts: list[str], connectivity: int, tile: int):
    names = (*SUMS, *LEAST, *MOST, *counts)

    def forest(cells: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The trees of several tiles in one pass: their pixels never touch."""
        number = np.repeat(np.arange(len(cells)), [len(y) for y in cells["y"]])
        columns = {c: np.concatenate(cells[c].to_numpy()).astype("int64") for c in (
            "y", "x", "level", "floor", "v", "dist3", *counts)}
        order = np.lexsort((columns["x"], columns["y"], number))
        columns, number = {c: column[order] for c, column in columns.items()}, number[order]
        y, x, v = (columns[c] for c in ("y", "x", "v"))
        height, width = (cells[c].to_numpy("int64") for c in ("height", "width"))
        # Neighbours are looked for by place in the tile, as large frames have long rows; an empty
        # row parts two tiles.
        pairs = neighbours(number * (tile + 1) + y % tile, x % tile, connectivity)
        edge = np.minimum(np.minimum(x, width[number] - 1 - x), np.minimum(y, height[number] - 1 - y))
        values = {"area": np.ones_like(y), "s_y": y, "s_x": x, "s_v": v, "x0": x, "y0": y, "edge": edge,
                  "x1": x, "y1": y, "max_v": v, "max_dist3": columns["dist3"], **{c: columns[c] for c in counts}}
        rim = np.flatnonzero(np.isin(y % tile, (0, tile - 1)) | np.isin(x % tile, (0, tile - 1)))
        code = y * width[number] + x

        def same(at):
            return {c: cells[c].to_numpy()[number[at]] for c in (*TREE, "height", "width")}
        for now, nodes, held, rim_roots in tile_tree(columns["level"], columns["floor"], pairs, values, rim):
            yield pd.DataFrame({**same(nodes), "level": now, "node": code[nodes], "y": -1, "x": -1,
                                **{c: held[c] for c in names}})[[*_columns(counts)]]
            at = rim[columns["level"][rim] >= now]
            if len(at):
                yield pd.DataFrame({**same(at), "level": now, "node": code[rim_roots], "y": y[at], "x": x[at],
                                    **{c: 0 for c in names}})[[*_columns(counts)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = held = 0
            for n, y in enumerate(batch["y"]):
                if n > start and held + len(y) > CELLS:
                    yield from forest(batch.iloc[start:n])
                    start, held = n, 0
                held += len(y)
            if start < len(batch):
                yield from forest(batch.iloc[start:])
    return run


def _columns(counts: list[str]) -> tuple[str, ...]:
    return (*TREE, "height", "width", "level", "node", "y", "x", *SUMS, *LEAST, *MOST, *counts)


def level_regions(pixels: DataFrame, thresholds: DataFrame, diff: str = "diff", img: str = "v",
                  connectivity: int = 4, counts: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """One row per frame, run and region above the run's threshold, with the measures of
    ``regions.measure`` and, for each boolean column in ``counts``, how many pixels have it.

    ``thresholds`` holds frame_id, run_id, height, width, diff_threshold, baseline and
    border_margin. A region's id is the place of its first pixel in the frame.
    """
    counts = list(counts)
    cells = with_floor(levels(pixels, thresholds, diff, img, tile), tile)
    unit = [*TREE, "ty", "tx"]
    columns = ["y", "x", "level", "floor", "v", "dist3", *counts]
    # One row per tile: its size is bounded by the tile.
    packed = (spread(cells, *unit).groupBy(*unit)
              .agg(F.collect_list(F.struct("y", "x", "level", "floor", F.col("v").cast("long").alias("v"), "dist3",
                                           *[F.col(c).cast("int").alias(c) for c in counts])).alias("cells"),
                   F.max("height").alias("height"), F.max("width").alias("width"))
              .select(*unit, "height", "width", *[F.col(f"cells.{c}").alias(c) for c in columns]))
    kind = dict(packed.dtypes)
    schema = f"frame_id {kind['frame_id']}, baseline double, " + ", ".join(
        f"{c} {'int' if c in ('height', 'width', 'level', 'y', 'x') else 'long'}" for c in _columns(counts)[2:])
    rows = checkpoint(packed.mapInPandas(_trees(counts, connectivity, tile), schema))
    nodes = rows.where("y < 0").drop("y", "x")
    keys = [*TREE, "level"]
    edges = _rim_edges(rows.where("y >= 0").select(*keys, "y", "x", "node"), keys, connectivity, tile)
    if not edges.isEmpty():
        roots = _merge(edges, keys).withColumnRenamed("id", "node")
        nodes = nodes.join(roots, [*keys, "node"], "left").withColumn("node", F.coalesce("root", "node")).drop("root")
    merged = nodes.groupBy(*keys, F.col("node").alias("comp_id")).agg(
        *[F.sum(c).alias(c) for c in (*SUMS, *counts)], *[F.min(c).alias(c) for c in LEAST],
        *[F.max(c).alias(c) for c in MOST], F.max("height").alias("height"), F.max("width").alias("width"))
    rungs = Window.partitionBy(*TREE).orderBy("diff_threshold")
    runs = thresholds.select("frame_id", "run_id", "border_margin", "baseline",
                             F.dense_rank().over(rungs).alias("level"))
    found = merged.join(runs, keys).withColumn("touches_border", F.col("edge") <= F.col("border_margin"))
    numbers = {c: F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1", "max_dist3")}
    numbers["max_v"] = F.col("max_v").cast(pixels.schema["v"].dataType)
    return with_shape(found.withColumns(numbers)).drop("edge", "level", "baseline", "border_margin")


def _rim_edges(rim: DataFrame, keys: list[str], connectivity: int, tile: int) -> DataFrame:
    """Pairs of nodes of one level whose pixels touch across a tile edge."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in FORWARD[connectivity]])
    ahead = (rim.withColumn("s", F.explode(steps))
             .withColumn("ny", F.col("y") + F.col("s.dy")).withColumn("nx", F.col("x") + F.col("s.dx"))
             .where((F.col("nx") >= 0) & ((div("y", tile) != div("ny", tile)) | (div("x", tile) != div("nx", tile))))
             .select(*keys, F.col("ny").alias("y"), F.col("nx").alias("x"), F.col("node").alias("a")))
    return (ahead.join(rim.withColumnRenamed("node", "b"), [*keys, "y", "x"])
            .where("a <> b").select(*keys, "a", "b").distinct())
