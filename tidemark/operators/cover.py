"""Adaptive covers of shapes: quadtree cells, of which those inside need no test.

A shape is cut into cells of sizes that fall by a factor of four, from cells larger than
itself down to the given size.  Cells that no edge touches are inside or outside as a
whole; only those on the border are cut further, each with just the edges that touch
it.  So a cover's size follows the length of the border, not the area, and a point meets
at most one cell of a shape.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How much smaller the cells of the next level are.
STEP = 4
#: Border cells of a shape from which the cover is left as coarse as it is.
MAX_BORDER = 4096
#: Cells of the highest level are of this many degrees, or just under.
_WHOLE = 90.0


def levels(size: float) -> list[float]:
    """Cell sizes in degrees, the smallest first."""
    out = [size]
    while out[-1] * STEP <= _WHOLE:
        out.append(out[-1] * STEP)
    return out


def unwrapped(rings: list[np.ndarray]) -> tuple[list[np.ndarray], bool]:
    """Rings (x, y) in one frame: where one leaps across 180 degrees, western longitudes of the shape count on from 180; whether it does."""
    leaps = [np.abs(np.diff(r[:, 0])) for r in rings]
    crosses = any(((leap > 180) & (leap < 360)).any() for leap in leaps)
    return [np.stack([np.where(r[:, 0] < 0, r[:, 0] + 360, r[:, 0]), r[:, 1]], axis=1) for r in rings] if crosses else rings, crosses


def cells(rings: list[np.ndarray], size: float) -> list[tuple[int, int, int, bool]]:
    """(level, row, column, inside) of a shape's cover; columns of rings beyond 180 degrees count on."""
    edges = np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for r in rings if len(r) > 1] or [np.zeros((0, 4))])
    if not len(edges):
        return []
    sizes = levels(size)
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    extent = (high.max(axis=0) - low.min(axis=0)).max()
    level = next((i for i, s in enumerate(sizes) if s >= extent), len(sizes) - 1)
    first, last = np.floor(low.min(axis=0) / sizes[level]).astype(int), np.floor(high.max(axis=0) / sizes[level]).astype(int)
    every = np.arange(len(edges))
    open_ = [(int(y), int(x), every) for y in range(first[1], last[1] + 1) for x in range(first[0], last[0] + 1)]
    done: list[tuple[int, int, int, bool]] = []
    while True:
        border = []
        for row, column, near in open_:
            touching = near[_touch(edges[near], column * sizes[level], row * sizes[level], sizes[level])]
            if len(touching):
                border.append((row, column, touching))
            elif _odd(edges, (column + 0.5) * sizes[level], (row + 0.5) * sizes[level]):
                done.append((level, row, column, True))
        if level == 0 or len(border) * STEP > MAX_BORDER:
            return [*done, *((level, row, column, False) for row, column, _ in border)]
        level -= 1
        open_ = [(row * STEP + i, column * STEP + j, near) for row, column, near in border for i in range(STEP) for j in range(STEP)]


def _touch(edges: np.ndarray, west: float, south: float, size: float) -> np.ndarray:
    """Which edges have a point in the closed cell, or may by rounding."""
    slack = size * 1e-9
    west, south, east, north = west - slack, south - slack, west + size + slack, south + size + slack
    ax, ay, bx, by = edges.T
    meet = (np.minimum(ax, bx) <= east) & (np.maximum(ax, bx) >= west) & (np.minimum(ay, by) <= north) & (np.maximum(ay, by) >= south)
    side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (west, east) for y in (south, north)]
    return meet & (np.minimum.reduce(side) <= 0) & (np.maximum.reduce(side) >= 0)


def _odd(edges: np.ndarray, x: float, y: float) -> bool:
    ax, ay, bx, by = edges.T
    rise = np.where(by == ay, 1.0, by - ay)
    return bool(np.count_nonzero(((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / rise + ax)) % 2)


def covers(shapes: DataFrame, size: float, shape: str) -> DataFrame:
    """(shape, level, gy, gx, inside, turn): the cells of shapes (shape, rings); a point at longitude x lies in the shape's frame at x + turn."""
    sizes = levels(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            rows, out = [], {c: [] for c in ("level", "gy", "gx", "inside", "turn")}
            for i, given in enumerate(batch.column(1).to_pylist()):
                rings, crosses = unwrapped([np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in given or []])
                for level, row, column, inside in cells(rings, size):
                    # in a frame beyond 180 degrees a cell may lie under places on both sides of it
                    for turn in (0.0, 360.0) if crosses else (0.0,):
                        west = column * sizes[level] - turn
                        if not crosses or west + sizes[level] > -180 and west <= 180:
                            rows.append(i)
                            for c, v in zip(out, (level, row, column, inside, turn), strict=True):
                                out[c].append(v)
            kinds = {"level": pa.int32(), "gy": pa.int32(), "gx": pa.int32(), "inside": pa.bool_(), "turn": pa.float64()}
            yield pa.RecordBatch.from_arrays([names.take(pa.array(rows, pa.int64())), *(pa.array(out[c], k) for c, k in kinds.items())], [shape, *kinds])

    schema = T.StructType([shapes.schema[shape], *(T.StructField(c, t) for c, t in (("level", T.IntegerType()), ("gy", T.IntegerType()), ("gx", T.IntegerType()), ("inside", T.BooleanType()), ("turn", T.DoubleType())))])
    return shapes.select(shape, "rings").mapInArrow(work, schema)


def in_covers(points: DataFrame, covered: DataFrame, size: float, point: str, shape: str) -> DataFrame:
    """(point, shape, inside, _x, _y): the border or inner cell that each point meets, with its place in the shape's frame.

    A point is looked up in the cells of each level in both frames.
    """
    place = lambda turn: F.transform(F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col("latitude") / s).cast("int").alias("gy"), F.floor((F.col("longitude") + turn) / s).cast("int").alias("gx"), F.lit(turn).alias("turn")) for i, s in enumerate(levels(size))]), lambda c: c)
    asked = points.select(point, F.col("longitude").alias("_x"), F.col("latitude").alias("_y"), F.explode(F.concat(place(0.0), place(360.0))).alias("c")).select(point, "_x", "_y", "c.*")
    met = asked.join(covered, ["level", "gy", "gx", "turn"])
    return met.select(point, shape, "inside", (F.col("_x") + F.col("turn")).alias("_x"), "_y")
