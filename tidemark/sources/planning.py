"""Planning a scan: filters that a source takes or leaves, and splitting what is too large to ask at once."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.values import SQFT_PER_ACRE, at_least, at_most, one_of

#: Filters by name, and the field that each bounds. Acres are asked of lot_sqft.
RANGES = {"price": "price", "beds": "beds", "baths": "baths", "sqft": "sqft", "lot_acres": "lot_sqft", "year_built": "year_built"}
CHOICES = {"property_type": "property_type", "listing_type": "listing_status"}
#: Filters that only a source can apply; no row is dropped for them here.
SOURCE_ONLY = ("listing_type", "listed_within_days")
MAX_DEPTH = 20
Box = tuple[float, float, float, float]
MAX_BOUNDS = 100


@dataclass(frozen=True)
class Range:
    low: float | None = None
    high: float | None = None

    def __post_init__(self):
        given = [x for x in (self.low, self.high) if x is not None]
        if any(not math.isfinite(x) or x < 0 for x in given):
            raise ValueError("bounds must be finite and not negative")
        if len(given) == 2 and self.low > self.high:
            raise ValueError("the lower bound is above the upper one")


def check_filters(filters: Mapping[str, object]) -> None:
    """One error for every name or value that isn't understood."""
    known = {*RANGES, *CHOICES, "listed_within_days"}
    wrong = [f"unknown filter {k}" for k in filters if k not in known]
    wrong += [f"{k} needs a range" for k, v in filters.items() if k in RANGES and not isinstance(v, Range)]
    wrong += [f"{k} needs a list" for k, v in filters.items() if k in CHOICES and not (isinstance(v, list) and v)]
    if len(filters) > MAX_BOUNDS:
        wrong.append(f"more than {MAX_BOUNDS} filters")
    if wrong:
        raise ValueError("; ".join(sorted(wrong)))


def split_filters(filters: Mapping[str, object], capabilities: Iterable[str]) -> tuple[dict, dict]:
    """The filters that a source applies, and those left to apply here."""
    able = set(capabilities)
    return {k: v for k, v in filters.items() if k in able}, {k: v for k, v in filters.items() if k not in able and k not in SOURCE_ONLY}


def residual(filters: Mapping[str, object]) -> Column:
    """The predicate of the filters left: a null never drops a row."""
    check_filters(filters)
    parts = [F.lit(True)]
    for name, given in filters.items():
        if name in SOURCE_ONLY:
            continue
        if name in CHOICES:
            parts.append(one_of(F.col(CHOICES[name]), given))
            continue
        scale = (lambda x: round(x * SQFT_PER_ACRE)) if name == "lot_acres" else (lambda x: x)
        if given.low is not None:
            parts.append(at_least(F.col(RANGES[name]), scale(given.low)))
        if given.high is not None:
            parts.append(at_most(F.col(RANGES[name]), scale(given.high)))
    return reduce(lambda a, b: a & b, parts)


class _Halving:
    """A tree of boxes: a box is a leaf or was cut at `at` of a longitude (axis 0) or latitude into the two from `child` on."""

    def __init__(self, box: Box) -> None:
        self.boxes: list[Box] = [box]
        self.axis, self.at, self.child = [-1], [0.0], [0]

    def cut(self, leaf: int) -> list[int]:
        pair = geo.halves(self.boxes[leaf])
        self.axis[leaf], self.child[leaf] = (0, len(self.boxes)) if pair[0][2] == pair[1][0] and pair[0][1] == pair[1][1] else (1, len(self.boxes))
        self.at[leaf] = pair[0][2 + self.axis[leaf]]
        for box in pair:
            self.boxes.append(box)
            for of, x in ((self.axis, -1), (self.at, 0.0), (self.child, 0)):
                of.append(x)
        return [self.child[leaf], self.child[leaf] + 1]

    def counts(self, rows: DataFrame) -> dict[int, int]:
        """How many rows lie in each leaf; a task sends a number for each that it met."""
        axis, at, child = np.array(self.axis, np.int8), np.array(self.at), np.array(self.child)
        west, south, east, north = self.boxes[0]
        outer = (east, north)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = np.zeros(len(axis), np.int64)
            for batch in batches:
                x, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (0, 1))
                own = (x >= west) & (x <= east) & (y >= south) & (y <= north)
                place = np.stack([x[own], y[own]])
                node, moving = np.zeros(place.shape[1], np.int64), np.arange(place.shape[1])
                while len(moving := moving[axis[node[moving]] >= 0]):
                    of = node[moving]
                    cut, way = at[of], axis[of]
                    # the outer edge is in the box that ends there
                    node[moving] = child[of] + ((place[way, moving] >= cut) & (cut != np.where(way == 0, *outer)))
                met += np.bincount(node, minlength=len(axis))
            some = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(met[some])], ["b", "n"])

        told = rows.select(F.col("longitude").cast("double"), F.col("latitude").cast("double")).mapInArrow(run, "b bigint, n bigint")
        return {r["b"]: r["n"] for r in told.groupBy("b").agg(F.sum("n").alias("n")).collect()}


def split_by_ceiling(rows: DataFrame, box: Box, ceiling: int, depth: int = MAX_DEPTH) -> list[tuple[Box, int, bool]]:
    """Boxes (west, south, east, north) of at most `ceiling` rows each, with their counts and whether one is still over.

    Each level halves the boxes that are over and counts all their halves in one
    aggregation, for which rows go down the tree of cuts.  There are as many boxes as
    asks, which is what a source's budget bounds.  A row on a border between two belongs
    to the one east or north of it, one on the outer east or north edge to the last box
    there.
    """
    tree, done, over = _Halving(box), [], [0]
    for level in range(depth + 1):
        counts = tree.counts(rows)
        still = [(tree.boxes[i], counts.get(i, 0), i) for i in over]
        done += [(b, n, False) for b, n, _ in still if n <= ceiling]
        over = [i for _, n, i in still if n > ceiling]
        if not over:
            return done
        if level == depth:
            return done + [(b, n, True) for b, n, _ in still if n > ceiling]
        over = [h for i in over for h in tree.cut(i)]
    return done


def cover_circle(lat: float, lon: float, miles: float, most: float) -> list[tuple[float, float, float]]:
    """Circles (lat, lon, miles) of at most `most` miles that together cover a larger one, by quarters."""
    if miles <= most:
        return [(lat, lon, miles)]
    half = miles / 2
    dy = math.degrees(half / geo.MILES)
    dx = dy / max(1e-6, math.cos(math.radians(min(89.0, abs(lat) + dy))))
    return [c for sy in (-1, 1) for sx in (-1, 1) for c in cover_circle(lat + sy * dy, lon + sx * dx, half * math.sqrt(2) * 1.02, most)]


def split_dates(first: int, last: int, parts: int) -> list[tuple[int, int]]:
    """A range of day numbers, both ends included, as consecutive ranges of nearly equal length."""
    days = last - first + 1
    parts = max(1, min(parts, days))
    edges = [first + days * i // parts for i in range(parts + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]
