"""The nearest site, however far: a join through a packed tree of sites.

Sites (points, lines or outlines) are packed into leaves sort-tile-recursive: slabs of
longitude by a range partitioning, and within a slab runs of sites in the order of
latitude.  The boxes of the leaves, a bounded number whatever the sites', are the
directory that every task has.  A point asks the leaf whose box is nearest first; what
it finds there bounds its distance, and then exactly the leaves whose boxes begin within
that bound are asked too.  So the answer is proven after two exchanges.  Points that
crowd at one leaf are dealt over several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import geo
from tidemark.sources.tables import Scratch, stored

#: Sites of a leaf at least, and leaves of the directory at most (about; one more for each slab and kind).
LEAF_SITES, MAX_LEAVES = 256, 1 << 16
#: Points that one task asks of a leaf.
POINT_ROWS = 50_000
#: Sites whose distances are worked out together, and points.
_GROUP, _CHUNK = 32, 2048
_MERCATOR = 6_378_137.0
_PER_DEGREE = math.radians(1) * geo.MILES


class Sphere:
    """Great-circle distance to points, as chords between unit vectors, which know neither poles nor a date line."""

    period = None

    def coordinates(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lon, lat = np.radians(x), np.radians(y)
        return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)

    def scale(self, y: np.ndarray) -> np.ndarray:
        return np.ones((len(y), 3))


class Mercator:
    """Distance on the Mercator map, which is true in its ranking near the point; what is told is the great circle to the outline's nearest point."""

    period = 2 * math.pi * _MERCATOR

    def coordinates(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lat = np.radians(np.clip(y, -89.9999, 89.9999))
        return np.stack([_MERCATOR * np.radians(x), _MERCATOR * np.log(np.tan(math.pi / 4 + lat / 2))], axis=1)

    def scale(self, y: np.ndarray) -> np.ndarray:
        return np.ones((len(y), 2))


class Flat:
    """Distance in miles on a flat map around the point."""

    period = 360.0

    def coordinates(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([x, y], axis=1).astype(float)

    def scale(self, y: np.ndarray) -> np.ndarray:
        return np.stack([np.cos(np.radians(y)) * _PER_DEGREE, np.full(len(y), _PER_DEGREE)], axis=1)


def _unwrapped(x: np.ndarray) -> np.ndarray:
    """Longitudes of a line's vertices without leaps: the short way across the date line."""
    leap = np.diff(x, prepend=x[:1])
    return x - 360 * np.cumsum(np.where((np.abs(leap) > 180) & (np.abs(leap) < 360), np.sign(leap), 0))


def _haversine(lat1, lon1, lat2, lon2) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.MILES * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _apart(low: np.ndarray, high: np.ndarray, at: np.ndarray, scale: np.ndarray, period: float | None) -> np.ndarray:
    """Least squared distance of each point (rows) from each box (columns)."""
    out = np.zeros((len(at), len(low)))
    for d in range(at.shape[1]):
        gaps = []
        for turn in (0.0,) if d or period is None else (0.0, period, -period):
            x = at[:, d, None] + turn
            gaps.append(np.maximum(0.0, np.maximum(low[None, :, d] - x, x - high[None, :, d])))
        out += (np.minimum.reduce(gaps) * scale[:, d, None]) ** 2
    return out


class Boxes:
    """Boxes in an order in which neighbours are near, in groups of about as many as there are groups."""

    def __init__(self, low: np.ndarray, high: np.ndarray, period: float | None):
        self.low, self.high, self.period = low, high, period
        size = max(1, math.isqrt(len(low)))
        self.starts = np.arange(0, len(low), size)
        self.ends = np.append(self.starts[1:], len(low))
        self.outer = np.minimum.reduceat(low, self.starts), np.maximum.reduceat(high, self.starts)

    def first(self, at: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """A near box for each point."""
        group = _apart(*self.outer, at, scale, self.period).argmin(axis=1)
        out = np.empty(len(at), np.int64)
        for g in np.unique(group).tolist():
            own, a, b = np.flatnonzero(group == g), self.starts[g], self.ends[g]
            out[own] = a + _apart(self.low[a:b], self.high[a:b], at[own], scale[own], self.period).argmin(axis=1)
        return out

    def within(self, at: np.ndarray, scale: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (point, box) no further apart than the point's bound, a squared distance."""
        near = _apart(*self.outer, at, scale, self.period) <= bound[:, None]
        points, boxes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in np.flatnonzero(near.any(axis=0)).tolist():
            own, a, b = np.flatnonzero(near[:, g]), self.starts[g], self.ends[g]
            p, k = np.nonzero(_apart(self.low[a:b], self.high[a:b], at[own], scale[own], self.period) <= bound[own, None])
            points.append(own[p])
            boxes.append(a + k)
        return np.concatenate(points), np.concatenate(boxes)


class _Sites:
    """The sites of a leaf: vertices end to end, edges, and boxes of small groups of them."""

    def __init__(self, metric, names: list, xs: list[np.ndarray], ys: list[np.ndarray], area: np.ndarray):
        self.metric, self.area = metric, area
        self.rank = np.empty(len(names), np.int64)  # ties go to the smaller name
        self.rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        self.xs, self.ys = [_unwrapped(x) for x in xs], ys
        size = np.array([len(x) for x in xs])
        self.first = np.cumsum(size) - size
        at = metric.coordinates(np.concatenate(self.xs), np.concatenate(ys))
        last = self.first + size - 1
        follows = np.minimum(np.arange(len(at)) + 1, np.repeat(last, size))
        self.a, self.b = at, at[follows]  # a site's last vertex is an edge of no length
        self.groups = np.arange(0, len(xs), _GROUP)
        self.group_ends = np.append(self.groups[1:], len(xs))
        vertex = self.first[self.groups]
        self.boxes = Boxes(np.minimum.reduceat(at, vertex), np.maximum.reduceat(at, vertex), metric.period)

    def of_group(self, g: int, at: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest site of a group for each point, and its squared distance."""
        s, e = self.groups[g], self.group_ends[g]
        v, w = self.first[s], self.first[e] if e < len(self.first) else len(self.a)
        starts = self.first[s:e] - v
        best = None
        for turn in (0.0,) if self.metric.period is None else (0.0, self.metric.period, -self.metric.period):
            moved = at.copy()
            moved[:, 0] += turn
            far, along = np.zeros((len(at), w - v)), np.zeros((len(at), w - v))
            length = np.zeros((len(at), w - v))
            parts = [((self.a[v:w, d] - moved[:, d, None]) * scale[:, d, None], (self.b[v:w, d] - self.a[v:w, d])[None, :] * scale[:, d, None]) for d in range(at.shape[1])]
            for to, step in parts:
                along -= to * step
                length += step * step
            t = np.clip(np.divide(along, length, out=np.zeros_like(along), where=length > 0), 0.0, 1.0)
            for to, step in parts:
                far += (to + t * step) ** 2
            own = np.minimum.reduceat(far, starts, axis=1)
            if self.area[s:e].any():
                x, y = moved[:, 0, None], moved[:, 1, None]
                ax, ay, bx, by = self.a[v:w, 0], self.a[v:w, 1], self.b[v:w, 0], self.b[v:w, 1]
                rise = np.where(by == ay, 1.0, by - ay)
                crossed = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / rise + ax)
                own[(np.add.reduceat(crossed, starts, axis=1) % 2 == 1) & self.area[s:e]] = 0.0
            best = own if best is None else np.minimum(best, own)
        least = best.min(axis=1)
        which = np.where(best == least[:, None], self.rank[s:e], len(self.rank)).argmin(axis=1)
        return s + which, least

    def nearest(self, at: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        site, far = np.zeros(len(at), np.int64), np.full(len(at), np.inf)

        def ask(points: np.ndarray, groups: np.ndarray) -> None:
            for g in np.unique(groups).tolist():
                own = points[groups == g]
                s, f = self.of_group(g, at[own], scale[own])
                better = (f < far[own]) | (f == far[own]) & (self.rank[s] < self.rank[site[own]])
                site[own[better]], far[own[better]] = s[better], f[better]

        begun = self.boxes.first(at, scale)
        ask(np.arange(len(at)), begun)
        p, g = self.boxes.within(at, scale, far * (1 + 1e-9))
        other = g != begun[p]
        ask(p[other], g[other])
        return site, far

    def miles(self, x: np.ndarray, y: np.ndarray, site: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Great-circle miles from each point to its site: to the nearest point of the outline in degrees, none inside."""
        out = np.zeros(len(x))
        for s in np.unique(site[far > 0]).tolist():
            own = np.flatnonzero((site == s) & (far > 0))
            px, py = x[own, None], y[own, None]
            sx, sy = self.xs[s], self.ys[s]
            px = px + 360 * np.round((sx.mean() - px) / 360)
            dx, dy = np.append(np.diff(sx), 0.0), np.append(np.diff(sy), 0.0)
            length = dx * dx + dy * dy
            t = np.clip(((px - sx) * dx + (py - sy) * dy) / np.where(length > 0, length, 1.0), 0.0, 1.0)
            ex, ey = sx + t * dx, sy + t * dy
            at = ((ex - px) ** 2 + (ey - py) ** 2).argmin(axis=1)
            rows = np.arange(len(own))
            out[own] = _haversine(y[own], x[own], ey[rows, at], ex[rows, at])
        return out


def _vertices(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    xs, ys = [], []
    for path in column.to_pylist():
        xs.append(np.array([p["x"] for p in path], float))
        ys.append(np.array([p["y"] for p in path], float))
    return xs, ys


class Tree:
    """Leaves of sites, stored, and their directory."""

    def __init__(self, keep: Scratch, sites: DataFrame, metric, site: str, kind: str):
        """sites: site, kind, path (vertices x, y), area."""
        self.metric, self.site, self.kind = metric, site, kind
        spark = sites.sparkSession
        known = keep(sites.where((F.size("path") > 0) & ~F.exists("path", lambda p: p["x"].isNull() | p["y"].isNull())))
        n = known.count()
        size = max(LEAF_SITES, -(-n // MAX_LEAVES))
        slabs = max(1, round(math.sqrt(n / size)))
        middle = lambda c: F.aggregate("path", F.lit(0.0), lambda acc, p: acc + p[c]) / F.size("path")
        ordered = known.withColumn("_x", middle("x")).withColumn("_y", middle("y")).repartitionByRange(slabs, kind, "_x").sortWithinPartitions(kind, "_y", site)
        dims = metric.coordinates(np.zeros(1), np.zeros(1)).shape[1]

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            slab, leaf, filled, now = TaskContext.get().partitionId(), -1, 0, None
            for batch in batches:
                xs, ys = _vertices(batch.column(batch.schema.get_field_index("path")))
                kinds = batch.column(batch.schema.get_field_index(kind)).to_pylist()
                leaves = []
                for k in kinds:
                    if leaf < 0 or filled == size or k != now:
                        leaf, filled, now = leaf + 1, 0, k
                    filled += 1
                    leaves.append((slab << 32) + leaf)
                boxes = []
                for x, y in zip(xs, ys, strict=True):
                    at = metric.coordinates(_unwrapped(x), y)
                    boxes.append([*at.min(axis=0).tolist(), *at.max(axis=0).tolist()])
                names = [c for c in batch.schema.names if c not in ("_x", "_y")]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(leaves, pa.int64()), pa.array(boxes, pa.list_(pa.float64()))], [*names, "leaf", "box"])

        schema = T.StructType([*known.schema.fields, T.StructField("leaf", T.LongType()), T.StructField("box", T.ArrayType(T.DoubleType()))])
        self.leaves = keep(ordered.mapInArrow(packed, schema))
        edge = [F.min(F.col("box")[d]).alias(f"l{d}") for d in range(dims)] + [F.max(F.col("box")[dims + d]).alias(f"h{d}") for d in range(dims)]
        rows = self.leaves.groupBy(kind, "leaf").agg(*edge).orderBy(kind, "leaf").collect()
        by_kind: dict = {}
        for r in rows:
            by_kind.setdefault(r[0], []).append(r)
        told = {k: (np.array([r[1] for r in own], np.int64), np.array([r[2 : 2 + dims] for r in own]), np.array([r[2 + dims :] for r in own])) for k, own in by_kind.items()}
        self.directory = spark.sparkContext.broadcast(told)

    def asked(self, points: DataFrame, point: str, found: bool) -> DataFrame:
        """(point, _px, _py, kind, leaf): the leaf that each point asks of each kind first, or, with what was found there (far, leaf), the others within reach."""
        directory, metric, kind = self.directory, self.metric, self.kind

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = {k: (leaves, Boxes(low, high, metric.period)) for k, (leaves, low, high) in directory.value.items()}
            for batch in batches:
                column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                x, y = column["_px"].to_numpy(), column["_py"].to_numpy()
                kinds = np.array([*column[kind].to_pylist(), None], object)[:-1] if found else None
                for k, (leaves, boxes) in trees.items():
                    mine = np.flatnonzero(np.array([v == k for v in kinds], bool)) if found else np.arange(len(x))
                    for a in range(0, len(mine), _CHUNK):
                        own = mine[a : a + _CHUNK]
                        at, scale = metric.coordinates(x[own], y[own]), metric.scale(y[own])
                        if found:
                            row, box = boxes.within(at, scale, column["far"].to_numpy()[own] * (1 + 1e-9))
                            other = leaves[box] != column["leaf"].to_numpy()[own[row]]
                            row, leaf = own[row[other]], leaves[box[other]]
                        else:
                            row, leaf = own, leaves[boxes.first(at, scale)]
                        take = pa.array(row)
                        of_kind = pa.array([k] * len(row), kind_type)
                        yield pa.RecordBatch.from_arrays([column[point].take(take), column["_px"].take(take), column["_py"].take(take), of_kind, pa.array(leaf)], [point, "_px", "_py", kind, "leaf"])

        from pyspark.sql.pandas.types import to_arrow_type

        kind_type = to_arrow_type(self.leaves.schema[kind].dataType)
        fields = [points.schema[point], points.schema["_px"], points.schema["_py"], self.leaves.schema[kind], T.StructField("leaf", T.LongType())]
        return points.mapInArrow(work, T.StructType(fields))

    def answers(self, keep: Scratch, asked: DataFrame, point: str) -> DataFrame:
        """(point, _px, _py, kind, leaf, site, far, miles) of the leaves that were asked."""
        asked = keep(asked)
        metric, site, kind = self.metric, self.site, self.kind
        crowds = asked.groupBy("leaf").agg(F.count("*").alias("_n")).where(F.col("_n") > POINT_ROWS).select("leaf", F.ceil(F.col("_n") / POINT_ROWS).cast("int").alias("_lots"))
        crowds = F.broadcast(keep(crowds))  # of the leaves, whose number is bounded
        lots = F.coalesce("_lots", F.lit(1))
        dealt = asked.join(crowds, "leaf", "left").withColumn("_lot", F.pmod(F.xxhash64(point, "_px", "_py"), lots).cast("int")).drop("_lots")
        held = self.leaves.drop("box", kind).join(crowds, "leaf", "left").withColumn("_lot", F.explode(F.sequence(F.lit(0), lots - 1))).drop("_lots")

        def meet(key: tuple[pa.Scalar, ...], ours: pa.Table, theirs: pa.Table) -> pa.Table:
            ours, theirs = ours.combine_chunks(), theirs.sort_by([("_y", "ascending"), (site, "ascending")])
            which, far, miles = np.zeros(ours.num_rows, np.int64), np.zeros(ours.num_rows), np.zeros(ours.num_rows)
            if ours.num_rows:
                names = theirs[site].combine_chunks()
                sites = _Sites(metric, names.to_pylist(), *_vertices(theirs["path"]), np.array(theirs["area"].to_pylist(), bool))
                x, y = ours["_px"].to_numpy(), ours["_py"].to_numpy()
                for a in range(0, len(x), _CHUNK):
                    part = slice(a, a + _CHUNK)
                    which[part], far[part] = sites.nearest(metric.coordinates(x[part], y[part]), metric.scale(y[part]))
                    miles[part] = np.sqrt(far[part]) if isinstance(metric, Flat) else sites.miles(x[part], y[part], which[part], far[part])
                found = names.take(pa.array(which))
            else:
                found = theirs[site].combine_chunks().slice(0, 0)
            columns = [*(ours[c] for c in (point, "_px", "_py", kind, "leaf")), found, pa.array(far), pa.array(miles)]
            return pa.table(columns, names=[point, "_px", "_py", kind, "leaf", site, "far", "miles"])

        fields = [*(asked.schema[c] for c in (point, "_px", "_py", kind, "leaf")), self.leaves.schema[site], T.StructField("far", T.DoubleType()), T.StructField("miles", T.DoubleType())]
        order = ["leaf", "_lot"]
        return dealt.groupBy(*order).cogroup(held.withColumn("_y", F.col("path")[0]["y"]).groupBy(*order)).applyInArrow(meet, T.StructType(fields))


def nearest_join(points: DataFrame, sites: DataFrame, metric, point: str = "id", site: str = "site", kind: str | None = None) -> DataFrame:
    """(point, kind, site, miles), or (point, site, miles) without kinds: the nearest site of each kind, ties to the smaller.

    points: ids that differ, latitude and longitude.  sites: site, kind, path (an array of
    vertices x, y: one for a point, closed for an outline) and area (whether it has an
    inside, in which the distance is none).  Points without a place and kinds without
    sites have no row.  Sites without a vertex are left out.
    """
    own = kind or "_kind"
    with Scratch() as keep:
        given = sites.select(F.col(site), (F.col(kind) if kind else F.lit(0)).alias(own), "path", "area")
        tree = Tree(keep, given, metric, site, own)
        placed = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(F.col(point), F.col("longitude").cast("double").alias("_px"), F.col("latitude").cast("double").alias("_py"))
        first = keep(tree.answers(keep, tree.asked(placed, point, False), point))
        second = tree.answers(keep, tree.asked(first, point, True), point)
        best = first.unionByName(second).groupBy(point, own).agg(F.min(F.struct("far", site, "miles")).alias("_b"))
        return stored(best.select(point, *([own] if kind else []), F.col(f"_b.{site}").alias(site), F.col("_b.miles").alias("miles")))


def point_paths(sites: DataFrame) -> DataFrame:
    """Sites with latitude and longitude as paths of one vertex."""
    vertex = F.struct(F.col("longitude").cast("double").alias("x"), F.col("latitude").cast("double").alias("y"))
    placed = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.array(vertex)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    return sites.withColumn("path", placed).withColumn("area", F.lit(False))


def outline_paths(sites: DataFrame) -> DataFrame:
    """Sites with an outline of three or more vertices as closed paths with an inside; the others are points."""
    some = F.size(F.coalesce("outline", F.array().cast("array<struct<x:double,y:double>>"))) >= 3
    first, last = F.element_at("outline", 1), F.element_at("outline", -1)
    closed = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), F.col("outline")).otherwise(F.concat("outline", F.array(first)))
    return point_paths(sites).withColumn("path", F.when(some, closed).otherwise(F.col("path"))).withColumn("area", some)
