"""Column expressions over coordinates in degrees, and over rings of points."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radii of the Earth that different distances are defined by.
METRES = 6_371_000.0
METRES_MEAN = 6_371_008.8
MILES = 3958.7613
MILES_ROUND = 3958.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = METRES) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def mercator(lat: Column, lon: Column, radius: float = 6_378_137.0) -> Column:
    return F.struct((F.radians(lon) * radius).alias("x"), (F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * radius).alias("y"))


def known_point(lat: Column, lon: Column) -> Column:
    """Whether a point can be a place: in range, not 0/0, not a pair of whole degrees."""
    fine = (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)) & ~((lat == F.floor(lat)) & (lon == F.floor(lon)))
    return F.coalesce(fine, F.lit(False))


def place_key(lat: Column, lon: Column, digits: int) -> Column:
    """A rounded point as the key of a cache: a street shares one."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string(f"%.{digits}f,%.{digits}f", F.round(lat, digits), F.round(lon, digits)))


#: Fixed value: decimals of the cells that records are compared in, about 110 metres.
CELL_DECIMALS = 3


def cells(lat: Column, lon: Column, decimals: int = CELL_DECIMALS) -> Column:
    """The cell that a point rounds into and those that it would half a cell further down and left; null for no place.

    Points much closer than a cell share one of these, wherever the borders run.
    """
    scale = 10.0**decimals
    at = lambda x, k: F.floor((x - k * 0.5 / scale) * scale + 0.5)
    found = F.array_distinct(F.array(*[F.concat_ws(",", at(lat, i), at(lon, j)) for i in (0, 1) for j in (0, 1)]))
    return F.when(known_point(lat, lon), found)


def grid(lat: Column, lon: Column, size: float) -> Column:
    return F.struct(F.floor(lat / size).cast("int").alias("gy"), F.floor(lon / size).cast("int").alias("gx"))


def around(lat: Column, lon: Column, miles: float) -> Column:
    """The box that holds every point within so many miles: south, west, north, east."""
    dy = F.lit(math.degrees(miles / MILES))
    dx = F.least(F.lit(180.0), dy / F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + dy)))))
    return F.struct((lat - dy).alias("south"), (lon - dx).alias("west"), (lat + dy).alias("north"), (lon + dx).alias("east"))


def ring(points: Sequence[tuple[float, float]]) -> Column:
    """A literal closed ring of (longitude, latitude) as an array of structs x, y."""
    closed = [*points, points[0]] if points[0] != points[-1] else list(points)
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in closed])


def box_ring(box: Column) -> Column:
    """The closed ring of a box (west, south, east, north)."""
    corner = lambda x, y: F.struct(box[x].alias("x"), box[y].alias("y"))
    return F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south"))


def bounds(points: Column) -> Column:
    """The extent of a ring and the middle of it."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    west, east, south, north = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"), ((west + east) / 2).alias("mid_x"), ((south + north) / 2).alias("mid_y"))


def _edges(points: Column) -> Column:
    return F.arrays_zip(F.slice(points, F.lit(1), F.size(points) - 1).alias("a"), F.slice(points, F.lit(2), F.size(points) - 1).alias("b"))


def in_ring(x: Column, y: Column, points: Column) -> Column:
    """Even-odd test of a point against a closed ring, after a test of the extent; unknown for an unknown point."""
    box = bounds(points)
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    odd = F.aggregate(_edges(points), F.lit(0), lambda n, e: n + F.coalesce(crosses(e), F.lit(False)).cast("int")) % 2 == 1
    inside = x.between(box["west"], box["east"]) & y.between(box["south"], box["north"]) & odd
    return F.when(x.isNotNull() & y.isNotNull(), inside)


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd test against all rings of a shape at once: its parts, and their holes."""
    odd = F.aggregate(rings, F.lit(False), lambda acc, r: acc != F.coalesce(in_ring(x, y, r), F.lit(False)))
    return F.when(x.isNotNull() & y.isNotNull(), odd)


def unwrapped_rings(rings: Column) -> Column:
    """Rings in one frame: where one leaps across 180 degrees, western longitudes of the shape count on from 180."""
    leaps = lambda r: F.exists(_edges(r), lambda e: (F.abs(e["b"]["x"] - e["a"]["x"]) > 180) & (F.abs(e["b"]["x"] - e["a"]["x"]) < 360))
    on = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.when(p["x"] < 0, p["x"] + 360).otherwise(p["x"]).alias("x"), p["y"].alias("y"))))
    return F.when(F.exists(rings, leaps), on).otherwise(rings)


def rings_of_geojson(text: Column) -> Column:
    """All rings of a GeoJSON Polygon or MultiPolygon, plain, as a Feature, or as the only feature of a collection; else null."""
    kind = F.get_json_object(text, "$.type")
    alone = F.get_json_object(text, "$.features[1]").isNull()
    geometry = F.when(kind == "Feature", F.get_json_object(text, "$.geometry")).when((kind == "FeatureCollection") & alone, F.get_json_object(text, "$.features[0].geometry")).otherwise(text)
    what, given = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    numbers = F.when(what == "Polygon", F.from_json(given, "array<array<array<double>>>")).when(what == "MultiPolygon", F.flatten(F.from_json(given, "array<array<array<array<double>>>>")))
    return F.transform(numbers, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))


#: What a covering circle is widened by, and its least radius in miles.
CIRCLE_MARGIN, CIRCLE_FLOOR = 0.02, 0.5


def covering_circle(points: Column) -> Column:
    """latitude, longitude and miles of a circle around a closed ring: from its centroid past its farthest vertex."""
    first = F.get(points, F.lit(0))
    moved = F.transform(points, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    s = F.aggregate(_edges(moved), zero, lambda acc, e: F.struct((acc["w"] + cross(e)).alias("w"), (acc["x"] + (e["a"]["x"] + e["b"]["x"]) * cross(e)).alias("x"), (acc["y"] + (e["a"]["y"] + e["b"]["y"]) * cross(e)).alias("y")))
    lon, lat = F.try_divide(s["x"], 3 * s["w"]) + first["x"], F.try_divide(s["y"], 3 * s["w"]) + first["y"]
    far = F.array_max(F.transform(points, lambda p: haversine(lat, lon, p["y"], p["x"], MILES)))
    return F.struct(lat.alias("latitude"), lon.alias("longitude"), F.greatest(far * (1 + CIRCLE_MARGIN), F.lit(CIRCLE_FLOOR)).alias("miles"))


def in_radius(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column, miles: Column, named: Column) -> Column:
    """inside, outside or unknown of a circle.  Where a named centre has no point its source was asked for it: inside; an address without one is unknown."""
    apart = haversine(lat, lon, centre_lat, centre_lon, MILES)
    unresolved = centre_lat.isNull() | centre_lon.isNull()
    return F.when(unresolved, F.when(named, "inside").otherwise("unknown")).when(lat.isNull() | lon.isNull(), "unknown").when(apart <= miles, "inside").otherwise("outside")


def miles_to_line(lat: Column, lon: Column, points: Column) -> Column:
    """Distance to a line's nearest segment on a flat map around the point."""
    per_degree = math.radians(1) * MILES
    kx = F.cos(F.radians(lat)) * per_degree
    flat = F.transform(points, lambda p: F.struct(((p["x"] - lon) * kx).alias("x"), ((p["y"] - lat) * per_degree).alias("y")))

    def length(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        along = F.coalesce(F.try_divide(-(e["a"]["x"] * dx + e["a"]["y"] * dy), dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.sqrt(F.pow(e["a"]["x"] + t * dx, 2) + F.pow(e["a"]["y"] + t * dy, 2))

    return F.array_min(F.transform(_edges(flat), length))


def rounded_by_confidence(miles: Column, confidence: Column) -> Column:
    return F.when(confidence == "high", F.round(miles, 1)).when(confidence == "medium", F.round(miles, 0)).otherwise(F.round(miles / 5, 0) * 5)


def halves(box: tuple[float, float, float, float]) -> list[tuple[float, float, float, float]]:
    """A (west, south, east, north) box cut across its longer side, measured on the ground."""
    west, south, east, north = box
    if (east - west) * math.cos(math.radians((south + north) / 2)) >= north - south:
        mid = (west + east) / 2
        return [(west, south, mid, north), (mid, south, east, north)]
    mid = (south + north) / 2
    return [(west, south, east, mid), (west, mid, east, north)]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once; a column named several times, or within a lambda, is worked out each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ring_moments(points: Column, origin: Column) -> Column:
    """Twice a ring's area, without sign, and its first moments to that scale, about an origin."""
    moved = F.transform(points, lambda p: F.struct((p["x"] - origin["x"]).alias("x"), (p["y"] - origin["y"]).alias("y")))
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    add = lambda acc, e: _once(cross(e), lambda c: F.struct((acc["w"] + c).alias("w"), (acc["x"] + (e["a"]["x"] + e["b"]["x"]) * c).alias("x"), (acc["y"] + (e["a"]["y"] + e["b"]["y"]) * c).alias("y")))
    turn = lambda s: F.when(s["w"] < 0, -1.0).otherwise(1.0)
    summed = _once(moved, lambda m: F.aggregate(_edges(m), zero, add))
    return _once(summed, lambda s: F.struct((turn(s) * s["w"]).alias("w"), (turn(s) * s["x"]).alias("x"), (turn(s) * s["y"]).alias("y")))


def _ring_sign(rings: Column, ring_: Column, at: Column) -> Column:
    """1 for an outer ring, -1 for a hole: a ring whose first edge begins inside an odd number of the others is a hole."""
    a, b = F.get(ring_, F.lit(0)), F.get(ring_, F.lit(1))
    middle = F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    around = _once(middle, lambda m: F.size(F.filter(rings, lambda o, i: (i != at) & F.coalesce(in_ring(m["x"], m["y"], o), F.lit(False)))))
    return F.when(around % 2 == 1, -1.0).otherwise(1.0)


def covering_circle_of(rings: Column) -> Column:
    """latitude, longitude and miles of a circle around a shape of parts and holes: from the centroid of its area past its farthest vertex.

    Rings may turn either way.  A shape without area has no circle.
    """

    def of_sums(rings: Column, origin: Column, s: Column) -> Column:
        lon, lat = F.try_divide(s["x"], 3 * s["w"]) + origin["x"], F.try_divide(s["y"], 3 * s["w"]) + origin["y"]
        far = lambda c: F.array_max(F.transform(F.flatten(rings), lambda p: haversine(c["latitude"], c["longitude"], p["y"], p["x"], MILES)))
        circle = lambda c: F.struct(c["latitude"].alias("latitude"), c["longitude"].alias("longitude"), F.greatest(far(c) * (1 + CIRCLE_MARGIN), F.lit(CIRCLE_FLOOR)).alias("miles"))
        return F.when(s["w"] > 0, _once(F.struct(lat.alias("latitude"), lon.alias("longitude")), circle))

    def about(rings: Column, origin: Column) -> Column:
        signed = F.transform(rings, lambda r, i: F.struct(_ring_sign(rings, r, i).alias("sign"), _ring_moments(r, origin).alias("m")))
        total = lambda signed, part: F.aggregate(signed, F.lit(0.0), lambda acc, s: acc + s["sign"] * s["m"][part]).alias(part)
        return _once(_once(signed, lambda x: F.struct(*[total(x, part) for part in ("w", "x", "y")])), lambda s: of_sums(rings, origin, s))

    return _once(rings, lambda given: _once(F.get(F.get(given, F.lit(0)), F.lit(0)), lambda origin: about(given, origin)))
