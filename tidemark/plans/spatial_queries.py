"""Spatial and enrichment operators over made coordinates and the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.values import solar_time
from tidemark.operators import enrich as e
from tidemark.operators import spatial as s
from tidemark.plans import worlds as w

QUERIES = {}
MILES = 25.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


_BASE = f"c AS ({w.places_sql('customer', 'c_custkey')}), st AS (SELECT *, id AS site, id % 4 AS condition FROM ({w.places_sql('supplier', 's_suppkey')}))"
_NEAR = f"{_BASE}, near AS (SELECT c.id, st.site, st.condition, {w.miles_sql('c', 'st', geo.MILES_ROUND)} AS miles FROM c, st WHERE {w.miles_sql('c', 'st', geo.MILES_ROUND)} <= {MILES})"


def _customers(spark, sf_dir):
    return w.places(spark, sf_dir, "customer", "c_custkey")


@query("within_distance", f"WITH {_NEAR} SELECT id, site, round(miles, 4) AS miles FROM near")
def within_distance(spark, sf_dir):
    return s.within(_customers(spark, sf_dir), w.sites(spark, sf_dir), MILES, told=F.round("miles", 4))


@query("nearest_site", f"WITH {_NEAR} SELECT c.id, arg_min(site, miles) AS site, round(min(miles), 4) AS miles FROM c LEFT JOIN near USING (id) GROUP BY c.id")
def nearest_site(spark, sf_dir):
    return s.nearest(_customers(spark, sf_dir), w.sites(spark, sf_dir), MILES).select("id", "site", F.round("miles", 4).alias("miles"))


@query("surroundings", f"WITH {_NEAR} SELECT c.id, count(site) AS n, arg_min(site, miles) AS nearest, round(min(miles), 4) AS miles, min(condition) AS worst FROM c LEFT JOIN near USING (id) GROUP BY c.id")
def surroundings(spark, sf_dir):
    return s.surroundings(_customers(spark, sf_dir), w.sites(spark, sf_dir), MILES, "condition").withColumn("miles", F.round("miles", 4))


def _inside_sql() -> str:
    edges = [(n, *a, *b) for n, ring in w.SHAPES.items() for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    values = ", ".join(f"('{n}', {x1}, {y1}, {x2}, {y2})" for n, x1, y1, x2, y2 in edges)
    return f"""edges(shape, x1, y1, x2, y2) AS (VALUES {values}),
crossed AS (SELECT c.id, e.shape, count(*) FILTER ((y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1)::DOUBLE * (latitude - y1) / nullif(y2 - y1, 0)::DOUBLE + x1) AS n FROM c, edges e GROUP BY ALL),
inside AS (SELECT id, shape FROM crossed WHERE n % 2 = 1)"""


def _shapes(spark):
    rows = F.array(*[F.struct(F.lit(n).alias("shape"), geo.ring(p).alias("ring")) for n, p in w.SHAPES.items()])
    return spark.range(1).select(F.inline(rows))


@query("points_in_shapes", f"WITH {_BASE}, {_inside_sql()} SELECT id, shape FROM inside")
def points_in_shapes(spark, sf_dir):
    return s.in_shapes(_customers(spark, sf_dir), _shapes(spark), 0.5)


@query("shape_counts", f"WITH {_BASE}, {_inside_sql()} SELECT shape, count(*) AS n, count(*) FILTER (id % 3 = 0) AS thirds, max(id) AS latest FROM inside GROUP BY shape")
def shape_counts(spark, sf_dir):
    hit = s.in_shapes(_customers(spark, sf_dir), _shapes(spark), 0.5)
    return hit.groupBy("shape").agg(F.count("*").alias("n"), F.count_if(F.col("id") % 3 == 0).alias("thirds"), F.max("id").alias("latest"))


@query("first_shape", f"WITH {_BASE}, {_inside_sql()} SELECT c.id, min(shape) AS shape FROM c LEFT JOIN inside USING (id) GROUP BY c.id")
def first_shape(spark, sf_dir):
    c = _customers(spark, sf_dir)
    hit = s.in_shapes(c, _shapes(spark), 0.5).groupBy("id").agg(F.min("shape").alias("shape"))
    return c.select("id").join(hit, "id", "left")


@query("where_is", f"""WITH {_BASE}, {_inside_sql()}, f AS (SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE bool_or(shape = 'notch') END AS n, coalesce(bool_or(shape = 'south'), false) AS x FROM c LEFT JOIN inside USING (id) GROUP BY id)
SELECT CASE WHEN id % 6 <> 0 AND x THEN 'outside' WHEN id % 6 = 0 THEN 'unlocatable' WHEN coalesce(n, false) THEN 'inside' ELSE 'outside' END AS place, count(*) AS n FROM f GROUP BY 1""")
def where_is(spark, sf_dir):
    y, x = (F.when(F.col("id") % 6 != 0, F.col(c)) for c in ("latitude", "longitude"))
    area, out = (geo.in_ring(x, y, geo.ring(w.SHAPES[n])) for n in ("notch", "south"))
    return _customers(spark, sf_dir).select(s.where_is(y, x, [area], [out]).alias("place")).groupBy("place").agg(F.count("*").alias("n"))


@query("circle_groups", f"""WITH RECURSIVE {_BASE}, p AS (SELECT a.site AS a, b.site AS b FROM st a, st b WHERE {w.miles_sql('a', 'b', geo.MILES_ROUND)} <= 24),
reach AS (SELECT site AS n, site AS o FROM st UNION SELECT r.n, p.b FROM reach r JOIN p ON p.a = r.o) SELECT n AS id, min(o) AS component FROM reach GROUP BY n""")
def circle_groups(spark, sf_dir):
    return s.circle_groups(w.sites(spark, sf_dir).withColumnRenamed("site", "id"), 12.0)


@query("radius_filter", f"WITH {_BASE} SELECT id FROM c WHERE 2 * {geo.MILES} * asin(least(1.0, sqrt(power(sin((radians(32.5) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(32.5)) * power(sin(radians(-102.5 - longitude) / 2), 2)))) <= 60")
def radius_filter(spark, sf_dir):
    y, x = F.col("latitude"), F.col("longitude")
    box = geo.around(F.lit(32.5), F.lit(-102.5), 60.0)
    near = y.between(box["south"], box["north"]) & x.between(box["west"], box["east"])
    return _customers(spark, sf_dir).where(near & (geo.haversine(y, x, F.lit(32.5), F.lit(-102.5), geo.MILES) <= 60)).select("id")


@query("mercator", f"WITH {_BASE} SELECT id, round(radians(longitude) * 6378137.0, 2) AS x, round(ln(tan(pi() / 4 + radians(latitude) / 2)) * 6378137.0, 2) AS y FROM c")
def mercator(spark, sf_dir):
    m = geo.mercator(F.col("latitude"), F.col("longitude"))
    return _customers(spark, sf_dir).select("id", F.round(m["x"], 2).alias("x"), F.round(m["y"], 2).alias("y"))


@query("known_points", f"WITH {_BASE} SELECT id, NOT (latitude = floor(latitude) AND longitude = floor(longitude)) AS known FROM c")
def known_points(spark, sf_dir):
    return _customers(spark, sf_dir).select("id", geo.known_point(F.col("latitude"), F.col("longitude")).alias("known"))


@query("place_keys", f"WITH {_BASE} SELECT printf('%.4f,%.4f', round(latitude, 4), round(longitude, 4)) AS k, count(*) AS n, min(id) AS first_id FROM c GROUP BY 1")
def place_keys(spark, sf_dir):
    return _customers(spark, sf_dir).groupBy(geo.place_key(F.col("latitude"), F.col("longitude"), 4).alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("nearest_line", f"""WITH {_BASE}, seg(line, x1, y1, x2, y2) AS (VALUES ('n', -105.0, 34.0, -102.0, 33.0), ('n', -102.0, 33.0, -100.0, 34.5), ('s', -104.0, 30.0, -101.0, 31.0)),
flat AS (SELECT id, line, (x1 - longitude) * kx AS x1, (y1 - latitude) * k AS y1, (x2 - longitude) * kx AS x2, (y2 - latitude) * k AS y2
  FROM (SELECT *, radians(1) * {geo.MILES} AS k, cos(radians(latitude)) * radians(1) * {geo.MILES} AS kx FROM c, seg)),
far AS (SELECT id, line, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least(1, -(x1 * (x2 - x1) + y1 * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) AS t FROM flat),
d AS (SELECT id, line, min(sqrt(power(x1 + t * dx, 2) + power(y1 + t * dy, 2))) AS m FROM far GROUP BY ALL)
SELECT id, arg_min(line, m) AS line, round(min(m), 4) AS miles FROM d GROUP BY id""")
def nearest_line(spark, sf_dir):
    paths = {"n": [(-105.0, 34.0), (-102.0, 33.0), (-100.0, 34.5)], "s": [(-104.0, 30.0), (-101.0, 31.0)]}
    points = lambda p: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p])
    lines = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("line"), points(p).alias("path")) for n, p in paths.items()])))
    return s.nearest_line(_customers(spark, sf_dir), lines).withColumn("miles", F.round("miles", 4))


_HALF = 0.02


@query("nearest_outline", f"""WITH {_BASE}, sq AS (SELECT id AS site, id % 3 AS kind, latitude AS y, longitude AS x, CASE WHEN id % 2 = 0 THEN {_HALF} ELSE 0.0 END AS h FROM st),
near AS (SELECT c.id, kind, site, c.latitude, c.longitude, greatest(x - h, least(x + h, c.longitude)) AS px, greatest(y - h, least(y + h, c.latitude)) AS py FROM c, sq),
far AS (SELECT *, power(radians(px - longitude), 2) + power(ln(tan(pi() / 4 + radians(py) / 2)) - ln(tan(pi() / 4 + radians(latitude) / 2)), 2) AS f FROM near),
best AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY id, kind ORDER BY f, site) = 1)
SELECT b.id, b.kind, b.site, round({w.miles_sql('b', 'p', geo.MILES)}, 6) AS miles FROM best b, LATERAL (SELECT b.py AS latitude, b.px AS longitude) p""")
def nearest_outline(spark, sf_dir):
    """The nearest supplier of each of three kinds: every other one is a square, to whose border the way is measured."""
    corner = lambda x, y: F.struct((F.col("longitude") + x * _HALF).alias("x"), (F.col("latitude") + y * _HALF).alias("y"))
    square = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
    sites = w.sites(spark, sf_dir).withColumn("kind", F.col("site") % 3).withColumn("outline", F.when(F.col("site") % 2 == 0, square))
    return s.nearest_outline(_customers(spark, sf_dir), sites).withColumn("miles", F.round("miles", 6))


@query("rounded_distances", f"WITH {_NEAR} SELECT id, site, CASE condition WHEN 0 THEN round(miles, 1) WHEN 1 THEN round(miles, 0) ELSE round(miles / 5, 0) * 5 END AS about FROM near")
def rounded_distances(spark, sf_dir):
    confidence = F.when(F.col("condition") == 0, "high").when(F.col("condition") == 1, "medium").otherwise("low")
    near = s.within(_customers(spark, sf_dir), w.sites(spark, sf_dir), MILES, keep=["condition"], told=geo.rounded_by_confidence(F.col("miles"), confidence))
    return near.select("id", "site", F.col("miles").alias("about"))


_CACHE = "cache AS (SELECT o_custkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'zone' WHEN 1 THEN 'soil' ELSE 'wind' END AS name, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS value, o_orderdate AS fetched, o_orderkey AS seq FROM orders QUALIFY row_number() OVER (PARTITION BY k, name ORDER BY fetched DESC, seq DESC) = 1)"


def _cache(spark, sf_dir):
    from tidemark.operators.history import latest_per_key

    o = w.table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 3 == 0, "zone").when(F.col("o_orderkey") % 3 == 1, "soil").otherwise("wind")
    rows = o.select(F.col("o_custkey").alias("k"), name.alias("name"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("value"), F.col("o_orderdate").alias("fetched_at"), F.col("o_orderkey").alias("seq"))
    return latest_per_key(rows, ["k", "name"], ["fetched_at", "seq"]).drop("seq")


_NOW, _TTL = "2000-01-01", 1200


@query("cache_states", f"""WITH {_CACHE}, x AS (SELECT c_custkey AS k, n.name, c.k AS asked, value, fetched FROM customer CROSS JOIN (VALUES ('zone'), ('soil')) n(name) LEFT JOIN cache c ON c.k = c_custkey AND c.name = n.name)
SELECT k, max(value) FILTER (name = 'zone') AS zone_value, max(value) FILTER (name = 'soil') AS soil_value,
  max(st) FILTER (name = 'zone') AS zone_status, max(st) FILTER (name = 'soil') AS soil_status
FROM (SELECT *, CASE WHEN asked IS NULL THEN 'missing' WHEN epoch(TIMESTAMP '{_NOW}' - fetched) / 86400.0 > {_TTL} THEN 'stale' ELSE 'fresh' END AS st FROM x) GROUP BY k""")
def cache_states(spark, sf_dir):
    rows = w.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return e.attach_cached(rows, _cache(spark, sf_dir), "k", ["zone", "soil"], F.lit(_NOW).cast("timestamp_ntz"), F.lit(_TTL))


@query("known_values", f"WITH {_CACHE} SELECT k, string_agg(name || '=' || coalesce(value, '-'), ';' ORDER BY name) AS known FROM cache GROUP BY k")
def known_values(spark, sf_dir):
    known = e.known_values(_cache(spark, sf_dir), "k")
    return known.select("k", F.array_join(F.transform(F.map_entries("known"), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("-")))), ";").alias("known"))


@query("keys_to_ask", f"WITH {_CACHE} SELECT c_custkey AS k, min(c_custkey) AS first_place FROM customer WHERE c_custkey NOT IN (SELECT k FROM cache WHERE epoch(TIMESTAMP '{_NOW}' - fetched) / 86400.0 <= {_TTL}) GROUP BY 1")
def keys_to_ask(spark, sf_dir):
    places = w.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("first_place"))
    return e.keys_to_ask(places, _cache(spark, sf_dir), "k", F.lit(_NOW).cast("timestamp_ntz"), F.lit(_TTL), "first_place")


@query("latest_success", f"""WITH {w.OBS_SQL} SELECT entity, arg_max(bucket, event_id) FILTER (event_id % 4 <> 0) AS value, max(event_id) FILTER (event_id % 4 <> 0) AS fetched_at,
max(event_id) > max(event_id) FILTER (event_id % 4 <> 0) AS stale FROM obs GROUP BY entity HAVING count(*) FILTER (event_id % 4 <> 0) > 0""")
def latest_success(spark, sf_dir):
    o = w.observations(spark, sf_dir)
    log = o.select("entity", F.col("bucket").alias("value"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 4 != 0, "ok").otherwise("failed").alias("outcome"))
    return e.latest_success(log, "entity")


@query("best_by_block", """SELECT l_orderkey AS block, nullif(max(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END), 0) AS best_down, nullif(max(l_discount * 100), 0) AS best_up,
  string_agg(DISTINCT l_returnflag || l_linestatus, '; ' ORDER BY l_returnflag || l_linestatus) AS providers FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1""")
def best_by_block(spark, sf_dir):
    li = w.table(spark, sf_dir, "lineitem")
    down = F.when(F.col("l_linenumber") == 1, "n/a").otherwise(F.col("l_quantity").cast("string"))
    rows = li.select(F.col("l_orderkey").alias("block"), down.alias("down"), (F.col("l_discount") * 100).alias("up"), F.concat("l_returnflag", "l_linestatus").alias("brand"), "l_suppkey")
    return e.best_by_block(rows, "block", "down", "up", "brand", F.col("l_suppkey") % 3 != 0)


@query("region_answers", """WITH b AS (SELECT s_suppkey AS k, s_nationkey AS region, nullif(greatest(s_acctbal, 0), 0) AS d FROM supplier WHERE s_nationkey < 12)
SELECT c_custkey, CASE WHEN d IS NOT NULL THEN 'served' WHEN c_nationkey IN (SELECT region FROM b) THEN 'unserved' ELSE 'unknown' END AS answer FROM customer LEFT JOIN b ON b.k = c_custkey""")
def region_answers(spark, sf_dir):
    blocks = w.table(spark, sf_dir, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("region"), F.nullif(F.greatest("s_acctbal", F.lit(0.0)), F.lit(0.0)).alias("best_down"))
    points = w.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("region"))
    return e.with_known_region(points, blocks, "k", "region").select("c_custkey", "answer")


@query("recent_mean", "SELECT o_custkey, round(avg(o_totalprice), 4) AS mean FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3) WHERE o_totalprice > 100000 GROUP BY 1")
def recent_mean(spark, sf_dir):
    return e.recent_mean(w.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 3, 100000, digits=4)


@query("prevailing", """WITH r AS (SELECT s_nationkey, s_suppkey, greatest(s_acctbal, 0) AS p FROM supplier)
SELECT s_nationkey, CASE WHEN max(p) > 0 THEN (SELECT s_suppkey FROM r x WHERE x.s_nationkey = r.s_nationkey AND p > 0 ORDER BY p DESC, s_suppkey LIMIT 1) END AS prevailing, round(sum(p), 4) AS total FROM r GROUP BY s_nationkey""")
def prevailing(spark, sf_dir):
    rows = w.table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.greatest("s_acctbal", F.lit(0.0)).alias("p"))
    return e.prevailing(rows, "s_nationkey", "s_suppkey", "p")


@query("fold_updates", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS emergency, max(l_linenumber) AS damage, coalesce(min(l_shipdate) FILTER (l_linestatus = 'O'), min(l_shipdate)) AS issued FROM lineitem GROUP BY 1")
def fold_updates(spark, sf_dir):
    rows = w.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("flag"), "l_linenumber", F.when(F.col("l_linestatus") == "O", "NEW").otherwise("CON").alias("action"), "l_shipdate")
    return e.fold_updates(rows, ["l_orderkey"], "flag", F.col("l_linenumber"), "action", "l_shipdate")


@query("answerable_regions", """WITH held AS (SELECT DISTINCT s_nationkey AS region FROM supplier WHERE s_suppkey % 10 < 8), near AS (SELECT a.n_nationkey AS region, b.n_nationkey AS near FROM nation a JOIN nation b ON abs(a.n_nationkey - b.n_nationkey) = 1)
SELECT region FROM held WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.region = held.region AND near.near NOT IN (SELECT region FROM held))""")
def answerable_regions(spark, sf_dir):
    held = w.table(spark, sf_dir, "supplier").where("s_suppkey % 10 < 8").select(F.col("s_nationkey").alias("region")).distinct()
    return e.answerable_regions(held, _neighbours(spark, sf_dir))


def _neighbours(spark, sf_dir):
    n = w.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region"))
    ids = n.select(F.col("region").alias("near"))
    return n.select("region", F.explode(F.array(F.col("region") - 1, F.col("region") + 1)).alias("near")).join(ids, "near")


@query("with_neighbours", "SELECT DISTINCT n_nationkey + d AS region FROM nation, (VALUES (-1), (0), (1)) x(d) WHERE n_regionkey = 1 AND n_nationkey + d BETWEEN 0 AND 24")
def with_neighbours(spark, sf_dir):
    regions = w.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("region"))
    return e.with_neighbours(regions, _neighbours(spark, sf_dir))


@query("solar_dates", f"WITH {_BASE} SELECT event_id, CAST(ts + to_hours(CAST(round_even(longitude / 15, 0) AS INT)) AS DATE) AS day FROM events JOIN c ON c.id = user_id + 1")
def solar_dates(spark, sf_dir):
    ev, c = w.table(spark, sf_dir, "events"), _customers(spark, sf_dir)
    return ev.join(c, c["id"] == ev["user_id"] + 1).select("event_id", solar_time(F.col("ts"), F.col("longitude")).cast("date").alias("day"))


@query("date_window", "SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY 1")
def date_window(spark, sf_dir):
    day = F.to_date("ts")
    return w.table(spark, sf_dir, "events").where(day.between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date"))).groupBy("event_type").agg(F.count("*").alias("n"))
