"""Wide rows, derived texts, addresses, shapes and feeds over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import address as ad
from tidemark.functions import geo
from tidemark.functions import text as t
from tidemark.functions import values as v
from tidemark.operators import results as r
from tidemark.operators import rows as ro
from tidemark.operators import spatial as s
from tidemark.plans import worlds as w
from tidemark.sources import feeds, tables

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


# rows


@query("entity_rows", f"""WITH {w.OBS_SQL}, latest AS (SELECT entity, run_seq, status, bucket FROM snap QUALIFY row_number() OVER (PARTITION BY entity ORDER BY run_seq DESC, event_id DESC) = 1),
tags AS (SELECT entity, string_agg(DISTINCT status, ',' ORDER BY status) AS tags FROM snap GROUP BY entity), links AS (SELECT entity, coalesce(string_agg(DISTINCT CASE WHEN run_seq < 9 THEN source END, ',' ORDER BY CASE WHEN run_seq < 9 THEN source END), '') AS links FROM obs GROUP BY entity),
notes AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS note FROM customer)
SELECT l.*, tags, links, note FROM latest l LEFT JOIN tags USING (entity) LEFT JOIN links USING (entity) LEFT JOIN notes USING (entity)""")
def entity_rows(spark, sf_dir):
    from tidemark.operators.history import latest_per_key

    snaps, obs = w.snapshots(spark, sf_dir), w.observations(spark, sf_dir)
    latest = latest_per_key(snaps, ["entity"], ["run_seq", "event_id"]).select("entity", "run_seq", "status", "bucket")
    noted = (F.col("c_custkey") % 3 == 0) & (F.col("c_mktsegment") != "BUILDING")
    notes = w.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.when(noted, F.col("c_mktsegment")).alias("note"))
    early = obs.withColumn("source", F.when(F.col("run_seq") < 9, F.col("source")))
    rows = ro.entity_rows(latest, tags=ro.folded(snaps, "tags", ["status"]), links=ro.folded(early, "links", ["source"]), notes=notes)
    return rows.select("entity", "run_seq", "status", "bucket", F.array_join("tags.tags", ",").alias("tags"), F.array_join("links.links", ",").alias("links"), F.col("notes.note").alias("note"))


@query("criterion_values", f"""WITH {w.OBS_SQL}, upto AS (SELECT *, lag(price) OVER (PARTITION BY entity ORDER BY run_seq) AS p FROM snap WHERE run_seq <= 10),
story AS (SELECT entity, coalesce(bool_or(price < p), false) AS price_cut, CAST(greatest(0, floor(epoch(min(ts) FILTER (price > p) - min(ts)) / 86400)) AS BIGINT) AS price_raised_after_days, min(ts) AS first, min(run_seq) AS r FROM upto GROUP BY entity),
last AS (SELECT max(run_seq) AS h FROM health WHERE healthy AND run_seq <= 10)
SELECT n.entity, n.status, CAST(greatest(0, floor(epoch(TIMESTAMP '2024-01-20 00:00:00' - first) / 86400)) AS BIGINT) AS dom, price_cut, price_raised_after_days, r = 10 AS is_new,
  CASE WHEN coalesce(n.run_seq < h, false) THEN 'disappeared' ELSE 'observed' END AS presence, c.c_acctbal AS balance
FROM snap n JOIN story USING (entity) CROSS JOIN last LEFT JOIN customer c ON c.c_custkey = n.entity WHERE n.run_seq = 10""")
def criterion_values(spark, sf_dir):
    from tidemark.operators.history import presence_asof

    snaps = w.snapshots(spark, sf_dir)
    enriched = w.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("balance"))
    extracted = snaps.select("entity").distinct().withColumn("heating", F.lit("gas"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    out = ro.values_of(snaps, 10, now, enriched, extracted, presence_asof(snaps, w.healthy(spark, sf_dir), 10))
    return out.select("entity", "status", "dom", "price_cut", "price_raised_after_days", "is_new", "presence", "balance")


@query("judged_rows", f"""WITH {w.OBS_SQL}, latest AS (SELECT entity, status FROM snap QUALIFY row_number() OVER (PARTITION BY entity ORDER BY run_seq DESC, event_id DESC) = 1)
SELECT c_custkey AS entity, status, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS verdict FROM customer LEFT JOIN latest ON entity = c_custkey WHERE c_custkey % 3 = 1""")
def judged_rows(spark, sf_dir):
    from tidemark.operators.history import latest_per_key

    c = w.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    judgments = c.select("entity", F.element_at(F.array(F.lit("pass"), F.lit("keep"), F.lit(None)), (F.col("entity") % 3 + 1).cast("int")).alias("judgment"))
    latest = latest_per_key(w.snapshots(spark, sf_dir), ["entity"], ["run_seq", "event_id"]).select("entity", "status")
    notes = c.where("entity % 2 = 0").select("entity", F.col("c_mktsegment").alias("verdict"))
    return ro.judged(judgments, latest, notes, "keep").select("entity", "status", "verdict")


@query("detail", "SELECT c_custkey AS entity, c_mktsegment, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS links FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey = (SELECT max(o_custkey) FROM orders) GROUP BY ALL")
def detail(spark, sf_dir):
    orders = w.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("raw_id"), "o_orderstatus")
    customers = w.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    busiest = orders.agg(F.max("entity")).first()[0]
    told = ro.detail(busiest, customers, orders.unionByName(orders))
    return told.select("entity", "c_mktsegment", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["raw_id"], x["o_orderstatus"])), ",").alias("links"))


@query("place_notes", "SELECT c_custkey, CASE WHEN upper(c_mktsegment) IN ('BUILDING', 'MACHINERY') THEN 'about ' || lower(c_mktsegment) END AS city_note FROM customer")
def place_notes(spark, sf_dir):
    c = w.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    said = c.select(F.initcap(F.lower("c_mktsegment")).alias("name")).distinct().where(F.col("name").isin("Building", "Machinery"))
    notes = said.select(F.lit("city").alias("kind"), F.concat(F.lit(" "), F.col("name")).alias("name"), F.concat(F.lit("about "), F.lower("name")).alias("note"))
    return ro.place_notes(c, notes, "city", "c_mktsegment").select("c_custkey", "city_note")


@query("fired_sets", "SELECT DISTINCT o_orderstatus AS rule_id, o_custkey AS entity FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def fired_sets(spark, sf_dir):
    o = w.table(spark, sf_dir, "orders")
    verdicts = o.select(F.col("o_orderstatus").alias("rule_id"), F.col("o_custkey").alias("entity"), F.when(F.col("o_orderkey") % 3 == 0, "fired").otherwise("not-fired").alias("verdict"), F.when(F.col("o_orderkey") % 2 == 0, "flag").otherwise("drop").alias("severity"))
    return r.fired_sets(verdicts, ["flag"])


@query("live_count", "SELECT count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 1 AND c_custkey % 3 <> 2")
def live_count(spark, sf_dir):
    k = F.col("c_custkey")
    e = w.table(spark, sf_dir, "customer").select((k % 7 == 0).alias("retracted"), F.when(k % 5 == 1, k - 1).alias("superseded_by"), F.when(k % 3 == 2, "disappeared").otherwise("observed").alias("presence"))
    return r.live_count(e, include_disappeared=False)


@query("index_states", "SELECT o_orderstatus AS state, count(*) AS blocks, max(o_orderdate) AS as_of, max(o_orderkey) AS loaded_at FROM orders GROUP BY 1")
def index_states(spark, sf_dir):
    return r.index_states(w.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("as_of"), F.col("o_orderkey").alias("loaded_at")))


@query("empty_by_origin", """WITH c AS (SELECT CASE WHEN c_acctbal > 9999.9 THEN c_name ELSE '' END AS rich, CASE WHEN c_acctbal < -999.9 THEN c_name END AS poor, CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' END AS built, CASE WHEN c_nationkey > 24 THEN 'x' END AS gap FROM customer),
n AS (SELECT unnest(['rich', 'poor', 'built', 'gap']) AS name, unnest(['made', 'made', 'made', 'other']) AS origin, unnest([count(*) FILTER (rich <> ''), count(poor), count(built), count(gap)]) AS filled FROM c)
SELECT origin, string_agg(name, ',' ORDER BY name) AS empty FROM n WHERE filled = 0 GROUP BY origin""")
def empty_by_origin(spark, sf_dir):
    """Columns that no customer fills: whether any is rich or poor enough depends on the rows."""
    balance = F.col("c_acctbal")
    c = w.table(spark, sf_dir, "customer").select(
        F.when(balance > 9999.9, F.col("c_name")).otherwise("").alias("rich"), F.when(balance < -999.9, F.col("c_name")).alias("poor"), F.when(F.col("c_mktsegment") == "BUILDING", "x").alias("built"), F.when(F.col("c_nationkey") > 24, "x").alias("gap")
    )
    return r.empty_by_origin(r.empty_columns(c), {"rich": "made", "poor": "made", "built": "made"})


@query("clean_tags", "SELECT c_custkey % 500 AS entity, min(CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END) AS tag FROM customer WHERE c_custkey % 9 <> 0 GROUP BY c_custkey % 500, lower(c_mktsegment)")
def clean_tags(spark, sf_dir):
    k = F.col("c_custkey")
    tag = F.when(k % 9 == 0, "   ").when(k % 2 == 0, F.concat(F.lit(" "), F.upper("c_mktsegment"))).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("  ")))
    return r.clean_tags(w.table(spark, sf_dir, "customer").select((k % 500).alias("entity"), tag.alias("tag")))


@query("overlap_dedupe", """WITH rows AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'id|' || l_partkey ELSE 'at|road ' || l_partkey || '||' || l_suppkey END AS k FROM lineitem)
SELECT l_orderkey, l_linenumber FROM rows WHERE k IS NULL UNION ALL SELECT l_orderkey, l_linenumber FROM (SELECT * FROM rows WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY l_orderkey * 10 + l_linenumber) = 1)""")
def overlap_dedupe(spark, sf_dir):
    li = w.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    n = F.col("l_linenumber")
    identity = tables.row_identity(F.when(n == 2, F.col("l_partkey").cast("string")), F.when(n > 2, F.concat(F.lit(" Road  "), F.col("l_partkey"))), F.lit(None).cast("string"), F.col("l_suppkey").cast("string"))
    return tables.overlap_dedupe(li, identity, "at").select("l_orderkey", "l_linenumber")


# texts and values


@query("derived_texts", """WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_size AS z FROM part)
SELECT k, nullif(concat_ws(', ', CASE WHEN k % 2 = 0 THEN 'heat: ' || b END, CASE WHEN k % 3 = 0 THEN 'cool: ' || b END), '') AS hvac,
  CASE WHEN k % 5 <> 0 THEN concat_ws(', ', CASE WHEN z % 4 = 0 THEN '?' ELSE CAST(z AS VARCHAR) END || '/' || '? Mbps advertised', CASE WHEN k % 2 = 1 THEN b END) WHEN k % 2 = 1 THEN '?/? Mbps advertised, ' || b END AS internet,
  CASE k % 3 WHEN 0 THEN 'over a principal aquifer' WHEN 1 THEN 'not over a principal aquifer' END AS aquifer,
  CASE WHEN k % 4 <> 0 THEN CASE k % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'not decided by FEMA' END END AS flood,
  CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 7 = 0 THEN 'not surveyed' WHEN k % 3 = 0 THEN 'none recorded' ELSE z || ' cm' END END AS water FROM p""")
def derived_texts(spark, sf_dir):
    k, b, z = F.col("p_partkey"), F.col("p_brand"), F.col("p_size")
    known = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    return w.table(spark, sf_dir, "part").select(
        k.alias("k"), t.heat_and_cooling(F.when(k % 2 == 0, b), F.when(k % 3 == 0, b)).alias("hvac"),
        t.internet(F.when(k % 5 != 0, F.when(z % 4 == 0, 0).otherwise(z)), F.lit(None).cast("int"), F.when(k % 2 == 1, b).otherwise("")).alias("internet"),
        t.aquifer(known).alias("aquifer"), t.flood_area(k % 4 != 0, known).alias("flood"), t.water_table(k % 4 != 0, F.when(k % 7 == 0, "not surveyed"), F.when(k % 3 != 0, z)).alias("water"),
    )


@query("sentences_told", """WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_size AS z FROM part)
SELECT k, concat_ws(', ', b || CASE WHEN k % 2 = 0 THEN ' (D' || k || ')' ELSE '' END, CASE WHEN k % 3 = 0 THEN 'built ' || (1900 + z) END, 'condition ' || CASE WHEN k % 5 = 0 THEN 'not rated' ELSE 'fair' END || CASE WHEN k % 4 = 0 THEN ' (2020)' ELSE '' END, z || '.0 mi') AS dam,
  CASE WHEN k % 2 = 0 THEN b || ' (' || c || ')' WHEN c = 'ephemeral' THEN 'an unnamed wash (ephemeral)' WHEN c = 'river' THEN 'an unnamed river channel' WHEN c = 'stream' THEN 'an unnamed stream' ELSE 'an unnamed stream (' || c || ')' END AS channel,
  CASE WHEN k % 6 = 0 THEN 'no prevailing direction was recorded' ELSE 'most often from the NE' || CASE WHEN k % 4 = 0 THEN '' ELSE ', about ' || z || '% of the time' END END AS wind
FROM (SELECT *, (['ephemeral', 'river', 'stream', 'ditch'])[k % 4 + 1] AS c FROM p)""")
def sentences_told(spark, sf_dir):
    k, b, z = F.col("p_partkey"), F.col("p_brand"), F.col("p_size")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("ephemeral", "river", "stream", "ditch")]), (k % 4 + 1).cast("int"))
    dam = t.dam_sentence(b, F.when(k % 2 == 0, F.concat(F.lit("D"), k)), F.when(k % 3 == 0, z + 1900), F.when(k % 5 != 0, "fair").otherwise(""), F.when(k % 4 == 0, "2020"), F.lit(None).cast("string"), z.cast("double"))
    return w.table(spark, sf_dir, "part").select(k.alias("k"), dam.alias("dam"), t.channel_sentence(F.when(k % 2 == 0, b), kind).alias("channel"), t.wind_sentence(F.when(k % 6 != 0, "NE"), F.when(k % 4 != 0, z)).alias("wind"))


@query("sorted_payloads", """SELECT o_orderkey, '{"key":"' || o_orderkey || '","priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS payload FROM orders""")
def sorted_payloads(spark, sf_dir):
    o = w.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", v.sorted_json(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("key"), F.col("o_orderkey").cast("string"), F.lit("priority"), F.col("o_orderpriority"))).alias("payload"))


@query("claimed_days", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01')) END AS days FROM orders")
def claimed_days(spark, sf_dir):
    listed = F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    return w.table(spark, sf_dir, "orders").select("o_orderkey", v.claimed_days(listed, F.lit("1998-01-01").cast("date")).alias("days"))


_ZONES = [("AE", "FLOODWAY", "T"), ("A", "", ""), ("D", "", "F"), ("X", "0.2 PCT ANNUAL", "F"), ("X", "LEVEE", "F"), ("X", "", "F")]


@query("zone_severities", "SELECT c_nationkey, min(c_custkey % 6) AS worst, arg_min(c_custkey, (c_custkey % 6) * 10000000 + c_custkey) AS first FROM customer GROUP BY 1")
def zone_severities(spark, sf_dir):
    """The worst flood zone of each nation's customers, and the first one in it."""
    at = (F.col("c_custkey") % 6 + 1).cast("int")
    zone, sub, flag = (F.element_at(F.array(*[F.lit(z[i]) for z in _ZONES]), at) for i in range(3))
    ranked = w.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", v.zone_severity(zone, sub, flag).cast("bigint").alias("rank"))
    return ranked.groupBy("c_nationkey").agg(F.min("rank").alias("worst"), F.min_by("c_custkey", F.struct("rank", "c_custkey")).alias("first"))


@query("freshness_of_named", "SELECT entity FROM (SELECT c_custkey AS entity, min(ts) AS first FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1) WHERE first IS NULL OR floor(epoch(TIMESTAMP '2024-01-31' - first) / 86400) < 29 OR entity % 10 = 0")
def freshness_of_named(spark, sf_dir):
    """Customers seen for the first time of late; those never seen, and those asked for by name, pass."""
    first = w.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    c = w.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    joined = c.join(first, c["entity"] == first["user_id"], "left")
    return joined.where(v.fresh_enough(F.col("first"), F.lit("2024-01-31").cast("timestamp_ntz"), 29, F.col("entity") % 10 == 0)).select("entity")


@query("default_window", "WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events), l AS (SELECT max(day) AS d FROM e WHERE event_type = 'purchase') SELECT event_type, count(*) AS n FROM e, l WHERE day BETWEEN d - 13 AND d GROUP BY 1")
def default_window(spark, sf_dir):
    days = w.table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), (F.col("event_type") == "purchase").alias("emergency"))
    return v.date_window(days, "day", "emergency").groupBy("event_type").agg(F.count("*").alias("n"))


# addresses and places


@query("parsed_addresses", """SELECT s_suppkey, nullif(CAST(s_suppkey AS VARCHAR), '0') AS number, (['fennel', 'marigold', 'ave n', 'hwy ' || s_nationkey, NULL])[s_suppkey % 5 + 1] AS street,
  CASE WHEN s_suppkey % 2 = 0 THEN 'b' END AS unit, CASE WHEN s_suppkey <> 0 AND s_suppkey % 5 <> 4 THEN '880' || (10 + s_nationkey) || '|' || s_suppkey || '|' || (['fennel', 'marigold', 'ave n', 'hwy ' || s_nationkey])[s_suppkey % 5 + 1] END AS bare_key FROM supplier""")
def parsed_addresses(spark, sf_dir):
    """Suppliers at made addresses; the number 0 stands for none."""
    streets = F.array(F.lit("N. Fennel Ave"), F.lit("Marigold Parkway Dr"), F.lit("Avenue N"), F.concat(F.lit("Highway "), F.col("s_nationkey"), F.lit(" N")), F.lit("Tract 9 Lot 14"))
    line = F.concat(F.col("s_suppkey"), F.lit(" "), F.element_at(streets, (F.col("s_suppkey") % 5 + 1).cast("int")), F.when((F.col("s_suppkey") % 4 == 0), " Apt. B").otherwise(""))
    told = ad.parsed(line, F.when(F.col("s_suppkey") % 4 == 2, "# B"), F.concat(F.lit("880"), F.col("s_nationkey") + 10, F.lit("-1234")))
    return w.table(spark, sf_dir, "supplier").select("s_suppkey", told.alias("a")).select("s_suppkey", "a.number", "a.street", "a.unit", "a.bare_key")


@query("named_addresses", "SELECT s_suppkey FROM supplier WHERE s_nationkey = 7 AND (s_suppkey % 3 = 0 OR s_suppkey % 3 = 1)")
def named_addresses(spark, sf_dir):
    """Suppliers at the house 107 Fennel, unit 4, of whatever form: another unit is another home, none is no contradiction."""
    k = F.col("s_suppkey")
    line = F.concat(F.col("s_nationkey") + 100, F.when(k % 2 == 0, " Fennel Street").otherwise(" fennel ave"), F.when(k % 3 == 0, " #4").when(k % 3 == 1, "").otherwise(" Unit 5"))
    have = ad.parsed(line, F.lit(None).cast("string"), F.when(k % 2 == 0, "88001"))
    want = ad.parsed(F.lit("107 Fennel St"), F.lit("Apt 4"), F.lit("88001"))
    return w.table(spark, sf_dir, "supplier").where(ad.is_address(have, want)).select("s_suppkey")


@query("place_matches", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' WHEN lower(c_mktsegment) = 'building' AND c_custkey % 3 <> 1 THEN 'inside' ELSE 'outside' END AS city,
  CASE WHEN lower(c_mktsegment) = 'building' THEN 'inside' ELSE 'outside' END AS county, CASE c_custkey % 3 WHEN 0 THEN 'inside' WHEN 1 THEN 'outside' ELSE 'unknown' END AS state FROM customer""")
def place_matches(spark, sf_dir):
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    state = F.when(k % 3 == 0, "nm").when(k % 3 == 1, "TX")
    city, county, none = F.when(k % 5 != 0, F.initcap(F.lower(m))), F.concat(F.initcap(F.lower(m)), F.lit(" County")), F.lit(None).cast("string")
    return w.table(spark, sf_dir, "customer").select(
        "c_custkey", t.place_match("city", "Building, NM", city, none, state, none).alias("city"), t.place_match("county", "building county", none, county, none, none).alias("county"), t.place_match("state", "NM", none, none, state, none).alias("state")
    )


# shapes


#: A square with a square hole, and a second part; a large one around it all.
_COLLECTION = '{"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[-104.0, 31.0], [-102.0, 31.0], [-102.0, 33.0], [-104.0, 33.0], [-104.0, 31.0]], [[-103.5, 31.5], [-102.5, 31.5], [-102.5, 32.5], [-103.5, 32.5], [-103.5, 31.5]]], [[[-101.0, 34.0], [-100.5, 34.0], [-100.5, 34.5], [-101.0, 34.5], [-101.0, 34.0]]]]}}'
_AROUND = '{"type": "Polygon", "coordinates": [[[-104.7, 30.2], [-100.2, 30.2], [-100.2, 34.8], [-104.7, 34.8], [-104.7, 30.2]]]}'


def _shapes(spark):
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("shape"), F.lit(g).alias("g"), F.lit(i).alias("level")) for n, g, i in (("around", _AROUND, 0), ("holed", _COLLECTION, 1))])).alias("x")).select("x.shape", "x.level", geo.rings_of_geojson(F.col("x.g")).alias("rings"))


_INSIDE_SQL = """inside AS (
  SELECT id, 'around' AS shape, 0 AS level FROM c WHERE longitude BETWEEN -104.7 AND -100.2 AND latitude BETWEEN 30.2 AND 34.8
  UNION ALL SELECT id, 'holed', 1 FROM c WHERE (longitude BETWEEN -104 AND -102 AND latitude BETWEEN 31 AND 33 AND NOT (longitude BETWEEN -103.5 AND -102.5 AND latitude BETWEEN 31.5 AND 32.5)) OR (longitude BETWEEN -101 AND -100.5 AND latitude BETWEEN 34 AND 34.5))"""


def _off_border(spark, sf_dir):
    """Customers' places, moved by a little so that none lies on a border."""
    c = w.places(spark, sf_dir, "customer", "c_custkey")
    return c.select("id", (F.col("latitude") + F.lit(0.00013)).alias("latitude"), (F.col("longitude") + F.lit(0.00017)).alias("longitude"))


_C_SQL = f"c AS (SELECT id, latitude + 0.00013::DOUBLE AS latitude, longitude + 0.00017::DOUBLE AS longitude FROM ({w.places_sql('customer', 'c_custkey')}))"


@query("shapes_with_holes", f"WITH {_C_SQL}, {_INSIDE_SQL} SELECT c.id, coalesce(string_agg(shape, ',' ORDER BY shape), '') AS shapes FROM c LEFT JOIN inside USING (id) GROUP BY c.id")
def shapes_with_holes(spark, sf_dir):
    return s.shapes_of(_off_border(spark, sf_dir), _shapes(spark), 0.25).select("id", F.array_join("shapes", ",").alias("shapes"))


@query("containing_places", f"WITH {_C_SQL}, {_INSIDE_SQL} SELECT id, string_agg(shape, '>' ORDER BY level) AS places FROM inside GROUP BY id")
def containing_places(spark, sf_dir):
    return s.containing_places(_off_border(spark, sf_dir), _shapes(spark), 0.25).select("id", F.array_join("places", ">").alias("places"))


@query("covering_circles", f"""WITH {_C_SQL}, x AS (SELECT id, latitude + 0.25 AS latitude, longitude + 0.5 AS longitude, latitude AS south, longitude AS west FROM c)
SELECT x.id, round(x.latitude, 6) AS latitude, round(x.longitude, 6) AS longitude, round(greatest(0.5, 1.02 * greatest({w.miles_sql("x", "a", geo.MILES)}, {w.miles_sql("x", "b", geo.MILES)})), 6) AS miles
FROM x, LATERAL (SELECT x.south AS latitude, x.west AS longitude) a, LATERAL (SELECT x.south + 0.5 AS latitude, x.west AS longitude) b""")
def covering_circles(spark, sf_dir):
    at = lambda x, y: F.struct((F.col("longitude") + x).alias("x"), (F.col("latitude") + y).alias("y"))
    ring = F.array(at(0.0, 0.0), at(1.0, 0.0), at(1.0, 0.5), at(0.0, 0.5), at(0.0, 0.0))
    return _off_border(spark, sf_dir).select("id", geo.covering_circle(ring).alias("c")).select("id", *[F.round(f"c.{x}", 6).alias(x) for x in ("latitude", "longitude", "miles")])


@query("radius_verdicts", f"""WITH {_C_SQL}, m AS (SELECT 32.0::DOUBLE AS latitude, -102.5::DOUBLE AS longitude)
SELECT id, CASE WHEN id % 7 = 0 THEN CASE WHEN id % 2 = 0 THEN 'inside' ELSE 'unknown' END WHEN id % 5 = 0 THEN 'unknown' WHEN {w.miles_sql("c", "m", geo.MILES)} <= 60 THEN 'inside' ELSE 'outside' END AS verdict FROM c, m""")
def radius_verdicts(spark, sf_dir):
    k = F.col("id")
    lat = F.when(k % 5 != 0, F.col("latitude"))
    centre = lambda x: F.when(k % 7 != 0, F.lit(x))
    return _off_border(spark, sf_dir).select("id", geo.in_radius(lat, F.col("longitude"), centre(32.0), centre(-102.5), F.lit(60.0), k % 2 == 0).alias("verdict"))


@query("nearest_station", f"""WITH {_C_SQL}, z AS (SELECT s_suppkey AS station, latitude, longitude FROM ({w.places_sql("supplier", "s_suppkey")}))
SELECT id, station, round(miles, 6) AS miles FROM (SELECT c.id, z.station, {w.miles_sql("c", "z", geo.MILES)} AS miles FROM c, z) QUALIFY row_number() OVER (PARTITION BY id ORDER BY miles, station) = 1""")
def nearest_station(spark, sf_dir):
    stations = w.places(spark, sf_dir, "supplier", "s_suppkey").select(F.col("id").alias("station"), "latitude", "longitude")
    return s.nearest_station(_off_border(spark, sf_dir), stations).select("id", "station", F.round("miles", 6).alias("miles"))


@query("nearest_of_kind", f"""WITH {_C_SQL}, z AS (SELECT s_suppkey AS site, s_suppkey % 3 AS kind, latitude, longitude FROM ({w.places_sql("supplier", "s_suppkey")}))
SELECT id, kind, site, round(miles, 6) AS miles FROM (SELECT c.id, z.kind, z.site, {w.miles_sql("c", "z", geo.MILES_ROUND)} AS miles FROM c, z) WHERE miles <= 40 QUALIFY row_number() OVER (PARTITION BY id, kind ORDER BY miles, site) = 1""")
def nearest_of_kind(spark, sf_dir):
    sites = w.sites(spark, sf_dir).withColumn("kind", F.col("site") % 3)
    return s.nearest_of_kind(_off_border(spark, sf_dir), sites, 40.0).select("id", "kind", "site", F.round("miles", 6).alias("miles"))


# feeds


@query("cards", "SELECT o_custkey AS page, CAST(o_orderkey AS VARCHAR) AS id, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders WHERE o_orderkey % 4 <> 1 UNION ALL SELECT o_custkey, NULL, CAST(floor(o_totalprice) AS BIGINT) FROM orders WHERE o_orderkey % 8 = 1")
def cards(spark, sf_dir):
    """Orders as result pages of their customers; every fourth is no home by id, and half of those advertise many homes."""
    k = F.col("o_orderkey")
    many = k % 8 == 5
    card = F.struct(
        F.when(k % 4 != 1, k.cast("string")).alias("id"), F.when(many & (k % 16 == 5), "https://x.org/community/a").when(k % 4 == 0, "/b/1").otherwise("/home/1").alias("url"),
        (many & (k % 16 != 5)).alias("building"), F.floor("o_totalprice").alias("price"), F.lit("1 Road").alias("address"),
    )
    pages = w.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.to_json(F.struct(F.collect_list(card).alias("results"))).alias("payload"))
    return feeds.cards(pages, "payload").select("page", "id", "price")


@query("projected_payloads", "SELECT o_orderkey AS raw, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS price, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS status FROM orders")
def projected_payloads(spark, sf_dir):
    o = w.table(spark, sf_dir, "orders")
    text = F.to_json(F.struct(F.struct(F.floor("o_totalprice").alias("list")).alias("price"), F.struct(F.col("o_orderstatus").alias("code")).alias("status")))
    payloads = o.select(F.col("o_orderkey").alias("raw"), F.when(F.col("o_orderkey") % 9 == 0, "no json").otherwise(text).alias("payload"))
    return feeds.project(payloads, "payload", "price struct<list:bigint>, status struct<code:string>", {"price": F.col("_payload.price.list"), "status": F.col("_payload.status.code")})


@query("download_rows", "SELECT p_partkey, p_brand FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 4 <> 0")
def download_rows(spark, sf_dir):
    p = w.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select("p_partkey", F.when(k % 10 == 0, "In accordance with local rules").otherwise(F.col("p_brand")).alias("p_brand"), F.when(k % 4 == 0, " ").otherwise("1 Road").alias("address"))
    return feeds.without_notice(rows, "address", "accordance with local").select("p_partkey", "p_brand")


@query("flood_warnings", """SELECT 'A' || substr(o_orderpriority, 3, 1) || 'Z' AS office, o_custkey AS event, CAST(year(o_orderdate) AS INT) AS "year", max(CAST(o_orderdate AS TIMESTAMP)) AS issued FROM orders
WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_orderpriority <> '4-NOT SPECIFIED' GROUP BY ALL""")
def flood_warnings(spark, sf_dir):
    k = F.col("o_orderkey")
    office = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "toolong").otherwise(F.concat(F.lit(" a"), F.lower(F.substring("o_orderpriority", 3, 1)), F.lit("z")))
    p = F.struct(F.when(k % 3 == 0, "SV").otherwise("FF").alias("phenomena"), F.when(F.col("o_orderstatus") == "F", "W").otherwise("A").alias("significance"), office.alias("wfo"), F.when(k % 7 == 0, "none").otherwise(F.col("o_custkey").cast("string")).alias("eventid"), F.date_format("o_orderdate", "yyyy").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("issue"))
    found = feeds.warnings(w.table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.lit("Feature").alias("type"), p.alias("properties"))).alias("feature")))
    return found.select("office", F.col("event").cast("bigint").alias("event"), "year", F.col("issued").cast("timestamp_ntz").alias("issued"))


@query("flood_reports", """SELECT kind, count(*) AS n, count(DISTINCT latitude) AS places FROM (SELECT (['flash flood', 'flood', 'debris flow', 'hail'])[c_custkey % 4 + 1] AS kind, CAST(c_custkey % 90 AS VARCHAR) AS latitude FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 6 <> 0) WHERE kind <> 'hail' GROUP BY kind""")
def flood_reports(spark, sf_dir):
    k = F.col("c_custkey")
    rows = w.table(spark, sf_dir, "customer").select(
        F.element_at(F.array(*[F.lit(x) for x in (" Flash Flood", "FLOOD", "debris flow", "HAIL")]), (k % 4 + 1).cast("int")).alias("TYPETEXT"),
        F.when(k % 5 == 0, "NaN").otherwise((k % 90).cast("string")).alias("LAT"), F.lit("-100.123456").alias("LON"), F.when(k % 6 == 0, "yesterday").otherwise("202401021530").alias("VALID"),
    )
    return feeds.reports(rows).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("latitude").alias("places"))


@query("wind_sectors", "SELECT 'S' || s_nationkey AS station, CAST(s_suppkey % 36 * 10 AS INT) AS from_degrees, sum(s_suppkey % 5 + 0.5) AS percent FROM supplier WHERE s_suppkey % 11 <> 0 GROUP BY ALL")
def wind_sectors(spark, sf_dir):
    k = F.col("s_suppkey")
    line = F.when(k % 11 == 0, "# a comment, 10-20").otherwise(F.concat_ws(", ", F.concat(F.lit("S"), F.col("s_nationkey")), F.concat(k % 36 * 10, F.lit("-"), k % 36 * 10 + 10), k % 5, F.lit("0.5"), F.lit("M")))
    found = feeds.wind_sectors(w.table(spark, sf_dir, "supplier").select(F.regexp_replace(line, "^# a comment, 10-20$", "# a comment").alias("value")))
    return found.groupBy("station", "from_degrees").agg(F.sum("percent").alias("percent"))
