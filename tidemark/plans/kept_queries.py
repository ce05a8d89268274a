"""States kept by run, payloads kept whole, texts compared by collation, over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import collation, geo
from tidemark.plans import worlds as w
from tidemark.sources import payloads as p
from tidemark.sources import archives, feeds, tables
from tidemark.sources.states import StateTable

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


_POINTS = (3, 10, 17, 29)


def _kept(spark, sf_dir, use):
    """What `use` makes of the snapshots kept by run, the later half written first; stored, so that the kept ones can go."""
    snaps = w.snapshots(spark, sf_dir).select("entity", "run_seq", "event_id", "status", "price")
    path = f"{tables.shared_folder(spark)}/states-{uuid.uuid4().hex}"
    kept = StateTable(spark, path, snaps.schema, every=4)
    with tables.Scratch() as scratch:
        held = scratch(snaps)
        kept.write(held.where("run_seq >= 12"))
        kept.write(held.where("run_seq < 15"))  # runs 12 to 14 once more
        out = tables.stored(use(kept))
    tables.delete(spark, path)
    return out


@query("asof_from_bases", f"WITH {w.OBS_SQL} " + " UNION ALL ".join(f"(SELECT {at} AS at, entity, run_seq, event_id, status FROM snap WHERE run_seq <= {at} QUALIFY row_number() OVER (PARTITION BY entity ORDER BY run_seq DESC, event_id DESC) = 1)" for at in _POINTS))
def asof_from_bases(spark, sf_dir):
    """States at four runs, each from the base before it and the runs since."""

    def use(kept):
        out = None
        for at in _POINTS:
            state = kept.asof(at).select(F.lit(at).alias("at"), "entity", "run_seq", "event_id", "status")
            out = state if out is None else out.unionByName(state)
        return out

    return _kept(spark, sf_dir, use)


@query("recent_runs", f"WITH {w.OBS_SQL}, last AS (SELECT DISTINCT run_seq FROM snap WHERE run_seq <= 20 ORDER BY run_seq DESC LIMIT 8) SELECT entity, count(*) AS seen, max(run_seq) AS last_seen FROM snap SEMI JOIN last USING (run_seq) GROUP BY entity")
def recent_runs(spark, sf_dir):
    """Entities of the last eight runs, read from these runs' folders alone."""
    return _kept(spark, sf_dir, lambda kept: kept.recent(8, 20).groupBy("entity").agg(F.count("*").alias("seen"), F.max("run_seq").alias("last_seen")))


_FIELDS = (p.Field("id", "$.id", "bigint"), p.Field("status", "$.status"), p.Field("price", "$.price", "double"), p.Field("buyer", "$.buyer.id", "bigint"))

#: Orders as payloads of a feed whose format drifts: cut texts, a field under another name, prices as text, fields that are gone or null.
_PAYLOADS_SQL = """o AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, o_custkey AS buyer,
  CASE WHEN o_orderkey % 13 = 0 THEN 'broken' WHEN o_orderkey % 7 = 0 THEN 'renamed' WHEN o_orderkey % 11 = 0 THEN 'words' WHEN o_orderkey % 17 = 0 THEN 'quoted' ELSE 'plain' END AS how FROM orders)"""


def _payloads(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, F.lit("")).when(k % 3 == 0, F.lit('"status":null,')).otherwise(F.concat(F.lit('"status":"'), F.col("o_orderstatus"), F.lit('",')))
    price = F.when(k % 7 == 0, F.concat(F.lit('"total":'), "o_totalprice")).when(k % 11 == 0, F.lit('"price":"on request"')).when(k % 17 == 0, F.concat(F.lit('"price":"'), "o_totalprice", F.lit('"'))).otherwise(F.concat(F.lit('"price":'), "o_totalprice"))
    text = F.concat(F.lit('{"id":'), k, F.lit(","), status, price, F.lit(',"buyer":{"id":'), "o_custkey", F.lit("}}"))
    return p.keep(w.table(spark, sf_dir, "orders").select(k.alias("key"), F.when(k % 13 == 0, F.substring(text, 1, 20)).otherwise(text).alias("payload")), "payload")


@query("payload_fields", f"""WITH {_PAYLOADS_SQL} SELECT k AS key, CASE WHEN how <> 'broken' THEN k END AS id, CASE WHEN how <> 'broken' AND k % 5 <> 0 AND k % 3 <> 0 THEN status END AS status,
CASE WHEN how IN ('plain', 'quoted') THEN price END AS price, CASE WHEN how <> 'broken' THEN buyer END AS buyer, how = 'broken' AS broken FROM o""")
def payload_fields(spark, sf_dir):
    """Fields of kept payloads by path and type; a text that was cut short stays beside them."""
    return p.project(_payloads(spark, sf_dir), "payload", _FIELDS).withColumn("broken", F.col("broken").isNotNull())


@query("payload_drift", f"""WITH {_PAYLOADS_SQL}, x AS (SELECT * FROM o WHERE how <> 'broken')
SELECT 'id' AS field, 'ok' AS state, count(*) AS n FROM x UNION ALL SELECT 'buyer', 'ok', count(*) FROM x
UNION ALL SELECT 'status', CASE WHEN k % 5 = 0 THEN 'missing' WHEN k % 3 = 0 THEN 'null' ELSE 'ok' END, count(*) FROM x GROUP BY 2
UNION ALL SELECT 'price', CASE how WHEN 'renamed' THEN 'missing' WHEN 'words' THEN 'unreadable' WHEN 'quoted' THEN 'retyped' ELSE 'ok' END, count(*) FROM x GROUP BY 2
UNION ALL SELECT 'total', 'unexpected', count(*) FROM x WHERE how = 'renamed'""")
def payload_drift(spark, sf_dir):
    return p.drift(_payloads(spark, sf_dir), "payload", _FIELDS)


@query("payload_renames", f"""WITH {_PAYLOADS_SQL} SELECT 'price' AS field, 'total' AS candidate, count(*) AS n, count(*) AS missing FROM o WHERE how = 'renamed'""")
def payload_renames(spark, sf_dir):
    """A status that is missing isn't told as renamed to `total`, which is a number."""
    return p.renames(_payloads(spark, sf_dir), "payload", _FIELDS)


_SPELLED_SQL = """s AS (SELECT c_custkey % 50 AS entity, CASE c_custkey % 3 WHEN 0 THEN upper(c_mktsegment) || ' É' WHEN 1 THEN lower(c_mktsegment) || ' é' ELSE lower(c_mktsegment) || ' e' || chr(769) END AS tag FROM customer)"""


@query("tag_spellings", f"""WITH {_SPELLED_SQL}, c AS (SELECT entity, tag, lower(nfc_normalize(tag)) AS same, count(*) AS n FROM s GROUP BY ALL)
SELECT entity, first(tag ORDER BY n DESC, encode(tag)) AS tag, sum(n)::BIGINT AS n FROM c GROUP BY entity, same""")
def tag_spellings(spark, sf_dir):
    """Tags that differ in case, or in how an accent is written, are one: in the spelling most used."""
    k = F.col("c_custkey")
    lower = F.lower("c_mktsegment")
    tag = F.when(k % 3 == 0, F.concat(F.upper("c_mktsegment"), F.lit(" É"))).when(k % 3 == 1, F.concat(lower, F.lit(" é"))).otherwise(F.concat(lower, F.lit(" e\u0301")))
    return collation.one_spelling(w.table(spark, sf_dir, "customer").select((k % 50).alias("entity"), tag.alias("tag")), ["entity"], "tag")


@query("collated_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY regexp_replace(lower(p_brand), '[0-9]+', ''), CAST(regexp_extract(p_brand, '[0-9]+') AS INT), p_size, p_partkey) AS place FROM part")
def collated_order(spark, sf_dir):
    """Names in a reader's order: whatever their case, numbers in them by value."""
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")), F.lit(" size "), F.when(F.col("p_partkey") % 3 == 0, "00").otherwise(""), "p_size")
    order = W.partitionBy("p_type").orderBy(collation.natural(name), "p_partkey")
    return w.table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(order).alias("place"))


_VERTICES = ((0, 0), (4, 0), (4, 4), (0, 4), (6, 0), (7, 0), (7, 1), (6, 1))


@query("circles_of_parts", f"""WITH c AS ({w.places_sql('customer', 'c_custkey')}), x AS (SELECT id, latitude + 1.96875 AS latitude, longitude + 2.21875 AS longitude, latitude AS south, longitude AS west FROM c),
v AS (SELECT unnest({[a for a, _ in _VERTICES]}) AS dx, unnest({[b for _, b in _VERTICES]}) AS dy), a AS (SELECT id, west + dx AS longitude, south + dy AS latitude FROM x, v)
SELECT x.id, round(x.latitude, 6) AS latitude, round(x.longitude, 6) AS longitude, round(1.02 * max({w.miles_sql('x', 'a', geo.MILES)}), 6) AS miles FROM x JOIN a USING (id) GROUP BY ALL""")
def circles_of_parts(spark, sf_dir):
    """Circles around shapes of two parts, the larger with a hole, their rings turning both ways."""
    at = lambda x, y: F.struct((F.col("longitude") + x).alias("x"), (F.col("latitude") + y).alias("y"))
    ring = lambda *points: F.array(*[at(float(x), float(y)) for x, y in (*points, points[0])])
    rings = F.array(ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((2.5, 0.5), (3.5, 0.5), (3.5, 1.5), (2.5, 1.5)), ring((6, 0), (6, 1), (7, 1), (7, 0)))
    circles = w.places(spark, sf_dir, "customer", "c_custkey").select("id", geo.covering_circle_of(rings).alias("c"))
    return circles.select("id", *[F.round(f"c.{x}", 6).alias(x) for x in ("latitude", "longitude", "miles")])


@query("dam_rows", f"""WITH s AS ({w.places_sql('supplier', 's_suppkey')})
SELECT id::VARCHAR AS id, CASE WHEN id % 5 = 0 THEN 'an unnamed dam' ELSE s_name END AS name, round(latitude, 5) AS latitude, round(longitude, 5) AS longitude,
['not rated', 'poor', 'fair', 'good'][id % 4 + 1] AS condition, CASE WHEN id % 4 <> 0 THEN DATE '2020-01-01' + (id % 900)::INT END AS assessed, CASE WHEN id % 2 = 0 THEN 'yes' END AS plan, CASE WHEN id % 7 <> 0 THEN 1900 + id % 100 END::INT AS built
FROM s WHERE id % 3 = 0 AND id % 11 <> 0""")
def dam_rows(spark, sf_dir):
    """Suppliers as an inventory of dams: a third is of high hazard, some stand nowhere, some were never rated."""
    k = F.col("id")
    record = F.struct(
        k.alias("federalId"), F.when(k % 5 == 0, "  ").otherwise(F.col("s_name")).alias("name"), F.when(k % 11 == 0, "unknown").otherwise(F.col("latitude").cast("string")).alias("latitude"), "longitude",
        F.when(k % 3 == 0, "3").when(k % 3 == 1, "1").alias("publicHazardId"), F.when(k % 4 != 0, (k % 4).cast("string")).otherwise("").alias("conditionAssessId"),
        F.when(k % 4 != 0, F.concat(F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int")).cast("string"), F.lit("T00:00:00"))).alias("conditionAssessDate"),
        F.when(k % 2 == 0, "1").alias("eapId"), F.when(k % 7 == 0, "before 1900").otherwise((1900 + k % 100).cast("string")).alias("yearCompleted"),
    )
    rows = w.places(spark, sf_dir, "supplier", "s_suppkey").select(F.to_json(record).alias("record"))
    return feeds.dams(rows, "record", {"1": "low", "2": "significant", "3": "high"}, {"1": "poor", "2": "fair", "3": "good"}, {"1": "yes", "2": "no"}, "high").drop("owner")


@query("town_rows", f"""WITH c AS ({w.places_sql('customer', 'c_custkey')})
SELECT CASE WHEN id % 4 = 0 THEN c_name || ', NM--TX' ELSE c_name END AS name, latitude, longitude, CASE WHEN id % 6 = 0 THEN 0 ELSE id * 10 END AS size FROM c WHERE id % 9 <> 0 AND id % 13 <> 0""")
def town_rows(spark, sf_dir):
    k = F.col("id")
    name = F.when(k % 9 == 0, " ").when(k % 4 == 0, F.concat("c_name", F.lit(", NM--TX"))).when(k % 4 == 1, F.concat("c_name", F.lit(", NM"))).otherwise(F.col("c_name"))
    a = F.struct(name.alias("BASENAME"), F.when(k % 6 != 0, k * 10).alias("AREALAND"), F.when(k % 13 != 0, F.col("latitude")).alias("CENTLAT"), F.col("longitude").alias("CENTLON"))
    return feeds.towns(w.places(spark, sf_dir, "customer", "c_custkey").select(F.to_json(F.struct(a.alias("attributes"))).alias("feature")), "feature")


@query("zipped_orders", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority || chr(10) || '"' || o_orderstatus || '", as told' END AS note,
CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice END AS price, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS customer FROM orders""")
def zipped_orders(spark, sf_dir):
    """Every order, by way of zip archives: those of odd keys have their columns in another order, and no customer."""
    k = F.col("o_orderkey")
    note = F.when(k % 7 > 0, F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('", as told')))
    price = F.when(k % 11 > 0, F.col("o_totalprice").cast("string")).otherwise("n/a")
    told = w.table(spark, sf_dir, "orders").select(k.alias("id"), note.alias("note"), price.alias("price"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("customer"))
    path = f"{tables.shared_folder(spark)}/zipped-{uuid.uuid4().hex}"
    archives.write_zipped_csv(told.where("id % 2 = 0"), f"{path}/even")
    archives.write_zipped_csv(told.where("id % 2 <> 0").select("day", "price", "note", "id"), f"{path}/odd")
    out = tables.stored(archives.zipped_csv(spark, f"{path}/*", "id long, note string, price double, day date, customer long", by_name=["id", "note", "price", "day"]))
    tables.delete(spark, path)
    return out
