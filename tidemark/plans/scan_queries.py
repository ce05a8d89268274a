"""Planning of scans, stored tables, run logs, windows, and answers about texts, over the given tables."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions import text as t
from tidemark.operators import extract, history, passes
from tidemark.plans import worlds as w
from tidemark.sources import connector, paged, planning, runs, tables
from tidemark.streaming import batches

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


def _customers(spark, sf_dir):
    return w.places(spark, sf_dir, "customer", "c_custkey").select("id", "latitude", "longitude")


_CUSTOMERS = f"c AS (SELECT id, latitude, longitude FROM ({w.places_sql('customer', 'c_custkey')}))"


@query("ceiling_boxes", f"WITH {_CUSTOMERS} SELECT count(*) AS n, 0 AS over, true AS whole FROM c")
def ceiling_boxes(spark, sf_dir):
    """Boxes under a ceiling hold every row once, those on the outer edges too."""
    c = _customers(spark, sf_dir)
    b = c.agg(F.min("longitude"), F.min("latitude"), F.max("longitude"), F.max("latitude")).first()
    found = planning.split_by_ceiling(c, tuple(b), 200)
    boxes = spark.createDataFrame([(n, over, *box) for box, n, over in found], "n bigint, over boolean, west double, south double, east double, north double")
    area = F.sum((F.col("east") - F.col("west")) * (F.col("north") - F.col("south")))
    return boxes.agg(F.sum("n").alias("n"), F.count_if("over").cast("int").alias("over"), (F.abs(area - (b[2] - b[0]) * (b[3] - b[1])) < 1e-9).alias("whole"))


@query("covered_circle", f"WITH {_CUSTOMERS}, m AS (SELECT 32.0::DOUBLE AS latitude, -102.5::DOUBLE AS longitude) SELECT id FROM c, m WHERE {w.miles_sql('c', 'm', geo.MILES)} <= 100")
def covered_circle(spark, sf_dir):
    """The rows of a large circle, asked for by small ones that cover it, each row once."""
    c = _customers(spark, sf_dir)
    apart = lambda lat, lon: geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon), geo.MILES)
    asked = F.lit(False)
    for lat, lon, miles in planning.cover_circle(32.0, -102.5, 100.0, 40.0):
        asked = asked | (apart(lat, lon) <= miles)
    return c.where(asked & (apart(32.0, -102.5) <= 100)).select("id")


@query("date_parts", "WITH d AS (SELECT date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders), p AS (SELECT i, 2557 * i // 7 AS a, 2557 * (i + 1) // 7 - 1 AS b FROM range(7) x(i)) SELECT a AS first, b AS last, count(day) AS n FROM p LEFT JOIN d ON day BETWEEN a AND b GROUP BY ALL")
def date_parts(spark, sf_dir):
    """A long range of days asked for in seven parts."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    parts = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in planning.split_dates(0, 2556, 7)])))
    days = w.table(spark, sf_dir, "orders").groupBy(day.alias("day")).count()
    joined = F.broadcast(parts).join(days, F.col("day").between(F.col("first"), F.col("last")), "left")
    return joined.groupBy("first", "last").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))


@query("asked_and_left", "SELECT o_orderkey FROM orders WHERE (o_totalprice IS NULL OR o_totalprice >= 50000) AND (o_orderstatus IS NULL OR o_orderstatus IN ('O', 'P')) AND o_totalprice <= 200000")
def asked_and_left(spark, sf_dir):
    """A source that applies the upper bound of a price only: the rest of the filters is applied here."""
    asked, left = planning.split_filters({"sqft": planning.Range(high=200000.0), "price": planning.Range(low=50000.0), "property_type": ["O", "P"]}, ["sqft"])
    rows = w.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_totalprice").alias("sqft"), F.col("o_orderstatus").alias("property_type"))
    return rows.where(planning.residual(asked)).where(planning.residual(left)).select("o_orderkey")


@query("append_and_replace", f"WITH {w.OBS_SQL} SELECT run_seq, count(*) AS n, sum(CASE WHEN run_seq % 5 = 2 THEN 1 ELSE 0 END)::BIGINT AS replaced FROM obs GROUP BY run_seq")
def append_and_replace(spark, sf_dir):
    """Runs appended to a table of which some are then written again, and no others."""
    path = f"{tables.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = w.observations(spark, sf_dir).select("event_id", "run_seq", F.lit(0).alias("again"))
    tables.append(rows.where("run_seq % 2 = 0"), path, "run_seq")
    tables.append(rows.where("run_seq % 2 = 1"), path, "run_seq")
    tables.replace_partitions(rows.where("run_seq % 5 = 2").withColumn("again", F.lit(1)), path, "run_seq")
    got = tables.stored(spark.read.parquet(path).groupBy("run_seq").agg(F.count("*").alias("n"), F.sum("again").alias("replaced")))
    tables.delete(spark, path)
    return got


@query("committed_runs", f"WITH {w.OBS_SQL} SELECT event_id, price, run_seq % 3 AS run, source FROM obs WHERE run_seq % 3 <> 1")
def committed_runs(spark, sf_dir):
    """Three runs of all events: one of them dies in a task and is failed, one dies and is repeated; what is read are the two that completed."""
    runs.register(spark)
    path = f"{tables.shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = w.observations(spark, sf_dir).select("event_id", "price", "run_seq", "source")
    dies = F.when(F.col("event_id") % 50 == 7, F.raise_error(F.lit("the task dies"))).otherwise(F.col("price"))

    def give(run, source, price):
        runs.record(rows.where((F.col("run_seq") % 3 == run) & (F.col("source") == source)).select("event_id", price.alias("price")), path, run, source)

    for run in range(3):
        runs.start(spark, path, run)
        for source in ("s0", "s1", "s2"):
            if run:
                try:
                    give(run, source, dies)
                except PySparkException:
                    if run == 1:
                        continue
            give(run, source, F.col("price"))
        (runs.fail if run == 1 else runs.complete)(spark, path, run)
    got = tables.stored(runs.committed(spark, path, "event_id bigint, price double, run bigint, source string"))
    tables.delete(spark, path)
    return got


_CEILING, _PAGE, _BUDGET = 600, 100, 220


def _order_pages(path):
    """A service of orders by ranges of customers, in pages of a hundred by key; some ranges refuse their third page, some give it empty."""
    import pyarrow.dataset as ds

    def ask(query, token):
        low, high = query
        orders = ds.dataset(path)
        own = (ds.field("o_custkey") >= low) & (ds.field("o_custkey") <= high)
        after = own if token is None else own & (ds.field("o_orderkey") > token[1])
        page = 0 if token is None else token[0]
        if page == 2 and low % 7 == 1:
            raise ConnectionError("closed for today")
        if page == 2 and low % 7 == 2:
            return paged.Answer((), orders.count_rows(filter=own))
        rows = orders.to_table(["o_orderkey", "o_custkey"], filter=after).sort_by("o_orderkey").slice(0, _PAGE).to_pylist()
        more = (page + 1, rows[-1]["o_orderkey"]) if len(rows) == _PAGE else None
        return paged.Answer([(r["o_orderkey"], r["o_custkey"]) for r in rows], orders.count_rows(filter=own), more)

    return ask


def _halves(query):
    low, high = query
    middle = (low + high) // 2
    return None if high - low < 128 and low % 2 == 1 or low == high else ((low, middle), (middle + 1, high))


@query("paged_orders", f"""WITH RECURSIVE top AS (SELECT 0 AS low, CAST(max(o_custkey) AS BIGINT) AS high FROM orders),
tree AS (
  SELECT low, high, 0 AS depth, (SELECT count(*) FROM orders WHERE o_custkey BETWEEN low AND high) AS n FROM top
  UNION ALL
  SELECT h.low, h.high, t.depth + 1, (SELECT count(*) FROM orders WHERE o_custkey BETWEEN h.low AND h.high)
  FROM tree t, LATERAL (SELECT unnest([t.low, (t.low + t.high) // 2 + 1]) AS low, unnest([(t.low + t.high) // 2, t.high]) AS high) h
  WHERE t.n > {_CEILING} AND t.depth < {paged.MAX_DEPTH} AND NOT (t.high - t.low < 128 AND t.low % 2 = 1 OR t.low = t.high)
), visited AS (SELECT *, row_number() OVER (ORDER BY low, depth) <= {_BUDGET} AS asked, lead(low) OVER (ORDER BY low, depth) = low AND lead(depth) OVER (ORDER BY low, depth) = depth + 1 AS cut FROM tree),
pieces AS (
  SELECT v.low, v.high, v.n, v.asked, v.n > {_CEILING} AS over, row_number() OVER (ORDER BY v.low) - 1 AS piece FROM visited v
  WHERE v.asked AND NOT coalesce(v.cut, false) OR NOT v.asked AND (v.depth = 0 OR EXISTS (SELECT 1 FROM visited u WHERE u.asked AND u.depth = v.depth - 1 AND u.low <= v.low AND u.high >= v.high))
), wanted AS (SELECT *, CASE WHEN asked THEN least(n, {_CEILING}) ELSE 0 END AS w FROM pieces),
dealt AS (SELECT *, greatest(0, least((w + {_PAGE - 1}) // {_PAGE}, {_BUDGET} - (SELECT count(*) FROM visited WHERE asked) - coalesce(sum((w + {_PAGE - 1}) // {_PAGE}) OVER (ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS pages FROM wanted),
given AS (SELECT *, least(w, pages * {_PAGE}, CASE WHEN low % 7 IN (1, 2) THEN 2 * {_PAGE} ELSE w END) AS got FROM dealt),
told AS (SELECT *, CASE WHEN NOT asked THEN '{paged.OUT_OF_BUDGET}' WHEN got = w THEN CASE WHEN over THEN '{paged.OVER_CEILING}' END WHEN got = pages * {_PAGE} THEN '{paged.OUT_OF_BUDGET}' WHEN low % 7 = 1 THEN '{paged.REFUSED}' ELSE '{paged.EMPTY_PAGE}' END AS lacking FROM given),
rows AS (SELECT o_orderkey, piece, got, row_number() OVER (PARTITION BY piece ORDER BY o_orderkey) AS r FROM orders JOIN told ON o_custkey BETWEEN low AND high)
SELECT o_orderkey, CAST(piece AS INTEGER) AS piece, CAST((r - 1) // {_PAGE} AS INTEGER) AS page, '{paged.OK}' AS outcome FROM rows WHERE r <= got
UNION ALL SELECT NULL, CAST(piece AS INTEGER), CAST((got + {_PAGE - 1}) // {_PAGE} AS INTEGER), lacking FROM told WHERE lacking IS NOT NULL""")
def paged_orders(spark, sf_dir):
    """Orders from a paged service under a ceiling and a budget, and in which way each part of them is incomplete."""
    path = f"{sf_dir}/orders.parquet"
    high = w.table(spark, sf_dir, "orders").agg(F.max("o_custkey")).first()[0]
    paged.register(spark, "tidemark_order_pages", "o_orderkey bigint, o_custkey bigint", [(0, high)], _order_pages(path), _halves, _CEILING, _PAGE, _BUDGET)
    scan = spark.read.format("tidemark_order_pages").load()
    return scan.select("o_orderkey", F.col("_piece").alias("piece"), F.col("_page").alias("page"), F.col("_outcome").alias("outcome"))


_BEFORE_FAILING, _DEAR = 10, 200_000.0


def _order_years(path):
    """A source of orders by year: years in 5 can't be asked, years in 7 fail after ten rows; others give only what is asked for."""
    import datetime
    import operator

    import pyarrow.dataset as ds

    signs = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}

    def fetch(page, filters):
        year = int(page)
        if year % 10 == 5:
            raise connector.Unavailable("no key for this year")
        within = (ds.field("o_orderdate") >= datetime.datetime(year, 1, 1)) & (ds.field("o_orderdate") < datetime.datetime(year + 1, 1, 1))
        for sign, column, value in filters if year % 10 != 7 else []:
            within &= signs[sign](ds.field(column), value)
        rows = ds.dataset(path).to_table(["o_orderkey", "o_totalprice"], filter=within)
        if year % 10 == 7:
            yield from (tuple(r.values()) for r in rows.sort_by("o_orderkey").slice(0, _BEFORE_FAILING).to_pylist())
            raise ConnectionError("the line went dead")
        for batch in rows.to_batches(10_000):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    return fetch


@query("answering_years", f"""WITH o AS (SELECT o_totalprice, CAST(year(o_orderdate) AS VARCHAR) AS page, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS r FROM orders),
g AS (SELECT *, CASE right(page, 1) WHEN '5' THEN 'unavailable' WHEN '7' THEN 'failed' ELSE 'ok' END AS outcome FROM o)
SELECT page, outcome, count(*) FILTER (outcome = 'ok' OR outcome = 'failed' AND r <= {_BEFORE_FAILING}) AS rows, count(*) FILTER ((outcome = 'ok' OR outcome = 'failed' AND r <= {_BEFORE_FAILING}) AND o_totalprice >= {_DEAR}) AS dear FROM g GROUP BY ALL""")
def answering_years(spark, sf_dir):
    """What a source gave of each year of orders, how the year ended, and how many dear orders it gave when just these were asked for."""
    years = [str(r[0]) for r in w.table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL").select(F.year("o_orderdate")).distinct().collect()]
    connector.register(spark, "tidemark_order_years", "o_orderkey bigint, o_totalprice double", years, _order_years(f"{sf_dir}/orders.parquet"), pushes=("o_totalprice",))
    scan = spark.read.format("tidemark_order_years").load()
    dear = connector.asked(spark, "tidemark_order_years", (">=", "o_totalprice", _DEAR)).where(F.col("_outcome") == connector.OK).groupBy(F.col("_page").alias("page")).agg(F.count("*").alias("dear"))
    return connector.outcomes(scan).join(dear, "page", "left").withColumn("dear", F.coalesce("dear", F.lit(0)))


@query("streamed_snapshots", """WITH e AS (SELECT event_id, user_id, event_type, event_id % 3 AS run_seq FROM events)
SELECT CAST(run_seq AS INTEGER) AS run_seq, user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM e GROUP BY run_seq, user_id""")
def streamed_snapshots(spark, sf_dir):
    """Events that come in three batches, each a run of its own: a user's first event in each; starting the stream once more with nothing new adds no run."""
    base = f"{tables.shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    rows = w.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    for part in (0, 1, 2, None):
        if part is not None:
            rows.where(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        batches.write_snapshots(stream, f"{base}/out", f"{base}/checkpoint", ["user_id"], ["event_id"]).awaitTermination()
    out = tables.stored(spark.read.schema(rows.schema.add("run_seq", "integer")).parquet(f"{base}/out"))
    tables.delete(spark, base)
    return out


@query("run_log_states", "WITH e AS (SELECT user_id AS run_id, event_id, event_type FROM events) SELECT run_id, CASE arg_max(event_type, event_id) FILTER (event_type IN ('purchase', 'signup')) WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'failed' ELSE 'running' END AS state FROM e GROUP BY run_id")
def run_log_states(spark, sf_dir):
    """Users as runs: a purchase completes, a sign-up fails, anything else only shows that the run goes on."""
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "failed").otherwise("running")
    return history.run_states(w.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), state.alias("state")))


@query("beating_passes", "SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'finished' WHEN floor(epoch(TIMESTAMP '2024-01-30 12:00:00' - max(ts))) > 120 * 3600 THEN 'stopped' ELSE 'running' END AS state FROM events WHERE ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY user_id")
def beating_passes(spark, sf_dir):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    seen = w.table(spark, sf_dir, "events").where(F.col("ts") < now).groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    told = seen.withColumn("finished_at", F.when(F.col("user_id") % 4 == 0, F.col("updated_at")))
    return history.running(told, now, beat_seconds=3600, missed=120).select("user_id", "state")


@query("budgeted_asks", "SELECT c_custkey, c_custkey % 3 = 0 AS narrow FROM customer ORDER BY c_custkey % 3 = 0 DESC, c_custkey LIMIT 25")
def budgeted_asks(spark, sf_dir):
    """The asks of one pass under its budget of 25, narrow ones first."""
    c = w.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3 == 0).alias("narrow"))
    return passes.within_budget(c, "narrow", "c_custkey", 25)


@query("chosen_columns", "SELECT o_orderstatus AS status, o_orderkey AS key FROM orders")
def chosen_columns(spark, sf_dir):
    registry = {"key": F.col("o_orderkey"), "price": F.col("o_totalprice"), "status": F.col("o_orderstatus")}
    return passes.project(w.table(spark, sf_dir, "orders"), registry, ["status", "key"])


@query("address_lines", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '12 Road Apt 4' WHEN 1 THEN '12 Road ' || (['#4', 'Unit 4'])[c_custkey % 2 + 1] ELSE '12 Road' END AS line FROM customer")
def address_lines(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.when(k % 3 == 0, "12 Road Apt 4").otherwise("12 Road")
    unit = F.when(k % 3 == 0, "apt-4").when(k % 3 == 1, F.when(k % 2 == 0, "#4").otherwise("Unit 4"))
    return w.table(spark, sf_dir, "customer").select("c_custkey", t.address_line(line, unit).alias("line"))


@query("accepted_answers", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN regexp_matches(substr(text, 3, 40), '[^ \\t\\n\\x0B\\f\\r]') WHEN 1 THEN false WHEN 2 THEN false ELSE false END AS accepted FROM documents WHERE text IS NOT NULL AND NOT contains(text, 'q~q')")
def accepted_answers(spark, sf_dir):
    """Answers quoted from the texts: a known value with its quote counts; an unknown one, a made-up quote, and `none` without a denial don't."""
    k = F.col("doc_id") % 4
    d = w.table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.col("text").contains("q~q"))
    asked = d.select(
        "doc_id", "text", F.when(k == 1, "marsh").when(k == 3, "none").otherwise("well").alias("value"),
        F.when(k == 2, "q~q").when(k == 3, "12345").otherwise(F.concat(F.lit("  "), F.substring("text", 3, 40), F.lit(" "))).alias("quote"), F.array(F.lit("well"), F.lit("none")).alias("options"),
    )
    return extract.accept(asked).select("doc_id", "accepted")


@query("settled_values", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 's' WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'p' WHEN p_partkey % 2 = 0 THEN 'm' END AS value,
  CASE WHEN p_partkey % 5 = 0 THEN 'source' WHEN p_partkey % 4 = 0 THEN 'conflict' WHEN p_partkey % 3 = 0 THEN 'pattern' WHEN p_partkey % 2 = 0 THEN 'model' ELSE 'undetermined' END AS origin FROM part""")
def settled_values(spark, sf_dir):
    k = F.col("p_partkey")
    rows = w.table(spark, sf_dir, "part").select("p_partkey", F.when(k % 5 == 0, "s").alias("source_value"), F.when(k % 3 == 0, "p").alias("pattern_value"), (k % 4 == 0).alias("conflict"), F.when(k % 2 == 0, "m").alias("model_value"))
    return extract.settle(rows).select("p_partkey", "value", "origin")


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    found = batches.windowed_counts(w.table(spark, sf_dir, "events"), "ts", "event_type", "1 day", "1 hour")
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("late_windows", """SELECT start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def late_windows(spark, sf_dir):
    """Windows of a stream to which every third event is told again once the watermark is past it: closed windows don't count it."""
    base = f"{tables.shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    rows = w.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    for part in (F.lit(True), F.col("event_id") % 3 == 0):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        found = batches.windowed_counts(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), "ts", "event_type", "1 day", "1 hour").select("window.start", "event_type", "n")
        found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = tables.stored(spark.read.schema(found.schema).parquet(f"{base}/out").withColumn("start", F.col("start").cast("timestamp_ntz")))
    tables.delete(spark, base)
    return out


@query("session_counts", """WITH e AS (SELECT user_id, ts, coalesce(epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 21600, true) AS fresh FROM events),
n AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e), g AS (SELECT user_id, s, count(*) AS n FROM n GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM g GROUP BY user_id""")
def session_counts(spark, sf_dir):
    found = batches.sessions(w.table(spark, sf_dir, "events"), "ts", "user_id", "6 hours", "1 hour")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("flood_distances", f"WITH {_CUSTOMERS}, m AS (SELECT 32.0::DOUBLE AS latitude, -102.5::DOUBLE AS longitude) SELECT id, round({w.miles_sql('c', 'm', geo.METRES_MEAN)}, 3) AS metres FROM c, m")
def flood_distances(spark, sf_dir):
    apart = geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(32.0), F.lit(-102.5), geo.METRES_MEAN)
    return _customers(spark, sf_dir).select("id", F.round(apart, 3).alias("metres"))


@query("boxes_around", f"WITH {_CUSTOMERS} SELECT id, round(latitude - degrees(10 / {geo.MILES}), 6) AS south, round(latitude + degrees(10 / {geo.MILES}), 6) AS north, round(longitude - degrees(10 / {geo.MILES}) / cos(radians(latitude + degrees(10 / {geo.MILES}))), 6) AS west FROM c")
def boxes_around(spark, sf_dir):
    box = geo.around(F.col("latitude"), F.col("longitude"), 10.0)
    return _customers(spark, sf_dir).select("id", box.alias("b")).select("id", *[F.round(f"b.{x}", 6).alias(x) for x in ("south", "north", "west")])


@query("box_middles", f"WITH {_CUSTOMERS} SELECT id, 5 AS corners, round(longitude, 6) AS mid_x, round(latitude + 0.25, 6) AS mid_y FROM c")
def box_middles(spark, sf_dir):
    """Boxes as closed rings, and the middle of each ring's extent."""
    box = F.struct((F.col("longitude") - 1).alias("west"), F.col("latitude").alias("south"), (F.col("longitude") + 1).alias("east"), (F.col("latitude") + 0.5).alias("north"))
    rings = _customers(spark, sf_dir).select("id", geo.box_ring(box).alias("ring"))
    extent = rings.select("id", F.size("ring").alias("corners"), geo.bounds(F.col("ring")).alias("b"))
    return extent.select("id", "corners", F.round("b.mid_x", 6).alias("mid_x"), F.round("b.mid_y", 6).alias("mid_y"))
