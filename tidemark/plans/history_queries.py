"""History operators over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import history as h
from tidemark.plans import worlds as w
from tidemark.sources import tables

QUERIES = {}
FIELDS = ("status", "bucket")
#: Pairs of runs (target, baseline) that are compared.
TARGET, BASELINE = 1, 0
LATER = (3, 2)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


def _compare(spark, sf_dir, target, baseline, reset=False):
    return h.compare(w.observations(spark, sf_dir), w.healthy(spark, sf_dir), target, baseline, FIELDS, order=("ts", "event_id"), reset=reset)


def _compare_sql(target: int, baseline: int) -> str:
    return f"""{w.OBS_SQL}, src AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY entity, run_seq, source ORDER BY ts, event_id) = 1),
now AS (SELECT DISTINCT entity FROM obs WHERE run_seq = {target}),
was AS (SELECT entity, max(run_seq) AS run_seq FROM obs WHERE run_seq <= {baseline} GROUP BY entity),
both_saw AS (SELECT was.entity, min(x.source) AS source FROM was JOIN src x USING (entity, run_seq) JOIN src y ON y.entity = was.entity AND y.run_seq = {target} AND y.source = x.source GROUP BY was.entity),
last AS (SELECT max(run_seq) AS r FROM health WHERE healthy AND run_seq <= {baseline}),
laddered AS (
  SELECT coalesce(now.entity, was.entity) AS entity, x.price AS was_price, y.price AS now_price, x.status AS was_status, y.status AS now_status, x.bucket AS was_bucket, y.bucket AS now_bucket,
    CASE
      WHEN was.entity IS NULL THEN 'new'
      WHEN now.entity IS NOT NULL AND coalesce(was.run_seq < last.r, false) THEN 'returned'
      WHEN now.entity IS NOT NULL AND m.source IS NULL THEN 'unverified'
      WHEN now.entity IS NOT NULL AND (y.status IS DISTINCT FROM x.status OR y.bucket IS DISTINCT FROM x.bucket) THEN 'changed'
      WHEN now.entity IS NOT NULL THEN 'unchanged'
      WHEN (SELECT coalesce(bool_and(healthy), false) FROM health WHERE run_seq = {target}) AND NOT coalesce(was.run_seq < last.r, false) THEN 'gone'
    END AS kind
  FROM now FULL JOIN was ON now.entity = was.entity CROSS JOIN last LEFT JOIN both_saw m ON m.entity = was.entity
  LEFT JOIN src x ON x.entity = was.entity AND x.run_seq = was.run_seq AND x.source = m.source LEFT JOIN src y ON y.entity = now.entity AND y.run_seq = {target} AND y.source = m.source
), events_out AS (
  SELECT entity, kind, CASE WHEN kind = 'changed' THEN concat_ws(';',
      CASE WHEN was_status IS DISTINCT FROM now_status THEN 'status:' || was_status || '>' || now_status END,
      CASE WHEN was_bucket IS DISTINCT FROM now_bucket THEN 'bucket:' || was_bucket || '>' || now_bucket END) ELSE '' END AS changes,
    CASE WHEN kind = 'changed' AND now_price <> was_price THEN round(abs(now_price - was_price), 4) END AS price_amount,
    CASE WHEN kind = 'changed' AND now_price < was_price THEN 'down' WHEN kind = 'changed' AND now_price > was_price THEN 'up' END AS price_direction
  FROM laddered WHERE kind IS NOT NULL
)"""


def _flat(df):
    text = F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), c["before"], F.lit(">"), c["after"])), ";")
    return df.select("entity", "kind", text.alias("changes"), F.round("price_amount", 4).alias("price_amount"), "price_direction")


@query("history_compare", f"WITH {_compare_sql(TARGET, BASELINE)} SELECT * FROM events_out")
def history_compare(spark, sf_dir):
    return _flat(_compare(spark, sf_dir, TARGET, BASELINE))


@query("history_compare_after_failure", f"WITH {_compare_sql(*LATER)} SELECT * FROM events_out")
def history_compare_after_failure(spark, sf_dir):
    return _flat(_compare(spark, sf_dir, *LATER))


@query("history_compare_first", f"WITH {w.OBS_SQL} SELECT DISTINCT entity, 'new' AS kind, '' AS changes, CAST(NULL AS DOUBLE) AS price_amount, CAST(NULL AS VARCHAR) AS price_direction FROM obs WHERE run_seq = 0")
def history_compare_first(spark, sf_dir):
    """A first run: everything is new."""
    return _flat(_compare(spark, sf_dir, 0, None))


@query("comparison_heads", f"""WITH {w.OBS_SQL}, r AS (
  SELECT a.search, a.run_seq, (SELECT max(b.run_seq) FROM runs b WHERE b.search = a.search AND b.revision IS NOT DISTINCT FROM a.revision AND b.status = 'completed' AND b.run_seq < a.run_seq) AS baseline_seq,
    EXISTS (SELECT 1 FROM runs b WHERE b.search = a.search AND b.status = 'completed' AND b.run_seq < a.run_seq) AS earlier FROM runs a WHERE a.status = 'completed'),
n AS (SELECT run_seq, count(DISTINCT entity) AS observed_count FROM obs GROUP BY run_seq)
SELECT search, run_seq, baseline_seq, baseline_seq IS NULL AND earlier AS reset, run_seq % 3 = 0 AS identity_frozen, observed_count FROM r JOIN n USING (run_seq)""")
def comparison_heads(spark, sf_dir):
    """What every completed run is compared with: its baseline, or that the search was reset, and whether its identity is frozen."""
    runs = w.runs(spark, sf_dir)
    seen = w.observations(spark, sf_dir).groupBy("run_seq").agg(F.count_distinct("entity").alias("observed_count"))
    heads = h.previous_runs(runs).join(runs.where(F.col("status") == "completed").select("run_seq"), "run_seq", "left_semi").join(seen, "run_seq")
    return heads.select("search", "run_seq", F.col("previous_seq").alias("baseline_seq"), "reset", (F.col("run_seq") % 3 == 0).alias("identity_frozen"), "observed_count")


@query("identity_of_runs", f"""WITH {w.OBS_SQL}, ids AS (SELECT DISTINCT entity AS id FROM obs)
SELECT 6 AS run_seq, id, id - id % 2 AS live FROM ids UNION ALL SELECT 7, id, id - id % 4 FROM ids""")
def identity_of_runs(spark, sf_dir):
    """Run 6 froze its identity in pairs; run 7 has none of its own and takes the present one, in fours."""
    ids = w.observations(spark, sf_dir).select(F.col("entity").alias("id")).distinct()
    frozen = ids.select(F.lit(6).alias("run_seq"), "id", (F.col("id") - F.col("id") % 2).alias("live"))
    live = ids.select("id", (F.col("id") - F.col("id") % 4).alias("live"))
    one = lambda run: h.identity_of_run(frozen, live, run).select(F.lit(run).alias("run_seq"), "id", "live")
    return one(6).unionByName(one(7))


@query("seen_by_search", f"WITH {w.OBS_SQL} SELECT DISTINCT s.entity - s.entity % 4 AS entity FROM snap s JOIN runs r USING (run_seq) WHERE r.search = 'even' AND r.status = 'completed' AND run_seq < 9")
def seen_by_search(spark, sf_dir):
    snaps = w.snapshots(spark, sf_dir).where("run_seq < 9")
    live = snaps.select(F.col("entity").alias("id"), (F.col("entity") - F.col("entity") % 4).alias("live")).distinct()
    return h.seen_by_search(snaps, w.runs(spark, sf_dir), live, "even")


@query("observed_as", f"WITH {w.OBS_SQL} SELECT entity, entity - entity % 4 AS live, run_seq, search, revision, event_id FROM snap JOIN runs USING (run_seq) WHERE runs.status = 'completed'")
def observed_as(spark, sf_dir):
    snaps = w.snapshots(spark, sf_dir)
    live = snaps.select(F.col("entity").alias("id"), (F.col("entity") - F.col("entity") % 4).alias("live")).distinct()
    return h.observed_as(snaps, w.runs(spark, sf_dir), live).select("entity", "live", "run_seq", "search", "revision", "event_id")


_COUNTS_SQL = f"WITH {_compare_sql(TARGET, BASELINE)}, n AS (SELECT kind, count(*) AS n FROM events_out GROUP BY kind UNION ALL SELECT * FROM (VALUES ('new', 0), ('changed', 0), ('unchanged', 0), ('gone', 0), ('returned', 0)) t(kind, n)), counted AS (SELECT kind, sum(n)::BIGINT AS n FROM n GROUP BY kind)"


@query("digest_kind_counts", f"{_COUNTS_SQL} SELECT * FROM counted")
def digest_kind_counts(spark, sf_dir):
    return h.kind_counts(_compare(spark, sf_dir, TARGET, BASELINE))


@query("digest_counts", f"""{_COUNTS_SQL}, pick AS (SELECT kind, n FROM counted)
SELECT (SELECT sum(n) FROM pick WHERE kind <> 'gone')::BIGINT AS matched, (SELECT n FROM pick WHERE kind = 'new') AS "new", (SELECT n FROM pick WHERE kind = 'changed') AS changed, (SELECT n FROM pick WHERE kind = 'gone') AS gone,
  (SELECT n FROM pick WHERE kind = 'returned') AS returned, coalesce((SELECT n FROM pick WHERE kind = 'unverified'), 0)::BIGINT AS unverified""")
def digest_counts(spark, sf_dir):
    from tidemark.operators.results import digest_counts as counts

    return counts(h.kind_counts(_compare(spark, sf_dir, TARGET, BASELINE)))


@query("digest_json", f"""{_COUNTS_SQL} SELECT to_json(struct_pack(target := {TARGET}, counts := (SELECT list(struct_pack(kind := kind, n := n) ORDER BY kind) FROM counted)))::VARCHAR AS digest""")
def digest_json(spark, sf_dir):
    """The digest as one JSON document, which is written whole or not at all."""
    from tidemark.operators.results import as_document

    return as_document(h.kind_counts(_compare(spark, sf_dir, TARGET, BASELINE)), "kind", target=TARGET)


@query("digest_moved", f"WITH {_compare_sql(TARGET, BASELINE)} SELECT count(*) FILTER (kind <> 'unchanged') AS moved, count(*) FILTER (kind <> 'unchanged') > 0 AS send FROM events_out")
def digest_moved(spark, sf_dir):
    from tidemark.operators.results import moved

    return moved(h.kind_counts(_compare(spark, sf_dir, TARGET, BASELINE)))


@query("latest_asof", f"WITH {w.OBS_SQL} SELECT entity, run_seq, event_id, status, round(price, 4) AS price FROM snap WHERE run_seq <= 10 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY run_seq DESC, event_id DESC) = 1")
def latest_asof(spark, sf_dir):
    return h.latest_asof(w.snapshots(spark, sf_dir), 10).select("entity", "run_seq", "event_id", "status", F.round("price", 4).alias("price"))


@query("presence_asof", f"""WITH {w.OBS_SQL}, last AS (SELECT max(run_seq) AS r FROM health WHERE healthy AND run_seq <= 11)
SELECT entity, max(run_seq) AS last_seen, CASE WHEN coalesce(max(run_seq) < any_value(r), false) THEN 'disappeared' ELSE 'observed' END AS presence
FROM snap, last WHERE run_seq <= 11 GROUP BY entity""")
def presence_asof(spark, sf_dir):
    return h.presence_asof(w.snapshots(spark, sf_dir), w.healthy(spark, sf_dir), 11)


@query("run_health", f"WITH {w.OBS_SQL} SELECT run_seq, healthy FROM health")
def run_health(spark, sf_dir):
    return w.healthy(spark, sf_dir)


@query("movements", f"""WITH {w.OBS_SQL}, steps AS (
  SELECT a.run_seq, max(b.run_seq) AS previous_seq FROM runs a JOIN runs b ON a.search = b.search AND a.revision IS NOT DISTINCT FROM b.revision AND b.status = 'completed' AND b.run_seq < a.run_seq WHERE a.status = 'completed' GROUP BY a.run_seq),
src AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY entity, run_seq, source ORDER BY ts, event_id) = 1),
pairs AS (
  SELECT y.entity, y.run_seq, CASE WHEN x.source = y.source THEN x.price ELSE z.price END AS was_price, CASE WHEN x.source = y.source THEN x.status ELSE z.status END AS was_status, y.price, y.status
  FROM snap y JOIN steps USING (run_seq) JOIN snap x ON x.entity = y.entity AND x.run_seq = previous_seq LEFT JOIN src z ON z.entity = y.entity AND z.run_seq = previous_seq AND z.source = y.source
  WHERE x.source = y.source OR z.source IS NOT NULL)
SELECT entity, run_seq, 'price_change' AS kind FROM pairs WHERE was_price IS DISTINCT FROM price
UNION ALL SELECT entity, run_seq, 'status_change' FROM pairs WHERE was_status IS DISTINCT FROM status""")
def movements(spark, sf_dir):
    runs = w.runs(spark, sf_dir)
    steps = h.previous_runs(runs).join(runs.where("status = 'completed'").select("run_seq"), "run_seq", "left_semi")
    return h.movements(w.snapshots(spark, sf_dir), w.observations(spark, sf_dir), steps, order=("ts", "event_id")).select("entity", "run_seq", "kind")


@query("price_story", f"""WITH {w.OBS_SQL}, lagged AS (SELECT *, lag(price) OVER (PARTITION BY entity ORDER BY run_seq) AS p FROM snap)
SELECT entity, round(arg_min(price, run_seq), 4) AS first_price, round(arg_max(price, run_seq), 4) AS last_price, coalesce(bool_or(price < p), false) AS price_cut,
  CAST(greatest(0, floor(epoch(min(ts) FILTER (price > p) - min(ts)) / 86400)) AS BIGINT) AS raise_days
FROM lagged GROUP BY entity""")
def price_story(spark, sf_dir):
    out = h.price_story(w.snapshots(spark, sf_dir))
    return out.select("entity", F.round("first_price", 4).alias("first_price"), F.round("last_price", 4).alias("last_price"), "price_cut", "raise_days")


@query("previous_run", f"""WITH {w.OBS_SQL}, p AS (SELECT a.search, a.run_seq, max(b.run_seq) AS previous_seq FROM runs a LEFT JOIN runs b
ON a.search = b.search AND a.revision IS NOT DISTINCT FROM b.revision AND b.status = 'completed' AND b.run_seq < a.run_seq GROUP BY ALL)
SELECT p.*, previous_seq IS NULL AND EXISTS (SELECT 1 FROM runs b WHERE b.search = p.search AND b.status = 'completed' AND b.run_seq < p.run_seq) AS reset FROM p""")
def previous_run(spark, sf_dir):
    return h.previous_runs(w.runs(spark, sf_dir))


@query("baseline_since", f"WITH {w.OBS_SQL} SELECT search, max(run_seq) AS baseline_seq FROM runs WHERE status = 'completed' AND started_at <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY search")
def baseline_since(spark, sf_dir):
    return h.baseline_since(w.runs(spark, sf_dir), "2024-01-15 12:00:00")


@query("run_status", f"""WITH {w.OBS_SQL} SELECT search, arg_max(run_seq, run_seq) FILTER (status = 'completed') AS last_completed, count(*) FILTER (status = 'completed') AS completed, count(*) AS all_runs FROM runs GROUP BY search""")
def run_status(spark, sf_dir):
    done = F.col("status") == "completed"
    return w.runs(spark, sf_dir).groupBy("search").agg(F.max(F.when(done, F.col("run_seq"))).alias("last_completed"), F.count_if(done).alias("completed"), F.count("*").alias("all_runs"))


@query("histories", f"WITH {w.OBS_SQL} SELECT entity, string_agg(run_seq || '=' || bucket, ';' ORDER BY run_seq) AS history FROM snap GROUP BY entity")
def histories(spark, sf_dir):
    told = h.histories(w.snapshots(spark, sf_dir), price="bucket")
    return told.select("entity", F.array_join(F.transform("history", lambda x: F.concat(x["run_seq"], F.lit("="), x["bucket"])), ";").alias("history"))


@query("first_wins", f"WITH {w.OBS_SQL} SELECT entity, run_seq, event_id, source FROM snap")
def first_wins(spark, sf_dir):
    return w.snapshots(spark, sf_dir).select("entity", "run_seq", "event_id", "source")


@query("days_on_market", "SELECT user_id AS entity, CAST(greatest(0, floor(epoch(TIMESTAMP '2024-02-10 06:00:00' - min(ts)) / 86400)) AS BIGINT) AS days FROM events GROUP BY user_id")
def days_on_market(spark, sf_dir):
    from tidemark.functions.values import floor_days

    first = w.observations(spark, sf_dir).groupBy("entity").agg(F.min("ts").alias("first"))
    return first.select("entity", floor_days(F.col("first"), F.lit("2024-02-10 06:00:00").cast("timestamp_ntz")).alias("days"))


@query("page_dedupe", """WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 5 AS page, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_orderkey || '-' || l_linenumber END AS k FROM lineitem)
SELECT page, count(*) AS n, count(k) AS keyed FROM (SELECT *, min(page) OVER (PARTITION BY k) AS f FROM p) WHERE k IS NULL OR page = f GROUP BY page""")
def page_dedupe(spark, sf_dir):
    li = w.table(spark, sf_dir, "lineitem")
    key = F.when(F.col("l_orderkey") % 11 != 0, F.concat_ws("-", "l_orderkey", "l_linenumber"))
    rows = tables.page_dedupe(li.select((F.col("l_suppkey") % 5).alias("page"), key.alias("k")), "k", "page")
    return rows.groupBy("page").agg(F.count("*").alias("n"), F.count("k").alias("keyed"))


@query("source_report", f"""WITH {w.OBS_SQL}, asked AS (SELECT * FROM (VALUES ('s0', 'ok'), ('s1', 'ok'), ('s2', 'failed'), ('s3', 'unavailable')) t(source, outcome)),
n AS (SELECT source, count(*) AS c FROM obs GROUP BY source), told AS (SELECT source, outcome, CASE WHEN outcome = 'ok' THEN coalesce(c, 0) ELSE 0 END AS row_count FROM asked LEFT JOIN n USING (source))
SELECT source, row_count, row_count >= 3333 AS truncated, outcome, CASE WHEN outcome <> 'ok' THEN 'no rows: ' || outcome WHEN row_count >= 3333 THEN 'at the ceiling of 3333' END AS detail FROM told""")
def source_report(spark, sf_dir):
    """A scan of four sources, of which one failed and one was not to be reached."""
    outcome = F.create_map(*[F.lit(x) for pair in (("s0", "ok"), ("s1", "ok"), ("s2", "failed"), ("s3", "unavailable")) for x in pair])
    asked = spark.range(1).select(F.explode(outcome).alias("source", "outcome"))
    return tables.source_report(w.observations(spark, sf_dir), asked, "source", 3333)


@query("worst_outcome", f"WITH {w.OBS_SQL} SELECT run_seq, CASE WHEN healthy THEN 'ok' ELSE 'failed' END AS outcome FROM health")
def worst_outcome(spark, sf_dir):
    return tables.worst_outcome(w.run_sources(spark, sf_dir), "run_seq")


@query("high_water_marks", f"WITH {w.OBS_SQL} SELECT (SELECT max(event_id) FROM snap) AS snapshot_id, (SELECT max(run_seq) FROM runs) AS run_seq, (SELECT max(finished_at) FROM runs) AS finished_at, (SELECT max(event_id) FROM obs) AS event_id")
def high_water_marks(spark, sf_dir):
    a = w.snapshots(spark, sf_dir).agg(F.max("event_id").alias("snapshot_id"))
    b = w.runs(spark, sf_dir).agg(F.max("run_seq").alias("run_seq"), F.max("finished_at").alias("finished_at"))
    c = w.observations(spark, sf_dir).agg(F.max("event_id").alias("event_id"))
    return a.crossJoin(b).crossJoin(c)  # one row each


@query("entities_of_runs", f"WITH {w.OBS_SQL} SELECT count(DISTINCT entity) AS entities FROM snap WHERE run_seq BETWEEN 3 AND 6")
def entities_of_runs(spark, sf_dir):
    return w.snapshots(spark, sf_dir).where(F.col("run_seq").between(3, 6)).agg(F.count_distinct("entity").alias("entities"))


@query("live_without_snapshot", f"WITH {w.OBS_SQL} SELECT DISTINCT entity FROM obs WHERE entity NOT IN (SELECT entity FROM snap WHERE run_seq = 5)")
def live_without_snapshot(spark, sf_dir):
    seen = w.snapshots(spark, sf_dir).where("run_seq = 5").select("entity")
    return w.observations(spark, sf_dir).select("entity").distinct().join(seen, "entity", "left_anti")


@query("new_in_run", f"WITH {w.OBS_SQL} SELECT entity, min(run_seq) AS created_in, min(run_seq) = 1 AS is_new FROM snap GROUP BY entity")
def new_in_run(spark, sf_dir):
    return w.snapshots(spark, sf_dir).groupBy("entity").agg(F.min("run_seq").alias("created_in"), (F.min("run_seq") == 1).alias("is_new"))


@query("current_candidates", f"""WITH {w.OBS_SQL}, merged AS (SELECT DISTINCT entity AS constituent, 100000 + entity // 10 AS live FROM snap),
latest AS (SELECT entity, run_seq, event_id FROM snap QUALIFY row_number() OVER (PARTITION BY entity ORDER BY run_seq DESC, event_id DESC) = 1)
SELECT * FROM latest UNION ALL SELECT live, run_seq, event_id FROM (SELECT m.live, l.run_seq, l.event_id FROM merged m JOIN latest l ON l.entity = m.constituent QUALIFY row_number() OVER (PARTITION BY m.live ORDER BY l.run_seq DESC, l.event_id DESC) = 1)""")
def current_candidates(spark, sf_dir):
    snaps = w.snapshots(spark, sf_dir)
    merged = snaps.select(F.col("entity").alias("constituent"), (F.floor(F.col("entity") / 10) + 100000).alias("live")).distinct()
    return h.current_candidates(snaps, merged).select("entity", "run_seq", "event_id")


@query("stand_ins", f"""WITH {w.OBS_SQL}, merged AS (SELECT DISTINCT entity AS constituent, 100000 + entity // 10 AS live FROM snap)
SELECT m.live, s.run_seq, s.event_id, s.status FROM merged m JOIN snap s ON s.entity = m.constituent QUALIFY row_number() OVER (PARTITION BY m.live ORDER BY run_seq DESC, event_id DESC) = 1""")
def stand_ins(spark, sf_dir):
    snaps = w.snapshots(spark, sf_dir)
    merged = snaps.select(F.col("entity").alias("constituent"), (F.floor(F.col("entity") / 10) + 100000).alias("live")).distinct()
    return h.stand_ins(merged, snaps).select("live", "run_seq", "event_id", "status")


@query("source_observations", f"""WITH {w.OBS_SQL}, wanted AS (SELECT entity, run_seq FROM snap WHERE run_seq IN (2, 3))
SELECT entity, run_seq, source, event_id FROM obs SEMI JOIN wanted USING (entity, run_seq) QUALIFY row_number() OVER (PARTITION BY entity, run_seq, source ORDER BY ts, event_id) = 1""")
def source_observations(spark, sf_dir):
    wanted = w.snapshots(spark, sf_dir).where(F.col("run_seq").isin(2, 3)).select("entity", "run_seq")
    rows = w.observations(spark, sf_dir).join(wanted, ["entity", "run_seq"], "left_semi")
    return h.first_per_key(rows, ["entity", "run_seq", "source"], ["ts", "event_id"]).select("entity", "run_seq", "source", "event_id")


_EVENTS_SQL = f"""WITH {w.OBS_SQL}, s AS (SELECT entity, run_seq, lead(run_seq) OVER (PARTITION BY entity ORDER BY run_seq) AS following FROM (SELECT DISTINCT entity, run_seq FROM snap)),
t AS (SELECT s.entity, s.following, min(h.run_seq) AS missed FROM s JOIN health h ON h.healthy AND h.run_seq > s.run_seq GROUP BY s.entity, s.run_seq, s.following)
SELECT entity, missed AS run_seq, 'disappeared' AS event FROM t WHERE following IS NULL OR missed < following UNION ALL SELECT entity, following, 'returned' FROM t WHERE missed < following"""


@query("presence_events", _EVENTS_SQL)
def presence_events(spark, sf_dir):
    return h.presence_events(w.snapshots(spark, sf_dir), w.healthy(spark, sf_dir))


@query("streamed_presence", _EVENTS_SQL)
def streamed_presence(spark, sf_dir):
    """The same events from a stream that is stopped after half of the runs, told the first half again, and gone on with."""
    from tidemark.streaming.presence import presence_stream, use_state

    use_state(spark)
    base = f"{tables.shared_folder(spark)}/presence-{uuid.uuid4().hex}"
    seen, ends = w.snapshots(spark, sf_dir).select("entity", "run_seq"), w.healthy(spark, sf_dir)
    kinds = {name: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) for name, rows in (("seen", seen), ("ends", ends))}

    def feed(half):
        for name, rows in (("seen", seen), ("ends", ends)):
            rows.where(half).write.mode("append").parquet(f"{base}/{name}")
        events = presence_stream(*(spark.readStream.schema(kinds[name]).parquet(f"{base}/{name}") for name in ("seen", "ends")), buckets=16)
        events.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    feed(F.col("run_seq") < 15)
    feed((F.col("run_seq") >= 15) | (F.col("run_seq") < 8))
    out = tables.stored(spark.read.schema("entity bigint, run_seq bigint, event string").parquet(f"{base}/out"))
    tables.delete(spark, base)
    return out


@query("stopped_passes", """SELECT user_id AS pass_id, max(ts) AS last_beat, 'stopped' AS state FROM events GROUP BY user_id
HAVING user_id % 4 <> 0 AND epoch_ms(max(ts)) + 48 * 3600000 < (SELECT epoch_ms(max(ts)) FROM events) - 3600000""")
def stopped_passes(spark, sf_dir):
    """Users as passes whose events are beats, one an hour: those that have missed 48 when the stream's watermark, an hour late, is past it.

    Times travel as those since the first event, which is put on the second day of 1970, as watermarks begin there; no time zone takes part.
    Half a millisecond is added, as a watermark is rounded down and epoch_ms to the nearest.  Events that span more than 8,000 years
    are an error, as a time so put must still be one of Python's.
    """
    from tidemark.streaming.presence import stopped_passes, use_state

    use_state(spark)
    base = f"{tables.shared_folder(spark)}/beats-{uuid.uuid4().hex}"
    us = F.expr("cast(cast(ts - timestamp_ntz'1970-01-01' as interval second) as decimal(20, 6)) * 1000000").cast("bigint")
    events = w.table(spark, sf_dir, "events").select(F.col("user_id").alias("pass_id"), us.alias("us"), (F.col("user_id") % 4 == 0).alias("finished"))
    back = (events.agg(F.min("us")).first()[0] or 0) // 1000 * 1000 - 86_400_000_000 - 500
    rows = events.select("pass_id", F.timestamp_micros(F.col("us") - back).alias("at"), "finished")
    rows.write.parquet(f"{base}/in")
    stream = stopped_passes(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), "1 hour", 3600, 48)
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("pass_id bigint, last_beat timestamp, state string").parquet(f"{base}/out").withColumn("us", F.unix_micros("last_beat") + back)
    out = tables.stored(out.select("pass_id", F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, cast(us as decimal(20, 0)) / 1000000)").alias("last_beat"), "state"))
    tables.delete(spark, base)
    return out
