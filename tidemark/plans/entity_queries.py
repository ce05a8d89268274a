"""Identity operators over customers, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions import text as t
from tidemark.operators import history as h
from tidemark.operators import identity as i
from tidemark.operators.results import judgments
from tidemark.plans import worlds as w

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


_CHAINS_SQL = """
chains AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 16 <> 0 THEN p_partkey - 1 END AS superseded_by FROM part),
live AS (
  SELECT id, id AS live, superseded_by AS up FROM chains WHERE superseded_by IS NULL
  UNION ALL SELECT c.id, l.live, c.superseded_by FROM chains c JOIN live l ON c.superseded_by = l.id
)"""


def _chains(spark, sf_dir):
    """Parts in chains of sixteen, each replaced by the one before."""
    p = w.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 16 != 0, F.col("p_partkey") - 1).alias("superseded_by"))


@query("closure", f"WITH RECURSIVE {_CHAINS_SQL} SELECT id, live FROM live")
def closure(spark, sf_dir):
    return i.closure(_chains(spark, sf_dir))


@query("constituents", f"WITH RECURSIVE {_CHAINS_SQL} SELECT live, count(*) AS constituents FROM live GROUP BY live")
def constituents(spark, sf_dir):
    return i.constituents(i.closure(_chains(spark, sf_dir)))


@query("closure_places", f"""WITH RECURSIVE {_CHAINS_SQL} SELECT DISTINCT l.live, p.p_size FROM live l JOIN part p ON p.p_partkey = l.id WHERE upper(trim(p.p_brand)) LIKE 'BRAND%'""")
def closure_places(spark, sf_dir):
    parts = w.table(spark, sf_dir, "part").where(F.upper(F.trim("p_brand")).startswith("BRAND")).select("p_partkey", "p_size")
    live = i.closure(_chains(spark, sf_dir))
    return live.join(parts, live["id"] == parts["p_partkey"]).select("live", "p_size").distinct()


#: Records of the merge queries: customers three to a place, some with parcel numbers, addresses and units.
_PAIR_SQL = f"""
c AS (
  SELECT c_custkey AS id, 30.0::DOUBLE + (c_custkey // 3 * 7919 % 10000) / 2000.0::DOUBLE + (c_custkey % 3) * 0.0003::DOUBLE + CASE WHEN c_custkey % 4 = 1 THEN 0.002::DOUBLE ELSE 0.0::DOUBLE END AS latitude,
    -105.0::DOUBLE + (c_custkey // 3 * 104729 % 10000) / 2000.0::DOUBLE AS longitude,
    CASE WHEN c_custkey % 5 IN (0, 3) THEN 'p100' || (c_custkey // 2) END AS parcel,
    CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey // 3) || ' ' || c_nationkey % 2 END AS street, CASE c_custkey % 11 WHEN 0 THEN '1' WHEN 1 THEN '2' END AS unit
  FROM customer
), r AS (SELECT *, street || '|' || coalesce(unit, '') AS address_key, street AS bare_key,
    abs(latitude) <= 90 AND abs(longitude) <= 180 AND NOT (latitude = floor(latitude) AND longitude = floor(longitude)) AS placed FROM c),
keyed AS (
  SELECT id, 'a:' || address_key AS k FROM r WHERE address_key IS NOT NULL
  UNION SELECT id, 'c:' || CAST(floor((latitude - i * 0.5 / 1000.0::DOUBLE) * 1000.0::DOUBLE + 0.5) AS BIGINT) || ',' || CAST(floor((longitude - j * 0.5 / 1000.0::DOUBLE) * 1000.0::DOUBLE + 0.5) AS BIGINT) FROM r, range(2) x(i), range(2) y(j) WHERE placed
), pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM keyed a JOIN keyed b ON a.k = b.k AND a.id < b.id),
signals AS (
  SELECT p.a, p.b,
    CASE WHEN l.parcel IS NULL OR r.parcel IS NULL THEN 'unknown' WHEN l.parcel = r.parcel THEN 'agreed' ELSE 'disagreed' END AS parcel,
    CASE WHEN l.unit <> r.unit THEN 'disagreed' WHEN l.address_key IS NULL OR r.address_key IS NULL THEN 'unknown' WHEN l.address_key = r.address_key THEN 'agreed'
      WHEN l.bare_key = r.bare_key THEN 'unknown' ELSE 'disagreed' END AS address,
    CASE WHEN NOT (l.placed AND r.placed) THEN 'unknown' WHEN {w.miles_sql("l", "r", geo.METRES)} <= 50 THEN 'agreed' ELSE 'disagreed' END AS place,
    coalesce(l.unit <> r.unit, false) AS units_differ, l.parcel IS NOT NULL OR r.parcel IS NOT NULL AS some_parcel, coalesce(l.bare_key = r.bare_key, false) AS same_street
  FROM pairs p JOIN r l ON l.id = p.a JOIN r ON r.id = p.b
), decided AS (
  SELECT a, b, parcel, CASE
    WHEN parcel = 'agreed' THEN 'matched' WHEN parcel = 'disagreed' THEN 'distinct'
    WHEN address = 'disagreed' AND units_differ THEN 'distinct' WHEN address = 'disagreed' THEN 'unrelated'
    WHEN address = 'agreed' AND place = 'disagreed' THEN 'ambiguous' WHEN address = 'agreed' THEN 'matched'
    WHEN place = 'agreed' THEN 'ambiguous' ELSE 'unrelated' END AS decision
  FROM signals
), matched AS (SELECT a, b FROM decided WHERE decision = 'matched'),
ways AS (SELECT a, b FROM matched UNION ALL SELECT b, a FROM matched),
reach AS (SELECT a AS node, a AS other FROM ways UNION SELECT r.node, m.b FROM reach r JOIN ways m ON m.a = r.other),
groups AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
sized AS (SELECT component, count(*) AS members, list(node ORDER BY node) AS nodes FROM groups GROUP BY component),
paired AS (SELECT component, count(*) AS pairs FROM matched JOIN groups ON node = a GROUP BY component),
judged AS (SELECT component, nodes, members, pairs, pairs = members * (members - 1) / 2 AS complete FROM sized JOIN paired USING (component)),
why AS (SELECT component, bool_or(d.parcel = 'agreed') AS by_parcel FROM decided d JOIN groups ON node = d.a WHERE decision = 'matched' GROUP BY component)"""


def _records(spark, sf_dir):
    c = w.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    third = F.floor(F.col("id") / 3)
    shift = F.when(F.col("id") % 4 == 1, 0.002).otherwise(0.0)
    latitude = F.lit(30.0) + (third * 7919 % 10000) / F.lit(2000.0) + (F.col("id") % 3) * F.lit(0.0003) + shift
    street = F.when(F.col("id") % 7 != 0, F.concat_ws(" ", third, F.col("c_nationkey") % 2))
    unit = F.when(F.col("id") % 11 == 0, "1").when(F.col("id") % 11 == 1, "2")
    return c.select(
        "id", latitude.alias("latitude"), (F.lit(-105.0) + (third * 104729 % 10000) / F.lit(2000.0)).alias("longitude"),
        F.when((F.col("id") % 5).isin(0, 3), F.concat(F.lit("p100"), F.floor(F.col("id") / 2))).alias("parcel"),
        F.concat(street, F.lit("|"), F.coalesce(unit, F.lit(""))).alias("address_key"), street.alias("bare_key"), unit.alias("unit"),
    )


def _blocks():
    named = lambda p, x: F.concat(F.lit(p), x)
    cells = F.transform(F.coalesce(geo.cells(F.col("latitude"), F.col("longitude")), F.array().cast("array<string>")), lambda x: named("c:", x))
    return F.concat(F.array(named("a:", F.col("address_key"))), cells)


def _pairs(spark, sf_dir):
    return i.candidate_pairs(_records(spark, sf_dir), _blocks())


def _decided(spark, sf_dir):
    return i.decide(i.blocked_signals(_records(spark, sf_dir), _blocks())).withColumn("by_person", F.lit(False))


@query("candidate_pairs", f"WITH RECURSIVE {_PAIR_SQL} SELECT a, b FROM pairs")
def candidate_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("pair_signals", f"""WITH RECURSIVE {_PAIR_SQL} SELECT a, b, parcel, address, place, units_differ,
  concat_ws(',', CASE WHEN parcel = 'agreed' THEN 'parcel' END, CASE WHEN address = 'agreed' THEN 'address' END, CASE WHEN place = 'agreed' THEN 'place' END) AS agreed,
  concat_ws(',', CASE WHEN parcel = 'disagreed' THEN 'parcel' END, CASE WHEN address = 'disagreed' THEN 'address' END, CASE WHEN place = 'disagreed' THEN 'place' END) AS conflicted,
  concat_ws(',', CASE WHEN parcel = 'unknown' AND some_parcel THEN 'parcel on one side' END, CASE WHEN address = 'unknown' AND same_street THEN 'unit on one side' END,
    CASE WHEN address = 'unknown' AND NOT same_street THEN 'no address' END, CASE WHEN place = 'unknown' THEN 'no coordinates' END) AS unknown FROM signals""")
def pair_signals(spark, sf_dir):
    told = i.pair_signals(_pairs(spark, sf_dir), _records(spark, sf_dir))
    return told.select("a", "b", "parcel", "address", "place", "units_differ", *[F.array_join(c, ",").alias(c) for c in ("agreed", "conflicted", "unknown")])


@query("pair_decisions", f"WITH RECURSIVE {_PAIR_SQL} SELECT a, b, decision FROM decided")
def pair_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("a", "b", "decision")


def _said(spark, sf_dir):
    """People's verdicts on some pairs, the later of two counting."""
    pairs = _pairs(spark, sf_dir).where(F.col("a") % 4 == 0)
    late = F.when((F.col("a") + F.col("b")) % 2 == 0, "matched").otherwise("distinct")
    return pairs.select("a", "b", late.alias("verdict"), F.lit(2).alias("seq")).unionByName(pairs.select("a", "b", F.lit("distinct").alias("verdict"), F.lit(1).alias("seq")))


_SAID_SQL = "said AS (SELECT a, b, CASE WHEN (a + b) % 2 = 0 THEN 'matched' ELSE 'distinct' END AS v FROM pairs WHERE a % 4 = 0)"


@query("pair_overrides", f"WITH RECURSIVE {_PAIR_SQL}, {_SAID_SQL} SELECT d.a, d.b, coalesce(v, decision) AS decision, v IS NOT NULL AND v <> decision AS contradicted, v IS NOT NULL AS by_person FROM decided d LEFT JOIN said USING (a, b)")
def pair_overrides(spark, sf_dir):
    return i.override(_decided(spark, sf_dir), _said(spark, sf_dir)).drop("parcel", "agreed", "conflicted")


@query("match_groups", f"WITH RECURSIVE {_PAIR_SQL} SELECT node, component FROM groups")
def match_groups(spark, sf_dir):
    return i.connected_components(_decided(spark, sf_dir).where("decision = 'matched'"))


@query("complete_groups", f"WITH RECURSIVE {_PAIR_SQL} SELECT component, members, pairs, complete FROM judged")
def complete_groups(spark, sf_dir):
    matched = _decided(spark, sf_dir).where("decision = 'matched'").select("a", "b")
    return i.complete_groups(matched, i.connected_components(matched))


@query("merges", f"""WITH RECURSIVE {_PAIR_SQL}
SELECT component, array_to_string(nodes, ',') AS members, CASE WHEN by_parcel THEN '{i.BY_PARCEL}' ELSE '{i.BY_RULES}' END AS join_signal FROM judged JOIN why USING (component) WHERE complete""")
def merges(spark, sf_dir):
    found = i.merge_pass(_decided(spark, sf_dir))[0]
    return found.select("component", F.array_join("members", ",").alias("members"), "join_signal")


@query("resolved_merges", f"""WITH RECURSIVE {_PAIR_SQL.replace("), matched AS", f"), {_SAID_SQL}, settled AS (SELECT d.a, d.b, parcel, coalesce(v, decision) AS decision, v IS NOT NULL AS by_person FROM decided d LEFT JOIN said USING (a, b)), matched AS").replace("FROM decided WHERE", "FROM settled WHERE").replace("why AS (SELECT component, bool_or(d.parcel = 'agreed') AS by_parcel FROM decided d", "why AS (SELECT component, arg_min(by_person, a * 1000000 + b) FILTER (by_person OR d.parcel = 'agreed') AS person FROM settled d")}
SELECT component, array_to_string(nodes, ',') AS members, CASE WHEN person THEN '{i.BY_PERSON}' WHEN person IS NOT NULL THEN '{i.BY_PARCEL}' ELSE '{i.BY_RULES}' END AS join_signal FROM judged JOIN why USING (component) WHERE complete""")
def resolved_merges(spark, sf_dir):
    """The merges of a pass after people's answers: an answered pair decides, whatever the rules say."""
    found = i.merge_pass(i.override(_decided(spark, sf_dir), _said(spark, sf_dir)))[0]
    return found.select("component", F.array_join("members", ",").alias("members"), "join_signal")


@query("merge_edges", f"""WITH RECURSIVE {_PAIR_SQL}, m AS (SELECT nodes, 'm-' || substr(sha256(array_to_string(nodes, ',')), 1, 16) AS live FROM judged WHERE complete)
SELECT CAST(unnest(nodes) AS VARCHAR) AS id, live AS superseded_by FROM m""")
def merge_edges(spark, sf_dir):
    return i.merge_edges(i.merge_pass(_decided(spark, sf_dir))[0], 1).select("id", "superseded_by")


_QUESTION_SQL = f"""{_PAIR_SQL}, noted AS (
  SELECT s.a, s.b, x.component, x.component = y.component AS inside, parcel, address, place FROM signals s LEFT JOIN groups x ON x.node = s.a LEFT JOIN groups y ON y.node = s.b
), notes AS (
  SELECT component, count(*) AS compared,
    concat_ws(',', CASE WHEN bool_or(address = 'agreed') THEN 'address' END, CASE WHEN bool_or(parcel = 'agreed') THEN 'parcel' END, CASE WHEN bool_or(place = 'agreed') THEN 'place' END) AS agreed,
    concat_ws(',', CASE WHEN bool_or(address = 'disagreed') THEN 'address' END, CASE WHEN bool_or(parcel = 'disagreed') THEN 'parcel' END, CASE WHEN bool_or(place = 'disagreed') THEN 'place' END) AS conflicted
  FROM noted WHERE inside GROUP BY component
), questions AS (
  SELECT nodes, agreed, conflicted, CAST(members * (members - 1) / 2 AS BIGINT) - compared AS uncompared FROM judged JOIN notes USING (component) WHERE NOT complete
  UNION ALL SELECT [a, b], concat_ws(',', CASE WHEN address = 'agreed' THEN 'address' END, CASE WHEN parcel = 'agreed' THEN 'parcel' END, CASE WHEN place = 'agreed' THEN 'place' END),
    concat_ws(',', CASE WHEN address = 'disagreed' THEN 'address' END, CASE WHEN parcel = 'disagreed' THEN 'parcel' END, CASE WHEN place = 'disagreed' THEN 'place' END), 0
  FROM signals JOIN decided USING (a, b, parcel) WHERE decision = 'ambiguous' AND a NOT IN (SELECT node FROM groups) AND b NOT IN (SELECT node FROM groups)
)"""


def _questions(found):
    return found.select(*[F.array_join(c, ",").alias(c) for c in ("members", "agreed", "conflicted")], "uncompared")


@query("review_queue", f"WITH RECURSIVE {_QUESTION_SQL} SELECT array_to_string(nodes, ',') AS members, agreed, conflicted, uncompared FROM questions")
def review_queue(spark, sf_dir):
    return _questions(i.merge_pass(_decided(spark, sf_dir))[1])


@query("open_questions", f"WITH RECURSIVE {_QUESTION_SQL} SELECT array_to_string(nodes, ',') AS members, agreed, conflicted, uncompared FROM questions WHERE nodes[1] % 2 = 1")
def open_questions(spark, sf_dir):
    """Questions that are left when those with an even first member, groups of any number, were answered."""
    decided = _decided(spark, sf_dir)
    first = i.merge_pass(decided)[1].select(F.reverse("members").alias("members")).where(F.element_at("members", -1) % 2 == 0)
    return _questions(i.merge_pass(decided, first)[1])


@query("grown_components", f"WITH RECURSIVE {_PAIR_SQL} SELECT node, component FROM groups")
def grown_components(spark, sf_dir):
    """Match groups of a half of the pairs, kept up with the other half."""
    matched = _decided(spark, sf_dir).where("decision = 'matched'").select("a", "b")
    half = F.pmod(F.xxhash64("a", "b"), F.lit(2))
    return i.extended_components(i.connected_components(matched.where(half == 0)), matched.where(half == 1))


@query("fullest_row", """WITH r AS (SELECT c_custkey, c_custkey // 4 AS live, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS a, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS m FROM customer)
SELECT live, c_custkey FROM r QUALIFY row_number() OVER (PARTITION BY live ORDER BY (a IS NOT NULL)::INT + (m IS NOT NULL)::INT DESC, c_custkey) = 1""")
def fullest_row(spark, sf_dir):
    c = w.table(spark, sf_dir, "customer")
    rows = c.select("c_custkey", F.floor(F.col("c_custkey") / 4).alias("live"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_mktsegment")).alias("m"))
    return i.fullest(rows, "live", ["a", "m"], "c_custkey").select("live", "c_custkey")


@query("judgment_rollup", """WITH n AS (SELECT o_orderkey AS entity, CASE WHEN o_orderkey % 5 = 0 THEN 'pass' WHEN o_orderkey % 3 = 0 THEN 'keep' END AS j FROM orders),
e AS (SELECT entity AS live, j FROM n UNION ALL SELECT entity // 8, j FROM n)
SELECT live, CASE WHEN bool_or(j = 'pass') THEN 'pass' WHEN bool_or(j = 'keep') THEN 'keep' END AS judgment FROM e GROUP BY live""")
def judgment_rollup(spark, sf_dir):
    o = w.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"))
    notes = o.withColumn("judgment", F.when(F.col("entity") % 5 == 0, "pass").when(F.col("entity") % 3 == 0, "keep"))
    merged = o.select(F.col("entity").alias("constituent"), F.floor(F.col("entity") / 8).alias("live"))
    return judgments(notes, merged)


@query("merged_presence", f"WITH {w.OBS_SQL} SELECT entity // 5 AS live, bool_or(run_seq = 20) AS observed, min(ts) AS first_seen, arg_min(entity, ts) AS first_entity FROM snap GROUP BY ALL")
def merged_presence(spark, sf_dir):
    s = w.snapshots(spark, sf_dir).withColumn("live", F.floor(F.col("entity") / 5))
    return s.groupBy("live").agg(F.bool_or(F.col("run_seq") == 20).alias("observed"), F.min("ts").alias("first_seen"), F.min_by("entity", "ts").alias("first_entity"))


@query("same_texts", "SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def same_texts(spark, sf_dir):
    d = w.table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.fold(F.col("text")).cast("binary"), 256).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")


@query("entity_on_write", f"""WITH {w.OBS_SQL}, rows AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN status || '-' || bucket END AS source_id, CASE WHEN event_id % 5 <> 0 THEN 'road ' || bucket END AS address, CASE WHEN event_id % 2 = 0 THEN 'u1' END AS unit FROM obs),
a AS (SELECT source, source_id, entity FROM rows WHERE run_seq < 5 AND source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY event_id DESC) = 1),
b AS (SELECT source, address, unit, entity FROM rows WHERE run_seq < 5 AND source_id IS NULL QUALIFY row_number() OVER (PARTITION BY source, coalesce(address, ''), coalesce(unit, '') ORDER BY event_id DESC) = 1)
SELECT o.event_id, x.entity - x.entity % 4 AS entity FROM (SELECT o.event_id, CASE WHEN o.source_id IS NOT NULL THEN a.entity WHEN o.address IS NOT NULL THEN b.entity END AS entity FROM rows o
  LEFT JOIN a ON a.source = o.source AND a.source_id = o.source_id
  LEFT JOIN b ON b.source = o.source AND coalesce(b.address, '') = coalesce(o.address, '') AND coalesce(b.unit, '') = coalesce(o.unit, '') WHERE o.run_seq = 5) x JOIN obs o USING (event_id)""")
def entity_on_write(spark, sf_dir):
    obs = w.observations(spark, sf_dir)
    source_id = F.when(F.col("event_id") % 3 != 0, F.concat_ws("-", "status", "bucket"))
    rows = obs.select("entity", "run_seq", "event_id", "source", source_id.alias("source_id"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("road "), F.col("bucket"))).alias("address"), F.when(F.col("event_id") % 2 == 0, "u1").alias("unit"), F.lit(None).cast("string").alias("postal"))
    live = obs.select(F.col("entity").alias("id"), (F.col("entity") - F.col("entity") % 4).alias("live")).distinct()
    return i.resolve_on_write(rows.where("run_seq = 5").drop("entity"), rows.where("run_seq < 5").withColumn("at", F.col("event_id")), live).select("event_id", "entity")
