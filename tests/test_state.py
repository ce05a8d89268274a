"""Components, blocks, runs that commit, paged sources, streams with state, kinds of criteria."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.oracle import rows_of, rows_of_sql
from tests.test_operators import snaps
from tidemark.functions import criteria
from tidemark.functions.criteria import Rule, constant, evaluate, field
from tidemark.operators import history, identity
from tidemark.plans.registry import QUERIES, SQL
from tidemark.sources import paged, runs
from tidemark.streaming import presence


def plain_components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {x: find(x) for x in up}


def pairs_of(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_plain_search(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range((60, 150, 5)[seed])] + [(7, 7)]
    rows = identity.connected_components(pairs_of(spark, pairs)).collect()
    assert len(rows) == len({r["node"] for r in rows}) and {r["node"]: r["component"] for r in rows} == plain_components(pairs)
    identity_hubs, identity.HUB_EDGES = identity.HUB_EDGES, 0  # as a large graph
    half = identity.connected_components(pairs_of(spark, pairs[:40]))
    identity.HUB_EDGES = identity_hubs
    rows = identity.extended_components(half, pairs_of(spark, pairs[40:])).collect()
    assert len(rows) == len({r["node"] for r in rows}) and {r["node"]: r["component"] for r in rows} == plain_components(pairs)


def test_a_star_and_a_path_settle(spark):
    star = spark.range(1, 200_001).selectExpr("id a", "500000L b")
    path = spark.range(1_000_000, 1_020_000).selectExpr("id a", "id + 1 b")
    found = identity.connected_components(star.unionByName(path)).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert {(r["component"], r["n"]) for r in found} == {(1, 200_001), (1_000_000, 20_001)}


def test_large_blocks_are_cut_and_pairs_given_once(spark):
    rng = random.Random(4)
    rows = [(i, ["all", rng.choice("xyz"), None] + [rng.choice("uvw")] * (i % 2)) for i in range(60)] + [(99, None), (98, [])]
    frame = spark.createDataFrame(rows, "id long, keys array<string>")
    want = sorted((a, b) for a in range(60) for b in range(a + 1, 60))
    for size in (7, 2000):
        assert sorted(map(tuple, identity.candidate_pairs(frame, F.col("keys"), block_rows=size).collect())) == want
    loose = frame.withColumn("keys", F.array_remove("keys", "all"))
    keys = {i: {k for k in ks or () if k and k != "all"} for i, ks in rows}
    want = sorted((a, b) for a in keys for b in keys if a < b and keys[a] & keys[b])
    assert sorted(map(tuple, identity.candidate_pairs(loose, F.col("keys"), block_rows=5).collect())) == want


def test_questions_have_notes_and_answered_ones_are_not_asked(spark):
    rows = [(1, 2, "matched", ["place"], []), (2, 3, "matched", ["address"], ["parcel"]), (7, 8, "ambiguous", ["place"], []), (5, 6, "matched", [], [])]
    decided = spark.createDataFrame(rows, "a long, b long, decision string, agreed array<string>, conflicted array<string>").withColumn("parcel", F.lit("unknown")).withColumn("by_person", F.lit(False))
    merges, questions = identity.merge_pass(decided)
    assert [r["members"] for r in merges.collect()] == [[5, 6]]
    assert sorted(map(tuple, questions.collect())) == [([1, 2, 3], ["address", "place"], ["parcel"], 1), ([7, 8], ["place"], [], 0)]
    answered = spark.createDataFrame([([3, 1, 2],)], "members array<long>")
    assert [r["members"] for r in identity.merge_pass(decided, answered)[1].collect()] == [[7, 8]]


# --- runs


SCHEMA = "id long, price double, run long, source string"


def test_runs_count_as_a_whole_or_not_at_all(spark, tmp_path):
    runs.register(spark)
    path = str(tmp_path / "runs")
    rows = spark.range(100).selectExpr("id", "cast(id as double) price").repartition(4)
    read = lambda: spark.read.format(runs.FORMAT).option("path", path).schema(SCHEMA).load()
    with pytest.raises(ValueError, match="never began"):
        runs.complete(spark, path, 1)
    runs.start(spark, path, 1)
    runs.record(rows, path, 1, "a")
    runs.record(rows.where("id < 10"), path, 1, "b")
    assert read().count() == 0
    runs.record(rows.where("id < 5"), path, 1, "b")  # again: it replaces
    with pytest.raises(PySparkException):
        runs.record(rows.withColumn("price", F.when(F.col("id") == 77, F.raise_error(F.lit("dies"))).otherwise(F.col("price"))), path, 1, "c")
    runs.complete(spark, path, 1)
    assert sorted((r["source"], r["n"]) for r in read().groupBy("source").agg(F.count("*").alias("n")).collect()) == [("a", 100), ("b", 5)]
    assert not [d for d in (tmp_path / "runs" / "data" / "run=1").iterdir() if not any(d.iterdir())]
    with pytest.raises(ValueError, match="complete"):
        runs.start(spark, path, 1)
    runs.start(spark, path, 2)
    runs.record(rows, path, 2, "a")
    runs.fail(spark, path, 2)
    assert read().where("run = 2").count() == 0
    runs.start(spark, path, 2)  # repeated from the beginning
    runs.record(rows.where("id = 3"), path, 2, "z")
    runs.complete(spark, path, 2)
    assert [tuple(r) for r in read().where("run = 2").collect()] == [(3, 3.0, 2, "z")]
    # uses of one read don't see each other's filters, in one query or after another
    once = read()
    apart = [read().where("run = 1").count(), read().where("run = 2").count()]
    assert once.where("run = 1").unionByName(once.where("run = 2")).count() == sum(apart) and [once.where("run = 2").count(), once.where("run = 1").count()] == apart[::-1]
    only = runs.committed(spark, path, SCHEMA, first=2, sources=["z"])
    assert [tuple(r) for r in only.collect()] == [(3, 3.0, 2, "z")] and only.rdd.getNumPartitions() == 1
    assert runs.committed(spark, path, SCHEMA, last=1, sources=[]).count() == 0
    assert sorted(map(tuple, runs.states(spark, path).collect())) == [(1, "completed", 2, 105), (2, "completed", 1, 1)]


# --- pages


def service(total, page, faults=()):
    """A made source of numbered rows; faults: {(query, page): what goes wrong}."""

    def ask(query, token):
        low, high = query
        at = token or 0
        wrong = dict(faults).get((query, at // page))
        if isinstance(wrong, Exception):
            raise wrong
        rows = [(i,) for i in range(low, min(high, total))][at : at + page]
        return paged.Answer([] if wrong == "empty" else rows, max(0, min(high, total) - low), at + page if at + page < high - low else None)

    return ask


def halves(query):
    low, high = query
    return None if high - low < 8 else ((low, (low + high) // 2), ((low + high) // 2, high))


def scanned(ask, queries, ceiling, page, budget):
    out = []
    for piece in paged.plan(queries, ask, halves, ceiling, page, budget):
        out += [(row and row[0], piece.number, outcome) for row, _, outcome, _ in paged.walk(piece, ask, ceiling, page)]
    return out


def test_a_scan_is_split_under_the_ceiling():
    got = scanned(service(64, 4), [(0, 64)], 16, 4, 1000)
    assert [r for r, _, _ in got] == list(range(64)) and {o for _, _, o in got} == {paged.OK} and max(p for _, p, _ in got) == 3


def test_every_way_of_lacking_rows_is_told():
    lacking = lambda got: [(p, o) for r, p, o in got if r is None]
    assert lacking(scanned(service(64, 2), [(0, 64)], 3, 2, 10_000)) == [(i, paged.OVER_CEILING) for i in range(16)]
    cut = scanned(service(64, 4), [(0, 64)], 16, 4, 7 + 5)
    assert lacking(cut) == [(1, paged.OUT_OF_BUDGET), (2, paged.OUT_OF_BUDGET), (3, paged.OUT_OF_BUDGET)] and len(cut) == 20 + 3
    assert lacking(scanned(service(64, 4), [(0, 64)], 16, 4, 2)) == [(0, paged.OUT_OF_BUDGET), (1, paged.OUT_OF_BUDGET), (2, paged.OUT_OF_BUDGET)]
    faults = {((0, 16), 2): ValueError("no"), ((16, 32), 1): "empty"}
    got = scanned(service(64, 4, faults), [(0, 64)], 16, 4, 1000)
    assert lacking(got) == [(0, paged.REFUSED), (1, paged.EMPTY_PAGE)] and [r for r, p, _ in got if p == 0 and r is not None] == list(range(8))
    shut = {((0, 8), 0): paged.Unavailable("later"), ((8, 16), 0): ValueError("broken")}
    assert lacking(scanned(service(16, 4, shut), [(0, 8), (8, 16)], None, 4, 100)) == [(0, paged.UNAVAILABLE), (1, paged.FAILED)]


def test_a_paged_source_is_read_by_pieces_and_reported(spark):
    paged.register(spark, "made_pages", "n long", [(0, 64)], service(64, 4, {((0, 16), 2): ValueError("no")}), halves, 16, 4, 1000)
    scan = spark.read.format("made_pages").load()
    assert scan.rdd.getNumPartitions() == 4
    assert sorted(r["n"] for r in paged.rows_of(scan).collect()) == [*range(8), *range(16, 64)]
    assert [tuple(r) for r in paged.report(scan).collect()] == [("ok", 56, True, paged.REFUSED)]
    paged.register(spark, "shut_pages", "n long", [(0, 8)], service(8, 4, {((0, 8), 0): paged.Unavailable("later")}), halves, None, 4, 100)
    assert [tuple(r) for r in paged.report(spark.read.format("shut_pages").load()).collect()] == [("unavailable", 0, False, "unavailable")]


# --- streams


def run_stream(spark, base, feeds, make, schema):
    """Feeds one part after another, restarting the query from its checkpoint each time; everything that came out."""
    for part in feeds:
        for name, (rows, kind) in part.items():
            spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{base}/{name}")
        out = make({name: spark.readStream.schema(kind).parquet(f"{base}/{name}") for name, (_, kind) in part.items()})
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out").collect()


def test_presence_stream_goes_on_and_repeats_change_nothing(spark, tmp_path):
    presence.use_state(spark)
    seen, ends = "entity string, run_seq int", "run_seq int, healthy boolean"
    first = {"seen": ([("a", 1), ("b", 1), ("a", 3), (None, 1)], seen), "ends": ([(1, True), (2, False), (3, True)], ends)}
    more = {"seen": ([("b", 4), ("b", 2), ("a", 5)], seen), "ends": ([(4, True), (5, None), (6, True)], ends)}
    make = lambda s: presence.presence_stream(s["seen"], s["ends"], buckets=3)
    got = run_stream(spark, str(tmp_path), [first, first, more, more], make, "entity string, run_seq bigint, event string")
    want = [("a", 4, "disappeared"), ("a", 5, "returned"), ("a", 6, "disappeared"), ("b", 3, "disappeared"), ("b", 4, "returned"), ("b", 6, "disappeared")]
    assert sorted(map(tuple, got)) == want
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 3), ("b", 4), ("a", 5), (None, 1)], seen)
    ladder = history.presence_events(rows, spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (5, False), (6, True)], ends))
    assert sorted(map(tuple, ladder.collect())) == want


def test_passes_stop_when_beats_stay_away(spark, tmp_path):
    presence.use_state(spark)
    kind = "pass_id string, at timestamp, finished boolean"
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, s // 60, s % 60)
    first = {"beats": ([("quiet", at(0), False), ("done", at(0), False), ("done", at(5), True), ("live", at(100), False)], kind)}
    second = {"beats": ([("live", at(200), False), ("other", at(290), False)], kind)}
    got = run_stream(spark, str(tmp_path), [first, second], lambda s: presence.stopped_passes(s["beats"]), "pass_id string, last_beat_ms bigint, state string")
    assert [(r["pass_id"], r["state"]) for r in got] == [("quiet", "stopped")]


def test_last_beats_keep_microseconds_and_odd_beats_do_not_stop_the_stream(spark, tmp_path):
    presence.use_state(spark)
    kind = "pass_id string, at timestamp, finished boolean"
    at = lambda s, us=0: datetime(2024, 1, 1, 0, s // 60, s % 60, us)
    beats = [("past", at(0, 1999), False), ("past", None, False), ("edge", at(0, 2000), False), ("never", None, None), ("done", at(0), False), ("done", None, True), (None, at(0), False), (None, at(120, 2999), False)]
    got = run_stream(spark, str(tmp_path), [{"beats": (beats, kind)}], lambda s: presence.stopped_passes(s["beats"]), "pass_id string, last_beat timestamp, last_beat_ms bigint, state string")
    told = [(r["pass_id"], r["last_beat"], r["last_beat_ms"] % 1000, r["state"]) for r in got]
    assert told == [("past", at(0, 1999), 1, "stopped")]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_stopped_passes_of_odd_events_match_sql(spark, tmp_path, zone):
    newest, limit = datetime(2024, 3, 12, 12, 0, 0, 123_500), timedelta(hours=49)
    near = [(newest - limit + timedelta(microseconds=us), user) for user, us in ((1, -1000), (2, -1), (3, 0), (5, 500), (6, -1001))]
    old = [(datetime(1969, 12, 31, 23, 59, 59, 999_999), 7), (datetime(1900, 1, 1), 9), (datetime(1970, 1, 1), 10), (datetime(2024, 3, 10, 2, 30, 0, 7), 11)]
    rows = [(newest, 4), *near, *old, (newest - 2 * limit, 13), (None, 13), (None, 14), (None, None), (newest - 3 * limit, None), (newest - 3 * limit, 16)]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = rows_of(QUERIES["stopped_passes"](spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = rows_of_sql(con, SQL["stopped_passes"])
    assert len(want[1]) > 5 and got == want


# --- history and criteria


def test_rows_without_a_source_or_an_entity_are_compared(spark):
    rows = [("a", 1, 1, "x", 1.0, [None]), ("a", 2, 2, "y", 1.0, [None]), (None, 1, 3, "x", 1.0, ["s"]), (None, 2, 4, "x", 1.0, ["s"]), ("b", 1, 5, "x", 1.0, [None]), ("b", 2, 6, "z", 1.0, ["s"])]
    healthy = spark.createDataFrame([(1, True), (2, True)], "run_seq int, healthy boolean")
    got = history.compare(snaps(spark, rows), healthy, 2, 1, ["status"]).collect()
    assert sorted((r["entity"], r["kind"]) for r in got) == [("a", "changed"), ("b", "unverified")]


KINDS = "t string, i int, d double, b boolean, day date"


@pytest.mark.parametrize(
    ("criterion", "told"),
    [
        (field("t").equals(1), "compares text with number"), (field("t") > "a", "orders numbers, not text"), (field("b") > field("b"), "orders numbers, not truth"), (field("nope").is_null(), "no column 'nope'; there are b, d, day, entity, i, t"),
        (field("i").one_of(), "empty list"), (field("i").one_of(1, "x"), "of one kind"), (field("t").one_of(1, 2), "text is never one of a list of number"), (field("i") + field("t") > 1, "+ takes a number, not text"),
        (-field("t") > 1, "- takes a number, not text"), (~field("i"), "not takes a truth, not number"), (field("b") & field("d"), "and takes a truth, not number"), (field("i") + 1, "asks for yes or no"), (field("day").equals("2024-01-01"), "compares date with text"),
    ],
)
def test_what_is_wrong_with_a_criterion_is_told_before_it_runs(spark, criterion, told):
    rows = spark.createDataFrame([], KINDS)
    with pytest.raises(ValueError) as e:
        evaluate(rows.withColumn("entity", F.lit(1)), [Rule("r", "flag", criterion)])
    assert told in str(e.value)


def test_fitting_kinds_and_bounded_minus(spark):
    rows = spark.createDataFrame([("a", -(2**31), 0.5, True, None)], KINDS).withColumn("entity", F.lit(1))
    fine = [(field("t").one_of("a", None)) | field("b"), field("i").equals(constant(None)), -field("i") > 2147483647, (field("d") > field("i")) & ~field("b").equals(False), field("day").is_null(), field("b")]
    assert all(criteria.complaints(c, rows.schema) == [] for c in fine)
    got = {r["rule_id"]: r["verdict"] for r in evaluate(rows, [Rule(str(i), "flag", c) for i, c in enumerate(fine)]).collect()}
    assert got == {"0": "fired", "1": "undetermined", "2": "fired", "3": "fired", "4": "fired", "5": "fired"}
