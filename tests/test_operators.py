"""Operators on small literal tables: the cases that the given tables don't hold."""

import hashlib
import math
import time
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo, text, values
from tidemark.functions.criteria import Rule, constant, evaluate, field
from tidemark.operators import enrich, history, identity, results, spatial
from tidemark.operators.extract import accept, claims, found, settle
from tidemark.plans.registry import QUERIES, SQL
from tidemark.sources import planning, tables


def one(spark, column, **given):
    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'double'}" for k, v in given.items()) or "_ int"
    return spark.createDataFrame([tuple(given.values()) or (0,)], schema).select(column.alias("x")).first()[0]


# history


def snaps(spark, rows):
    """Observations: a row for each of the sources named."""
    return spark.createDataFrame(rows, "entity string, run_seq int, event_id int, status string, price double, sources array<string>").withColumn("source", F.explode("sources")).drop("sources")


def outcomes(spark, rows):
    return history.healthy_runs(spark.createDataFrame(rows, "run_seq int, source string, outcome string, truncated boolean"))


OK = [(r, "a", "ok", False) for r in range(6)]


def kinds(spark, rows, target, baseline, runs=OK):
    got = history.compare(snaps(spark, rows), outcomes(spark, runs), target, baseline, ["status"])
    return {r["entity"]: r for r in got.collect()}


def test_compare_tells_each_kind_once(spark):
    rows = [
        ("same", 0, 1, "on", 5.0, ["a"]), ("same", 1, 2, "on", 5.0, ["a"]),
        ("moved", 0, 3, "on", 5.0, ["a"]), ("moved", 1, 4, "off", 4.0, ["a"]),
        ("fresh", 1, 5, "on", 1.0, ["a"]), ("lost", 0, 6, "on", 1.0, ["a"]),
        ("other", 0, 7, "on", 1.0, ["a"]), ("other", 1, 8, "off", 1.0, ["b"]),
    ]
    got = kinds(spark, rows, 1, 0)
    assert {k: r["kind"] for k, r in got.items()} == {"same": "unchanged", "moved": "changed", "fresh": "new", "lost": "gone", "other": "unverified"}
    assert [tuple(c) for c in got["moved"]["changes"]] == [("status", "on", "off")] and got["moved"]["price_direction"] == "down"


def test_missing_is_no_evidence_unless_every_source_was_whole(spark):
    rows = [("lost", 0, 1, "on", 1.0, ["a"]), ("x", 1, 2, "on", 1.0, ["a"])]
    for bad in [("failed", False), ("unavailable", False), ("ok", True)]:
        runs = [(0, "a", "ok", False), (1, "a", "ok", False), (1, "b", *bad)]
        assert "lost" not in kinds(spark, rows, 1, 0, runs)
    assert "lost" not in kinds(spark, rows, 1, 0, [(0, "a", "ok", False)])  # no source at all


def test_returned_and_not_gone_twice(spark):
    rows = [("back", 0, 1, "on", 1.0, ["a"]), ("back", 2, 2, "on", 1.0, ["a"]), ("lost", 0, 3, "on", 1.0, ["a"]), ("x", 1, 4, "on", 1.0, ["a"])]
    got = kinds(spark, rows, 2, 1)
    assert got["back"]["kind"] == "returned" and "lost" not in got


def test_price_that_was_unknown_has_no_direction(spark):
    got = kinds(spark, [("a", 0, 1, "on", None, ["a"]), ("a", 1, 2, "on", 3.0, ["a"])], 1, 0)
    assert got["a"]["price_direction"] is None and got["a"]["price_amount"] is None


def test_compare_reads_the_rows_of_a_source_that_both_sides_share(spark):
    rows = [("e", 0, 1, "on", 5.0, ["a"]), ("e", 0, 2, "sold", 9.0, ["b"]), ("e", 1, 3, "off", 1.0, ["c"]), ("e", 1, 4, "sold", 7.0, ["b"]), ("f", 0, 5, "on", 5.0, ["b"]), ("f", 1, 6, "off", 8.0, ["b"])]
    got = kinds(spark, rows, 1, 0)
    assert got["e"]["kind"] == "unchanged" and got["e"]["price_amount"] is None  # only a changed entity tells its price
    assert (got["f"]["kind"], got["f"]["price_amount"], got["f"]["price_direction"]) == ("changed", 3.0, "up")


def test_without_a_baseline_all_is_new_or_nothing_is_told(spark):
    rows = snaps(spark, [("e", 1, 1, "on", 5.0, ["a"])])
    assert [r["kind"] for r in history.compare(rows, outcomes(spark, OK), 1, None, ["status"]).collect()] == ["new"]
    assert history.compare(rows, outcomes(spark, OK), 1, None, ["status"], reset=True).count() == 0


def test_merge_ladder(spark):
    cases = [
        ("agreed", "disagreed", "disagreed", True, "matched"), ("disagreed", "agreed", "agreed", False, "distinct"), ("unknown", "disagreed", "agreed", True, "distinct"),
        ("unknown", "disagreed", "agreed", False, "unrelated"), ("unknown", "agreed", "disagreed", False, "ambiguous"), ("unknown", "agreed", "unknown", False, "matched"),
        ("unknown", "agreed", "agreed", False, "matched"), ("unknown", "unknown", "agreed", False, "ambiguous"), ("unknown", "unknown", "unknown", False, "unrelated"),
    ]
    got = identity.decide(spark.createDataFrame(cases, "parcel string, address string, place string, units_differ boolean, want string"))
    assert all(r["decision"] == r["want"] for r in got.collect())


def test_a_unit_on_one_side_is_a_question(spark):
    rows = spark.createDataFrame([(1, None, "s|", "s", None, 40.0001, -100.0), (2, None, "s|4", "s", "4", 40.0001, -100.0), (3, None, "s|5", "s", "5", 40.0001, -100.0)], "id long, parcel string, address_key string, bare_key string, unit string, latitude double, longitude double")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    got = {(r["a"], r["b"]): r for r in identity.decide(identity.pair_signals(pairs, rows)).collect()}
    assert got[1, 2]["decision"] == "ambiguous" and "unit on one side" in got[1, 2]["unknown"] and got[2, 3]["decision"] == "distinct"


def test_incomplete_group_is_one_question_and_merges_can_be_taken_back(spark):
    rows = [(1, 2, "matched"), (2, 3, "matched"), (1, 3, "distinct"), (5, 6, "matched"), (6, 7, "ambiguous"), (8, 9, "ambiguous")]
    decided = spark.createDataFrame(rows, "a long, b long, decision string").withColumn("parcel", F.lit("unknown")).withColumn("by_person", F.lit(False))
    merges, questions = identity.merge_pass(decided)
    assert [r["members"] for r in merges.collect()] == [[5, 6]]
    assert sorted(r["members"] for r in questions.collect()) == [[1, 2, 3], [8, 9]]
    edges = identity.merge_edges(merges, 1)
    new = edges.first()["superseded_by"]
    back = edges.unionByName(identity.unmerge_edges(edges, new, 2))
    assert {r["id"]: r["superseded_by"] for r in identity.current_edges(back).collect()} == {"5": None, "6": None}


def test_close_points_share_a_cell(spark):
    for y, x in [(40.00049, -100.00051), (39.9995, -99.9995), (0.0004, 10.00149)]:
        for dy, dx in [(0.0002, 0.0003), (-0.0003, 0.0002), (0.0004, -0.0004)]:
            cells = lambda a, b: set(one(spark, geo.cells(F.lit(a), F.lit(b))))
            assert cells(y, x) & cells(y + dy, x + dx)


def test_deep_criteria_are_planned_in_proportion(spark):
    c = field("a")
    for k in range(32):
        c = (c + 1) * 1.0 if k % 2 else c - field("a")
    assert verdict(spark, c.equals(c), a=2.0)[0] == "fired"
    plan = evaluate(spark.createDataFrame([("e", 1.0)], "entity string, a double"), [Rule("r", "flag", c > 0)])._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000


def test_nan_equals_nothing(spark):
    nan = float("nan")
    assert verdict(spark, field("a").equals(field("a")), a=nan)[0] == "not-fired" and verdict(spark, field("a").differs(1.0), a=nan)[0] == "fired"
    assert verdict(spark, field("a").equals(field("u")), a=nan, u=None)[0] == "undetermined" and verdict(spark, field("s").equals("it's \\ so"), s="it's \\ so")[0] == "fired"


def test_kind_counts_fill_zeros(spark):
    events = spark.createDataFrame([("new",), ("new",)], "kind string")
    assert {r["kind"]: r["n"] for r in history.kind_counts(events, ["new", "gone"]).collect()} == {"new": 2, "gone": 0}


def test_running_is_told_by_beats(spark):
    rows = spark.sql("select 1 as id, timestamp_ntz '2024-01-01 00:00:00' as updated_at, cast(null as timestamp_ntz) as finished_at")
    at = lambda s: F.lit(f"2024-01-01 00:{s}").cast("timestamp_ntz")
    assert history.running(rows, at("02:00")).first()["state"] == "running"
    assert history.running(rows, at("02:01")).first()["state"] == "stopped"


# identity


def test_closure_of_chains_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, None), (7, 8), (8, 7), (9, None)], "id long, superseded_by long")
    got = dict(identity.closure(edges).collect())
    assert got == {1: 3, 2: 3, 3: 3, 7: 7, 8: 7, 9: 9}


def test_long_chain(spark):
    edges = spark.range(1, 300).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("superseded_by"))
    assert identity.closure(edges).where("live <> 1").count() == 0


def test_components_do_not_depend_on_order(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101)]
    for p in (pairs, [(b, a) for a, b in reversed(pairs)]):
        got = dict(identity.connected_components(spark.createDataFrame(p, "a long, b long")).collect())
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_group_with_an_unmatched_pair_is_not_complete(spark):
    matched = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    groups = identity.complete_groups(matched, identity.connected_components(matched))
    assert {r["component"]: r["complete"] for r in groups.collect()} == {1: False, 5: True}


# criteria


def verdict(spark, criterion, **given):
    kinds = {k: ("double" if v is None or isinstance(v, float) else "bigint" if isinstance(v, int) else "string") for k, v in given.items()}
    row = spark.createDataFrame([("e", *given.values())], "entity string, " + ", ".join(f"{k} {t}" for k, t in kinds.items()))
    r = evaluate(row, [Rule("r", "flag", criterion)]).first()
    return r["verdict"], r["missing"]


def test_three_valued_logic(spark):
    yes, no, unknown = field("a").equals(1), field("a").equals(2), field("u").equals(1)
    table = [
        (yes & yes, "fired"), (yes & no, "not-fired"), (yes & unknown, "undetermined"), (no & unknown, "not-fired"), (unknown & unknown, "undetermined"),
        (yes | unknown, "fired"), (no | unknown, "undetermined"), (no | no, "not-fired"), (~unknown, "undetermined"), (~no, "fired"),
    ]
    for c, want in table:
        got, missing = verdict(spark, c, a=1, u=None)
        assert got == want and missing == (["u"] if want == "undetermined" else [])


def test_unknown_arithmetic(spark):
    assert verdict(spark, field("a") / field("z") > 1, a=1, z=0) == ("undetermined", [])
    assert verdict(spark, field("a") * 1e15 > 1, a=5) == ("undetermined", [])
    assert verdict(spark, (field("a") / field("z")).is_null(), a=1, z=0) == ("fired", [])
    assert verdict(spark, field("n") > 1, n=math.nan)[0] == "not-fired"
    assert verdict(spark, field("a") + field("u") > 1, a=1, u=None) == ("undetermined", ["u"])


def test_membership_with_an_unknown_option(spark):
    assert verdict(spark, field("a").one_of(1, field("u")), a=1, u=None) == ("undetermined", ["u"])
    assert verdict(spark, field("a").one_of(1, constant(2)), a=1)[0] == "fired"


def test_rule_ids_must_differ(spark):
    with pytest.raises(ValueError):
        evaluate(spark.range(1), [Rule("r", "flag", constant(True))] * 2, "id")


# space


def test_points_that_are_no_place(spark):
    for lat, lon, want in [(0.0, 0.0, False), (34.0, -103.0, False), (91.0, 1.5, False), (34.18, -103.33, True)]:
        assert one(spark, geo.known_point(F.col("a"), F.col("b")), a=lat, b=lon) is want
    assert one(spark, geo.known_point(F.col("a"), F.col("b")), a=None, b=1.5) is False


def test_distance_joins_find_every_pair(spark):
    import random

    rng = random.Random(5)
    points = [(i, rng.uniform(50, 52), rng.uniform(5, 8)) for i in range(150)]
    sites = [(i, rng.uniform(50, 52), rng.uniform(5, 8)) for i in range(40)]

    def miles(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.MILES_ROUND * math.asin(math.sqrt(h))

    got = spatial.within(spark.createDataFrame(points, "id int, latitude double, longitude double"), spark.createDataFrame(sites, "site int, latitude double, longitude double"), 20.0)
    assert {(r["id"], r["site"]) for r in got.collect()} == {(a[0], b[0]) for a in points for b in sites if miles(a, b) <= 20}


def test_nearest_line(spark):
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(-1.0, 10.0), (1.0, 10.0)]])
    assert abs(one(spark, geo.miles_to_line(F.col("a"), F.col("b"), line), a=11.0, b=0.3) - math.radians(1) * geo.MILES) < 1e-6


def test_exclusion_needs_evidence(spark):
    where = spatial.where_is(F.col("a"), F.col("a"), [F.col("a") > 0], [F.col("b") > 0])
    assert one(spark, where, a=1.0, b=None) == "inside" and one(spark, where, a=None, b=1.0) == "outside" and one(spark, where, a=None, b=None) == "unlocatable"


def test_box_halves():
    assert geo.halves((0, 0, 4, 2)) == [(0, 0, 2, 2), (2, 0, 4, 2)] and geo.halves((0, 60, 3, 62)) == [(0, 60, 3, 61), (0, 61, 3, 62)]


# text and values


def test_address_forms(spark):
    assert one(spark, text.unit_form(F.col("x")), x="Apt. # 4B") == "4b" and one(spark, text.unit_form(F.col("x")), x="Unit") is None
    assert one(spark, text.address_line(F.col("a"), F.col("b")), a="12 Elm St Apt 4", b="#4") == "12 Elm St Apt 4"
    assert one(spark, text.address_line(F.col("a"), F.col("b")), a="12 Elm St", b="B") == "12 Elm St B"
    assert one(spark, text.parcel_form(F.col("x")), x="1-2.3") is None and one(spark, text.parcel_form(F.col("x")), x="R 12-34") == "r1234"


def test_sheet_cells(spark):
    assert one(spark, text.sheet_cell(F.col("x")), x=" =1+1") == "' =1+1" and one(spark, text.sheet_cell(F.col("x")), x="a\x07b") == "ab"
    assert len(one(spark, text.sheet_cell(F.col("x")), x="x" * 40000)) == text.CELL_LIMIT


def test_sheet_cells_of_whole_texts(spark, tmp_path):
    body = ["word " * 40 + "\x07end", "é" * 32_766, "é" * 32_767, "é" * 32_768, "x" * 40_000, "\x00" * 50 + "y" * 32_767, "line\tone\nline\x1ftwo" * 30, "+1" + "z" * 32_766, ""]
    texts = [x for x in body for _ in range(3)]  # each meets every kind of start
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def cell(i, x):
        x = "".join(c for c in ("=", " -", "")[i % 3] + x if c >= " " or c in "\t\n\r")
        x = "'" + x if x.lstrip(" ")[:1] in tuple("=+@-") else x
        return x if len(x) <= 32_767 else x[: 32_767 - len(text.CELL_MARK)] + text.CELL_MARK

    want = {(i, hashlib.sha256(cell(i, x).encode()).hexdigest()) for i, x in enumerate(texts)}
    assert {tuple(r) for r in QUERIES["sheet_cells"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert set(con.sql(SQL["sheet_cells"]).fetchall()) == want


def test_digests_are_of_whole_texts_unless_bounded(spark, tmp_path):
    long = "é" * text.READ_LIMIT
    spark.createDataFrame([(3, long + "a"), (4, long + "b"), (5, long + "b"), (6, "x"), (7, "x")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {tuple(r) for r in QUERIES["text_digests"](spark, str(tmp_path)).collect()} == {(3, sha(long + "a")), (4, sha(long + "b")), (5, sha(long + "b")), (6, sha("x")), (7, sha("x"))}
    assert [(r["digest"], r["id"]) for r in QUERIES["unanswered_texts"](spark, str(tmp_path)).select("digest", "id").collect()] == [(sha(long + "b"), 4)]
    assert one(spark, text.digest(F.col("x"), text.READ_LIMIT), x=long + "a") == sha(long)


def test_units_and_sums(spark):
    assert one(spark, values.to_square_feet(F.col("a"), F.lit("Acres")), a=0.5) == 21780
    with pytest.raises(Exception, match="unknown unit"):
        one(spark, values.to_square_feet(F.col("a"), F.lit("hectares")), a=0.5)
    assert one(spark, values.weighted_sum({"a": 1.0, "b": 0.5}), a=2, b=1) == 2.5 and one(spark, values.weighted_sum({"a": 1.0}), a=None) is None


def test_rounding_of_ties_and_real_quotients(spark):
    exact = lambda x, to: float(Decimal(repr(x)).quantize(Decimal(to), ROUND_HALF_UP))
    pairs = [(p / 100, a) for p in (1, 5, 201, 2010, 57, -1005, 100001, 99999999) for a in (1, 2, 3, 4, 7, 24)] + [(1.0, None), (None, 1), (1.0, 0)]
    got = spark.createDataFrame(pairs, "p double, a int").select(values.price_per_area(F.col("p"), F.col("a"))).collect()
    assert [r[0] for r in got] == [exact(p / a, "0.01") if p and a else None for p, a in pairs]
    sizes = [0.5, 1.5, 2.5, 3.49, 1000.5]
    got = spark.createDataFrame([(x,) for x in sizes], "x double").select(values.to_square_feet(F.col("x"), F.lit("sqft"))).collect()
    assert [r[0] for r in got] == [exact(x, "1") for x in sizes]
    degrees = [11.25 * k for k in range(33)]
    got = spark.createDataFrame([(x,) for x in degrees], "x double").select(text.wind_name(F.col("x"))).collect()
    assert [r[0] for r in got] == [text.WINDS[int(x / 22.5 + 0.5) % 16] for x in degrees]


@pytest.mark.parametrize("name,of", [("pair_keys", "lineitem"), ("price_per_area", "orders"), ("table_export", "customer"), ("areas", "part"), ("wind_names", "customer")])
def test_queries_answer_for_every_row(spark, small, name, of):
    assert QUERIES[name](spark, small).count() == spark.read.parquet(f"{small}/{of}.parquet").count()


def test_floor_days_are_elapsed_days(spark):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, values.floor_days(at("2024-01-01 23:00:00"), at("2024-01-03 22:00:00"))) == 1
    assert one(spark, values.floor_days(at("2024-01-03 23:00:00"), at("2024-01-01 22:00:00"))) == 0


def said(spark, texts, *more, limit=4_000):
    """What each text claims, as pairs of field and value."""
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {i: set() for i in range(len(texts))}
    for r in found(rows, *more, limit=limit).collect():
        got[r["id"]].add((r["field"], r["value"]))
    return [got[i] for i in range(len(texts))]


def test_a_stated_fact_is_recovered(spark):
    stated = {
        "Has a private well and septic.": {("water_source", "well"), ("sewer", "septic")},
        "The barn keeps its own deep well.": {("water_source", "well")},
        "Served by 12 GPM wells with two tanks": {("water_source", "well")},
        "Irrigation well.": {("water_source", "irrigation")},
        "We drink from a cistern; lagoon behind": {("water_source", "cistern"), ("sewer", "lagoon")},
        "On coop water and municipal sewer": {("water_source", "co-op"), ("sewer", "city")},
        "mini split": {("heating", "mini-split"), ("cooling", "mini-split")},
        "a mini-split a/c": {("cooling", "mini-split")},
        "forced central heat/air": {("heating", "central"), ("cooling", "central")},
        "Central  heating\nand cooling": {("heating", "central"), ("cooling", "central")},
        "with central air conditioning": {("cooling", "central")},
        "Warm radiant in-floor heating": {("heating", "radiant")},
        "radiant baseboard heating": {("heating", "baseboard")},
        "a wood burning stove": {("heating", "wood stove")},
        "EPDM on the porch": {("roof", "flat")},
        "a standing seam roof over the shop": {("roof", "metal")},
        "concrete tile roofs, spray foam roof": {("roof", "tile"), ("roof", "foam")},
        "a new roof": set(),
    }
    assert said(spark, list(stated)) == list(stated.values())


def test_the_adverb_is_no_source_of_water(spark):
    texts = ["a well-tended garden", "kept as well as new", "The yard is well laid out", "rooms that are well lit", "windows work as well.", "our well watered lawn", "a well kept shed", "well beyond the fence", "welll, swell"]
    assert said(spark, texts) == [set()] * len(texts)


def test_a_possibility_is_not_a_fact(spark):
    texts = [
        "Well, power and septic needed.", "Sewer and propane are nearby", "Town water is available", "A well water system could be added", "city water extends past the gate", "city water line some 400 feet off",
        "a corner with venting for a pellet stove", "roughed in for a boiler", "septic to be installed",
    ]
    assert said(spark, texts) == [set()] * len(texts)


def test_a_stated_absence_is_a_value(spark):
    stated = {
        "The butane tank was removed.": {("gas", "none")},
        "an all-electric place-no propane required": {("gas", "none")},
        "It does not have a water well": {("water_source", "none")},
        "Studio (no permanent heat source)": {("heating", "none")},
        "Septic is not working": {("sewer", "none")},
        "No septic here. City sewer.": {("sewer", "none"), ("sewer", "city")},
        "no, septic tank": {("sewer", "septic")},
        "not much of a long way to the septic": {("sewer", "septic")},
        "lacks no sewer": set(),
        "There is a septic system. City water is available.": {("sewer", "septic")},
        "septic septic septic septic septic septic septic septic septic septic septic planned": {("sewer", "septic")},
        "": set(),
    }
    assert said(spark, list(stated)) == list(stated.values())


def test_claims_carry_their_phrase_and_conflicts_are_no_value(spark):
    one_line = found(spark.createDataFrame([("a", " A\n\nrural  water. No roof")], "id string, text string")).collect()
    assert [tuple(r) for r in one_line] == [("a", "water_source", "co-op", "rural water", "a rural water.")]
    rows = spark.createDataFrame([(1, "city water; private well."), (2, None), (3, "septic system"), (4, "x" * 4_000 + " septic")], "id long, text string")
    got = {(r["id"], r["field"]): (r["value"], r["conflict"]) for r in claims(rows).collect()}
    assert got == {(1, "water_source"): (None, True), (3, "sewer"): ("septic", False)}
    assert claims(rows, limit=None).where("id = 4").count() == 1 and claims(rows.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_an_automaton_of_thousands_of_phrases_is_plain_search(seed):
    import random
    import re

    from tidemark.operators.vocabulary import Automaton

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab-") for _ in range(rng.randint(1, 3)))
    known = list({(" ".join(word() for _ in range(rng.randint(1, 3))), rng.choice("xyz"), rng.choice("uv"), None) for _ in range(4000)})
    automaton = Automaton(known)
    for _ in range(40):
        sentence = " ".join(word() for _ in range(rng.randint(0, 25)))
        want = []
        for field in automaton.fields:
            hits = sorted({(m.start(), -m.start() - len(p), v) for p, f, v, _ in known if f == field for m in re.finditer(rf"(?={re.escape(p)})", sentence) if _whole(sentence, m.start(), m.start() + len(p))})
            free = 0
            for start, end, value in hits:
                if start >= free:
                    free = -end
                    want.append((field, value, start, -end))
        assert [(c.field, c.value, c.start, c.end) for c in automaton.claims(sentence)] == want


def _whole(s, a, b):
    inner = str.isalnum
    return not (a and inner(s[a - 1]) and inner(s[a]) or b < len(s) and inner(s[b]) and inner(s[b - 1]))


def test_templates_are_expanded():
    from tidemark.operators.vocabulary import VOCABULARY, expanded, phrases

    assert expanded("a|b c? d~e") == ["a c d-e", "a c d e", "a c de", "a d-e", "a d e", "a de", "b c d-e", "b c d e", "b c de", "b d-e", "b d e", "b de"]
    assert len(phrases(VOCABULARY)) > 250 and "central heat/air" in {p for p, f, _, _ in phrases(VOCABULARY) if f == "cooling"}


def test_answers_need_their_quote(spark):
    rows = spark.createDataFrame([("There is NO  well", "none", "no well"), ("a well", "none", "a well"), ("a well", "well", "two wells")], "text string, value string, quote string")
    got = accept(rows.withColumn("options", F.array(F.lit("none"), F.lit("well")))).select("accepted").collect()
    assert [r[0] for r in got] == [True, False, False]


def test_precedence(spark):
    rows = spark.createDataFrame([("s", "p", False, "m"), (None, "p", False, "m"), (None, None, True, "m"), (None, None, False, "m"), (None, None, False, None)], "source_value string, pattern_value string, conflict boolean, model_value string")
    assert [(r["value"], r["origin"]) for r in settle(rows).collect()] == [("s", "source"), ("p", "pattern"), (None, "conflict"), ("m", "model"), (None, "undetermined")]


# caches and results


def test_cache_tells_missing_from_null_and_stale(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    cache = spark.sql("select * from values (1L, 'z', 'x', timestamp_ntz '2024-01-10'), (2L, 'z', cast(null as string), timestamp_ntz '2024-01-10'), (3L, 'z', 'old', timestamp_ntz '2023-01-01') as t(k, name, value, fetched_at)")
    now = F.lit("2024-01-11").cast("timestamp_ntz")
    got = {r["k"]: (r["z_value"], r["z_status"]) for r in enrich.attach_cached(rows, cache, "k", ["z"], now, F.lit(30)).collect()}
    assert got == {1: ("x", "fresh"), 2: (None, "fresh"), 3: ("old", "stale"), 4: (None, "missing")}
    assert all(r["z_status"] != "stale" for r in enrich.attach_cached(rows, cache, "k", ["z"], now, F.lit(None).cast("int")).collect())


def test_nulls_sort_last_both_ways(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 1), (4, 5)], "id long, x long")
    assert [r["id"] for r in results.order_by(rows, "x", True, ["id"]).collect()] == [2, 4, 3, 1]
    assert [r["id"] for r in results.order_by(rows, "x", False, ["id"]).collect()] == [3, 2, 4, 1]


# tables


def test_append_replace_and_csv(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "run int, x string")
    tables.append(df, path, "run")
    tables.replace_partitions(spark.createDataFrame([(2, "c")], "run int, x string"), path, "run")
    assert sorted(map(tuple, spark.read.schema("x string, run int").parquet(path).collect())) == [("a", 1), ("c", 2)]
    out = str(tmp_path / "csv")
    tables.write_csv(spark.createDataFrame([("=1",)], "x string"), out, text.sheet_cell)
    assert tables.read_csv(spark, out, spark.createDataFrame([], "x string").schema, ["x"]).first()[0] == "'=1"
    with pytest.raises(ValueError, match="missing"):
        tables.read_csv(spark, out, spark.createDataFrame([], "y string").schema, ["y"])


def test_page_repeats(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 2)], "k string, page int")
    assert sorted((r["k"] or "", r["page"]) for r in tables.page_dedupe(rows, "k", "page").collect()) == [("", 1), ("", 2), ("a", 1), ("a", 1)]


def test_streamed_runs(spark, tmp_path):
    from tidemark.streaming.batches import write_snapshots

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", 1, 1.0), ("a", 2, 2.0)], [("a", 3, 3.0), ("b", 4, 4.0)]):
        spark.createDataFrame(rows, "entity string, ord int, price double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("entity string, ord int, price double").parquet(source)
        write_snapshots(stream, out, str(tmp_path / "cp"), ["entity"], ["ord"]).awaitTermination()
    got = spark.read.schema("entity string, ord int, price double, run_seq int").parquet(out).collect()
    assert sorted((r["run_seq"], r["entity"], r["ord"]) for r in got) == [(0, "a", 1), (1, "a", 3), (1, "b", 4)]


# planning and passes


def test_filters_are_split_and_checked(spark):
    asked = {"price": planning.Range(100, 200), "property_type": ["house"], "listed_within_days": 7}
    taken, left = planning.split_filters(asked, ["price"])
    assert set(taken) == {"price"} and set(left) == {"property_type"}
    rows = spark.createDataFrame([(1, "house"), (2, "barn"), (3, None)], "id long, property_type string")
    assert [r["id"] for r in rows.where(planning.residual(left)).collect()] == [1, 3]
    with pytest.raises(ValueError, match="unknown filter colour"):
        planning.check_filters({"colour": 1})
    for low, high in [(2, 1), (-1, None), (math.nan, None)]:
        with pytest.raises(ValueError):
            planning.Range(low, high)


def test_boxes_hold_no_more_than_the_ceiling(spark):
    import random

    rng = random.Random(3)
    points = [(rng.uniform(0, 8), rng.uniform(0, 8)) for _ in range(200)] + [(1.0, 1.0)] * 30
    rows = spark.createDataFrame(points, "latitude double, longitude double")
    boxes = planning.split_by_ceiling(rows, (0.0, 0.0, 8.0, 8.0), 40)
    assert sum(n for _, n, _ in boxes) == 230 and all(n <= 40 and not over for _, n, over in boxes)
    stuck = planning.split_by_ceiling(rows, (0.0, 0.0, 8.0, 8.0), 20, depth=5)
    assert sum(n for _, n, _ in stuck) == 230 and [over for _, n, over in stuck if n > 20] == [True]


def test_circles_cover():
    import random

    rng = random.Random(1)
    circles = planning.cover_circle(40.0, -100.0, 120.0, 50.0)
    assert all(m <= 50 for _, _, m in circles)

    def miles(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * geo.MILES * math.asin(math.sqrt(h))

    for _ in range(500):
        p = (rng.uniform(38, 42), rng.uniform(-103, -97))
        if miles(p, (40.0, -100.0)) <= 120:
            assert any(miles(p, c[:2]) <= c[2] for c in circles)


def test_date_ranges():
    assert planning.split_dates(1, 10, 3) == [(1, 3), (4, 6), (7, 10)] and planning.split_dates(5, 5, 4) == [(5, 5)]


# addresses, shapes and sources


@pytest.mark.parametrize(
    ("line", "number", "street", "unit"),
    [
        ("12 Fennel Ave", "12", "fennel", None), ("12 N. Fennel St #B", "12", "fennel", "b"), ("7 Marigold Parkway Dr", "7", "marigold", None), ("7 Marigold Pky", "7", "marigold", None),
        ("99 KS Highway 58", "99", "ks 58", None), ("99 KS 58", "99", "ks 58", None), ("5 Ave N", "5", "ave n", None), ("5 Highway 71 N", "5", "hwy 71", None),
        ("5 Hwy 71 Hwy", "5", "hwy 71", None), ("0 Fennel Ave", None, "fennel", None), ("Tract 9 Lot 14", None, None, None), ("118 Juniper Loop #Lot 6", "118", "juniper", "lot 6"), ("1309c Tansy", "1309c", "tansy", None),
        ("8 Quince Circ", "8", "quince", None), ("8 Deer Path", "8", "deer", None), ("8 Unassigned Acreage", "8", None, None), ("9 Path", "9", "path", None),
    ],
)
def test_addresses_are_parsed(spark, line, number, street, unit):
    from tidemark.functions.address import parsed

    got = one(spark, parsed(F.col("x"), F.lit(None).cast("string"), F.lit("88001-1")), x=line)
    assert (got["number"], got["street"], got["unit"], got["postal"]) == (number, street, unit, "88001")


def test_pairs_across_the_date_line_and_the_poles(spark):
    points = spark.createDataFrame([(1, 10.0, 179.99), (2, 89.95, 0.0), (3, -89.99, 90.0), (4, 60.0, -179.8), (5, 0.0, 0.0)], "id long, latitude double, longitude double")
    sites = spark.createDataFrame([(1, 10.0, -179.99), (2, 89.95, 170.0), (3, -89.99, -90.0), (4, 60.0, 179.9), (5, 0.2, 0.2)], "site long, latitude double, longitude double")
    for miles in (25.0, 300.0):
        got = {(r["id"], r["site"]) for r in spatial.within(points, sites, miles).collect()}
        assert {(i, i) for i in range(1, 6)} <= got
    assert {(r["id"], r["site"]) for r in spatial.within(points, sites, 25.0).collect()} == {(i, i) for i in range(1, 6)}


def test_distance_join_against_every_pair(spark):
    import random

    rng = random.Random(4)
    spot = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    ps, ss = [spot() for _ in range(150)], [spot() for _ in range(150)]
    ps += [(89.9 - k / 50, k * 11.0 - 180) for k in range(20)]
    ss += [(89.9 - k / 40, k * 17.0 - 180) for k in range(20)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(ps)], "id long, latitude double, longitude double")
    sites = spark.createDataFrame([(i, *p) for i, p in enumerate(ss)], "site long, latitude double, longitude double")

    def apart(a, b):
        h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * geo.MILES_ROUND * math.asin(min(1, math.sqrt(h)))

    for miles in (60.0, 700.0, 5000.0):
        want = {(i, j) for i, a in enumerate(ps) for j, b in enumerate(ss) if apart(a, b) <= miles}
        assert {(r["id"], r["site"]) for r in spatial.within(points, sites, miles).collect()} == want


def test_geojson_of_every_form(spark):
    ring = "[[0,0],[4,0],[4,4],[0,4],[0,0]]"
    forms = ['{"type":"Polygon","coordinates":[%s]}', '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[%s]}}', '{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[%s]}}]}']
    assert all(len(one(spark, geo.rings_of_geojson(F.col("g")), g=f % ring)) == 1 for f in forms)
    two = '{"type":"FeatureCollection","features":[{"geometry":{"type":"Polygon","coordinates":[%s]}},{"geometry":null}]}' % ring
    assert one(spark, geo.rings_of_geojson(F.col("g")), g=two) is None and one(spark, geo.rings_of_geojson(F.col("g")), g='{"type":"Point","coordinates":[1,2]}') is None


def test_a_source_that_is_asked_for_less_and_a_page_that_fails(spark, tmp_path):
    from tidemark.sources import connector

    log = str(tmp_path / "asked")

    def fetch(page, filters):
        with open(f"{log}-{page}", "w") as f:
            f.write(repr(filters))
        if page == "bad":
            yield 9, 9.0
            raise ValueError("no such page")
        if page == "shut":
            raise connector.Unavailable("try later")
        low = max([value for sign, column, value in filters if column == "price" and sign == ">"], default=0)
        yield from ((i, float(i)) for i in range(10) if i > low)

    connector.register(spark, "shop", "id long, price double", ["good", "bad", "shut"], fetch, pushes=("price",))
    scan = spark.read.format("shop").load()
    assert sorted((r["page"], r["outcome"], r["rows"]) for r in connector.outcomes(scan).collect()) == [("bad", "failed", 1), ("good", "ok", 9), ("shut", "unavailable", 0)]
    dear = connector.asked(spark, "shop", (">", "price", 6.0), ("<", "id", 9))
    assert sorted(r["id"] for r in dear.where("_outcome = 'ok'").collect()) == [7, 8]
    assert open(f"{log}-good").read() == "[('>', 'price', 6.0)]"  # of the columns that the source bounds
    assert sorted(r["_outcome"] for r in dear.where("_outcome <> 'ok'").collect()) == ["failed", "unavailable"]
    # uses of one scan don't see each other's filters, in one query or after another
    assert scan.where("price > 6").select("id").unionByName(scan.select("id").where("id IS NOT NULL")).count() == 4 + 10
    assert scan.where("price > 8").count() == 2 and scan.where("_outcome = 'ok'").count() == 10
    with pytest.raises(ValueError, match="can't be asked"):
        connector.asked(spark, "shop", ("like", "price", 6.0))


def test_outer_edges_belong_to_a_box(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (4.0, 4.0), (4.0, 1.0), (2.0, 2.0)], "latitude double, longitude double")
    assert sum(n for _, n, _ in planning.split_by_ceiling(rows, (0.0, 0.0, 4.0, 4.0), 1)) == 4


def test_windows_are_bounded(spark):
    rows = spark.sql("select date '2024-03-01' as day, true as e union all select date '2024-02-17', false union all select date '2024-02-10', false")
    assert values.date_window(rows, "day", "e").count() == 2 and values.date_window(rows, "day", "e", "2024-02-01", "2024-02-20").count() == 2
    for start, end in (("2023-01-01", "2024-03-01"), ("2024-03-02", "2024-03-01")):
        with pytest.raises(ValueError):
            values.date_window(rows, "day", "e", start, end)


def test_an_exported_ratio_of_nothing_is_zero(spark, tmp_path):
    at = f"{tmp_path}/customer.parquet"
    duckdb.sql(f"COPY (SELECT * FROM (VALUES (1, 'a', 's', 0.0::DOUBLE, 3), (2, 'b', 's', 0.0::DOUBLE, 0), (3, 'c', 's', -0.05::DOUBLE, 24), (4, 'd', 's', NULL, 2), (5, 'e', 's', 5.03::DOUBLE, 2)) x(c_custkey, c_name, c_mktsegment, c_acctbal, c_nationkey)) TO '{at}'")
    got = {r["id"]: r["ratio"] for r in QUERIES["table_export"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{at}'")
    assert got == {r[0]: r[2] for r in con.sql(SQL["table_export"]).fetchall()} == {1: 0.0, 2: None, 3: 0.0, 4: None, 5: 2.52}


def crowd(spark, name, n, latitude):
    return spark.range(n).select(F.col("id").alias(name), F.lit(latitude).alias("latitude"), F.lit(-101.0).alias("longitude"), (F.col("id") % 2).alias("kind"))


def test_pairs_of_crowds_are_told_by_place(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PLACE_ROWS", 16)
    monkeypatch.setattr(spatial, "CELL_POINTS", 32)
    points, sites = crowd(spark, "id", 100, 31.0).unionByName(crowd(spark, "id", 1, None)), crowd(spark, "site", 50, 31.1).unionByName(crowd(spark, "site", 1, float("nan")))
    got = spatial.within(points, sites, 25.0, keep=["kind"], told=F.when(F.col("kind") == 0, F.round("miles", 1)).otherwise(F.round("miles", 0))).collect()
    assert sorted(map(tuple, got)) == sorted((i, j, j % 2, 7.0 if j % 2 else 6.9) for i in range(100) for j in range(50))


@pytest.mark.parametrize("name", ["nearest", "surroundings", "nearest_of_kind", "circle_groups"])
def test_a_place_is_asked_once_for_all_its_rows(spark, name):
    n = 40_000
    points, sites = crowd(spark, "id", n, 31.0), crowd(spark, "site", n, 31.1)
    began = time.monotonic()
    if name == "circle_groups":
        got = spatial.circle_groups(points, 12.0).agg(F.count("*"), F.max("component"))
        want = (n, 0)
    elif name == "nearest":
        got = spatial.nearest(points, sites, 25.0).agg(F.count("*"), F.max("site"), F.max(F.round("miles", 2)))
        want = (n, 0, 6.91)
    elif name == "surroundings":
        got = spatial.surroundings(points, sites, 25.0, "kind").agg(F.count("*"), F.min("n"), F.max("nearest"), F.max("worst"))
        want = (n, n, 0, 0)
    else:
        got = spatial.nearest_of_kind(points, sites, 25.0).groupBy("kind").agg(F.count("*").alias("n"), F.max("site").alias("s")).agg(F.array_sort(F.collect_list(F.struct("kind", "n", "s"))))
        want = ([(0, n, 0), (1, n, 1)],)
    assert tuple(got.first()) == want and time.monotonic() - began < 40


def test_thousands_of_boxes_are_counted_without_a_case_for_each(spark):
    n = 96
    rows = spark.range(n * n).select(((F.col("id") % n + 0.5) / 64).alias("longitude"), ((F.floor(F.col("id") / n) + 0.5) / 64).alias("latitude"))
    all_rows = rows.unionByName(spark.createDataFrame([(None, 1.0), (1.0, float("nan")), (-1.0, 1.0)], "longitude double, latitude double"))
    began = time.monotonic()
    boxes = planning.split_by_ceiling(all_rows, (0.0, 0.0, n / 64, n / 64), 1)
    assert time.monotonic() - began < 40
    seen = sorted(b for b, k, _ in boxes if k)
    assert len(seen) == n * n == sum(k for _, k, _ in boxes) and not any(over for *_, over in boxes)


def test_rows_that_travel_with_their_blocks_say_the_same(spark):
    rows = spark.createDataFrame(
        [(i, f"p{i % 7}" if i % 3 else None, f"{i % 5} st|{i % 2}", f"{i % 5} st", str(i % 2) if i % 4 else None, 31.5 + (i % 6) * 0.0003, -101.5) for i in range(60)],
        "id long, parcel string, address_key string, bare_key string, unit string, latitude double, longitude double",
    )
    keys = F.array("address_key", F.concat(F.lit("p:"), F.col("parcel")))
    want = identity.pair_signals(identity.candidate_pairs(rows, keys), rows)
    got = identity.blocked_signals(rows, keys, block_rows=5)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 200
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 1
