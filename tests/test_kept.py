"""States kept by run, payloads kept whole, collations, circles of shapes."""

import glob
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import collation, geo
from tidemark.operators.history import latest_asof
from tidemark.plans.registry import QUERIES
from tidemark.sources import feeds
from tidemark.sources import payloads as p
from tidemark.sources.states import StateTable

STATES = "entity long, run_seq long, event_id long, status string"


def state_rows(seed, runs, entities=30):
    rng = random.Random(seed)
    return [(e, r, r * 1000 + e * 2 + i, rng.choice("abc")) for r in runs for e in range(entities) if rng.random() < 0.3 for i in range(rng.choice((1, 1, 2)))]


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


@pytest.mark.parametrize("every", [1, 4, 50])
def test_a_state_is_that_of_the_whole_history(spark, tmp_path, every):
    rows = spark.createDataFrame(state_rows(1, [1, 2, 3, 5, 8, 9, 10, 12, 20]), STATES)
    kept = StateTable(spark, str(tmp_path), STATES, every=every)
    kept.write(rows)
    for at in (0, 1, 4, 9, 11, 20, 99):
        assert same(kept.asof(at), latest_asof(rows, at)), at


def test_a_state_reads_its_base_and_the_runs_since(spark, tmp_path):
    rows = spark.createDataFrame(state_rows(2, range(1, 21)), STATES)
    kept = StateTable(spark, str(tmp_path), STATES, every=8)
    kept.write(rows)
    read = {os.path.relpath(f.removeprefix("file://"), tmp_path).rsplit("/", 1)[0] for f in kept.asof(18).inputFiles()}
    assert read == {"bases/run_seq=16", "runs/run_seq=17", "runs/run_seq=18"}
    assert {os.path.basename(os.path.dirname(f)) for f in kept.recent(3, 12).inputFiles()} == {"run_seq=10", "run_seq=11", "run_seq=12"}


def test_a_run_written_again_replaces_it_and_what_was_made_of_it(spark, tmp_path):
    first, again = state_rows(3, range(1, 13)), [(99, 3, 1, "new"), (1, 3, 2, "z")]
    kept = StateTable(spark, str(tmp_path), STATES, every=4)
    kept.write(spark.createDataFrame(first, STATES))
    kept.write(spark.createDataFrame(again, STATES))
    kept.write(spark.createDataFrame(again, STATES))
    now = spark.createDataFrame([r for r in first if r[1] != 3] + again, STATES)
    for at in (3, 4, 12):
        assert same(kept.asof(at), latest_asof(now, at)), at
    assert sorted(os.path.basename(b) for b in glob.glob(f"{tmp_path}/bases/run*")) == ["run_seq=12", "run_seq=4", "run_seq=8"]


def test_a_late_run_moves_the_bases_after_it(spark, tmp_path):
    early, late = state_rows(4, [1, 2, 4, 5, 6, 7]), state_rows(5, [3])
    kept = StateTable(spark, str(tmp_path), STATES, every=3)
    kept.write(spark.createDataFrame(early, STATES))
    kept.write(spark.createDataFrame(late, STATES))
    for at in range(8):
        assert same(kept.asof(at), latest_asof(spark.createDataFrame(early + late, STATES), at)), at


def test_a_base_without_its_mark_is_not_read(spark, tmp_path):
    rows = spark.createDataFrame(state_rows(6, range(1, 10)), STATES)
    kept = StateTable(spark, str(tmp_path), STATES, every=4)
    kept.write(rows)
    os.remove(tmp_path / "bases" / "run_seq=8" / "_SUCCESS")
    assert same(kept.asof(9), latest_asof(rows, 9))
    assert not any("run_seq=8" in f and "bases" in f for f in kept.asof(9).inputFiles())
    kept.fold()
    assert any("bases/run_seq=8" in f for f in kept.asof(9).inputFiles())


def test_states_of_nothing_and_of_rows_without_a_run(spark, tmp_path):
    kept = StateTable(spark, str(tmp_path), STATES)
    kept.write(spark.createDataFrame([], STATES))
    assert kept.asof(5).count() == 0 and kept.recent(3).count() == 0 and kept.asof(5).columns == ["entity", "run_seq", "event_id", "status"]
    with pytest.raises(ValueError, match="1 rows have no run_seq"):
        kept.write(spark.createDataFrame([(1, None, 1, "a")], STATES))
    kept.write(spark.createDataFrame([(None, 1, 1, "a"), (None, 2, 2, "b"), (7, 1, 3, None)], STATES))
    assert sorted(map(tuple, kept.asof(2).collect()), key=str) == [(7, 1, 3, None), (None, 2, 2, "b")]


FIELDS = (p.Field("id", "$.id", "bigint"), p.Field("price", "$.cost.price", "double"), p.Field("sold", "$.sold", "boolean"), p.Field("any", "$.any", "variant"))
TEXTS = [
    '{"id": 1, "cost": {"price": 2.50}, "sold": true, "any": [1]}',
    '{"sold": "true", "cost": {"price": "7"}, "id": "x"}',
    '{"id": null, "cost": {"amount": 3}, "extra": {}}',
    '{"id": 4, "id": 5}',
    '{"id": 6',
    "[1, 2]",
    "",
    None,
    '{"id": 1, "cost": {"price": 2.50}, "sold": true, "any": [1]}',
]


@pytest.fixture(scope="module")
def kept_payloads(spark):
    return p.keep(spark.createDataFrame(list(enumerate(TEXTS)), "n int, body string"), "body").cache()


def test_texts_that_are_not_json_stay_beside_the_payloads(kept_payloads):
    assert {r.n: r.broken for r in kept_payloads.collect() if r.broken is not None} == {3: TEXTS[3], 4: TEXTS[4], 6: ""}
    assert kept_payloads.where("body is null").count() == 4


def test_fields_are_read_by_path_and_type(kept_payloads):
    got = {r.n: (r.id, r.price, r.sold) for r in p.project(kept_payloads, "body", FIELDS).collect()}
    assert got[0] == got[8] == (1, 2.5, True) and got[1] == (None, 7.0, True)
    assert all(got[n] == (None, None, None) for n in range(2, 8))


def test_drift_names_what_each_field_became(kept_payloads):
    got = {(r.field, r.state): r.n for r in p.drift(kept_payloads, "body", FIELDS).collect()}
    assert got == {
        ("id", "ok"): 2, ("id", "unreadable"): 1, ("id", "null"): 1, ("id", "missing"): 1,
        ("price", "ok"): 2, ("price", "retyped"): 1, ("price", "missing"): 2,
        ("sold", "ok"): 2, ("sold", "retyped"): 1, ("sold", "missing"): 2,
        ("any", "ok"): 2, ("any", "missing"): 3, ("extra", "unexpected"): 1,
    }


def test_renames_are_of_a_kind(spark):
    fields = (p.Field("price", "$.price", "double"), p.Field("name", "$.name"))
    texts = ['{"name": "a", "cost": 1, "label": "x"}', '{"name": "b", "cost": 2}', '{"price": 3, "title": "c"}', '{"price": 4, "name": "d", "cost": 9}']
    rows = p.keep(spark.createDataFrame([(t,) for t in texts], "body string"), "body")
    assert sorted(map(tuple, p.renames(rows, "body", fields).collect())) == [("name", "title", 1, 1), ("price", "cost", 2, 2)]


def test_names_seen_at_a_path(kept_payloads):
    assert sorted(map(tuple, p.observed(kept_payloads, "body", "$.cost").collect())) == [("amount", "number", 1), ("price", "number", 2), ("price", "text", 1)]
    assert p.observed(kept_payloads, "body", "$.nowhere").count() == 0


def test_equal_payloads_are_equal_texts(spark):
    rows = spark.createDataFrame([('{"b": 1.50, "a": {"d": 1, "c": [2, 1]}}',), ('{ "a":{"c":[2,1],"d":1},"b":1.5 }',)], "body string")
    assert [r.t for r in p.keep(rows, "body").select(p.canonical(F.col("body")).alias("t")).collect()] == ['{"a":{"c":[2,1],"d":1},"b":1.5}'] * 2


def test_a_letter_is_one_however_it_is_written(spark):
    rows = spark.createDataFrame([(1, "Étage"), (1, "étage"), (1, "étage"), (1, "étage"), (1, "etage"), (2, "Étage"), (2, None)], "entity int, tag string")
    assert sorted(map(tuple, collation.one_spelling(rows, ["entity"], "tag").collect())) == [(1, "etage", 1), (1, "étage", 4), (2, "Étage", 1)]
    assert sorted(map(tuple, collation.one_spelling(rows, ["entity"], "tag", "UNICODE_CI_AI").collect())) == [(1, "étage", 5), (2, "Étage", 1)]
    wanted = spark.createDataFrame([("ÉTAGE",), (None,)], "tag string")
    assert collation.semi_join(rows, wanted, "tag").count() == 5
    assert dict(collation.one_spelling(rows, ["entity"], "tag").dtypes)["tag"] == "string"


def test_numbers_in_texts_sort_by_value_and_letters_without_case(spark):
    told = ["lot 2", "Lot 10", "LOT 009", "ébene 1", "Ebene 2", "zone", ""]
    rows = spark.createDataFrame([(t,) for t in told], "t string")
    got = [r.t for r in rows.orderBy(collation.natural(F.col("t")), "t").collect()]
    assert got == ["", "ébene 1", "Ebene 2", "lot 2", "LOT 009", "Lot 10", "zone"]


def test_circles_of_parts_and_holes(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    circle = lambda *rings: spark.range(1).select(geo.covering_circle_of(F.array(*[geo.ring(r) for r in rings])).alias("c")).first().c
    plain = spark.range(1).select(geo.covering_circle(geo.ring(square(-100.0, 30.0, 2.0))).alias("c")).first().c
    whole = circle(square(-100.0, 30.0, 2.0))
    assert whole.latitude == pytest.approx(plain.latitude) and whole.miles == pytest.approx(plain.miles)
    turned = circle(square(-100.0, 30.0, 2.0)[::-1])
    assert turned.longitude == pytest.approx(-99.0) and turned.miles == pytest.approx(plain.miles)
    holed = circle(square(-100.0, 30.0, 2.0), square(-99.0, 30.5, 0.5))
    assert holed.longitude == pytest.approx((4 * -99.0 - 0.25 * -98.75) / 3.75) and holed.latitude == pytest.approx((4 * 31.0 - 0.25 * 30.75) / 3.75)
    island = circle(square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0), square(1.5, 1.5, 0.5))
    assert island.longitude == pytest.approx((16 * 2 - 4 * 2 + 0.25 * 1.75) / 12.25)
    assert circle([(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]) is None
    assert circle(square(0.0, 0.0, 0.001)).miles == 0.5


def texts(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "t string")


CODES = ({"1": "low", "3": "high"}, {"1": "poor"}, {"1": "yes"}, "high")


def test_dams_with_codes_that_nobody_knows_are_errors(spark):
    good = '{"federalId": "NM1", "publicHazardId": "3", "latitude": 34.123456, "longitude": "-105.5", "conditionAssessId": 1, "yearCompleted": 1931}'
    got = feeds.dams(texts(spark, good, '{"publicHazardId": "1"}', '{"latitude": 1, "longitude": 2}', '{"publicHazardId": "3", "latitude": "NaN", "longitude": 2}', "no", None), "t", *CODES).collect()
    assert [tuple(r) for r in got] == [("NM1", "an unnamed dam", 34.12346, -105.5, "poor", None, None, 1931, "")]
    for bad in (good.replace('Id": "3"', 'Id": "9"'), good.replace('AssessId": 1', 'AssessId": 7')):
        with pytest.raises(PySparkException, match="is not known"):
            feeds.dams(texts(spark, bad), "t", *CODES).collect()


def test_tracked_sites_need_a_known_status(spark):
    point = '{"geometry": {"type": "Point", "coordinates": [-105.0, 35.0]}, "properties": {"status": " Operating", "lat": 1, "long": 2, "tenant": "T", "state": "nm"}}'
    plain_place = '{"geometry": null, "properties": {"facility_name": "A", "status": "planned", "lat": "36", "long": "-104", "operator_name": "O"}}'
    rows = texts(spark, point, plain_place, '{"properties": {"status": "planned"}}', '{"properties": {"lat": 1, "long": 1}}', None)
    kinds = {"operating": "built", "planned": "proposed"}
    got = sorted(tuple(r[c] for c in ("name", "kind", "latitude", "longitude", "state", "operator")) for r in feeds.tracked_sites(rows, "t", kinds).collect())
    assert got == [("A", "proposed", 36.0, -104.0, "", "O"), ("an unnamed site", "built", 35.0, -105.0, "NM", "T")]
    with pytest.raises(PySparkException, match="status is not known: planned"):
        feeds.tracked_sites(rows, "t", {"operating": "built"}).collect()


def test_mapped_sites_stand_at_the_middle_of_their_outline(spark):
    way = '{"tags": {"name": "W"}, "lat": 9, "lon": 9, "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}, {"lat": null, "lon": 4}]}'
    relation = '{"members": [{"role": "outer", "geometry": [{"lat": 0, "lon": 0}]}, {"role": "inner", "geometry": [{"lat": 50, "lon": 50}]}, {"role": "", "geometry": [{"lat": 2, "lon": 4}]}]}'
    got = {r.name: (r.latitude, r.longitude, r.outline and len(r.outline)) for r in feeds.mapped_sites(texts(spark, way, relation, '{"tags": {"name": "N"}, "lat": 7, "lon": 8}', '{"tags": {"name": "none"}}', None), "t").collect()}
    assert got == {"W": (2.0, 3.0, 2), "an unnamed site": (1.0, 2.0, 2), "N": (7.0, 8.0, None)}


def test_counties_and_towns(spark):
    shape = '{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}'
    feature = '{"properties": {"BASENAME": "%s", "COUNTY": "025", "CENTLAT": "+33.5", "CENTLON": "-104"}, "geometry": %s}'
    got = feeds.counties(texts(spark, feature % ("Lea", shape), feature % ("", shape), feature % ("Eddy", "null"), None), "t").collect()
    assert [(r.fips, r.name, r.latitude, r.longitude, len(r.rings)) for r in got] == [("025", "Lea", 33.5, -104.0, 1)]
    town = '{"attributes": {"BASENAME": "%s", "AREALAND": %s, "CENTLAT": "1", "CENTLON": "2"}}'
    got = feeds.towns(texts(spark, town % ("Vale, NM", "12"), town % ("Twin, TX--NM", "null"), town % ("Plain", "7"), town % (" ", "7"), '{"attributes": {"BASENAME": "x"}}'), "t").collect()
    assert sorted((r.name, r.size) for r in got) == [("Plain", 7), ("Twin, TX--NM", 0), ("Vale", 12)]


def test_a_circle_of_parts_names_each_value_once(spark, small):
    """As expressions within others the values were worked out thousands of times a row."""
    plan = QUERIES["circles_of_parts"](spark, small)._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") < 10 and len(plan) < 50_000
