"""Feeds of sources and reference data as DataFrames: payloads to rows of the model, by explicit schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import rings_of_geojson

#: Kinds of flood report, and what marks a flash flood warning.
REPORT_KINDS = ("FLASH FLOOD", "FLOOD", "DEBRIS FLOW")
WARNING = ("FF", "W")


def project(payloads: DataFrame, column: str, schema: str, fields: Mapping[str, Column]) -> DataFrame:
    """Payloads as JSON text by an explicit schema, projected to named columns; a text that isn't JSON gives nulls.

    `fields` are expressions over `_payload`.  Other columns of the payloads stay.
    """
    rest = [c for c in payloads.columns if c != column]
    parsed = payloads.withColumn("_payload", F.from_json(column, schema))
    return parsed.select(*rest, *[e.alias(n) for n, e in fields.items()])


def is_collection(card: Column) -> Column:
    """Whether a card advertises many homes: it has no id of a home and says so by a flag or by its page's path."""
    identified = F.coalesce(F.trim(card["id"]), F.lit("")) != ""
    path = F.coalesce(F.parse_url(F.concat(F.lit("http://x"), F.regexp_replace(card["url"], r"^https?://[^/]*", "")), F.lit("PATH")), F.lit(""))
    marked = F.coalesce(card["building"], F.lit(False)) | path.rlike("^/(community|b)/")
    return ~identified & marked


def cards(payloads: DataFrame, column: str) -> DataFrame:
    """Homes of result pages, one row each: `results` is exploded, collections of homes are left out."""
    page = F.from_json(column, "results array<struct<id:string,url:string,building:boolean,price:bigint,address:string>>")
    each = payloads.select(*[c for c in payloads.columns if c != column], F.explode(page["results"]).alias("card"))
    return each.where(~is_collection(F.col("card"))).select(*[c for c in payloads.columns if c != column], "card.*")


def without_notice(rows: DataFrame, address: str, notice: str) -> DataFrame:
    """Rows of a download but for its notice line and for rows without an address; `notice` is what that line contains."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    return rows.where(~F.concat_ws(" ", *texts).contains(notice) & (F.coalesce(F.trim(F.col(address)), F.lit("")) != ""))


def warnings(features: DataFrame, column: str = "feature") -> DataFrame:
    """(office, event, year, issued) of the flash flood warnings among GeoJSON features, one a key: the last issued."""
    p = F.from_json(F.get_json_object(column, "$.properties"), "phenomena string, significance string, wfo string, eventid string, year string, issue string")
    told = features.select(p.alias("p")).where((F.col("p.phenomena") == WARNING[0]) & (F.col("p.significance") == WARNING[1]))
    read = told.select(F.upper(F.trim("p.wfo")).alias("office"), F.col("p.eventid").try_cast("int").alias("event"), F.col("p.year").try_cast("int").alias("year"), F.try_to_timestamp("p.issue").alias("issued"))
    good = read.where(F.col("office").rlike("^[A-Z]{3}$") & F.col("event").isNotNull() & F.col("year").isNotNull() & F.col("issued").isNotNull())
    return good.groupBy("office", "event", "year").agg(F.max("issued").alias("issued"))


def reports(rows: DataFrame) -> DataFrame:
    """(at, latitude, longitude, kind) of flood reports (TYPETEXT, LAT, LON, VALID): known kinds with a time and finite coordinates, to four decimals."""
    kind = F.upper(F.trim("TYPETEXT"))
    lat, lon = F.col("LAT").try_cast("double"), F.col("LON").try_cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    at = F.try_to_timestamp(F.trim("VALID"), F.lit("yyyyMMddHHmm"))
    return rows.where(kind.isin(*REPORT_KINDS) & finite(lat) & finite(lon) & at.isNotNull()).select(at.alias("at"), F.round(lat, 4).alias("latitude"), F.round(lon, 4).alias("longitude"), F.lower(kind).alias("kind"))


def wind_sectors(lines: DataFrame, column: str = "value") -> DataFrame:
    """(station, from_degrees, percent) of wind-rose tables: lines `station, from-to, speed shares...`, each share in percent; other lines are comments."""
    parts = F.split(F.trim(column), r"\s*,\s*")
    read = lines.select(parts.alias("p")).where(F.get("p", F.lit(1)).rlike(r"^\d{1,3}-\d{1,3}$"))
    shares = F.transform(F.slice("p", F.lit(3), F.size("p") - 2), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return read.select(F.col("p")[0].alias("station"), F.split(F.get("p", F.lit(1)), "-")[0].cast("int").alias("from_degrees"), F.aggregate(shares, F.lit(0.0), lambda a, x: a + x).alias("percent"))


def _text(x: Column) -> Column:
    """A value as trimmed text; empty for nothing."""
    return F.coalesce(F.trim(x.cast("string")), F.lit(""))


def _number(x: Column) -> Column:
    """A finite number, or null."""
    n = x.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def _known(code: Column, words: Mapping[str, str], what: str) -> Column:
    """The word of a code; null for no code.  A code that has no word is an error: a guess would be told as a fact."""
    named = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.when(code == "", F.lit(None).cast("string")).when(code.isin(*words), named[code]).otherwise(F.raise_error(F.concat(F.lit(f"{what} is not known: "), code)).cast("string"))


def dams(rows: DataFrame, column: str, hazards: Mapping[str, str], conditions: Mapping[str, str], plans: Mapping[str, str], wanted: str) -> DataFrame:
    """(id, name, latitude, longitude, condition, assessed, plan, built, owner) of an inventory's dams of the wanted hazard that have a place.

    `rows` has a dam's record as JSON text.  The three codes are read by the given words, and one that has none is an error when it is asked for.
    """
    r = F.from_json(column, "federalId string, name string, latitude string, longitude string, publicHazardId string, conditionAssessId string, conditionAssessDate string, eapId string, yearCompleted string, ownerNames string")
    told = rows.select(r.alias("r")).where(_known(_text(F.col("r.publicHazardId")), hazards, "hazard") == wanted)
    placed = told.withColumn("latitude", _number(F.col("r.latitude"))).withColumn("longitude", _number(F.col("r.longitude"))).where("latitude IS NOT NULL AND longitude IS NOT NULL")
    text = lambda c, longest: F.substring(_text(F.col(f"r.{c}")), 1, longest)
    return placed.select(
        text("federalId", 12).alias("id"),
        F.coalesce(F.nullif(text("name", 100), F.lit("")), F.lit("an unnamed dam")).alias("name"),
        F.round("latitude", 5).alias("latitude"),
        F.round("longitude", 5).alias("longitude"),
        F.coalesce(_known(text("conditionAssessId", 20), conditions, "condition"), F.lit("not rated")).alias("condition"),
        F.substring(_text(F.col("r.conditionAssessDate")), 1, 10).try_cast("date").alias("assessed"),
        _known(text("eapId", 20), plans, "emergency plan").alias("plan"),
        F.regexp_extract(text("yearCompleted", 10), r"^\d{4}$", 0).try_cast("int").alias("built"),
        text("ownerNames", 100).alias("owner"),
    )


def tracked_sites(features: DataFrame, column: str, kinds: Mapping[str, str]) -> DataFrame:
    """(name, kind, status, confidence, latitude, longitude, state, county, city, operator) of a tracker's sites, GeoJSON features as text.

    A site without a status or a place is left out; a status that no kind is given for is an error.  A point of the geometry goes before the properties.
    """
    p = F.from_json(F.get_json_object(column, "$.properties"), "facility_name string, status string, location_confidence string, long string, lat string, state string, county string, city string, operator_name string, tenant string")
    point = F.get_json_object(column, "$.geometry.type") == "Point"
    at = lambda i, c: _number(F.when(point, F.get_json_object(column, f"$.geometry.coordinates[{i}]")).otherwise(F.col(f"p.{c}")))
    read = features.select(column, p.alias("p")).withColumn("status", F.lower(_text(F.col("p.status"))))
    placed = read.where(F.col("status") != "").select("p", "status", at(1, "lat").alias("latitude"), at(0, "long").alias("longitude"))
    named = placed.withColumn("kind", _known(F.col("status"), kinds, "status")).where("latitude IS NOT NULL AND longitude IS NOT NULL")
    text = lambda c: _text(F.col(f"p.{c}"))
    return named.select(
        F.coalesce(F.nullif(text("facility_name"), F.lit("")), F.lit("an unnamed site")).alias("name"), "kind", "status", F.lower(text("location_confidence")).alias("confidence"), "latitude", "longitude",
        F.upper(text("state")).alias("state"), text("county").alias("county"), text("city").alias("city"), F.coalesce(F.nullif(text("operator_name"), F.lit("")), text("tenant")).alias("operator"),
    )


def mapped_sites(elements: DataFrame, column: str) -> DataFrame:
    """(name, operator, outline, latitude, longitude) of a map's elements as JSON text: nodes, ways, and relations, whose outer members run together.

    An element with an outline stands at the mean of its corners, another where it says; without either it is left out.
    """
    corner = "array<struct<lat:string,lon:string>>"
    e = F.from_json(column, f"tags map<string,string>, lat string, lon string, geometry {corner}, members array<struct<role:string,geometry:{corner}>>")
    read = elements.select(e.alias("e"))
    outer = F.filter("e.members", lambda m: F.coalesce(m["role"], F.lit("")).isin("", "outer"))
    none = F.array().cast(corner)
    points = lambda g: F.filter(F.transform(g, lambda c: F.struct(_number(c["lon"]).alias("x"), _number(c["lat"]).alias("y"))), lambda c: c["x"].isNotNull() & c["y"].isNotNull())
    own, joined = points(F.coalesce(F.col("e.geometry"), none)), points(F.coalesce(F.flatten(F.transform(outer, lambda m: F.coalesce(m["geometry"], none))), none))
    drawn = read.withColumn("outline", F.when(F.size(own) > 0, own).when(F.size(joined) > 0, joined))
    mean = lambda c: F.aggregate("outline", F.lit(0.0), lambda acc, q: acc + q[c]) / F.size("outline")
    placed = drawn.withColumn("latitude", F.when(F.col("outline").isNotNull(), mean("y")).otherwise(_number(F.col("e.lat")))).withColumn("longitude", F.when(F.col("outline").isNotNull(), mean("x")).otherwise(_number(F.col("e.lon"))))
    tag = lambda t: _text(F.col("e.tags")[t])
    return placed.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(F.coalesce(F.nullif(tag("name"), F.lit("")), F.lit("an unnamed site")).alias("name"), tag("operator").alias("operator"), "outline", "latitude", "longitude")


def counties(features: DataFrame, column: str) -> DataFrame:
    """(fips, name, latitude, longitude, rings) of GeoJSON features as text; those without a name or a shape are left out."""
    p = F.from_json(F.get_json_object(column, "$.properties"), "BASENAME string, COUNTY string, CENTLAT string, CENTLON string")
    rings = rings_of_geojson(F.get_json_object(column, "$.geometry"))
    read = features.select(p.alias("p"), rings.alias("rings")).where((_text(F.col("p.BASENAME")) != "") & (F.size("rings") > 0))
    return read.select(_text(F.col("p.COUNTY")).alias("fips"), _text(F.col("p.BASENAME")).alias("name"), _number(F.col("p.CENTLAT")).alias("latitude"), _number(F.col("p.CENTLON")).alias("longitude"), "rings")


def towns(features: DataFrame, column: str) -> DataFrame:
    """(name, latitude, longitude, size) of urban areas as JSON text, by land area; `Town, ST` goes by its town alone, an area across state lines by its whole name."""
    a = F.from_json(F.get_json_object(column, "$.attributes"), "BASENAME string, AREALAND string, CENTLAT string, CENTLON string")
    read = features.select(a.alias("a")).select(_text(F.col("a.BASENAME")).alias("_n"), _number(F.col("a.CENTLAT")).alias("latitude"), _number(F.col("a.CENTLON")).alias("longitude"), F.coalesce(_number(F.col("a.AREALAND")).cast("bigint"), F.lit(0)).alias("size"))
    behind = F.trim(F.regexp_extract("_n", ",(.*)$", 1))
    alone = ~behind.contains("-") & (F.length(behind) <= 2)
    name = F.when(alone, F.trim(F.substring_index("_n", ",", 1))).otherwise(F.col("_n"))
    return read.where((F.col("_n") != "") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(name.alias("name"), "latitude", "longitude", "size")
