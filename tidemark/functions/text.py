"""Column expressions over text: normal forms, keys, guards for exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the longest text that is read for extraction, and the longest cell of a sheet.
READ_LIMIT = 4_000
CELL_LIMIT = 32_767
CELL_MARK = " [cut]"
#: Names of the sixteen winds from north, clockwise.
WINDS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
#: Words that only decorate a unit's number, and endings of county names.
UNIT_WORDS = ("unit", "apt", "apartment", "suite", "ste", "no", "number")
COUNTY_ENDINGS = ("county", "parish", "borough", "census area", "municipality")


def clean(x: Column) -> Column:
    """Lower case; anything but letters, digits and slashes is one blank; trimmed."""
    return F.trim(collapse(F.regexp_replace(F.lower(x), "[^a-z0-9/ ]+", " ")))


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", " ")


def fold(x: Column) -> Column:
    """The form in which quotations are compared."""
    return F.trim(collapse(F.lower(x)))


def digest(x: Column, limit: int | None = None) -> Column:
    """SHA-256 of the text, or of its first `limit` characters: READ_LIMIT for what extraction reads."""
    return F.sha2((x if limit is None else F.substring(x, 1, limit)).cast("binary"), 256)


def unit_form(x: Column) -> Column:
    """A unit without its decorations; null if nothing is left."""
    words = F.filter(F.split(clean(F.regexp_replace(x, "#", " ")), " "), lambda w: ~w.isin(*UNIT_WORDS) & (w != ""))
    return F.nullif(F.array_join(words, " "), F.lit(""))


def address_key(number: Column, street: Column, postal: Column, unit: Column | None = None) -> Column:
    """postal|number|street[|unit]; null without a street."""
    parts = [F.coalesce(c, F.lit("")) for c in ([postal, number, street] + ([unit] if unit is not None else []))]
    return F.when(F.coalesce(street, F.lit("")) != "", F.concat_ws("|", *parts))


def parcel_form(x: Column) -> Column:
    """A parcel number's letters and digits; null below four of them."""
    kept = F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    return F.when(F.length(kept) >= 4, kept)


def address_line(line: Column, unit: Column) -> Column:
    """The line, with the unit after it unless the line ends with it already."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    lacking = unit.isNotNull() & (bare(unit) != "") & ~F.endswith(bare(line), bare(unit))
    return F.when(lacking, F.concat_ws(" ", line, unit)).otherwise(line)


def sentences(x: Column) -> Column:
    return F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def sheet_cell(x: Column) -> Column:
    """Safe for a spreadsheet: no control characters, bounded, and no text that reads as a formula."""
    plain = F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    guarded = F.when(F.ltrim(plain).rlike(r"^[=+@-]"), F.concat(F.lit("'"), plain)).otherwise(plain)
    cut = F.concat(F.substring(guarded, 1, CELL_LIMIT - len(CELL_MARK)), F.lit(CELL_MARK))
    return F.when(F.length(guarded) > CELL_LIMIT, cut).otherwise(guarded)


def bare_county(x: Column) -> Column:
    """A county's name without the word that says what it is."""
    return F.regexp_replace(F.trim(F.lower(x)), rf"\s+({'|'.join(COUNTY_ENDINGS)})$", "")


def wind_name(degrees: Column) -> Column:
    at = F.pmod(F.round(degrees / 22.5).cast("int"), F.lit(16))
    return F.element_at(F.array(*[F.lit(w) for w in WINDS]), at + 1)


def city_and_state(x: Column) -> Column:
    """`City, ST` as a struct of both, lower and upper case; null parts where there is no comma."""
    parts = F.split(x, ",")
    has = F.size(parts) == 2
    return F.struct(F.lower(F.trim(parts[0])).alias("city"), F.when(has, F.upper(F.trim(F.get(parts, F.lit(1))))).alias("state"))


def status_label(status: Column, presence: Column) -> Column:
    return F.when(presence == "disappeared", F.concat(F.coalesce(status, F.lit("unknown")), F.lit(" (disappeared)"))).otherwise(status)


def price_history(first: Column, last: Column, days: Column) -> Column:
    """First to last price with its direction and days; one price alone if they are equal."""
    way = F.when(last < first, " down to ").otherwise(" up to ")
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first, way, last, F.lit(" in "), days, F.lit(" days")))


def shown_number(x: Column) -> Column:
    return F.when(x.isNull(), "not known").otherwise(F.format_number(x, 0))


def matches_shown(x: Column, wanted: str) -> Column:
    """Whether a number as shown, or without its punctuation, contains what was typed."""
    shown = F.lower(shown_number(x))
    bare = r"[\s$,]"
    return shown.contains(wanted.lower()) | F.regexp_replace(shown, bare, "").contains("".join(c for c in wanted.lower() if c not in " $,"))


def any_column_contains(columns: list[str], wanted: str) -> Column:
    return F.exists(F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), lambda v: v.contains(wanted.lower()))


def natural_key(x: Column) -> Column:
    """A key under which numbers in text sort by value: digit runs padded to twelve."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def place_match(kind: str, wanted: str, city: Column, county: Column, state: Column, postal: Column) -> Column:
    """inside, outside or unknown of a named place: a postal code by its first five, a state, or `City, ST` and `County, ST`.

    Names match whatever their case and without the word County; states contradict only where both are known.
    """
    place, _, wanted_state = (x.strip() for x in wanted.partition(","))
    answer = lambda missing, same: F.when(missing, "unknown").when(same, "inside").otherwise("outside")
    if kind == "zip":
        code = F.substring(F.trim(F.coalesce(postal, F.lit(""))), 1, 5)
        return answer(code == "", code == place[:5])
    if kind == "state":
        return answer(state.isNull(), F.upper(F.trim(state)) == place.upper())
    if kind not in ("city", "county"):
        raise ValueError(f"unknown kind of place: {kind}")
    bare = lambda x: F.regexp_replace(F.trim(x), r"(?i)\s+county$", "")
    name = F.lower(bare(county) if kind == "county" else F.trim(city))
    target = place.lower().removesuffix(" county") if kind == "county" else place.lower()
    contradicted = F.coalesce(F.upper(F.trim(state)) != wanted_state.upper(), F.lit(False)) if wanted_state else F.lit(False)
    return answer(F.coalesce(name, F.lit("")) == "", (name == target) & ~contradicted)


def _joined(*parts: Column, by: str = ", ") -> Column:
    return F.nullif(F.concat_ws(by, *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def heat_and_cooling(heating: Column, cooling: Column) -> Column:
    said = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    return _joined(said("heat: ", heating), said("cool: ", cooling))


def internet(down: Column, up: Column, provider: Column) -> Column:
    """Speeds as filed and the provider; a speed of zero or none is a question mark."""
    speed = lambda c: F.coalesce(F.nullif(c, F.lit(0)).cast("string"), F.lit("?"))
    some = down.isNotNull() | up.isNotNull() | (F.coalesce(provider, F.lit("")) != "")
    return F.when(some, _joined(F.concat(speed(down), F.lit("/"), speed(up), F.lit(" Mbps advertised")), provider))


def aquifer(over: Column) -> Column:
    return F.when(over, "over a principal aquifer").when(~over, "not over a principal aquifer")


def flood_area(asked: Column, hazard: Column) -> Column:
    """An answer that is there but empty is `not decided by FEMA`, one that was never asked for is null."""
    return F.when(asked, F.when(hazard.isNull(), "not decided by FEMA").when(hazard, "yes").otherwise("no"))


def water_table(asked: Column, flooding: Column, depth: Column) -> Column:
    told = F.when(flooding.eqNullSafe(F.lit("not surveyed")), "not surveyed").when(depth.isNull(), "none recorded").otherwise(F.concat(depth, F.lit(" cm")))
    return F.when(asked, told)


def dam_sentence(name: Column, dam: Column, built: Column, condition: Column, assessed: Column, plan: Column, miles: Column) -> Column:
    called = F.when(F.coalesce(dam, F.lit("")) != "", F.concat(name, F.lit(" ("), dam, F.lit(")"))).otherwise(name)
    rated = F.concat(F.lit("condition "), F.coalesce(F.nullif(condition, F.lit("")), F.lit("not rated")), F.coalesce(F.concat(F.lit(" ("), F.nullif(assessed, F.lit("")), F.lit(")")), F.lit("")))
    return _joined(called, F.concat(F.lit("built "), built), rated, plan, F.concat(F.format_number(miles, 1), F.lit(" mi")))


def channel_sentence(name: Column, kind: Column) -> Column:
    unnamed = F.when(kind == "ephemeral", "an unnamed wash (ephemeral)").when(kind == "river", "an unnamed river channel").when(kind == "stream", "an unnamed stream").otherwise(F.concat(F.lit("an unnamed stream ("), kind, F.lit(")")))
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(name, F.lit(" ("), kind, F.lit(")"))).otherwise(unnamed)


def wind_sentence(compass: Column, percent: Column) -> Column:
    often = F.when(F.coalesce(percent, F.lit(0)) != 0, F.concat(F.lit(", about "), F.bround(percent).cast("int"), F.lit("% of the time"))).otherwise("")
    return F.when(compass.isNotNull(), F.concat(F.lit("most often from the "), compass, often)).otherwise("no prevailing direction was recorded")
