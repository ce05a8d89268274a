"""Wide rows: everything that is known about an entity, gathered once, for screens and criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import floor_days
from tidemark.operators.history import price_story


def entity_rows(latest: DataFrame, key: str = "entity", **parts: DataFrame) -> DataFrame:
    """One row for each latest snapshot with the parts known about it, each as a struct, null where there is none.

    A part has one row for each entity at most; fold it before (tags, links and notes as
    arrays).  Every join is on the entity, so one exchange serves them all.
    """
    out = latest
    for name, part in parts.items():
        rest = [c for c in part.columns if c != key]
        out = out.join(part.select(key, F.struct(*rest).alias(name)), key, "left")
    return out


def folded(rows: DataFrame, name: str, columns: list[str], key: str = "entity") -> DataFrame:
    """(key, name): an entity's rows as one sorted array of structs, or of values for a single column."""
    item = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias(name))


def values_of(snapshots: DataFrame, run: int, now: Column, enriched: DataFrame, extracted: DataFrame, presence: DataFrame, key: str = "entity") -> DataFrame:
    """What a criterion may ask about each entity of a run.

    The run's snapshot, enriched and extracted values (both one row an entity; a later
    one of a name replaces an earlier), and what its own history tells up to the run:
    days on market from the first sighting, presence, whether the price was ever cut,
    days to the first raise, and whether the run saw it first.
    """
    upto = snapshots.where(F.col("run_seq") <= run)
    here = snapshots.where(F.col("run_seq") == run)
    story = price_story(upto, key).select(key, "price_cut", F.col("raise_days").alias("price_raised_after_days"))
    seen = upto.groupBy(key).agg(F.min("ts").alias("_first"), F.min("run_seq").alias("_run"))
    out = here.join(seen, key).join(story, key, "left").join(presence.select(key, "presence"), key, "left")
    out = out.withColumn("dom", floor_days(F.col("_first"), now)).withColumn("is_new", F.col("_run") == run).drop("_first", "_run")
    for more in (enriched, extracted):
        out = out.drop(*[c for c in more.columns if c != key]).join(more, key, "left")
    return out


def judged(judgments: DataFrame, latest: DataFrame, annotations: DataFrame, judgment: str, key: str = "entity") -> DataFrame:
    """Entities that carry a judgment, with their latest snapshot and annotation, both of which may be missing."""
    kept = judgments.where(F.col("judgment") == judgment)
    return kept.join(latest, key, "left").join(annotations, key, "left")


def detail(key_value, entities: DataFrame, links: DataFrame, key: str = "entity", raw: str = "raw_id") -> DataFrame:
    """Everything about one entity: its row, and its links, one for each raw row, in order."""
    own = links.where(F.col(key) == key_value).dropDuplicates([raw])
    told = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(raw, *[c for c in links.columns if c not in (key, raw)]))).alias("links"))
    return entities.where(F.col(key) == key_value).join(told, key, "left")


def place_notes(rows: DataFrame, notes: DataFrame, kind: str, column: str) -> DataFrame:
    """Adds the note about each row's city or county, matched whatever its case: null where nobody wrote one."""
    own = notes.where(F.col("kind") == kind).select(F.lower(F.trim("name")).alias("_name"), F.col("note").alias(f"{kind}_note"))
    return rows.join(own, F.lower(F.trim(F.col(column))) == F.col("_name"), "left").drop("_name")
