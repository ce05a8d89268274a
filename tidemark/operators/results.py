"""Results: verdicts to ordered rows, what changed between runs, judgments, table filters, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarise(verdicts: DataFrame, key: str = "entity") -> DataFrame:
    """(key, score, drops, flags, dropped): boosts less demotes of the rules that fired, and the ids of those that drop or flag."""
    fired = F.col("verdict") == "fired"
    listed = lambda s: F.array_sort(F.collect_list(F.when(fired & (F.col("severity") == s), F.col("rule_id"))))
    out = verdicts.groupBy(key).agg((F.count_if(fired & (F.col("severity") == "boost")) - F.count_if(fired & (F.col("severity") == "demote"))).alias("score"), listed("drop").alias("drops"), listed("flag").alias("flags"))
    return out.withColumn("dropped", F.size("drops") > 0)


def ordered(rows: DataFrame, key: str = "entity", first: str = "first_seen") -> DataFrame:
    return rows.orderBy(F.desc("score"), F.asc(first), F.asc(key))


def order_by(rows: DataFrame, field: str, descending: bool, ties: Sequence[str]) -> DataFrame:
    """By a field with nulls last both ways, equal rows in the order of `ties`."""
    c = F.col(field)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *ties)


def exclusion_counts(verdicts: DataFrame) -> DataFrame:
    """(rule_id, n): how many rows each dropping rule dropped."""
    return verdicts.where((F.col("verdict") == "fired") & (F.col("severity") == "drop")).groupBy("rule_id").agg(F.count("*").alias("n"))


def newly_fired(now: DataFrame, before: DataFrame, key: str = "entity") -> DataFrame:
    fired = lambda v: v.where(F.col("verdict") == "fired").select(key, "rule_id").distinct()
    return fired(now).join(fired(before), [key, "rule_id"], "left_anti")


def judgments(annotations: DataFrame, merged: DataFrame, key: str = "entity") -> DataFrame:
    """(live, judgment) over an entity and its direct constituents: pass beats keep.  merged: (constituent, live)."""
    own = annotations.select(F.col(key).alias("live"), "judgment")
    theirs = annotations.join(merged, annotations[key] == merged["constituent"]).select("live", "judgment")
    rank = F.when(F.col("judgment") == "pass", 2).when(F.col("judgment") == "keep", 1)
    folded = own.unionByName(theirs).groupBy("live").agg(F.max(rank).alias("_r"))
    return folded.select("live", F.when(F.col("_r") == 2, "pass").when(F.col("_r") == 1, "keep").alias("judgment"))


def bound_status(value: Column, low, high, asked: Column) -> Column:
    """match, excluded, pending (not yet asked) or unavailable (asked, no answer) of one bounded value."""
    fails = F.lit(False)
    if low is not None:
        fails = fails | (value < low)
    if high is not None:
        fails = fails | (value > high)
    return F.when(value.isNull() & asked, "unavailable").when(value.isNull(), "pending").when(fails, "excluded").otherwise("match")


def overall_status(statuses: Sequence[Column]) -> Column:
    """A sure failure beats what is unknown; pending beats unavailable."""
    has = lambda s: F.array_contains(F.array(*statuses), s)
    return F.when(has("excluded"), "excluded").when(has("pending"), "pending").when(has("unavailable"), "unavailable").otherwise("match")


def tag_counts(tags: DataFrame, uses: DataFrame) -> DataFrame:
    """(tag, n) with zeros; tags match whatever their case."""
    used = uses.select(F.lower("tag").alias("_t"), "entity").distinct().groupBy("_t").agg(F.count("*").alias("n"))
    return tags.join(used, F.lower("tag") == F.col("_t"), "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


def rename_tag(uses: DataFrame, old: str, new: str) -> DataFrame:
    """A rename merges into a tag that exists already."""
    return uses.select("entity", F.when(F.lower("tag") == old.lower(), F.lit(new)).otherwise(F.col("tag")).alias("tag")).distinct()


def replace_tags(uses: DataFrame, wanted: DataFrame, family: DataFrame) -> DataFrame:
    """Tags after a family's list is replaced: others' tags stay, absent ones go, new ones come once."""
    others = uses.join(family, "entity", "left_anti")
    same = wanted.select(F.lower("tag").alias("_t"))
    kept = uses.join(family, "entity", "left_semi").join(same, F.lower("tag") == F.col("_t"), "left_semi")
    held = kept.select(F.lower("tag").alias("_t")).distinct()
    new = wanted.where(F.col("entity").isNotNull()).join(held, F.lower("tag") == F.col("_t"), "left_anti").select("entity", "tag")
    return others.unionByName(kept).unionByName(new)


def place_counts(rows: DataFrame, city: str, county: str) -> DataFrame:
    """(kind, name, n) of non-empty cities and counties."""
    one = lambda kind, c: rows.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return one("city", city).unionByName(one("county", county))


def empty_columns(rows: DataFrame) -> DataFrame:
    """(column, has_values) over every column, in one pass."""
    flags = rows.agg(*[F.max((F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int")).alias(c) for c in rows.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), (F.coalesce(F.col(c), F.lit(0)) == 1).alias("has_values")) for c in rows.columns])
    return flags.select(F.inline(pairs))


def moved(counts: DataFrame) -> DataFrame:
    """Whether a digest has anything to tell, which is when it is sent."""
    told = F.coalesce(F.sum(F.when(F.col("kind") != "unchanged", F.col("n"))), F.lit(0))
    return counts.agg(told.alias("moved"), (told > 0).alias("send"))


def top_examples(rows: DataFrame, group: str, reason: str, order: str, n: int) -> DataFrame:
    """The first n of each group, those with a reason first."""
    from tidemark.operators.spatial import rank_within

    return rank_within(rows, [group], [F.col(reason).isNull(), F.col(order)], n)


def parsed_concerns(text: Column) -> Column:
    """The levels of a JSON list of concerns, lower case; null if the text is null or no list."""
    return F.transform(F.from_json(text, "array<struct<level:string>>"), lambda c: F.lower(F.trim(c["level"])))


def worst_concern(assessments: DataFrame, key: str, levels: Sequence[str]) -> DataFrame:
    """Latest assessment by seq: number of concerns (null if it has none at all, zero for an empty list) and the worst level."""
    if dict(assessments.dtypes)["concerns"] == "string":
        assessments = assessments.withColumn("concerns", parsed_concerns(F.col("concerns")))
    last = assessments.groupBy(key).agg(F.max_by(F.struct("concerns"), "seq").alias("_a"))
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in levels]), c)
    worst = F.array_max(F.transform(F.col("_a.concerns"), rank))
    return last.select(key, F.when(F.col("_a.concerns").isNotNull(), F.size("_a.concerns")).alias("n"), F.when(worst > 0, F.element_at(F.array(*[F.lit(x) for x in levels]), worst.cast("int"))).alias("worst"))


def digest_counts(counts: DataFrame, observed_count: int | None = None, flagged: int | None = None) -> DataFrame:
    """One row of a digest's counts: matched (what was observed, or else the sum of all kinds but gone) and each kind."""
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k)
    summed = F.coalesce(F.sum(F.when(F.col("kind") != "gone", F.col("n"))), F.lit(0))
    matched = summed if observed_count is None else F.lit(observed_count).cast("bigint")
    more = [] if flagged is None else [F.lit(flagged).alias("flagged")]
    return counts.agg(matched.alias("matched"), *[n(k) for k in ("new", "changed", "gone", "returned", "unverified")], *more)


def as_document(counts: DataFrame, order: str, **head) -> DataFrame:
    """One JSON text of the given values and the counts in order: a closed list of kinds, so its size is bounded."""
    rows = counts.agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in counts.columns if c != order]))).alias("counts"))
    return rows.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in head.items()], "counts")).alias("digest"))


def fired_sets(verdicts: DataFrame, severities: Sequence[str] | None = None, key: str = "entity") -> DataFrame:
    """(rule_id, entity), distinct: which entities fired which rules; sets as rows, as one rule may fire on any number."""
    fired = verdicts.where(F.col("verdict") == "fired")
    if severities is not None:
        fired = fired.where(F.col("severity").isin(*severities))
    return fired.select("rule_id", key).distinct()


def live_count(entities: DataFrame, include_disappeared: bool = True) -> DataFrame:
    """How many entities live: neither retracted nor merged into another, and present if asked for."""
    live = entities.where(~F.col("retracted") & F.col("superseded_by").isNull())
    return (live if include_disappeared else live.where(F.col("presence") == "observed")).agg(F.count("*").alias("n"))


def index_states(blocks: DataFrame, state: str = "state") -> DataFrame:
    """Per state how many blocks are indexed, as of when, and when they were loaded last."""
    return blocks.groupBy(state).agg(F.count("*").alias("blocks"), F.max("as_of").alias("as_of"), F.max("loaded_at").alias("loaded_at"))


def empty_by_origin(flags: DataFrame, origins: dict[str, str]) -> DataFrame:
    """(origin, empty): of each origin of columns those without any value, joined in order."""
    named = F.create_map(*[F.lit(x) for pair in origins.items() for x in pair])
    empty = flags.where(~F.col("has_values")).select(F.coalesce(named[F.col("column")], F.lit("other")).alias("origin"), "column")
    return empty.groupBy("origin").agg(F.array_join(F.array_sort(F.collect_list("column")), ",").alias("empty"))


def clean_tags(uses: DataFrame) -> DataFrame:
    """Tags trimmed, their blanks collapsed, empty ones dropped, and of an entity's tags that differ in case only the first in order."""
    named = uses.withColumn("tag", F.trim(F.regexp_replace("tag", r"\s+", " "))).where(F.coalesce(F.col("tag"), F.lit("")) != "")
    return named.groupBy("entity", F.lower("tag").alias("_t")).agg(F.min("tag").alias("tag")).select("entity", "tag")
