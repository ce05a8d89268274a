"""Enrichment: reference folds, and caches in which an absent answer, an empty one and an old one differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.values import stale


def attach_cached(rows: DataFrame, cache: DataFrame, key: str, names: list[str], now: Column, ttl_days: Column) -> DataFrame:
    """Adds for each name its value and status: missing (never asked), fresh or stale; a known null is not missing.

    cache: (key, name, value, fetched_at).  One aggregation pivots it, one join attaches it.
    """
    latest = cache.where(F.col("name").isin(names)).groupBy(key).pivot("name", names).agg(F.max_by(F.struct("value", "fetched_at"), "fetched_at"))
    joined = rows.join(latest, key, "left")
    out = []
    for n in names:
        status = F.when(F.col(n).isNull(), "missing").when(stale(F.col(f"{n}.fetched_at"), now, ttl_days), "stale").otherwise("fresh")
        out += [F.col(f"{n}.value").alias(f"{n}_value"), status.alias(f"{n}_status")]
    return joined.select(*rows.columns, *out)


def known_values(cache: DataFrame, key: str) -> DataFrame:
    """(key, known): a map of every name asked, nulls included."""
    pairs = cache.groupBy(key, "name").agg(F.max_by(F.struct("value"), "fetched_at").alias("v"))
    return pairs.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v.value")))).alias("known"))


def keys_to_ask(places: DataFrame, cache: DataFrame, key: str, now: Column, ttl_days: Column, order: str) -> DataFrame:
    """Distinct keys without a fresh answer, each with the first place that has it."""
    fresh = cache.where(~stale(F.col("fetched_at"), now, ttl_days)).select(key).distinct()
    return places.where(F.col(key).isNotNull()).join(fresh, key, "left_anti").groupBy(key).agg(F.min(order).alias(order))


def latest_success(log: DataFrame, key: str) -> DataFrame:
    """The newest good answer of each key, and whether a later attempt failed: a failure never removes a value."""
    good = F.col("outcome") == "ok"
    folded = log.groupBy(key).agg(F.max_by(F.when(good, F.col("value")), F.when(good, F.col("at"))).alias("value"), F.max(F.when(good, F.col("at"))).alias("fetched_at"), F.max("at").alias("_last"))
    return folded.where(F.col("fetched_at").isNotNull()).select(key, "value", "fetched_at", (F.col("_last") > F.col("fetched_at")).alias("stale"))


def best_by_block(rows: DataFrame, block: str, down: str, up: str, brand: str, keep: Column) -> DataFrame:
    """Per block the best speeds (zero or unreadable is none) and the providers, sorted and joined."""
    speed = lambda c: F.nullif(F.max(F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0))), F.lit(0.0))
    return rows.where(keep).groupBy(block).agg(speed(down).alias("best_down"), speed(up).alias("best_up"), F.array_join(F.array_sort(F.collect_set(brand)), "; ").alias("providers"))


def with_known_region(points: DataFrame, blocks: DataFrame, key: str, region: str) -> DataFrame:
    """Left join that tells a block without service from a region that was never loaded."""
    loaded = blocks.select(region, F.lit(True).alias("_loaded")).distinct()
    joined = points.join(blocks.drop(region), key, "left").join(loaded, region, "left")
    return joined.withColumn("answer", F.when(F.col("best_down").isNotNull(), "served").when(F.col("_loaded"), "unserved").otherwise("unknown")).drop("_loaded")


def recent_mean(rows: DataFrame, key: str, order: str, value: str, n: int, least: float, digits: int = 1) -> DataFrame:
    """Mean of the last n rows' values above a floor: the rows are chosen first, then filtered."""
    last = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= n)
    return last.where(F.col(value) > least).groupBy(key).agg(F.round(F.avg(value), digits).alias("mean"))


def prevailing(rows: DataFrame, key: str, direction: str, percent: str) -> DataFrame:
    """The direction of largest share above zero, ties to the first in order, and all shares' sum."""
    best = F.max_by(F.when(F.col(percent) > 0, F.col(direction)), F.struct(percent, F.negate(direction)))
    return rows.groupBy(key).agg(F.when(F.max(percent) > 0, best).alias("prevailing"), F.round(F.sum(percent), 4).alias("total"))


def fold_updates(rows: DataFrame, key: list[str], emergency: str, damage: Column, action: str, issued: str) -> DataFrame:
    """One row per event of many updates: any emergency, the worst damage, the issue time of the first NEW update or else the first."""
    first_new = F.min(F.when(F.col(action) == "NEW", F.col(issued)))
    return rows.groupBy(*key).agg(F.bool_or(emergency).alias("emergency"), F.max(damage).alias("damage"), F.coalesce(first_new, F.min(issued)).alias("issued"))


def answerable_regions(held: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Regions that are held together with every neighbour.  neighbours: (region, near)."""
    lacking = neighbours.join(held.select(F.col("region").alias("near")), "near", "left_anti").select("region").distinct()
    return held.join(lacking, "region", "left_anti").select("region")


def with_neighbours(regions: DataFrame, neighbours: DataFrame) -> DataFrame:
    return regions.select("region").unionByName(neighbours.join(regions, "region").select(F.col("near").alias("region"))).distinct()
