"""History of observed entities: the latest state at a point, and differences between two points.

Snapshots are whole rows, one per entity and run.  Runs are ordered by a sequence
number, never by a clock.  What is latest is found by max_by aggregation, which
combines before the shuffle, rather than by sorting each entity's history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by the order columns, which must be a total order."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_asof(snapshots: DataFrame, run: int, key: str = "entity", seq: str = "run_seq", tie: str = "event_id") -> DataFrame:
    """The latest snapshot of each entity at or before a run."""
    return latest_per_key(snapshots.where(F.col(seq) <= run), [key], [seq, tie])


def healthy_runs(run_sources: DataFrame) -> DataFrame:
    """(run_seq, healthy): whether a missing entity is evidence, which takes at least one source and all of them ok and whole."""
    return run_sources.groupBy("run_seq").agg(F.bool_and((F.col("outcome") == "ok") & ~F.col("truncated")).alias("healthy"))


def presence_asof(snapshots: DataFrame, runs: DataFrame, run: int, key: str = "entity", seq: str = "run_seq") -> DataFrame:
    """(entity, last_seen, presence): disappeared if a healthy run up to `run` came after the last sighting."""
    last_healthy = runs.where(F.col("healthy") & (F.col(seq) <= run)).agg(F.max(seq).alias("_last"))
    seen = snapshots.where(F.col(seq) <= run).groupBy(key).agg(F.max(seq).alias("last_seen"))
    gone = F.coalesce(F.col("last_seen") < F.col("_last"), F.lit(False))
    return seen.crossJoin(F.broadcast(last_healthy)).select(key, "last_seen", F.when(gone, "disappeared").otherwise("observed").alias("presence"))


def presence_events(snapshots: DataFrame, runs: DataFrame, key: str = "entity", seq: str = "run_seq") -> DataFrame:
    """(entity, run_seq, event): every disappearance and return.

    An entity disappears in the first healthy run after a sighting that didn't see it, and
    returns with its next sighting.  runs: (run_seq, healthy).  Each sighting looks up the
    next healthy run and the entity's next sighting; rows without an entity are nobody's.
    """
    healthy = F.when(F.col("healthy"), F.col(seq))
    ahead = runs.groupBy(seq).agg(F.bool_and("healthy").alias("healthy")).select(F.col(seq).alias("_run"), F.min(healthy).over(W.orderBy(seq).rowsBetween(1, W.unboundedFollowing)).alias("_next_healthy"))
    seen = snapshots.where(F.col(key).isNotNull()).select(key, seq).distinct()
    told = seen.withColumn("_next", F.lead(seq).over(W.partitionBy(key).orderBy(seq))).join(ahead, F.col(seq) == F.col("_run"))
    gone = told.where(F.col("_next_healthy").isNotNull() & (F.col("_next").isNull() | (F.col("_next_healthy") < F.col("_next"))))
    both = F.array(F.struct(F.col("_next_healthy").alias(seq), F.lit("disappeared").alias("event")), F.struct(F.col("_next").alias(seq), F.lit("returned").alias("event")))
    return gone.select(key, F.inline(F.filter(both, lambda e: e[seq].isNotNull())))


def field_changes(fields: Sequence[str], before: str, after: str) -> Column:
    """Array of (field, before, after) as text for the fields that differ, null-safely."""
    entries = [
        F.when(~F.col(f"{before}.{f}").eqNullSafe(F.col(f"{after}.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"{before}.{f}").cast("string").alias("before"), F.col(f"{after}.{f}").cast("string").alias("after")))
        for f in fields
    ]
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def by_source(observations: DataFrame, fields: Sequence[str], key: str = "entity", order: Sequence[str] = ("event_id",)) -> DataFrame:
    """(key, run_seq, rows): for each entity and run the first row of every source, as a map by source.

    Rows without an entity are nobody's and are left out; those without a source are of a source of their own.
    """
    named = observations.where(F.col(key).isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    first = named.groupBy(key, "run_seq", "source").agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_row"))
    return first.groupBy(key, "run_seq").agg(F.map_from_entries(F.collect_list(F.struct("source", "_row"))).alias("rows"))


def compare(observations: DataFrame, runs: DataFrame, target: int, baseline: int | None, fields: Sequence[str], key: str = "entity", price: str = "price", order: Sequence[str] = ("event_id",), reset: bool = False) -> DataFrame:
    """Exactly one event for each entity seen by `target` or up to `baseline`.

    kind: new, returned (had disappeared), unverified (no source saw it both times, so a
    difference may be the source's), changed, unchanged; and for those missing from
    `target`, gone if that run was healthy and they hadn't disappeared before.  What is
    compared are the rows of the first source, in order, that both sides share.  A
    changed price tells its amount, without a sign, and its direction where both prices
    are known.  Rows without an entity are nobody's; no source is a source too.  Without a baseline all is new, or, where the search's definition was
    reset, there is no event at all.
    """
    told = [*fields, price] if price not in fields else list(fields)
    seen = by_source(observations.where(F.col("run_seq") <= F.lit(max(target, baseline if baseline is not None else target))), told, key, order)
    now = seen.where(F.col("run_seq") == target).select(key, F.col("rows").alias("now"))
    if baseline is None:
        changes = F.filter(F.array(F.struct(*[F.lit("").alias(c) for c in ("field", "before", "after")])), lambda _: F.lit(False))
        return now.where(F.lit(not reset)).select(key, F.lit("new").alias("kind"), changes.alias("changes"), F.lit(None).cast("double").alias("price_amount"), F.lit(None).cast("string").alias("price_direction"))
    was = seen.where(F.col("run_seq") <= baseline).groupBy(key).agg(F.max_by("rows", "run_seq").alias("was"), F.max("run_seq").alias("_seen"))
    last_healthy = runs.agg(F.max(F.when(F.col("healthy") & (F.col("run_seq") <= baseline), F.col("run_seq"))).alias("_last"), F.coalesce(F.bool_or(F.col("healthy") & (F.col("run_seq") == target)), F.lit(False)).alias("_healthy"))
    joined = now.join(was, key, "full_outer").crossJoin(F.broadcast(last_healthy))
    shared = F.array_min(F.array_intersect(F.map_keys("was"), F.map_keys("now")))
    joined = joined.withColumn("_source", shared).withColumn("_before", F.col("was")[F.col("_source")]).withColumn("_after", F.col("now")[F.col("_source")])
    joined = joined.withColumn("_changes", field_changes(fields, "_before", "_after"))
    gone_before = F.coalesce(F.col("_seen") < F.col("_last"), F.lit(False))
    kind = (
        F.when(F.col("now").isNotNull() & F.col("was").isNull(), "new")
        .when(F.col("now").isNotNull() & gone_before, "returned")
        .when(F.col("now").isNotNull() & F.col("_source").isNull(), "unverified")
        .when(F.col("now").isNotNull() & (F.size("_changes") > 0), "changed")
        .when(F.col("now").isNotNull(), "unchanged")
        .when(F.col("_healthy") & ~gone_before, "gone")
    )
    amount = F.col(f"_after.{price}") - F.col(f"_before.{price}")
    moved = (F.col("kind") == "changed") & (amount != 0)
    return joined.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        key, "kind", F.when(F.col("kind") == "changed", F.col("_changes")).otherwise(F.slice("_changes", 1, 0)).alias("changes"),
        F.when(moved, F.abs(amount)).alias("price_amount"), F.when(moved, F.when(amount < 0, "down").otherwise("up")).alias("price_direction"),
    )


#: Kinds that are counted even where there are none.
ALWAYS_COUNTED = ("new", "changed", "unchanged", "gone", "returned")


def kind_counts(events: DataFrame, kinds: Sequence[str] = ALWAYS_COUNTED) -> DataFrame:
    """(kind, n) for every kind of a list, zero where there are none, and for others only if there are any."""
    names = events.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"), F.lit(0).alias("n"))
    return events.groupBy("kind").agg(F.count("*").alias("n")).unionByName(names).groupBy("kind").agg(F.sum("n").alias("n"))


def movements(snapshots: DataFrame, observations: DataFrame, steps: DataFrame, key: str = "entity", price: str = "price", status: str = "status", order: Sequence[str] = ("event_id",)) -> DataFrame:
    """Price and status moves of entities between a run and the one before it; steps: (run_seq, previous_seq).

    Where the two snapshots come from different sources, the earlier side is the first
    row of the later snapshot's source in the earlier run; without one nothing is told.
    """
    steps = steps.where(F.col("previous_seq").isNotNull()).select("run_seq", "previous_seq")
    after = snapshots.join(steps, "run_seq").select(key, "run_seq", "previous_seq", F.struct(price, status, "source").alias("_after"))
    before = snapshots.select(key, F.col("run_seq").alias("previous_seq"), F.struct(price, status, "source").alias("_snapshot"))
    moved = after.join(before, [key, "previous_seq"])
    same = moved.where(F.col("_snapshot.source").eqNullSafe(F.col("_after.source"))).withColumn("_before", F.struct(f"_snapshot.{price}", f"_snapshot.{status}"))
    rows = observations.groupBy(key, F.col("run_seq").alias("previous_seq"), F.col("source").alias("_source")).agg(F.min_by(F.struct(price, status), F.struct(*order)).alias("_before"))
    other = moved.where(~F.col("_snapshot.source").eqNullSafe(F.col("_after.source"))).withColumn("_source", F.col("_after.source")).join(rows, [key, "previous_seq", "_source"]).drop("_source")
    both = same.unionByName(other)
    move = lambda kind, c: F.when(~F.col(f"_before.{c}").eqNullSafe(F.col(f"_after.{c}")), F.struct(F.lit(kind).alias("kind"), F.col(f"_before.{c}").cast("string").alias("was"), F.col(f"_after.{c}").cast("string").alias("now")))
    told = F.filter(F.array(move("price_change", price), move("status_change", status)), lambda x: x.isNotNull())
    return both.select(key, "run_seq", F.explode(told).alias("m")).select(key, "run_seq", "m.kind", "m.was", "m.now")


def price_story(snapshots: DataFrame, key: str = "entity", seq: str = "run_seq", at: str = "ts", price: str = "price") -> DataFrame:
    """Per entity: first and last known price, whether it was ever cut, days from first sighting to the first raise."""
    known = snapshots.where(F.col(price).isNotNull())
    stepped = known.withColumn("_before", F.lag(price).over(W.partitionBy(key).orderBy(seq)))
    first_seen = snapshots.groupBy(key).agg(F.min(at).alias("first_seen"))
    told = stepped.groupBy(key).agg(
        F.min_by(price, seq).alias("first_price"), F.max_by(price, seq).alias("last_price"),
        F.coalesce(F.bool_or(F.col(price) < F.col("_before")), F.lit(False)).alias("price_cut"), F.min(F.when(F.col(price) > F.col("_before"), F.col(at))).alias("_raise"),
    )
    days = F.greatest(F.lit(0).cast("bigint"), F.timestamp_diff("DAY", F.col("first_seen"), F.col("_raise")))
    return first_seen.join(told, key, "left").select(key, "first_price", "last_price", F.coalesce("price_cut", F.lit(False)).alias("price_cut"), F.when(F.col("_raise").isNotNull(), days).alias("raise_days"))


def previous_runs(runs: DataFrame) -> DataFrame:
    """(search, run_seq, previous_seq, reset): each run with the completed run before it of the same search and revision.

    A null revision equals a null one.  `reset` marks a run that has none, although the
    search has completed runs of other revisions: its definition changed.
    """
    done = F.when(F.col("status") == "completed", F.col("run_seq"))
    before = lambda *keys: W.partitionBy(*keys).orderBy("run_seq").rowsBetween(W.unboundedPreceding, -1)
    told = runs.select("search", "run_seq", F.max(done).over(before("search", "revision")).alias("previous_seq"), F.max(done).over(before("search")).alias("_any"))
    return told.select("search", "run_seq", "previous_seq", (F.col("previous_seq").isNull() & F.col("_any").isNotNull()).alias("reset"))


def identity_of_run(frozen: DataFrame, live: DataFrame, run: int) -> DataFrame:
    """(id, live) as a run saw it: what was frozen at its end, or the present identity if nothing was.

    frozen: (run_seq, id, live), one whole mapping a run; live: (id, live).
    """
    own = frozen.where(F.col("run_seq") == run)
    kept = own.agg((F.count("*") > 0).alias("_frozen"))
    return own.select("id", "live").unionByName(live.crossJoin(F.broadcast(kept)).where(~F.col("_frozen")).select("id", "live"))


def seen_by_search(snapshots: DataFrame, runs: DataFrame, live: DataFrame, search: str, key: str = "entity") -> DataFrame:
    """Live entities that a completed run of a search has observed, whatever its revision, followed through merges."""
    own = runs.where((F.col("search") == search) & (F.col("status") == "completed")).select("run_seq")
    seen = snapshots.join(own, "run_seq", "left_semi").select(F.col(key).alias("_id")).distinct()
    return seen.join(live, seen["_id"] == live["id"], "left").select(F.coalesce("live", "_id").alias(key)).distinct()


def observed_as(snapshots: DataFrame, runs: DataFrame, live: DataFrame, key: str = "entity") -> DataFrame:
    """Snapshots of completed runs with each run's search and the entity's live id."""
    done = runs.where(F.col("status") == "completed").select("run_seq", "search", "revision")
    named = live.select(F.col("id").alias(key), "live")
    return snapshots.join(done, "run_seq").join(named, key)


def current_candidates(snapshots: DataFrame, merged: DataFrame, key: str = "entity") -> DataFrame:
    """Each live entity's latest snapshot, for one that was merged but never seen since that of its constituents."""
    latest = latest_per_key(snapshots, [key], ["run_seq", "event_id"])
    return latest.unionByName(stand_ins(merged, snapshots, key).withColumnRenamed("live", key))


def baseline_since(runs: DataFrame, moment: str) -> DataFrame:
    """The latest completed run of each search that began by a moment."""
    done = runs.where((F.col("status") == "completed") & (F.col("started_at") <= F.lit(moment).cast("timestamp_ntz")))
    return done.groupBy("search").agg(F.max("run_seq").alias("baseline_seq"))


def stand_ins(merged: DataFrame, snapshots: DataFrame, key: str = "entity", seq: str = "run_seq") -> DataFrame:
    """For live entities never observed under their own id, the latest snapshot of their constituents; merged is (constituent, live)."""
    own = snapshots.select(F.col(key).alias("live")).distinct()
    lacking = merged.join(own, "live", "left_anti")
    rows = lacking.join(snapshots, lacking["constituent"] == snapshots[key]).drop("constituent", key)
    return latest_per_key(rows, ["live"], [seq, "event_id"])


def histories(snapshots: DataFrame, key: str = "entity", seq: str = "run_seq", price: str = "price") -> DataFrame:
    """Each entity's (run, price) pairs in run order, as one array: sorted inside, since a collected list has no order."""
    return snapshots.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(seq, price))).alias("history"))


def running(passes: DataFrame, now: Column, beat_seconds: int = 20, missed: int = 6) -> DataFrame:
    """Adds whether an unfinished pass still beats."""
    quiet = F.timestamp_diff("SECOND", F.col("updated_at"), now)
    return passes.withColumn("state", F.when(F.col("finished_at").isNotNull(), "finished").when(quiet > beat_seconds * missed, "stopped").otherwise("running"))


def run_states(log: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, state): the last of completed and failed in a run's log by seq; one that has neither is running and is read by nobody."""
    ended = F.col("state").isin("completed", "failed")
    return log.groupBy(run).agg(F.coalesce(F.max_by(F.when(ended, F.col("state")), F.when(ended, F.col("seq"))), F.lit("running")).alias("state"))
