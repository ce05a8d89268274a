"""Presence and heartbeats as streams with state: what disappears, what returns, what has stopped.

State lives in the state store, keyed by buckets of entities or by pass, and survives a
restart from the checkpoint; what a batch emits is committed with it, so a batch that is
run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Entities are followed in so many buckets, each of which a task holds at once; the end of a run is told to each of them.
BUCKETS = 256
#: Seconds between beats, and missed beats after which a pass has stopped.
BEAT_SECONDS, MISSED = 20, 6

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """State of this kind needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


class _Presence(StatefulProcessor):
    """One bucket: for each entity the last run that saw it and whether it has disappeared since; the last run that ended."""

    def __init__(self, entity: str):
        self.entity = entity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", f"entity {self.entity}", "last bigint, gone boolean")
        self.ended = handle.getValueState("ended", "run bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        ended = before = self.ended.get()[0] if self.ended.exists() else None
        seen = {k[0]: (v[0], v[1]) for k, v in self.seen.iterator()}
        moved = set()
        # sightings of a run before its end
        for r in sorted(rows, key=lambda r: (r["run_seq"], r["healthy"] is not None)):
            run, entity = r["run_seq"], r["entity"]
            if ended is not None and run <= ended:
                continue  # late, or told again
            if r["healthy"] is None:
                last, gone = seen.get(entity, (None, False))
                if gone:
                    yield Row(entity=entity, run_seq=run, event="returned")
                if last is None or gone or run > last:
                    seen[entity] = run, False
                    moved.add(entity)
                continue
            for entity, (last, gone) in seen.items() if r["healthy"] else ():
                if not gone and last < run:
                    seen[entity] = last, True
                    moved.add(entity)
                    yield Row(entity=entity, run_seq=run, event="disappeared")
            ended = run
        for entity in moved:
            self.seen.updateValue((entity,), seen[entity])
        if ended != before:
            self.ended.update((ended,))

    def close(self) -> None:
        pass


def presence_stream(sightings: DataFrame, ends: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(entity, run_seq, event): each entity's disappearances and returns, as runs end.

    sightings: a stream of (entity, run_seq); ends: a stream of (run_seq, healthy), one for
    each run that ended, in order.  Only the end of a healthy run makes what it didn't see
    disappear.  A sighting that comes after its run ended belongs to no run; told again,
    neither it nor an end changes anything.  Rows without an entity are nobody's.
    """
    kind = sightings.schema["entity"].dataType.simpleString()
    seen = sightings.where(F.col("entity").isNotNull()).select(F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int").alias("bucket"), "entity", F.col("run_seq").cast("bigint").alias("run_seq"), F.lit(None).cast("boolean").alias("healthy"))
    told = ends.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(None).cast(kind).alias("entity"), F.col("run_seq").cast("bigint").alias("run_seq"), F.coalesce("healthy", F.lit(False)).alias("healthy"))
    rows = seen.unionByName(told).groupBy("bucket")
    return rows.transformWithState(_Presence(kind), f"entity {kind}, run_seq bigint, event string", "append", "none")


class _Beats(StatefulProcessor):
    """One pass: its last beat, in microseconds, and a timer that goes off when beats stay away."""

    def __init__(self, limit: timedelta):
        self.limit = int(limit.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_us", "at_us bigint, finished boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if key[0] is None:
            return iter(())
        last, finished = self.last.get() if self.last.exists() else (None, False)
        for r in rows:
            finished = finished or bool(r["finished"])
            if r["at_us"] is not None:
                at = int(r["at_us"])
                last = at if last is None else max(last, at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None and not finished:
            # watermarks are whole milliseconds, and a timer goes off when one reaches it: past the limit is one more
            self.handle.registerTimer(last // 1000 + self.limit + 1)
        self.last.update((last, finished))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        last, _ = self.last.get()
        yield Row(pass_id=key[0], last_beat_us=last, state="stopped")

    def close(self) -> None:
        pass


def stopped_passes(beats: DataFrame, late: str = "0 seconds", beat_seconds: int = BEAT_SECONDS, missed: int = MISSED) -> DataFrame:
    """(pass_id, last_beat_ms, state, last_beat): passes whose beats have stayed away for `missed` of them, told once a silence, when the watermark is past it.

    beats: a stream of (pass_id, at, finished); `at` is a timestamp, and finished passes need no more beats.
    A beat without a time can only finish its pass; one without a pass is nobody's, but moves the watermark.
    Watermarks begin at 1970: what is from before, or from its first moment, is late.
    """
    kind = beats.schema["pass_id"].dataType.simpleString()
    marked = beats.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    told = f"pass_id {kind}, last_beat_us bigint, state string"
    out = marked.groupBy("pass_id").transformWithState(_Beats(timedelta(seconds=beat_seconds * missed)), told, "append", "eventTime")
    last = F.timestamp_micros("last_beat_us")
    return out.select("pass_id", F.unix_millis(last).alias("last_beat_ms"), "state", last.alias("last_beat"))
