"""Snapshots kept by run, with full states in between, so that a state at a point is read without the history before it.

Every run is a folder of its own, and after every so many runs the latest row of each key
is written down as a base.  The state at a run is then that of the last base, and the few
runs after it: other folders aren't listed, let alone read.  A run may be written again;
bases that it went into are dropped before and folded anew after.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.history import latest_per_key
from tidemark.sources.tables import delete, replace_partitions


class StateTable:
    """Snapshots at a path by run.  `schema` names all columns, the key and the run among them; `tie` orders rows of one run."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str = "entity", seq: str = "run_seq", tie: Sequence[str] = ("event_id",), every: int = 8):
        if every < 1:
            raise ValueError("a base covers at least one run")
        self.spark, self.path, self.key, self.seq, self.tie, self.every = spark, path, key, seq, list(tie), every
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def write(self, snapshots: DataFrame) -> None:
        """Adds runs, or replaces those that snapshots has rows of; rows without a run are an error."""
        lowest, unplaced = snapshots.agg(F.min(self.seq), F.count_if(F.col(self.seq).isNull())).first()
        if unplaced:
            raise ValueError(f"{unplaced} rows have no {self.seq}")
        if lowest is None:
            return
        for base in self._folders("bases"):
            if base >= lowest:
                delete(self.spark, f"{self.path}/bases/{self.seq}={base}")
        replace_partitions(snapshots.select(*self.schema.fieldNames()), f"{self.path}/runs", self.seq)
        self.fold()

    def fold(self) -> None:
        """Writes the bases that are due, each from the one before it; what died half-way has no mark of success and is written again."""
        held, runs = set(self._folders("bases")), self._folders("runs")
        for run in runs[self.every - 1 :: self.every]:
            if run not in held:
                self.asof(run).withColumnRenamed(self.seq, "_seen_in").write.mode("overwrite").parquet(f"{self.path}/bases/{self.seq}={run}")

    def asof(self, run: int) -> DataFrame:
        """The latest row of each key at or before a run."""
        base, runs = self._plan(run)
        rows = self._runs(runs)
        if base is not None:
            names = [T.StructField("_seen_in" if f.name == self.seq else f.name, f.dataType) for f in self.schema.fields]
            state = self.spark.read.schema(T.StructType(names)).parquet(f"{self.path}/bases/{self.seq}={base}")
            rows = rows.unionByName(state.withColumnRenamed("_seen_in", self.seq))
        return latest_per_key(rows, [self.key], [self.seq, *self.tie]).select(*self.schema.fieldNames())

    def recent(self, n: int, run: int | None = None) -> DataFrame:
        """All rows of the last n runs, at or before a run if one is given."""
        runs = [r for r in self._folders("runs") if run is None or r <= run]
        return self._runs(runs[max(len(runs) - n, 0) :])

    def _plan(self, run: int) -> tuple[int | None, list[int]]:
        base = max((b for b in self._folders("bases") if b <= run), default=None)
        return base, [r for r in self._folders("runs") if r <= run and (base is None or r > base)]

    def _runs(self, runs: Sequence[int]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/runs/{self.seq}={r}" for r in runs]
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/runs").parquet(*folders).select(*self.schema.fieldNames())

    def _folders(self, kind: str) -> list[int]:
        """The runs that have a folder; of bases only whole ones."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        marked = lambda p: kind == "runs" or files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        paths = [s.getPath() for s in files.listStatus(where)]
        return sorted(int(p.getName().split("=")[1]) for p in paths if p.getName().startswith(f"{self.seq}=") and marked(p))
