"""Runs that count as a whole or not at all: a data source whose writes commit, and whose reads see committed runs only.

    runs.register(spark)
    runs.start(spark, path, 7, search="north")
    runs.record(rows, path, 7, "shop")          # a failing task leaves nothing behind
    runs.complete(spark, path, 7)               # or runs.fail(...)
    runs.committed(spark, path, "id long, price double, run bigint, source string", first=5)

Tasks write Parquet files of an attempt of their own and report them; the driver's commit
names them in a manifest, in one file that appears at once.  A source's last manifest
holds, so what died half-way can be recorded again, and a run without the mark of its
completion isn't read.  Paths are URIs of a file system that pyarrow knows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "tidemark_runs"
RUNNING, COMPLETED, FAILED = "running", "completed", "failed"


class _Log:
    """The folder of a run table: data files, and one small JSON file for each fact about a run."""

    def __init__(self, path: str):
        local = path.removeprefix("file://").removeprefix("file:")
        self.files, self.base = (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(path)

    def say(self, name: str, fact: dict) -> None:
        """Writes a fact beside the log, then moves it in, so that nobody reads a half of it."""
        folder = f"{self.base}/_log"
        self.files.create_dir(folder, recursive=True)
        half = f"{folder}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(half) as out:
            out.write(json.dumps(fact).encode())
        self.files.move(half, f"{folder}/{name}.json")

    def facts(self) -> list[dict]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.base}/_log", allow_not_found=True))
        out = []
        for info in found:
            if info.is_file and info.base_name.endswith(".json"):
                with self.files.open_input_stream(info.path) as given:
                    out.append(json.loads(given.read()))
        return sorted(out, key=lambda f: f["at"])


def _fact(kind: str, run: int, **more) -> dict:
    return {"kind": kind, "run": run, "at": time.time_ns(), **more}


def start(spark: SparkSession, path: str, run: int, search: str = "", revision: str | None = None) -> None:
    """Notes that a run began.  A run that completed is over and can't begin again."""
    log = _Log(path)
    if _states(log.facts()).get(run) == COMPLETED:
        raise ValueError(f"run {run} is complete")
    log.say(f"run-{run}-start-{uuid.uuid4().hex}", _fact("start", run, search=search, revision=revision))


def record(rows: DataFrame, path: str, run: int, source: str) -> None:
    """Writes what one source gave to a run, whole or not at all; recorded again, it replaces what the source gave before."""
    rows.write.format(FORMAT).mode("append").option("path", path).option("run", run).option("source", source).save()


def complete(spark: SparkSession, path: str, run: int) -> None:
    _end(path, run, COMPLETED)


def fail(spark: SparkSession, path: str, run: int) -> None:
    """The run isn't read, whatever it recorded; it may be repeated."""
    _end(path, run, FAILED)


def _end(path: str, run: int, state: str) -> None:
    log = _Log(path)
    known = _states(log.facts())
    if run not in known:
        raise ValueError(f"run {run} never began")
    if known[run] == COMPLETED:
        raise ValueError(f"run {run} is complete")
    log.say(f"run-{run}-{state}-{uuid.uuid4().hex}", _fact(state, run))


def _states(facts: list[dict]) -> dict[int, str]:
    """Each run's state by its last fact; a start after a failure makes it run again."""
    out: dict[int, str] = {}
    for f in facts:
        if f["kind"] in ("start", COMPLETED, FAILED) and out.get(f["run"]) != COMPLETED:
            out[f["run"]] = RUNNING if f["kind"] == "start" else f["kind"]
    return out


def _manifests(facts: list[dict]) -> dict[tuple[int, str], dict]:
    """The files of each run and source that hold: the last recorded since the run last began."""
    out: dict[tuple[int, str], dict] = {}
    for f in facts:
        if f["kind"] == "start":
            out = {k: v for k, v in out.items() if k[0] != f["run"]}
        elif f["kind"] == "recorded":
            out[f["run"], f["source"]] = f
    return out


def states(spark: SparkSession, path: str) -> DataFrame:
    """(run, state, sources, rows): every run that began, and what it recorded."""
    facts = _Log(path).facts()
    held = _manifests(facts)
    rows = [(run, state, sum(1 for k in held if k[0] == run), sum(f["rows"] for k, f in held.items() if k[0] == run)) for run, state in _states(facts).items()]
    return spark.createDataFrame(rows, "run bigint, state string, sources int, rows bigint")


@dataclass
class _Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    rows: int = 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.run, self.source = options["path"], int(options["run"]), options["source"]
        self.attempt = uuid.uuid4().hex
        self.names = schema.fieldNames()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        log, told, out = _Log(self.path), _Written(), None
        folder = f"data/run={self.run}/{self.attempt}"
        name = f"{folder}/{uuid.uuid4().hex}.parquet"
        try:
            for batch in iterator:
                if out is None:
                    log.files.create_dir(f"{log.base}/{folder}", recursive=True)
                    out = pq.ParquetWriter(f"{log.base}/{name}", batch.schema, filesystem=log.files)
                    told.files.append(name)
                out.write_batch(batch)
                told.rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return told

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        told = [m for m in messages if m is not None]
        _Log(self.path).say(f"run-{self.run}-recorded-{self.attempt}", _fact("recorded", self.run, source=self.source, files=[f for m in told for f in m.files], rows=sum(m.rows for m in told), columns=self.names))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        log = _Log(self.path)
        folder = f"{log.base}/data/run={self.run}/{self.attempt}"
        if log.files.get_file_info(folder).type == fs.FileType.Directory:
            log.files.delete_dir(folder)


class _File(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"], schema
        self.asked = json.loads(options.get("asked", "{}"))

    def _chosen(self, run: int, source: str) -> bool:
        first, last, sources = (self.asked.get(k) for k in ("first", "last", "sources"))
        return (first is None or run >= first) and (last is None or run <= last) and (sources is None or source in sources)

    def partitions(self) -> list[InputPartition]:
        facts = _Log(self.path).facts()
        known = _states(facts)
        return [_File((run, source, name)) for (run, source), f in sorted(_manifests(facts).items()) if known.get(run) == COMPLETED and self._chosen(run, source) for name in f["files"]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # there was nothing to plan
            return
        run, source, name = partition.value
        log, wanted = _Log(self.path), to_arrow_schema(self.schema)
        with log.files.open_input_file(f"{log.base}/{name}") as given:
            parquet = pq.ParquetFile(given)
            there = [c for c in wanted.names if c in parquet.schema_arrow.names]
            for batch in parquet.iter_batches(columns=there):
                fixed = {"run": run, "source": source}
                columns = [batch.column(there.index(f.name)).cast(f.type) if f.name in there else pa.array([fixed.get(f.name)] * batch.num_rows, f.type) for f in wanted]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)


class RunTable(DataSource):
    """Runs of a path; read with a schema, whose columns `run` and `source` say where a row is from, or those recorded first."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("give the schema of a run table")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("runs are only ever appended")
        return _Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RunTable)


def committed(spark: SparkSession, path: str, schema: str | T.StructType, first: int | None = None, last: int | None = None, sources: Sequence[str] | None = None) -> DataFrame:
    """Rows of the completed runs from first to last and of the named sources; files of others aren't opened.

    The bounds belong to this read.  Spark's own pushing of filters into sources is not
    used: it keeps with a loaded source what one use of it pushed, for all later uses.
    """
    asked = {"first": first, "last": last, "sources": None if sources is None else list(sources)}
    return spark.read.format(FORMAT).option("path", path).option("asked", json.dumps(asked)).schema(schema).load()
