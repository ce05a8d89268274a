"""Files inside zip archives: members are dealt over tasks, and each is read as a stream from where the archive lies.

Spark lists the archives; tasks read their directories, and after one exchange of
(archive, member) a task has members, not archives.  A member is unpacked piece by piece
from the archive's own file, so memory follows neither, and an archive may be of any size.
Files are reached through pyarrow, which takes the file systems that it knows.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Records, and about as many characters, that a task holds at most (one record is never cut).
BATCH_ROWS, BATCH_CHARS = 10_000, 4_000_000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    local = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(path)


class _Raw(io.RawIOBase):
    """A file of pyarrow's that says no to places before its start as Python's files do, which reading a very small archive relies on."""

    def __init__(self, file: pa.NativeFile) -> None:
        self._file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._file.tell(), io.SEEK_END: self._file.size()}[whence]
        if at < 0:
            raise OSError(f"no such place: {at}")
        return self._file.seek(at)

    def readinto(self, buffer: memoryview) -> int:
        return self._file.readinto(buffer)

    def close(self) -> None:
        self._file.close()
        super().close()


def open_file(path: str) -> io.BufferedReader:
    """A file that can be read from any place of it, a megabyte at a time."""
    files, inner = _place(path)
    return io.BufferedReader(_Raw(files.open_input_file(inner)), 1 << 20)


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, entry, member, bytes) of the files in zip archives: their place in the archive's directory, name and unpacked size; folders are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with open_file(archive) as raw, zipfile.ZipFile(raw) as z:
                    found = [(archive, i, m.filename, m.file_size) for i, m in enumerate(z.infolist()) if not m.is_dir()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["archive", "entry", "member", "bytes"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "archive string, entry int, member string, bytes long")


def records(held: DataFrame, encoding: str = "utf-8-sig") -> DataFrame:
    """(archive, member, number, header, fields): every record of comma-separated members after the first, which is the header.

    Quoted fields may hold commas, quotes and line breaks.  Blank lines are no records.
    Bytes that aren't of the encoding become U+FFFD.  A member without a header gives
    nothing.  Of members by one name in an archive each is read.  A member is one task's,
    as it can be unpacked only from its start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            named = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for archive, entries in groupby(named, itemgetter(0)):
                with open_file(archive) as raw, zipfile.ZipFile(raw) as z:
                    for _, entry, member in entries:
                        with z.open(z.infolist()[entry]) as packed:
                            yield from _batches(archive, member, csv.reader(io.TextIOWrapper(packed, encoding, "replace", newline="")))

    # with a number of partitions given, as Spark would else run such small rows in one task
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.select("archive", "entry", "member").repartition(tasks, "archive", "entry").sortWithinPartitions("archive", "entry")
    return dealt.mapInArrow(run, "archive string, member string, number long, header array<string>, fields array<string>")


def _batches(archive: str, member: str, lines: Iterable[list[str]]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())
    header: list[str] | None = None
    fields: list[list[str]] = []
    chars, done = 0, 0

    def batch() -> pa.RecordBatch:
        n = len(fields)
        numbers = pa.array(range(done, done + n), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([archive] * n), pa.array([member] * n), numbers, pa.array([header] * n, texts), pa.array(fields, texts)], ["archive", "member", "number", "header", "fields"])

    for line in lines:
        if not line:
            continue
        if header is None:
            header = [name.strip() for name in line]
            continue
        fields.append(line)
        chars += sum(map(len, line)) + sum(map(len, header))
        if len(fields) == BATCH_ROWS or chars >= BATCH_CHARS:
            yield batch()
            done, chars, fields = done + len(fields), 0, []
    if fields:
        yield batch()


def _cell(text: Column, kind: T.DataType) -> Column:
    """A field by its type: null if it is empty or can't be read as that."""
    text = F.nullif(text, F.lit(""))
    return text if isinstance(kind, T.StringType) else F.trim(text).try_cast(kind)


def zipped_csv(spark: SparkSession, path: str, schema: str, keep: Column | None = None, by_name: Sequence[str] | None = None) -> DataFrame:
    """Rows of comma-separated files with a header in zip archives, by an explicit schema.

    Columns go by position; a record that is short has nulls, and what it has beyond the
    schema is left out.  With by_name they go by the header instead, in whatever order a
    member has them: a member that lacks one of the names in by_name is an error, which
    tells the member and the name, and other columns that it lacks are null.  Of columns
    that one header names twice the first counts.  An empty field is null, and so is one
    that its type can't be read from.
    """
    read = records(members(spark, path))
    kinds = T.StructType.fromDDL(schema).fields
    if by_name is None:
        out = read.select(*[_cell(F.get("fields", F.lit(i)), f.dataType).alias(f.name) for i, f in enumerate(kinds)])
    else:
        needed = F.array_except(F.array(*[F.lit(c) for c in by_name]).cast("array<string>"), F.col("header"))
        told = F.concat(F.lit("columns are missing in "), "archive", F.lit("!"), "member", F.lit(": "), F.array_join(needed, ", "))
        whole = read.where(F.when(F.size(needed) > 0, F.raise_error(told).cast("boolean")).otherwise(True))
        at = lambda name: F.array_position("header", name).cast("int")  # noqa: E731  0 for none
        out = whole.select(*[F.when(at(f.name) > 0, _cell(F.get("fields", at(f.name) - 1), f.dataType)).alias(f.name) for f in kinds])
    return out if keep is None else out.where(keep)


def write_zipped_csv(df: DataFrame, path: str) -> int:
    """Writes rows as comma-separated members of zip archives, an archive for each partition and a member for each Arrow batch; how many rows that were.

    A task writes to a name that Spark passes over and moves that to the archive's when it
    is whole, so tasks that are run again leave one archive, and no part of one is read.
    Nulls are empty fields.  The folder is made in any case, if only for no rows.
    """
    names = df.columns
    files, folder = _place(path)
    files.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, folder = _place(path)
        name, rows = f"part-{task.partitionId():06d}", 0
        beside = f"{folder}/_{name}.{task.taskAttemptId()}"
        with files.open_output_stream(beside, compression=None) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for i, batch in enumerate(batches):
                with z.open(f"{i:06d}.csv", "w", force_zip64=True) as packed, io.TextIOWrapper(packed, "utf-8", newline="") as text:
                    out = csv.writer(text)
                    out.writerow(names)
                    out.writerows(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                rows += batch.num_rows
        files.move(beside, f"{folder}/{name}.zip")
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    return texts.mapInArrow(run, "rows long").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
