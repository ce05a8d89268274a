"""Documents in stored blocks, and the exchange that finds keys that several blocks hold.

Documents are dealt by hash into blocks of a few megabytes, written once as a
bucketed table; each pass over a block's texts then needs no further shuffle of
them.  A pass turns a block into a sorted array of distinct 64-bit keys; slices of
these meet in buckets by key range, one bucket at a time in a task, and what comes
back is flags in the same order, not keys.  A key that very many texts hold is sent
once a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.common import partitions
from tidemark.sources.tables import delete, shared_folder, store_at

BLOCK_BYTES = 4 << 20
BUCKET_KEYS = 2 << 20
#: Text bytes of one file of the stored blocks, up to MAX_FILES; a task reads one file.
FILE_BYTES = 128 << 20
MAX_FILES = 100_000


#: What owns a key: a text's id and hash, the least of which comes first.
OWNER = np.dtype([("id", "<i8"), ("text", "<u8")])


class Blocks:
    def __init__(self, docs: DataFrame, key: str = "doc_id", block_bytes: int = BLOCK_BYTES):
        """Stores (key, text) of docs as a table of a name of its own, until drop()."""
        self.spark = docs.sparkSession
        rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
        self.bytes = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        self.count = max(1, -(-self.bytes // block_bytes))
        self.files = max(1, min(self.count, max(4 * partitions(self.spark), -(-self.bytes // FILE_BYTES)), MAX_FILES))
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(self.count)).cast("int"))
        self.name = f"tidemark_blocks_{uuid.uuid4().hex}"
        # the shared folder, not the warehouse, which may be each machine's own
        self.paths = [f"{shared_folder(self.spark)}/{self.name}"]
        dealt.repartition(self.files, "block").write.option("path", self.paths[0]).bucketBy(self.files, "block").format("parquet").saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def drop(self) -> None:
        """Deletes the stored blocks and what was resolved about them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        for path in self.paths:
            delete(self.spark, path)

    def buckets(self, keys_per_byte: float) -> int:
        return max(partitions(self.spark), int(self.bytes * keys_per_byte / BUCKET_KEYS) + 1)

    def keys(self, make: Callable[[pa.Table, dict], tuple[np.ndarray, np.ndarray | None]], buckets: int, flags: DataFrame | None = None) -> DataFrame:
        """(bucket, block, keys, ids): each block's sorted distinct keys, sliced by bucket."""
        edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

        def sliced(block: int, texts: pa.Table, told: dict) -> pa.Table:
            keys, ids = make(texts, told)
            at = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)
            some = np.flatnonzero(np.diff(at))
            sizes = np.diff(at)[some]
            return pa.table(
                {
                    "bucket": pa.array(some, pa.int32()),
                    "block": pa.array(np.full(len(some), block), pa.int32()),
                    "keys": _binaries(keys, sizes),
                    "ids": pa.nulls(len(some), pa.binary()) if ids is None else _binaries(ids, sizes),
                }
            )

        return self._run(sliced, "bucket int, block int, keys binary, ids binary", flags)

    def finish(self, make: Callable[[pa.Table, dict], pa.Table], schema: str, flags: DataFrame) -> DataFrame:
        return self._run(lambda _, texts, told: make(texts, told), schema, flags)

    def _run(self, work, schema: str, flags: DataFrame | None) -> DataFrame:
        if flags is None:
            return self.table.groupBy("block").applyInArrow(lambda key, texts: work(key[0].as_py(), texts, {}), schema)

        def both(key, texts: pa.Table, told: pa.Table) -> pa.Table:
            return work(key[0].as_py(), texts, _told(told)) if texts.num_rows else pa.Table.from_batches([], schema=work_schema)

        work_schema = _arrow(schema)
        return self.table.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(both, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive slices of an array as binary values, without a copy for each."""
    offsets = np.concatenate(([0], np.cumsum(sizes))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _laid_out(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column end to end, as numbers, and how many each row has."""
    whole = pa.concat_arrays(column.cast(pa.large_binary()).chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if not len(whole):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, kind), np.diff(at)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind), np.diff(at) // np.dtype(kind).itemsize


_SHARED, _FIRST = 1, 2


def _told(flags: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By pass: for each of the block's keys in order whether others hold it, whether this block is the first, and the least owner."""
    out = {}
    for name in pa.compute.unique(flags["pass"]).to_pylist():
        own = flags.filter(pa.compute.equal(flags["pass"], name)).sort_by("bucket")
        bits = _laid_out(own["flags"], np.uint8)[0]
        out[name] = bits & _SHARED > 0, bits & _FIRST > 0, _laid_out(own["low"], OWNER)[0]
    return out


def resolve(store: Blocks, keys: DataFrame, name: str) -> DataFrame:
    """For each slice of keys, flags that tell which keys are in another block too and where a shared key's first block is.

    With owners (OWNER), also the least one over all blocks of every shared key.  Stored,
    as later passes read it again.
    """

    def meet(table: pa.Table) -> pa.Table:
        table = table.select(["block", "bucket", "keys", "ids"]).sort_by("block")
        merged, sizes = _laid_out(table["keys"], np.uint64)
        order = np.argsort(merged, kind="stable")
        ordered = merged[order]
        same = np.zeros(len(ordered) + 1, bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        shared, first = np.empty(len(merged), bool), np.empty(len(merged), bool)
        shared[order] = same[1:] | same[:-1]
        first[order] = ~same[:-1]
        low = pa.nulls(len(table), pa.binary())
        if table["ids"].null_count == 0:
            owners = _laid_out(table["ids"], OWNER)[0][order]
            starts = np.flatnonzero(~same[:-1])
            spread = lambda x: np.repeat(x, np.diff(np.append(starts, len(merged))))
            lows = np.empty(len(merged), OWNER)
            low = spread(np.minimum.reduceat(owners["id"], starts)) if len(starts) else owners["id"]
            texts = np.where(owners["id"] == low, owners["text"], np.iinfo(np.uint64).max)
            lows["id"][order] = low
            lows["text"][order] = spread(np.minimum.reduceat(texts, starts)) if len(starts) else texts
            row = np.repeat(np.arange(len(sizes)), sizes)
            low = _binaries(lows[shared], np.bincount(row[shared], minlength=len(sizes)))
        flags = shared * np.uint8(_SHARED) + first * np.uint8(_FIRST)
        return pa.table({"pass": pa.array([name] * len(table), pa.string()), "block": table["block"], "bucket": table["bucket"], "flags": _binaries(flags, sizes), "low": low})

    found, path = store_at(keys.groupBy("bucket").applyInArrow(meet, "pass string, block int, bucket int, flags binary, low binary"))
    store.paths.append(path)
    return found


def segments(texts: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of a block's texts, about a megabyte at a time, in an order that doesn't change."""
    order = np.lexsort((texts["text"].to_numpy(), texts["id"].fill_null(np.iinfo(np.int64).max).to_numpy()))
    ordered = texts.select(["id", "text"]).take(pa.array(order)).combine_chunks()
    for batch in ordered.to_batches():
        for rows, data, offsets in tb.segments(batch, "text"):
            yield rows.column(0), data, offsets


def distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a block's segments and how often each is there."""
    return np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)


def marked(keys: np.ndarray, uniq: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The mark of each key."""
    return mark[np.searchsorted(uniq, keys)] if len(uniq) else np.zeros(0, bool)
