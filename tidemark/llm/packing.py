"""Best-fit decreasing packing of token sequences.

Pieces of documents are packed longest first, each into the open sequence with the
least room that it fits.  How a piece fits depends on its length only, so the packing
of a corpus of any size follows from the number of pieces of each length: the driver
gets these (at most as many as a sequence has tokens), walks the lengths from the
longest down, asks a segment tree over remaining capacities for the tightest open
sequences, and fills those of one capacity as a run.  The plan is a few thousand runs;
each piece finds its place in it by its number among the pieces of its length.  The
result is exactly what best-fit decreasing gives when it takes the pieces one by one.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bound_batches, cut, partitions, table
from tidemark.sources.tables import Scratch

SEQUENCE_TOKENS = 2048
#: The id that ends a document.
END_ID = 0
#: Pieces that are numbered together.
PART_ROWS = 50_000


class CapacityTree:
    """A segment tree over remaining capacities 0..size: which of them any open sequence has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = [False] * (2 * self.leaves)

    def mark(self, capacity: int, some: bool) -> None:
        at = capacity + self.leaves
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest marked capacity that is at least `least`."""
        at = least + self.leaves
        if self.some[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_runs(counts: Mapping[int, int], size: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for counts[length] pieces of each length, as runs (length, first, sequence, offset, each).

    Pieces of that length numbered first, first + 1, ... (up to the next run) go `each` to a
    sequence, from number `sequence` on, the first of a sequence at `offset`.
    """
    open_at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by capacity: (first sequence, how many)
    tree = CapacityTree(size)
    runs, used = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_at[capacity].append((first, n))
            tree.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens doesn't fit a sequence of {size}")
        left, at = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                new = -(-left // (size // length))
                put(size, used, new)
                used += new
                continue
            first, n = open_at[room].pop()
            if not open_at[room]:
                tree.mark(room, False)
            # a sequence that got a piece is the tightest for the next one as long as that fits
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, at, first, size - room, each))
                at, left = at + full * each, left - full * each
                put(room - each * length, first, full)
            if full < n and 0 < left < each:
                runs.append((length, at, first + full, size - room, left))
                put(room - left * length, first + full, 1)
                at, left, full = at + left, 0, full + 1
            put(room, first + full, n - full)
    return runs


class Plan:
    """Looks up places of pieces in the runs of a packing."""

    def __init__(self, runs: list[tuple[int, int, int, int, int]]):
        rows = np.array(sorted(runs), np.int64).reshape(-1, 5)
        self.length, self.first, self.sequence, self.offset, self.each = rows.T
        self.starts = {int(n): (int(a), int(b)) for n, a, b in zip(*self._spans(), strict=True)}

    def _spans(self):
        lengths, begin = np.unique(self.length, return_index=True)
        return lengths, begin, np.append(begin[1:], len(self.length))

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of given lengths and numbers."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            a, b = self.starts[n]
            own = np.flatnonzero(length == n)
            run = a + np.searchsorted(self.first[a:b], number[own], side="right") - 1
            past = number[own] - self.first[run]
            sequence[own] = self.sequence[run] + past // self.each[run]
            offset[own] = self.offset[run] + past % self.each[run] * n
        return sequence, offset


@lru_cache(maxsize=1)
def encoder(tokenizer: str):
    """A function from a text to its ids (uint32), for the JSON of a byte-level BPE tokenizer.

    tiktoken runs the same merges four times as fast as the library whose format this
    is; that library is used for vocabularies whose ids don't follow their merges.
    """
    told = json.loads(tokenizer)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and told.get("normalizer") is None
    if plain and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True):
        special = {x["content"]: x["id"] for x in told.get("added_tokens", ()) if x["special"]}
        alphabet = _byte_of()
        ranks = {bytes(map(alphabet.__getitem__, w)): i for w, i in model["vocab"].items() if w not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merged = [model["vocab"][a + b] for a, b in pairs]
        if merged == sorted(set(merged)) and all(bytes([b]) in ranks for b in range(256)) and len(merged) + 256 == len(ranks):
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=GPT_WORDS, mergeable_ranks=ranks, special_tokens=special)
            return lambda text: own.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(tokenizer)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


#: How byte-level BPE splits a text into words (a fixed value of the format).
GPT_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def tokenizer_text(path: str) -> str:
    """A tokenizer's JSON, read by the driver and sent along with the tasks, so that executors need no such file."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE_TOKENS, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32) and ids if asked for: each document's tokens with END_ID after, cut if over `size`.

    All pieces of a document but the first have `size` tokens.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value)
        for batch in batches:
            rows, cells = [], {"piece": [], "start": [], "length": [], "ids_crc32": []}
            ids_out: list[bytes] = []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                first = (len(ids) - 1) % size + 1
                for piece, start in enumerate([0, *range(first, len(ids), size)]):
                    part = ids[start : start + size] if piece else ids[:first]
                    rows.append(row)
                    for c, v in (("piece", piece), ("start", start), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes()))):
                        cells[c].append(v)
                    if with_ids:
                        ids_out.append(part.tolist())
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cells["piece"], pa.int32()), *(pa.array(cells[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids_out, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    more = [T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []
    return docs.select(F.col(f"`{key}`").alias(key), F.col("text")).mapInArrow(work, T.StructType([*fields, *more]))


def place(cut_up: DataFrame, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to stored rows that have `length` and a number `row` of their own.

    Rows are numbered within their length in parts of some PART_ROWS rows, dealt by hash
    of the row's number, so no length is one task's, however many rows have it.  The
    driver gets a count for each length.
    """
    spark = cut_up.sparkSession
    parts = max(partitions(spark), -(-cut_up.count() // PART_ROWS))
    dealt = cut_up.withColumn("_part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_runs(by_length, size))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    prior = counts.select("_part", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part", "length").orderBy("row"))
    numbered = dealt.withColumn("_number", number).join(prior, ["_part", "length"]).withColumn("_number", F.col("_number") - 1 + F.col("_before")).drop("_part", "_before")
    schema = T.StructType([*(f for f in numbered.schema.fields if f.name not in ("_number", "row")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked_up = Plan(plan.value)
        for batch in batches:
            told = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sequence, offset = looked_up.places(told["length"].to_numpy(), told.pop("_number").to_numpy())
            told.pop("row")
            told |= {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays(list(told.values()), list(told))

    return numbered.mapInArrow(work, schema)


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE_TOKENS, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document; ids too if asked for.

    tokenizer: a byte-level BPE tokenizer's JSON.  A null text is an empty one, whose only
    token is END_ID.  Every row is a document, so repeated rows and ids get places of their
    own; null ids stay null.  Ties are settled by any order, which changes no sequence's
    room.  An empty table has no pieces.  Columns besides key and text are not read.
    """
    with Scratch() as keep:
        cut_up = keep(pieces(docs, tokenizer, size, key, with_ids).withColumn("row", F.monotonically_increasing_id()))
        placed = place(cut_up, size)
        order = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        return cut(placed.select(*[F.col(f"`{c}`") for c in order]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, of pack(..., with_ids=True)."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Where every piece of every document goes when all are packed into sequences of 2048 tokens; tokenizer: a path."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(table(spark, sf_dir, "documents"), tokenizer_text(tokenizer))
