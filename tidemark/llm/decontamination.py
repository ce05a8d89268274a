"""Benchmark decontamination by winnowing.

Of every window of `SPAN - K + 1` consecutive K-word grams the one with the
smallest hash is kept as a fingerprint, in the documents and in the benchmark
alike, so that any `SPAN` consecutive words that they share put the same
fingerprint at the same place of both.  Fingerprints are joined, and each joint
one is extended word by word to both sides; runs of SPAN words or more are hits.
Items of fewer than SPAN words have no full window of grams: each is looked up
as one gram of its own length.

The benchmark's index is broadcast in blocks of bounded size: one block as a
rule, several if the benchmark is large, whose hits are then merged by document.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.common import bound_batches, table, without

SPAN = 10
K = 5
#: Text bytes of the benchmark that one broadcast index covers.
BLOCK_BYTES = 16 << 20


def fingerprints(g: np.ndarray, ok: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest gram of some full window; ties all count."""
    m = len(g) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    least, full = g[:m].copy(), ok[:m].copy()
    for k in range(1, window):
        np.minimum(least, g[k : k + m], out=least)
        full &= ok[k : k + m]
    chosen = np.zeros(len(g), bool)
    for k in range(window):
        chosen[k : k + m] |= full & (g[k : k + m] == least)
    return np.flatnonzero(chosen)


class Index:
    """The benchmark side of the join: fingerprints with their places, and short items by length."""

    def __init__(self, items: list[tuple[str, str | None]], span: int = SPAN, k: int = K):
        self.span, self.k, self.window = span, k, span - k + 1
        data, offsets = tb.utf8(pa.array([t for _, t in items], pa.large_string()))
        words = tb.Words(data, offsets, tb.ALNUM_LOWER)
        self.names = [n for n, _ in items]
        self.words, self.first = words.hashes(), words.first
        counts = words.counts
        self.item_of = words.row_of()
        g = tb.grams(self.words, k)
        at = fingerprints(g, self._inside(k), self.window)
        order = np.argsort(g[at], kind="stable")
        self.keys, self.at = g[at][order], at[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, span):
            rows = np.flatnonzero(counts == n)
            if len(rows):
                whole = tb.grams(self.words, n)[self.first[rows]]
                by = np.argsort(whole, kind="stable")
                self.short[n] = whole[by], rows[by]

    def _inside(self, k: int) -> np.ndarray:
        return tb.inside_row(self.first, k, len(self.words))

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Marks of hit words, and the items that occur in each row that has any."""
        mark = np.zeros(len(h) + 1, np.int64)
        found: dict[int, set[int]] = defaultdict(set)
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if len(self.keys) and len(h) >= self.span:
            g = tb.grams(h, self.k)
            at = fingerprints(g, tb.inside_row(first, self.k, len(h)), self.window)
            at = at[tb.member(g[at], self.keys)]
            low = np.searchsorted(self.keys, g[at], side="left")
            high = np.searchsorted(self.keys, g[at], side="right")
            done: dict[tuple[int, int], int] = {}  # by row's item and diagonal: where the last extension ended
            for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                for q in self.at[a:b].tolist():
                    item, row = int(self.item_of[q]), int(row_of[p])
                    if done.get((q - p, item), -1) >= p + self.k:
                        continue
                    start, end = self._extend(h, first[row], first[row + 1], p, q, self.first[item], self.first[item + 1])
                    done[q - p, item] = end
                    if end - start >= self.span:
                        mark[start] += 1
                        mark[end] -= 1
                        found[row].add(item)
        for n, (keys, rows) in self.short.items():
            g = tb.grams(h, n)
            at = np.flatnonzero(tb.member(g, keys) & tb.inside_row(first, n, len(h)))
            for p in at.tolist():
                mark[p] += 1
                mark[p + n] -= 1
                found[int(row_of[p])].update(rows[np.searchsorted(keys, g[p], "left") : np.searchsorted(keys, g[p], "right")].tolist())
        return np.cumsum(mark[:-1]) > 0, found

    def _extend(self, h, low, high, p, q, item_low, item_high) -> tuple[int, int]:
        left = min(p - low, q - item_low)
        a, b = h[p - left : p][::-1], self.words[q - left : q][::-1]
        differ = np.flatnonzero(a != b)
        left = int(differ[0]) if len(differ) else int(left)
        right = min(high - p, item_high - q)
        differ = np.flatnonzero(h[p : p + right] != self.words[q : q + right])
        right = int(differ[0]) if len(differ) else int(right)
        return p - left, p + right


OUT = "doc_id bigint, n_words bigint, spans array<bigint>, items array<string>, text_key bigint"


def _scan(documents: DataFrame, index: Index) -> DataFrame:
    """doc_id, text_key, n_words, hit spans as flat [start, end) pairs, item names."""
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        idx = shared.value
        for batch in batches:
            for rows, data, offsets in tb.segments(batch, "text"):
                words = tb.Words(data, offsets, tb.ALNUM_LOWER)
                hit, found = idx.hits(words.hashes(), words.first)
                spans, items = [], []
                for r in range(rows.num_rows):
                    if r not in found:
                        spans.append([])
                        items.append([])
                        continue
                    own = np.concatenate(([0], hit[words.first[r] : words.first[r + 1]].astype(np.int8), [0]))
                    spans.append(np.flatnonzero(np.diff(own)).tolist())
                    items.append(sorted({idx.names[i] for i in found[r]}))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).cast(pa.int64()), pa.array(words.counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), rows.column(2)],
                    ["doc_id", "n_words", "spans", "items", "text_key"],
                )

    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, OUT)


def _merge_spans(spans):
    """Union length of flat [start, end) pairs, as DataFrame functions."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.shiftright(F.size(spans), 1) - 1), lambda i: F.struct(F.get(spans, i * 2).alias("a"), F.get(spans, i * 2 + 1).alias("b"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("upto"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("bigint"), x["b"] - F.greatest(x["a"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], x["b"]).alias("upto"))
    return F.when(F.size(spans) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(pairs, start, step)["n"])


def index_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Into how many bounded blocks the benchmark is dealt."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, span: int = SPAN, k: int = K) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (names, sorted), spans, contaminated, text_key (a hash of the text).

    `documents` needs doc_id and text, `benchmark` item_id and text; other columns
    are not read.  Null or wordless texts have no words and no hits; null, empty and
    wordless items match nothing.  Repeated documents give repeated rows, repeated
    items count once by item_id, a null item_id counts as empty text.
    """
    bound_batches(documents.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    blocks = index_blocks(items, block_bytes)
    parts = []
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        parts.append(_scan(documents, Index([tuple(r) for r in block.orderBy("item_id", "text").collect()], span, k)))
    if blocks == 1:
        merged = parts[0]
    else:
        keys = ["doc_id", "text_key", "n_words"]
        hits = parts[0].where(F.size("items") > 0)
        for p in parts[1:]:
            hits = hits.unionByName(p.where(F.size("items") > 0))
        hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        base = parts[0].select(*keys)
        empty = F.array()
        merged = base.join(hits, base["doc_id"].eqNullSafe(hits["d"]) & (base["text_key"] == hits["t"]), "left").select(
            *keys, F.coalesce("spans", empty.cast("array<bigint>")).alias("spans"), F.coalesce("items", empty.cast("array<string>")).alias("items")
        )
    n_hit = _merge_spans(F.col("spans"))
    return merged.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans", (F.size("items") > 0).alias("contaminated"), "text_key")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item's window, with all their columns."""
    found = decontaminate(documents, benchmark)
    return without(documents, found.where("contaminated"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark item's window, and the items."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {SPAN}) AS n, array_to_string(w[i:i + least(len(w), {SPAN}) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SPAN - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), found AS (SELECT s.doc_id, s.i, s.n, x.item_id FROM spots s JOIN windows x ON x.g = s.g AND x.n = s.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""
