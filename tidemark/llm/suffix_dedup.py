"""Exact removal of long repeated strings by blockwise suffix sorting over a difference cover.

Suffixes are compared on LENGTH bytes only, as what counts is whether two share so
many.  The cover: of every V positions of a text, those of a perfect difference
set; for any two positions there is one shift under V that brings both onto cover
positions.  So if two suffixes share LENGTH bytes, cover strings of
LENGTH - V + 1 bytes repeat at the same shift of both.

1. Cover strings are ranked first (by hash, in buckets, one bucket at a time): a
   suffix with no repeated cover string within V positions is unique, and leaves.
2. Long ties: repeated cover positions are ranked on LENGTH + V - 1 bytes.  Where
   that repeats, all V suffixes from there on are settled by the cover alone, and
   only the first block that holds such a string passes them on.
3. The suffixes that are left are sorted bucket by bucket on their LENGTH bytes.

Ranks stand for byte order where only equality matters, so hashes serve for them:
61 bits modulo a prime for what decides, and no text leaves its block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import blocks as bl
from tidemark.llm import textbytes as tb
from tidemark.llm.common import cut, table

LENGTH = 200
#: A perfect difference set: every residue but 0 is the difference of one pair. Fixed values.
V = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)

_IN_COVER = np.zeros(V, bool)
_IN_COVER[list(COVER)] = True


class Segment:
    """Texts laid end to end with the hash of any of their substrings."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.offsets, self.length = data, offsets, length
        self.hash = tb.RollingHash(data)
        sizes = np.diff(offsets)
        row_start = np.repeat(offsets[:-1], sizes)
        self.left = np.repeat(offsets[1:], sizes) - np.arange(len(data))  # bytes from here to the end of the row
        cover = np.flatnonzero(_IN_COVER[(np.arange(len(data)) - row_start) % V])
        self.cover = cover[self.left[cover] >= length - V + 1]

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.hash.of(at, at + n)

    def spread(self, at: np.ndarray, before: int, after: int) -> np.ndarray:
        """The positions from `before` before to `after` after each given one that are suffixes long enough."""
        n = len(self.data)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.maximum(at - before, 0), 1)
        np.add.at(edge, np.minimum(at + after + 1, n), -1)
        return (np.cumsum(edge[:-1]) > 0) & (self.left >= self.length)


def _segments(texts: pa.Table, length: int):
    for ids, data, offsets in bl.segments(texts):
        yield ids, Segment(data, offsets, length)


class _Pass:
    """What a block knows of its keys after each round: recomputed from its texts and the bits told."""

    def __init__(self, texts: pa.Table, told: dict, length: int):
        self.length, self.told = length, told
        self.parts = [s for s in _segments(texts, length)] if len(texts) else []

    def cover_keys(self):
        return bl.distinct([s.keys(s.cover, self.length - V + 1) for _, s in self.parts])

    def repeated_cover(self) -> list[np.ndarray]:
        uniq, n = self.cover_keys()
        mark = self.told["cover"][0] | (n > 1) if len(uniq) else n > 1
        return [s.cover[bl.marked(s.keys(s.cover, self.length - V + 1), uniq, mark)] for _, s in self.parts]

    def long_keys(self, repeated: list[np.ndarray]):
        at = [r[s.left[r] >= self.length + V - 1] for r, (_, s) in zip(repeated, self.parts, strict=True)]
        return at, *bl.distinct([s.keys(a, self.length + V - 1) for a, (_, s) in zip(at, self.parts, strict=True)])

    def suffixes(self):
        """Per segment: suffixes settled by the cover, and those that go into the sort."""
        repeated = self.repeated_cover()
        at, uniq, n = self.long_keys(repeated)
        shared, first = self.told["long"][:2] if len(uniq) else (n > 1, n > 1)
        settles, passes = shared | (n > 1), (n > 1) & ~shared | shared & first
        settled, sorted_too = [], []
        for a, r, (_, s) in zip(at, repeated, self.parts, strict=True):
            keys = s.keys(a, self.length + V - 1)
            done = s.spread(a[bl.marked(keys, uniq, settles)], 0, V - 1)
            own = s.spread(a[bl.marked(keys, uniq, passes)], 0, V - 1)
            settled.append(done)
            sorted_too.append(np.flatnonzero(s.spread(r, V - 1, 0) & ~done | own))
        return settled, sorted_too


def remove_repeats(docs: DataFrame, key: str = "doc_id", length: int = LENGTH, with_text: bool = True, block_bytes: int = bl.BLOCK_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each text as UTF-8 bytes, and kept_text if asked for
    (a character that was cut through shows as the replacement character there).

    A byte goes if a string of `length` bytes that covers it starts anywhere else too,
    in this or another text, overlapping or not; matches never cross texts and are
    judged on the texts as given.  Null is an empty text: nothing goes, nothing stays.
    Texts shorter than `length` stay whole.  Repeated rows are texts like others, so
    all of a repeated long text goes.  Columns besides key and text are not read.
    """
    if length < V:
        raise ValueError(f"length must be {V} or more")
    store = bl.Blocks(docs, key, block_bytes)
    cover = bl.resolve(store, store.keys(lambda texts, told: (_Pass(texts, told, length).cover_keys()[0], None), store.buckets(len(COVER) / V)), "cover")

    def long(texts, told):
        p = _Pass(texts, told, length)
        return p.long_keys(p.repeated_cover())[1], None

    ties = bl.resolve(store, store.keys(long, store.buckets(len(COVER) / V / 2), cover), "long")
    told = cover.unionByName(ties)

    def suffix(texts, told):
        p = _Pass(texts, told, length)
        return bl.distinct([s.keys(at, length) for at, (_, s) in zip(p.suffixes()[1], p.parts, strict=True)])[0], None

    order = bl.resolve(store, store.keys(suffix, store.buckets(0.2), told), "suffix")

    def remove(texts, told):
        p = _Pass(texts, told, length)
        settled, sent = p.suffixes()
        uniq, n = bl.distinct([s.keys(at, length) for at, (_, s) in zip(sent, p.parts, strict=True)])
        mark = told["suffix"][0] | (n > 1) if len(uniq) else n > 1
        out = {"id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for done, at, (ids, s) in zip(settled, sent, p.parts, strict=True):
            starts = done.copy()
            starts[at[bl.marked(s.keys(at, length), uniq, mark)]] = True
            edge = np.zeros(len(s.data) + 1, np.int64)
            begin = np.flatnonzero(starts)
            edge[begin] += 1
            edge[begin + length] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            for r in range(len(ids)):
                a, b = s.offsets[r], s.offsets[r + 1]
                own = gone[a:b]
                out["id"].append(ids[r].as_py())
                out["n_bytes"].append(int(b - a))
                out["n_removed"].append(int(own.sum()))
                out["n_spans"].append(int((own[1:] & ~own[:-1]).sum() + own[:1].sum()))
                out["kept"].append(s.data[a:b][~own].tobytes())
        out["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in out["kept"]]
        out["kept"] = [x.decode("utf-8", "replace") if with_text else None for x in out["kept"]]
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)})

    found = store.finish(remove, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept string, kept_sha256 string", told.unionByName(order))
    texts = ["kept AS kept_text"] if with_text else []
    out = cut(found.selectExpr(f"id AS `{key}`", "n_bytes", "n_removed", "n_spans", "kept_sha256", *texts))
    store.drop()
    return out


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeats of 200 bytes, as a digest."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
