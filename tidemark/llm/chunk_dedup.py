"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes: the sum of random values of the last 32 bytes,
each shifted by its distance.  Where its top bits are all zero a chunk may end, so
that chunk borders depend on the bytes near them and fall into step again a few
bytes after an insertion.  Borders that have another within MIN_CHUNK bytes before
them are left out, and chunks over MAX_CHUNK bytes are cut at fixed steps; both
rules look at nearby bytes only too.  Chunks are deduplicated by a digest (61 bits):
the text with the smallest id (of several with one id the one of the smallest hash)
keeps its first copy, every later copy goes if the run of repeated chunks around it is
of `min_run` bytes or longer or all of its text.  A common phrase is no run of MIN_RUN
bytes; a passage of 51 words has one well within.  What a
text owns of a run and keeps doesn't shorten the run for the rest of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import blocks as bl
from tidemark.llm import textbytes as tb
from tidemark.llm.common import cut, table

MASK_BITS = 4
MIN_CHUNK = 12
MAX_CHUNK = 256
#: The shortest run of repeated chunks that goes, unless another is asked for; with 0 every repeated chunk does.
MIN_RUN = 64

_GEAR = np.random.default_rng(47).integers(0, 1 << 32, 256, dtype=np.uint32)
_LAST = np.iinfo(np.int64).max


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all chunks of the texts laid end to end; every text starts one."""
    n = len(data)
    h = _GEAR[data]
    width = 1
    while width < 32:  # the sum over 2w bytes from two sums over w bytes
        wide = h.copy()
        wide[width:] += h[:-width] << np.uint32(width)
        h, width = wide, 2 * width
    row_start = np.repeat(offsets[:-1], np.diff(offsets))
    ends = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0)
    # a border's hash must lie within its text, or it would depend on the text before
    ends = ends[ends - row_start[ends] >= 31]
    if len(ends):
        close = np.zeros(len(ends), bool)
        close[1:] = (ends[1:] - ends[:-1] < MIN_CHUNK) & (row_start[ends[1:]] == row_start[ends[:-1]])
        ends = ends[~close]
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], ends[ends + 1 < n] + 1]))
    sizes = np.diff(np.append(starts, n))
    extra = (sizes - 1) // MAX_CHUNK
    if extra.any():
        more = np.repeat(starts, extra)
        step = np.arange(len(more)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        starts = np.sort(np.concatenate([starts, more + step * MAX_CHUNK]))
    return starts


class _Chunks:
    """Chunks of a block's texts: by segment the texts' owners, offsets, starts, ends, digests and each chunk's text."""

    def __init__(self, texts: pa.Table):
        self.parts = []
        for ids, data, offsets in bl.segments(texts):
            owners = np.zeros(len(ids), bl.OWNER)
            owners["id"] = ids.fill_null(_LAST)
            if not len(data):
                none = np.zeros(0, np.int64)
                self.parts.append((owners, data, offsets, none, none, np.zeros(0, np.uint64), none))
                continue
            hashed = tb.RollingHash(data)
            owners["text"] = hashed.of(offsets[:-1], offsets[1:])
            starts = borders(data, offsets)
            ends = np.append(starts[1:], len(data))
            of = np.searchsorted(offsets, starts, side="right") - 1
            self.parts.append((owners, data, offsets, starts, ends, hashed.of(starts, ends), of))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct digests, the least owner that has each, and how many chunks do."""
        keys = np.concatenate([p[5] for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
        owners = np.concatenate([p[0][p[6]] for p in self.parts]) if self.parts else np.zeros(0, bl.OWNER)
        order = np.lexsort((owners["text"], owners["id"], keys))
        uniq, start, n = np.unique(keys[order], return_index=True, return_counts=True)
        return uniq, owners[order][start], n


def _runs(mark: np.ndarray, of: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The marked chunks in runs (within one text) of `least` bytes or more, or of the whole text, and which of them begin a run."""
    begins = mark.copy()
    begins[1:] &= ~(mark[:-1] & (of[1:] == of[:-1]))
    number = np.cumsum(begins)
    length = np.bincount(number[mark], sizes[mark], minlength=(number[-1] if len(number) else 0) + 1)
    long = mark & (length[number] >= np.minimum(least, np.bincount(of, sizes)[of]))
    return long, begins & long


def dedup_chunks(docs: DataFrame, key: str = "doc_id", with_text: bool = True, block_bytes: int = bl.BLOCK_BYTES, min_run: int = MIN_RUN) -> DataFrame:
    """(key, n_bytes, n_chunks, n_repeated, n_removed, n_spans, kept_sha256) and kept_text if asked for
    (a character that was cut through shows as the replacement character there).

    n_repeated counts bytes in long runs of chunks that are elsewhere too, n_removed
    those that go, as an earlier copy stays: the first one in the text of smallest key.
    Null and empty texts have no chunks.  A null key comes after all others.  Rows that
    repeat a key and text are one text, each of which keeps what that text keeps.
    Columns besides key and text are not read.
    """
    store = bl.Blocks(docs, key, block_bytes)

    def make(texts, told):
        uniq, low, _ = _Chunks(texts).keys()
        return uniq, low

    told = bl.resolve(store, store.keys(make, store.buckets(1 / 30)), "chunk")

    def finish(texts, flags):
        chunks = _Chunks(texts)
        uniq, low, n = chunks.keys()
        owner, repeats = low.copy(), n > 1
        if len(uniq):
            shared, _, lows = flags["chunk"]
            owner[shared] = lows
            repeats = repeats | shared
        out = {c: [] for c in ("id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans", "kept")}
        for owners, data, offsets, starts, ends, keys, of in chunks.parts:
            ids = owners["id"]
            at = np.searchsorted(uniq, keys)
            repeated = repeats[at] if len(uniq) else np.zeros(0, bool)
            # a text keeps the first of the chunks that it owns
            first = np.zeros(len(keys), bool)
            mine = np.flatnonzero(repeated & (owner[at] == owners[of])) if len(keys) else np.zeros(0, np.int64)
            if len(mine):
                order = np.lexsort((mine, keys[mine], of[mine]))
                m = mine[order]
                new = np.ones(len(m), bool)
                new[1:] = (keys[m][1:] != keys[m][:-1]) | (of[m][1:] != of[m][:-1])
                first[m[new]] = True
            sizes = ends - starts
            seen, _ = _runs(repeated, of, sizes, min_run)
            gone, begins = _runs(repeated & ~first & seen, of, sizes, 0)
            total = lambda w: np.bincount(of, w, minlength=len(ids)).astype(np.int64)  # noqa: E731, B023
            n_rep, n_gone, n_begin, n_all = total(sizes * seen), total(sizes * gone), total(begins), total(np.ones(len(of)))
            gone_bytes = np.repeat(gone, sizes)
            for r in range(len(ids)):
                a, b = offsets[r], offsets[r + 1]
                out["id"].append(None if ids[r] == _LAST else int(ids[r]))
                out["n_bytes"].append(int(b - a))
                for c, v in (("n_chunks", n_all), ("n_repeated", n_rep), ("n_removed", n_gone), ("n_spans", n_begin)):
                    out[c].append(int(v[r]))
                out["kept"].append(data[a:b][~gone_bytes[a:b]].tobytes())
        out["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in out["kept"]]
        out["kept"] = [x.decode("utf-8", "replace") if with_text else None for x in out["kept"]]
        kinds = {"kept": pa.string(), "kept_sha256": pa.string()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    found = store.finish(finish, "id bigint, n_bytes bigint, n_chunks bigint, n_repeated bigint, n_removed bigint, n_spans bigint, kept string, kept_sha256 string", told)
    texts = ["kept AS kept_text"] if with_text else []
    out = cut(found.selectExpr(f"id AS `{key}`", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans", "kept_sha256", *texts))
    store.drop()
    return out


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without chunks that an earlier one keeps, as a digest."""
    return dedup_chunks(table(spark, sf_dir, "documents"), with_text=False)
