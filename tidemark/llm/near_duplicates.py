"""Exact Jaccard self-join on word shingles, and its classes of near-duplicates.

Documents with the same shingle set are one node.  Two sets of Jaccard similarity
p or more share a shingle among the first n - ceil(p n) + 1 of each, in any common
order; the order here puts shingles that a corpus-wide count of hashed slots finds
frequent last.  These prefix entries, and MORE after them, are the inverted index.

Set relations are used twice.  Pairs of short lists of the index are counted over all
lists: how many entries two sets must share follows from their sizes.  Those that do
form clusters, outside which no pair is left, with what long lists tie, in which sets
lie by size and fall into runs.  Within a cluster one set's overlaps with all
others are counted from the lists once; the most similar set that is left gets its
overlaps from those by the few shingles in which the two differ, and so on along
the cluster, so that each answer costs a difference rather than a set.

Clusters of more than BLOCK sets are dealt into blocks, and every pair of blocks is
a task; a task returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import zlib
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.common import bound_batches, cut, free_names, partitions, small, table, without
from tidemark.llm.graph import components

#: Slots, as powers of two, in which shingles are counted for the order of prefixes: so many
#: that about SLOT_LOAD shingles share one, or rare shingles couldn't be told from common ones.
SLOT_BITS = (16, 24)
SLOT_LOAD = 24
_SLICES = 256
#: Entries of a prefix beyond those of which a pair shares one, so that it shares as many more.
MORE = 2
#: Sets of a list up to which every two of them are a pair.
PAIRED = 32
#: Sets of a cluster that one task takes at once.
BLOCK = 1000
#: Entries of one shingle's list that one task sorts, about; and times the mean of slots below which no list is split.
LIST_ENTRIES = 1 << 20
LIST_LOAD = 16
#: Ids of sets that a task remembers, so as to send a set only once; what it forgets it sends again.
REMEMBERED = 1 << 19


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, end to end, and the offsets of rows."""
    w = tb.Words(data, offsets, tb.NOT_SPACE)
    h, first = w.hashes(), w.first
    rows = len(first) - 1
    g = tb.grams(h, words)
    inside = tb.inside_row(first, words, len(h))
    row = w.row_of()[: len(g)][inside]
    g = g[inside]
    short = np.flatnonzero((w.counts > 0) & (w.counts < words))
    if len(short):  # fewer words: all of them are one shingle
        g = np.concatenate([g, [tb.grams(h[first[r] : first[r + 1]], int(w.counts[r]))[0] for r in short]])
        row = np.concatenate([row, short])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(rows + 1))


def set_ids(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set: sets are equal if ids are, up to hash collisions."""
    n = np.diff(at)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(tb.mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)))))
    return tb.mix((sums[at[1:]] - sums[at[:-1]]) + n.astype(np.uint64))


def need(a, b, percent: int):
    """The least overlap with which sets of sizes a and b reach the similarity."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_size(n, percent: int):
    return np.minimum(n, n - (percent * n + 99) // 100 + 1 + MORE)


def shared_at_least(a, b, percent: int):
    """How many entries of their prefixes two sets of sizes a and b share at least if they reach the similarity.

    The prefix that ends first in the order has all that is common up to its end; what
    it lacks of the overlap lies among the rest of its set.
    """
    t = need(a, b, percent)
    return np.maximum(1, np.minimum(prefix_size(a, percent) - (a - t), prefix_size(b, percent) - (b - t)))


def slot_bits(docs: DataFrame) -> int:
    """The power of two of slots for the texts' bytes, at six bytes a word."""
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    return min(max(int(size / 6 / SLOT_LOAD).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])


class _Met:
    """Which sets a task has met of late: of bounded size, as sending one again does no harm."""

    def __init__(self) -> None:
        self._ids: set[int] = set()

    def fresh(self, ids: list[int]) -> list[bool]:
        out = []
        for s in ids:
            out.append(s not in self._ids)
            self._ids.add(s)
        if len(self._ids) > REMEMBERED:
            self._ids.clear()
        return out


def _slots(g: np.ndarray, bits: int) -> np.ndarray:
    return (g >> np.uint64(64 - bits)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts as a byte each, exact below 128 and within a tenth beyond, compressed: a task's few shingles leave most slots empty."""
    code = np.minimum(counts, 127)
    large = np.flatnonzero(counts > 127)
    code[large] = np.minimum(255, 128 + 8 * np.log2(counts[large] / 128)).astype(code.dtype)
    return zlib.compress(code.astype(np.uint8).tobytes(), 1)


_UNPACKED = np.concatenate([np.arange(128), 128 * 2 ** (np.arange(128) / 8)]).astype(np.uint64)


def _scan(docs: DataFrame, key: str, words: int, bits: int) -> DataFrame:
    """One row per document (key, n, sid, text_key), and per task the slot counts of its shingles in slices."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        counts = np.zeros(1 << bits, np.int32)
        any_rows, ids = False, None
        for batch in batches:
            for rows, data, offsets in tb.segments(batch, "text"):
                any_rows, ids = True, rows.column(0).type
                g, at = shingle_sets(data, offsets, words)
                np.add.at(counts, _slots(g, bits), 1)
                none = pa.nulls(rows.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(set_ids(g, at).view(np.int64)), rows.column(2), none, pa.nulls(rows.num_rows, pa.binary())], ["k", "n", "sid", "text_key", "slice", "counts"]
                )
        if any_rows:
            width = len(counts) // _SLICES
            empty = pa.nulls(_SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(_SLICES, ids), empty, empty, empty, pa.array(range(_SLICES), pa.int32()), pa.array([_packed(counts[i * width : (i + 1) * width]) for i in range(_SLICES)], pa.binary())],
                ["k", "n", "sid", "text_key", "slice", "counts"],
            )

    return docs.select(key, "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"k {kind}, n bigint, sid bigint, text_key bigint, slice int, counts binary")


def frequency_levels(scanned: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """For each slot how many times over the mean its count is, as a power of the root of two; and the mean.

    Counts are rough: levels order prefixes and say which lists to split, and any levels give right results.
    """

    width = (1 << bits) // _SLICES

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.uint64)
        for x in pdf["counts"]:
            raw = zlib.decompress(x)
            total += _UNPACKED[np.frombuffer(raw, np.uint8)] if len(raw) == width else np.frombuffer(raw, np.uint64)
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "slice int, counts binary"
    tasks = scanned.where(F.col("slice") == 0).count()
    slices = scanned.where(F.col("slice").isNotNull()).select("slice", "counts", F.pmod(F.xxhash64("counts"), F.lit(1 + isqrt(tasks))).alias("part"))
    once = slices.groupBy("slice", "part").applyInPandas(add, schema)  # in two steps: a group has about the square root of the tasks
    got = {r["slice"]: np.frombuffer(zlib.decompress(r["counts"]), np.uint64) for r in once.groupBy("slice").applyInPandas(add, schema).collect()}
    if not got:
        return np.zeros(1 << bits, np.uint8), 1.0
    mean = max(1.0, sum(int(x.sum()) for x in got.values()) / (1 << bits))
    return np.concatenate([(2 * np.log2(1 + got[i] / mean)).astype(np.uint8) for i in range(_SLICES)]), mean


def list_parts(mean: float) -> np.ndarray:
    """For each level in how many parts the lists of its shingles are sorted."""
    return np.ceil(np.minimum(mean * 2 ** (np.arange(1, 257) / 2) / max(LIST_ENTRIES, LIST_LOAD * mean), 1 << 16)).astype(np.int32)


def prefix_entries(docs: DataFrame, levels: np.ndarray, parts: np.ndarray, words: int, percent: int) -> DataFrame:
    """(token, part, sid, n) of every set's prefix; a task emits a set that it meets again soon only once.

    Of a shingle whose slot is so full that its list is sorted in parts, a set's hash says the part; of others it is -1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    bits = len(levels).bit_length() - 1

    def run(batches):
        level, met = shared.value, _Met()
        for batch in batches:
            for _, data, offsets in tb.segments(batch, "text"):
                g, at = shingle_sets(data, offsets, words)
                n = np.diff(at)
                sid = set_ids(g, at).view(np.int64)
                salt = tb.mix(sid.view(np.uint64))
                fresh = np.array(met.fresh(sid.tolist()), bool) & (n > 0)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((g, level[_slots(g, bits)], row))
                pos = np.arange(len(g)) - at[:-1][row]
                kept = fresh[row] & (pos < prefix_size(n, percent)[row])
                token, of = g[order][kept], row[kept]
                many = parts[level[_slots(token, bits)]]
                part = np.where(many > 1, salt[of] % many.astype(np.uint64), np.uint64(1 << 32) - np.uint64(1)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(part), pa.array(sid[of]), pa.array(n[of].astype(np.int32))], ["token", "part", "sid", "n"])

    return docs.select("text").mapInArrow(run, "token bigint, part int, sid bigint, n int")


def _block_heads(listed: DataFrame, keys: list[str], end: Column, out: str) -> DataFrame:
    """Adds the first set of each row's block: by size, a new block begins where all rows so far end below the next size."""
    by_size = W.partitionBy(*keys).orderBy("n", "sid")
    upto = F.max(end).over(by_size.rowsBetween(W.unboundedPreceding, -1))
    begins = listed.withColumn("upto", upto).withColumn("begins", F.when(F.col("upto").isNull() | (F.col("upto") < F.col("n")), F.col("sid")))
    return begins.withColumn(out, F.last("begins", ignorenulls=True).over(by_size.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("upto", "begins")


def _list_edges(token: np.ndarray, part: np.ndarray, sid: np.ndarray, n: np.ndarray, percent: int) -> list[tuple[np.ndarray, ...]]:
    """(a, b, need, token, low, high) from whole lists, in the order of token, part, n and sid; see candidate_edges."""
    other = np.ones(len(sid), bool)
    other[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
    once = other.copy()
    once[1:] |= sid[1:] != sid[:-1]  # a set that several tasks sent
    token, part, sid, n, other = token[once], part[once], sid[once], n[once], other[once]
    start = np.flatnonzero(other)
    size = np.diff(np.append(start, len(sid)))
    size, pos = np.repeat(size, size), np.arange(len(sid)) - np.repeat(start, size)
    whole = part < 0
    out = []

    def give(a, b, need, token=None, low=None, high=None):
        none = np.zeros(len(a), np.int64)
        out.append((a, b, need, *(none if x is None else x for x in (token, low, high))))

    rows = np.flatnonzero(whole & (size > 1) & (size <= PAIRED))
    for d in range(1, PAIRED):
        rows = rows[pos[rows] + d < size[rows]]
        if not len(rows):
            break
        left = rows[100 * n[rows] >= percent * n[rows + d]]
        right = left + d
        give(np.minimum(sid[left], sid[right]), np.maximum(sid[left], sid[right]), shared_at_least(n[left], n[right], percent))
    rows = np.flatnonzero(~whole | (size > PAIRED))
    if len(rows):
        begins = other[rows].copy()
        begins[1:] |= 100 * n[rows[:-1]] < percent * n[rows[1:]]
        first = np.flatnonzero(begins)
        head = np.repeat(rows[first], np.diff(np.append(first, len(rows))))
        tied = rows != head
        x, y = sid[rows[tied]], sid[head[tied]]
        give(np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), np.int64))
        last = rows[np.append(first[1:], len(rows)) - 1]
        first = rows[first]
        dealt = part[first] >= 0
        first, last = first[dealt], last[dealt]
        give(sid[first], sid[first], np.full(len(first), -1), token[first], n[first], n[last])
    return out


def candidate_edges(entries: DataFrame, percent: int, split: bool) -> DataFrame:
    """Edges (a, b) that tie together all sets which may reach the similarity.

    Two sets in a short list are a pair, and a pair is an edge if it shares as many
    entries as sets of these sizes must: those that meet by chance share one.  In a
    longer list, by size, sets are tied to the first one of a run in which each size can
    match the next; so what is not tied there meets in short lists alone, and its count is
    whole.  With `split`, some lists came in parts; the runs of a list's parts, which are
    few, meet in the same way.
    """

    def run(batches):
        held: list[list[np.ndarray]] = []

        def told(rows):
            for a, b, *more in _list_edges(*rows, percent):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array(x.astype(np.int32)) if i != 1 else pa.array(x) for i, x in enumerate(more))], ["a", "b", "need", "token", "low", "high"])

        joined = lambda: [np.concatenate(x) for x in zip(*held, strict=True)]
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("token", "part", "sid")] + [batch.column("n").to_numpy().astype(np.int64)]
            if not len(rows[0]):
                continue
            held.append(rows)
            token, part = rows[:2]
            if len(held) > 1 and (token[-1], part[-1]) == (held[0][0][-1], held[0][1][-1]):
                continue  # all of one list, which goes on
            rows = joined()
            token, part = rows[:2]
            ends = np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1]))
            if len(ends):
                yield from told([x[: ends[-1] + 1] for x in rows])
                rows = [x[ends[-1] + 1 :] for x in rows]
            held = [rows]
        if held:
            yield from told(joined())

    lists = entries.repartition(partitions(entries.sparkSession), "token", "part").sortWithinPartitions("token", "part", "n", "sid")
    found = lists.mapInArrow(run, "a bigint, b bigint, need int, token bigint, low int, high int")
    pairs = found.where("need >= 0").select("a", "b", "need")
    if split:
        found = cut(found)
        runs = found.where("need < 0").select("token", F.col("a").alias("sid"), F.col("low").alias("n"), F.floor(F.col("high") * F.lit(100) / F.lit(percent) + F.lit(1e-9)).alias("end"))
        ties = _block_heads(runs, ["token"], F.col("end"), "head").where(F.col("sid") != F.col("head"))
        pairs = found.where("need >= 0").select("a", "b", "need").unionByName(ties.select(F.least("sid", "head").alias("a"), F.greatest("sid", "head").alias("b"), F.lit(0).alias("need")))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need")).where(F.col("shared") >= F.col("need")).select("a", "b")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def cluster_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among `left`, or (with `right`) between left and right sets.

    Sets of the right are numbered after those of the left.  Answers run along the
    queries from each set to the most similar one left.
    """
    queries = left if right is None else right
    sizes = np.array([len(s) for s in left])
    tokens = np.concatenate(left)
    of = np.repeat(np.arange(len(left)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, of = tokens[order], of[order]
    uniq, start = np.unique(tokens, return_index=True)
    start = np.append(start, len(tokens))
    base = 0 if right is None else len(left)
    forest, out = _Forest(base + len(queries)), []

    def add(overlap: np.ndarray, shingles: np.ndarray, sign: int) -> None:
        at = np.minimum(np.searchsorted(uniq, shingles), len(uniq) - 1)
        at = at[uniq[at] == shingles]
        for i in at.tolist():
            overlap[of[start[i] : start[i + 1]]] += sign

    waiting = np.ones(len(queries), bool)
    fresh = iter(sorted(range(len(queries)), key=lambda i: (int(queries[i][0]), i)))  # those that share the least shingle lie together
    overlap, last = None, -1
    for _ in range(len(queries)):
        current = -1
        if overlap is not None and right is None:
            similar = np.where(waiting, overlap / (sizes + sizes[last] - overlap), 0.0)
            current = int(similar.argmax())
        if current < 0 or similar[current] < 0.5:
            current = next(i for i in fresh if waiting[i])
        if overlap is not None:
            gone = np.setdiff1d(queries[last], queries[current], assume_unique=True)
            come = np.setdiff1d(queries[current], queries[last], assume_unique=True)
        if overlap is None or len(gone) + len(come) >= len(queries[current]):
            overlap = np.zeros(len(left), np.int64)
            add(overlap, queries[current], 1)
        else:
            add(overlap, come, 1)
            add(overlap, gone, -1)
        waiting[current] = False
        last = current
        n = len(queries[current])
        linked = np.flatnonzero(100 * overlap >= percent * (sizes + n - overlap))
        for j in linked.tolist():
            if forest.join(base + current, j):
                out.append((base + current, j))
    return out


def verified_links(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that span each class, from `clusters` (node, root) of candidate sets."""
    wanted = nodes.join(clusters, nodes["sid"] == clusters["node"]).select("text_key", "sid", "root")
    keys = small(wanted.select("text_key").distinct())
    texts = docs.select("text", F.xxhash64("text").alias("text_key")).join(keys, "text_key", "left_semi")

    def run(batches):
        met = _Met()
        for batch in batches:
            for rows, data, offsets in tb.segments(batch, "text"):
                g, at = shingle_sets(data, offsets, words)
                ids = set_ids(g, at).view(np.int64)
                fresh = [r for r, new in enumerate(met.fresh(ids.tolist())) if new]
                yield pa.RecordBatch.from_arrays([pa.array(ids[fresh]), pa.array([g[at[r] : at[r + 1]].tobytes() for r in fresh], pa.binary())], ["sid", "shingles"])

    sets = texts.select("text").mapInArrow(run, "sid bigint, shingles binary").groupBy("sid").agg(F.first("shingles").alias("shingles"))
    sizes = clusters.groupBy(F.col("root").alias("r")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = clusters.join(sizes, clusters["root"] == sizes["r"]).select("node", "root", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    members = dealt.join(sets, dealt["node"] == sets["sid"]).select("node", "root", "blocks", "block", "shingles")
    # a block meets every block: as the left one those from it on, as the right one those before it
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    tasks = members.select("node", "root", "block", "shingles", F.explode(pairs).alias("t")).select("node", "root", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "block", "shingles")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        own = pdf["block"] == i
        parts = [pdf[own]] if i == j else [pdf[own], pdf[~own]]
        nodes_in = np.concatenate([p["node"].to_numpy() for p in parts])
        sets_in = [[np.frombuffer(x, np.uint64) for x in p["shingles"]] for p in parts]
        if not all(sets_in):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        found = cluster_links(sets_in[0], sets_in[1] if len(sets_in) > 1 else None, percent)
        a = np.array([x for x, _ in found], np.int64)
        b = np.array([y for _, y in found], np.int64)
        return pd.DataFrame({"a": nodes_in[a], "b": nodes_in[b]})

    return tasks.repartition(partitions(docs.sparkSession), "root", "i", "j").groupBy("root", "i", "j").applyInPandas(link, "a bigint, b bigint")


def classes(docs: DataFrame, key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, text_key, first_text_key): each row's set size, the smallest key of its class, and the hashes of its text and of that of the class's first row.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the
    distinct shingles of `words` words, or of all words where there are fewer.  Sets
    link if 100 * intersection >= percent * union; classes are the components.
    Null, empty and wordless texts have an empty set and are a class each.  A null
    key takes part but names a class only if it has no other key.  Repeated rows come
    back repeated; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), "text")
    bits = slot_bits(docs)
    scanned = cut(_scan(docs, "key", words, bits))
    rows = scanned.where(F.col("slice").isNull()).select("k", "n", "sid", "text_key")
    named_row = F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"), F.col("text_key").alias("text_key"))
    nodes = cut(rows.where(F.col("n") > 0).groupBy("sid").agg(F.min(named_row).alias("low"), F.min("text_key").alias("text_key")))
    levels, mean = frequency_levels(scanned, bits)
    parts = list_parts(mean)
    clusters = components(candidate_edges(prefix_entries(docs, levels, parts, words, percent), percent, split=bool((parts[levels] > 1).any())))
    linked = components(cut(verified_links(docs, nodes, clusters, words, percent)))
    rooted = nodes.join(linked, nodes["sid"] == linked["node"], "left").select("sid", F.coalesce("root", "sid").alias("root"), "low")
    named = rooted.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("first"))
    named = rooted.join(named, rooted["root"] == named["r"]).select(F.col("sid").alias("s"), "first")
    out = rows.join(named, (rows["sid"] == named["s"]) & (rows["n"] > 0), "left")
    some = F.col("n") > 0
    return out.select(
        F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(some, F.col("first.k")).otherwise(F.col("k")).alias("component_id"),
        "text_key", F.when(some, F.col("first.text_key")).otherwise(F.col("text_key")).alias("first_text_key"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class with all its columns: that of the smallest key, of several texts
    of that key the one of the smallest hash.

    A null key comes after all others.  Documents with an empty set stay all.  Of rows that
    repeat a key and text one stays.
    """
    found = cut(classes(docs, key, words, percent))
    first = F.col(key).eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_text_key"))
    kept = without(docs, found.where((F.col("n_shingles") > 0) & ~first), key)
    own, own_text = free_names(docs.columns, "key", "text_key")
    repeated = found.where(F.col("n_shingles") > 0).groupBy(key, "text_key").count().where("count > 1")
    twice = small(repeated.select(F.col(key).alias(own), F.col("text_key").alias(own_text)))
    if not twice.limit(1).count():
        return kept
    same = F.col(f"`{key}`").eqNullSafe(F.col(own)) & F.xxhash64("text").eqNullSafe(F.col(own_text))
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates([key, "text"]))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and class of every document: shingles of three words, similarity 0.9."""
    return classes(table(spark, sf_dir, "documents"), "doc_id", words=3, percent=90).drop("text_key", "first_text_key")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def classes_sql(source: str, words: int, percent: int) -> str:
    return f"""
w AS (SELECT doc_id, {_WORDS} AS w FROM {source}),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), {words}) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM {source}
  UNION
  SELECT r.a, l.b FROM reach r JOIN ways l ON l.a = r.b
), classes AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)"""


OP3_SQL = f"""
WITH RECURSIVE {classes_sql("documents", 3, 90)}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d JOIN classes USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
