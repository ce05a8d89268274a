"""How sources of a language differ in what words they use, by exact recounts in perfect hashes.

The first pass counts the documents of every term and keeps the terms of enough of
them, exactly.  The kept terms of a language are dealt by hash into shards of some
SHARD_KEYS keys, and a task builds each shard's minimal perfect hash: in a table of
twice the keys those alone in their cell are settled, the others go on to the next,
smaller table; a key's slot is the number of settled cells before its own.  The keys
lie in slot order beside it.  The second pass has shards of a bounded size by
broadcast (several passes if all are more), finds each word's slot, compares the
stored key byte by byte, and adds to the dense slots of the document's group.  The
audit then compares the smoothed shares of terms between sources, shard by shard.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.common import bound_batches, cut, table
from tidemark.sources.tables import Scratch

MIN_DOCS = 3
TOP_TERMS = 200
#: Shares are counted in parts of this.
SCALE = 1_000_000_000
#: Keys of a shard, on average.
SHARD_KEYS = 4096
#: Sources of a language that are compared in one task, on average.
SOURCE_BLOCK = 64
#: Bytes of perfect hashes that one pass has by broadcast.
PASS_BYTES = 32 << 20
#: Dense slots that a task holds, of 32 bits; groups that come when there are no more left are counted in a sorted list.
DENSE_CELLS = 32 << 20
#: Words that this list takes in before it is sorted and added up, and entries from which it is handed on.
LISTED = 2 << 20
#: Arrays of counts that a task adds up at once.
FAN = 64
_SEGMENT = 1 << 20
_LEVELS = 24
_STEP = 0x9E3779B97F4A7C15


def _placed(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _cells(hashes: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    return (tb.mix(hashes + np.uint64((level + 1) * _STEP & (1 << 64) - 1)) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def build_shard(keys: list[bytes]) -> bytes:
    """A minimal perfect hash of distinct keys with the keys in slot order, as bytes."""
    data = np.frombuffer(b"".join(keys), np.uint8)
    size = np.array([len(k) for k in keys], np.int64)
    end = np.cumsum(size)
    start = end - size
    hashes = tb.span_hashes(data, start, end)
    left, tables, order = np.arange(len(keys)), [], []
    while len(left) and len(tables) < _LEVELS:
        cell = _cells(hashes[left], len(tables), 2 * len(left))
        held = np.bincount(cell, minlength=2 * len(left))
        alone = held[cell] == 1
        tables.append(held == 1)
        order.append(left[alone][np.argsort(cell[alone])])
        left = left[~alone]
    rest = len(left)  # keys of one hash; they have the last slots, and are compared one by one
    order = np.concatenate([*order, left]).astype(np.int64)
    stored, offsets = tb.take_spans(data, start[order], end[order])
    return pickle.dumps(([len(t) for t in tables], np.packbits(np.concatenate(tables)), offsets, stored, rest))


def shard_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a shard's keys in slot order, and their offsets."""
    _, _, offsets, stored, _ = pickle.loads(blob)
    return stored, offsets


class PerfectHash:
    """The shards of one language that are at hand, laid end to end."""

    def __init__(self, shards: int, blobs: list[tuple[int, bytes]]):
        self.shards = shards
        self.numbers = np.array([n for n, _ in blobs], np.int64)
        self.local = np.full(shards, -1, np.int64)
        self.local[self.numbers] = np.arange(len(blobs))
        parts = [pickle.loads(b) for _, b in blobs]
        levels = max(len(p[0]) for p in parts)
        self.sizes = np.zeros((len(parts), levels), np.int64)
        for i, p in enumerate(parts):
            self.sizes[i, : len(p[0])] = p[0]
        flat = self.sizes.ravel()
        self.cells = (np.cumsum(flat) - flat).reshape(self.sizes.shape)
        self.settled = np.concatenate([np.unpackbits(p[1], count=sum(p[0])).astype(bool) for p in parts])
        keys = np.array([len(p[2]) - 1 for p in parts], np.int64)
        self.rest = np.array([p[4] for p in parts], np.int64)
        self.base = np.cumsum(keys) - keys
        # the slots of a shard begin at its base, whatever rests of other shards stand between
        first = np.cumsum(keys - self.rest) - (keys - self.rest)
        owner = np.repeat(np.arange(len(parts)), self.sizes.sum(axis=1))
        self.slot = np.cumsum(self.settled) - 1 - first[owner] + self.base[owner]
        self.start = np.concatenate([p[2][:-1] + at for p, at in zip(parts, _before([len(p[3]) for p in parts]), strict=True)])
        self.end = np.concatenate([p[2][1:] + at for p, at in zip(parts, _before([len(p[3]) for p in parts]), strict=True)])
        self.data = np.concatenate([p[3] for p in parts])
        self.keys = int(keys.sum())

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each span, -1 for spans that are no key at hand."""
        shard = self.local[_placed(hashes, self.shards)]
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(shard >= 0)
        for level in range(self.sizes.shape[1]):
            at = at[self.sizes[shard[at], level] > 0]
            if not len(at):
                break
            cell = self.cells[shard[at], level] + _cells(hashes[at], level, self.sizes[shard[at], level])
            hit = self.settled[cell]
            out[at[hit]] = self.slot[cell[hit]]
            at = at[~hit]
        found = np.flatnonzero(out >= 0)
        same = tb.same_spans(data, start[found], end[found], self.data, self.start[out[found]], self.end[out[found]])
        out[found[~same]] = -1
        if self.rest.any():
            for i in np.flatnonzero((out < 0) & (shard >= 0) & (self.rest[np.maximum(shard, 0)] > 0)).tolist():
                own, word = shard[i], data[start[i] : end[i]].tobytes()
                last = self.base[own] + (self.base[own + 1] - self.base[own] if own + 1 < len(self.base) else self.keys - self.base[own])
                for slot in range(last - self.rest[own], last):
                    if self.data[self.start[slot] : self.end[slot]].tobytes() == word:
                        out[i] = slot
        return out


def _before(sizes: list[int]) -> np.ndarray:
    return np.cumsum(sizes) - np.array(sizes, np.int64)


def _classes(words: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """One word of each distinct one, and the class of every word: by hash, and by bytes should hashes ever deceive."""
    _, one, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
    if not tb.same_spans(words.data, words.start, words.end, words.data, words.start[one][of], words.end[one][of]).all():
        spelled = [words.data[a:b].tobytes() for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
        numbers: dict[bytes, int] = {}
        of = np.array([numbers.setdefault(w, len(numbers)) for w in spelled])
        _, one = np.unique(of, return_index=True)
    return one, of


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): in how many of a segment's documents a term is."""
    for batch in batches:
        for rows, data, offsets in tb.segments(batch, "text", _SEGMENT):
            words = tb.Words(data, offsets, tb.LETTER_LOWER)
            if not len(words.start):
                continue
            one, of = _classes(words)
            langs = rows.column(rows.schema.get_field_index("lang")).dictionary_encode()
            lang = langs.indices.to_numpy().astype(np.int64)
            pairs = np.unique(words.row_of() * len(one) + of)
            kinds, n = np.unique(lang[pairs // len(one)] * len(one) + pairs % len(one), return_counts=True)
            term = one[kinds % len(one)]
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(kinds // len(one))).cast(pa.string()), tb.strings(*tb.take_spans(words.data, words.start[term], words.end[term])), pa.array(n.astype(np.int64))], ["lang", "term", "n"]
            )


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term): the terms that at least min_docs documents of a language have."""
    counted = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n bigint")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_docs).select("lang", "term")


def perfect_hashes(kept: DataFrame) -> DataFrame:
    """(lang, shard, shards, keys, blob) of the kept terms; blobs are some 16 to 30 bytes a key."""
    size = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_KEYS).cast("int").alias("shards"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.utf8(batch.column(1))
            hashes = tb.span_hashes(data, offsets[:-1], offsets[1:])
            yield batch.append_column("shard", pa.array(_placed(hashes, batch.column(2).to_numpy()).astype(np.int32)))

    def build(lang_shard: tuple[pa.Scalar, ...], terms: pa.Table) -> pa.Table:
        keys = sorted(x.encode() for x in terms["term"].to_pylist())
        return pa.table({"lang": [lang_shard[0].as_py()], "shard": pa.array([lang_shard[1].as_py()], pa.int32()), "shards": pa.array([terms["shards"][0].as_py()], pa.int32()), "keys": [len(keys)], "blob": [build_shard(keys)]})

    rows = kept.join(size, "lang").select("lang", "term", "shards").mapInArrow(dealt, "lang string, term string, shards int, shard int")
    return rows.groupBy("lang", "shard").applyInArrow(build, "lang string, shard int, shards int, keys bigint, blob binary")


def _packed(key: dict[str, pa.Array], slots: list[np.ndarray], ns: list[np.ndarray], **more: pa.Array) -> pa.RecordBatch:
    """Rows of counts: a key, and for it the slots that have any and how many, as bytes of int32 and int64."""
    columns = key | more | {"slots": pa.array([x.astype(np.int32).tobytes() for x in slots], pa.binary()), "ns": pa.array([x.astype(np.int64).tobytes() for x in ns], pa.binary())}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _unpacked(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for slots, ns in zip(rows["slots"].to_pylist(), rows["ns"].to_pylist(), strict=True):
        yield np.frombuffer(slots, np.int32), np.frombuffer(ns, np.int64)


def _recounted(docs: DataFrame, blobs: list, dense_cells: int) -> DataFrame:
    """One pass: (lang, source, shard, part, slots, ns) of the shards at hand, a row for each group and shard of a task."""
    by_lang: dict[str, list] = {}
    for r in blobs:
        by_lang.setdefault(r["lang"], []).append((r["shards"], r["shard"], bytes(r["blob"])))
    sent = docs.sparkSession.sparkContext.broadcast(by_lang)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes = {lang: PerfectHash(own[0][0], [(s, b) for _, s, b in own]) for lang, own in sent.value.items()}
        dense: dict[tuple[str, str], np.ndarray] = {}
        late: dict[tuple[str, str], int] = {}
        heard: list[np.ndarray] = []
        listed, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = waiting = 0
        part = TaskContext.get().partitionId() << 32

        def counted(group: tuple[str, str], slots: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            own = hashes[group[0]]
            at = np.searchsorted(slots, np.append(own.base, own.keys))
            full = np.flatnonzero(np.diff(at))
            key = {"lang": pa.array([group[0]] * len(full), pa.string()), "source": pa.array([group[1]] * len(full), pa.string()), "shard": pa.array(own.numbers[full].astype(np.int32)), "part": pa.array([part] * len(full), pa.int64())}
            return _packed(key, [slots[at[i] : at[i + 1]] - own.base[i] for i in full], [n[at[i] : at[i + 1]] for i in full])

        def add_up() -> None:
            nonlocal listed, times, waiting
            codes, where = np.unique(np.concatenate([listed, *heard]), return_inverse=True)
            more = np.bincount(where[len(listed) :], minlength=len(codes))
            more[where[: len(listed)]] += times
            listed, times, waiting = codes, more, 0
            heard.clear()

        def handed_on() -> Iterator[pa.RecordBatch]:
            nonlocal listed, times, part
            add_up()
            of = listed >> 40
            for group, number in late.items():
                a, b = np.searchsorted(of, (number, number + 1))
                if b > a:
                    yield counted(group, listed[a:b] & ((1 << 40) - 1), times[a:b])
            listed, times, part = listed[:0], times[:0], part + 1

        for batch in batches:
            for rows, data, offsets in tb.segments(batch, "text", _SEGMENT):
                words = tb.Words(data, offsets, tb.LETTER_LOWER)
                spelled, row_of = words.hashes(), words.row_of()
                langs, sources = (rows.column(rows.schema.get_field_index(c)).dictionary_encode() for c in ("lang", "source"))
                lang_of, source_of = langs.indices.to_numpy(), sources.indices.to_numpy()
                names = sources.dictionary.to_pylist()
                for code, lang in enumerate(langs.dictionary.to_pylist()):
                    if lang not in hashes:
                        continue
                    own = np.flatnonzero(lang_of[row_of] == code)
                    slot = hashes[lang].find(words.data, words.start[own], words.end[own], spelled[own])
                    own, slot = own[slot >= 0], slot[slot >= 0]
                    source = source_of[row_of[own]]
                    order = np.argsort(source, kind="stable")
                    slot, ends = slot[order], np.searchsorted(source[order], np.arange(len(names) + 1))
                    for i in np.flatnonzero(np.diff(ends)).tolist():
                        group, slots = (lang, names[i]), slot[ends[i] : ends[i + 1]]
                        if group not in dense and held + hashes[lang].keys <= dense_cells and group not in late:
                            dense[group] = np.zeros(hashes[lang].keys, np.int32)
                            held += hashes[lang].keys
                        if group in dense:
                            np.add.at(dense[group], slots, 1)
                        else:
                            heard.append(late.setdefault(group, len(late)) << 40 | slots)
                            waiting += len(slots)
            if waiting > LISTED:
                add_up()
                if len(listed) > LISTED:
                    yield from handed_on()
        for group, n in dense.items():
            some = np.flatnonzero(n)
            yield counted(group, some, n[some])
        yield from handed_on()

    return docs.select("lang", "source", "text").mapInArrow(work, f"lang string, source string, shard int, part bigint, {_COUNTS}")


_COUNTS = "slots binary, ns binary"


def _added(rows: DataFrame, *key: str) -> DataFrame:
    """Counts of the same key added up, a few dozen at a time in a task."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)

    def add(name: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        own = list(_unpacked(parts))
        total = np.zeros(max((int(s.max()) + 1 for s, _ in own if len(s)), default=0), np.int64)
        for slots, ns in own:
            total[slots] += ns
        some = np.flatnonzero(total)
        return pa.Table.from_batches([_packed({c: parts[c].combine_chunks().slice(0, 1) for c in key}, [some], [total[some]])])

    return rows.groupBy(*key).applyInArrow(add, f"{schema}, {_COUNTS}")


def _sums(keep: Scratch, rows: DataFrame, most: int, part: str, *key: str) -> DataFrame:
    """Adds up stored counts of each key, of which it has `most` at most, by as many rounds as keep FAN of them in a task."""
    while most > FAN:
        most = -(-most // FAN)
        rows = keep(_added(rows.withColumn("_lot", F.pmod(F.xxhash64(part), F.lit(most))), *key, "_lot").withColumnRenamed("_lot", part))
    return _added(rows, *key)


def recount(keep: Scratch, docs: DataFrame, hashes: DataFrame, pass_bytes: int = PASS_BYTES, dense_cells: int = DENSE_CELLS) -> DataFrame:
    """(lang, source, shard, slots, ns): occurrences of the kept terms in each group, a row for each shard that has any.

    hashes: as of perfect_hashes, stored.  The driver holds the shards of one pass, whose
    bytes are counted before; a table of shards of twice the size takes twice the passes.
    """
    size = F.length("blob").alias("_size")
    passes = max(1, -(-int(hashes.agg(F.sum(size)).first()[0] or 0) // pass_bytes))
    while True:
        number = F.pmod(F.xxhash64("lang", "shard"), F.lit(passes))
        largest = hashes.groupBy(number.alias("_pass")).agg(F.sum(size).alias("_size"), F.count("*").alias("_n")).agg(F.max(F.when(F.col("_n") > 1, F.col("_size")))).first()[0]
        if (largest or 0) <= 2 * pass_bytes:
            break
        passes *= 2
    out = None
    for p in range(passes):
        one = _recounted(docs, hashes.where(number == p).collect(), dense_cells)
        out = one if out is None else out.unionByName(one)
    out, key = keep(out), ("lang", "source", "shard")
    most = out.groupBy(*key).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    return _sums(keep, out, most, "part", *key)


def _share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), exact for totals below 9e15, by long division in steps of a thousand."""
    if len(total) and int(total.max()) > 9 * 10**15:
        raise OverflowError("more than 9e15 words in a group")
    rest = n + 1
    out, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _dense(rows: pa.Table, at: dict[str, int], keys: int) -> np.ndarray:
    """Counts by source (rows) and slot (columns)."""
    out = np.zeros((len(at), keys), np.int64)
    for source, (slots, ns) in zip(rows["source"].to_pylist(), _unpacked(rows), strict=True):
        out[at[source], slots] = ns
    return out


def _compared(key: tuple[pa.Scalar, ...], counts: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, source, item, value) of one shard and pair of source blocks: the divergence summed over the shard's terms."""
    lang, _, low, high = (x.as_py() for x in key)
    sources = groups["source"].to_pylist()
    block, total = groups["block"].to_numpy(), groups["total"].to_numpy()
    n = _dense(counts, {s: i for i, s in enumerate(sources)}, int(groups["keys"][0].as_py()) if groups.num_rows else 0)
    share = _share(n, np.maximum(total, 1)[:, None])
    out = {"source": [], "item": [], "value": []}
    for i, source in enumerate(sources):
        others = np.flatnonzero((block == (high if block[i] == low else low)) & (np.arange(len(sources)) != i))
        apart = share[i] - share[others]
        value = (apart * apart // share[others]).sum(axis=1)
        out["source"] += [source] * len(others)
        out["item"] += [sources[j] for j in others]
        out["value"] += value.tolist()
    return _told(lang, out)


def _told(lang: str, out: dict[str, list]) -> pa.Table:
    return pa.table({"lang": pa.array([lang] * len(out["source"]), pa.string()), "source": pa.array(out["source"], pa.string()), "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})


_TOLD = "lang string, source string, item string, value bigint"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, pass_bytes: int = PASS_BYTES, dense_cells: int = DENSE_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) for docs' lang, source and text; see the contract of the query.

    Part `pair` has every other source of a group's language with the divergence of the
    group's shares from that source's, summed over all kept terms; part `term` the terms
    that a group has more of than its language, up to `top`.  Null lang, source and text
    are empty texts, and so are a group and a language of their own.  Every row is a
    document, repeated ones too.  Ties rank by item.  A language with one source has no
    pairs; an empty table has no rows.  Other columns are not read.

    Counts travel as arrays of one shard's terms, and what a task compares is one shard's
    terms of at most some 2 x SOURCE_BLOCK sources.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def said(key: tuple[pa.Scalar, ...], counts: pa.Table, whole: pa.Table) -> pa.Table:
        """The terms of one shard that each source of a block has more of than the language; the first `top` of each are all that can count."""
        out = {"source": [], "item": [], "value": []}
        if counts.num_rows:
            data, offsets = shard_keys(whole["blob"][0].as_py())
            terms = tb.strings(data, offsets)
            every = np.zeros(len(terms), np.int64)
            slots, ns = next(_unpacked(whole))
            every[slots] = ns
            q = _share(every, whole["all"].to_numpy())
            for source, total, (slots, ns) in zip(counts["source"].to_pylist(), counts["total"].to_pylist(), _unpacked(counts), strict=True):
                p = _share(ns, np.full(len(ns), total))
                more = p > q[slots]
                own, apart, base = slots[more], (p - q[slots])[more], q[slots][more]
                value = apart * apart // base
                if len(value) > top:  # all that tie with the last one stay, to be ranked by name
                    most = value >= np.partition(value, len(value) - top)[len(value) - top]
                    own, value = own[most], value[most]
                out["source"] += [source] * len(own)
                out["item"] += terms.take(pa.array(own)).to_pylist()
                out["value"] += value.tolist()
        return _told(key[0].as_py(), out)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(x, np.int64).sum()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["lang", "source", "_n"])

    with Scratch() as keep:
        hashes = keep(perfect_hashes(kept_terms(texts, min_docs)))
        counts = keep(recount(keep, texts, hashes, pass_bytes, dense_cells))
        terms = hashes.groupBy("lang").agg(F.sum("keys").alias("v"))
        found = counts.select("lang", "source", "ns").mapInArrow(summed, "lang string, source string, _n bigint").groupBy("lang", "source").agg(F.sum("_n").alias("_n"))
        occurring = texts.select("lang", "source").distinct().join(terms, "lang", "left").join(found, ["lang", "source"], "left")
        blocks = F.ceil(F.count("*").over(Window.partitionBy("lang")) / SOURCE_BLOCK).cast("int")
        groups = keep(
            occurring.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("_n", F.lit(0)).alias("_n"), blocks.alias("blocks"))
            .select("lang", "source", (F.col("_n") + F.col("v")).alias("total"), F.col("_n"), "v", "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"))
        )
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        met = lambda rows, *own: rows.withColumn("_o", other).select("lang", "shard", F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high"), "source", *own)
        shards = hashes.select("lang", "shard", "keys")
        marks = met(groups.join(shards, "lang", "left").withColumn("shard", F.coalesce("shard", F.lit(0))).withColumn("keys", F.coalesce("keys", F.lit(0))), "block", "total", "keys")
        placed = counts.join(groups.select("lang", "source", "blocks", "block", "total"), ["lang", "source"])
        key = ["lang", "shard", "low", "high"]
        parts = met(placed, "slots", "ns").groupBy(*key).cogroup(marks.groupBy(*key)).applyInArrow(_compared, _TOLD)
        pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

        most = groups.groupBy("lang").agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
        whole = _sums(keep, counts.select("lang", "shard", "source", "slots", "ns"), most, "source", "lang", "shard")
        all_of = groups.groupBy("lang").agg((F.sum("_n") + F.max("v")).alias("all"), F.max("blocks").alias("blocks"))
        spelled = whole.join(hashes.select("lang", "shard", "blob"), ["lang", "shard"]).join(all_of, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        key = ["lang", "shard", "block"]
        apart = placed.select(*key, "source", "total", "slots", "ns").groupBy(*key).cogroup(spelled.select(*key, "all", "blob", "slots", "ns").groupBy(*key)).applyInArrow(said, _TOLD)
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).cast("int")
        told = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
        return cut(told(pairs, "pair").unionByName(told(apart, "term").where(F.col("rank") <= top)))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every source differs from the others of its language, and the terms that set it apart."""
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {MIN_DOCS}
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes USING (lang)
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, v
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n,
    1 + (CAST({SCALE} AS HUGEINT) * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p
  FROM dense
), overall AS (
  SELECT lang, term, 1 + (CAST({SCALE} AS HUGEINT) * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM (SELECT lang, term, sum(n) AS n, max(v) AS v FROM dense GROUP BY lang, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), said AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value
  FROM shares JOIN overall USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM said)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
