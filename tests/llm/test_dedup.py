"""Sharding, suffix, chunk and Jaccard deduplication, decontamination."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tests.oracle import connect, rows_of, rows_of_sql
from tidemark.llm import chunk_dedup, decontamination, near_duplicates, registry, sharding, suffix_dedup
from tidemark.llm import textbytes as tb


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, small, name):
    assert rows_of(registry.QUERIES[name](spark, small)) == rows_of_sql(connect(small), registry.SQL[name])


def frame(spark, rows, schema=plain.DOCS):
    return spark.createDataFrame(rows, schema)


def noisy_texts(seed, n=14):
    """Texts of passages from a common stock with edits, so that they share runs of all lengths."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(90)]
    stock = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))) for _ in range(5)]
    texts = []
    for _ in range(n):
        t = " ".join([rng.choice(stock) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(40)) for _ in range(rng.randint(1, 3))])
        if rng.random() < 0.7:
            at = rng.randrange(len(t))
            t = t[:at] + "#" * rng.randint(1, 3) + t[at + 2 :]
        texts.append(t)
    return [*texts, texts[0], "ab" * 300]


def twins(n):
    """Two different strings of n bytes that hashes modulo a power of two take for one."""
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t[:n], t[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 128, 256, 1024, 4096])
def test_hashes_tell_structured_texts_apart(n):
    data = np.frombuffer("".join(twins(n)).encode(), np.uint8)
    start, end = np.array([0, n]), np.array([n, 2 * n])
    for h in (tb.RollingHash(data).of(start, end), tb.span_hashes(data, start, end)):
        assert h[0] != h[1]
    again = np.concatenate([np.zeros(5, np.uint8), data])
    assert tb.RollingHash(again).of(start + 5, end + 5).tolist() == tb.RollingHash(data).of(start, end).tolist()


@pytest.mark.parametrize("n", [256, 1024])
def test_structured_texts_are_not_taken_for_each_other(spark, n):
    a, b = twins(n)
    df = frame(spark, [(1, a, None, None, 1), (2, b, None, None, 1)])
    rows = near_duplicates.classes(df, words=3, percent=90).collect()
    assert {r["component_id"] for r in rows} == {1, 2}
    hits = decontamination.decontaminate(df, frame(spark, [("7", a)], "item_id string, text string"))
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in hits.collect()} == {1: (1, ["7"]), 2: (0, [])}
    want = plain.removed_bytes([a.encode(), b.encode()], 200)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df).collect()}
    assert [got[1], got[2]] == [sum(x) for x in want]


def test_sharding_keeps_columns_of_the_names_that_it_works_with(spark):
    df = frame(spark, plain.awkward())
    for c in ("__slot", "__shard", "__at", "__SLOT_"):
        df = df.withColumn(c, F.lit(c))
    got = sharding.shard(df).collect()
    assert len(got) == df.count() and all(r["__slot"] == "__slot" and r["__shard"] == "__shard" and 0 <= r["slot"] < 2039 for r in got)


def test_one_row_of_a_class_stays_even_if_texts_share_a_key(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, None, "a", 1), (1, text + " more", None, "b", 1), (None, text + " other", None, "c", 1), (7, text, None, "d", 1), (None, "alone " * 9, None, "e", 1), (None, "alone " * 9, None, "f", 1)]
    got = near_duplicates.keep_first(frame(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "None"]


# sharding


def test_table_is_even_and_moves_little():
    before, after = (sharding.lookup_table([f"s{i}" for i in range(n)], 2039) for n in (16, 15))
    n = np.bincount(before)
    assert n.max() - n.min() <= 1
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a < 15)
    assert moved < 0.25 * 2039


def test_sharding_edges(spark):
    df = frame(spark, plain.awkward()).withColumn("slot", F.lit(-1)).withColumn("__slot2", F.lit(1))
    got = sharding.shard(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "__slot2", "slot", "shard"] and got.count() == df.count()
    assert got.where("slot < 0 or shard is null").count() == 0 and sharding.shard(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 7)


# suffixes


def test_cover_is_a_perfect_difference_set():
    assert sorted((a - b) % suffix_dedup.V for a in suffix_dedup.COVER for b in suffix_dedup.COVER if a != b) == list(range(1, suffix_dedup.V))


@pytest.mark.parametrize("seed,block", [(1, 1500), (2, 1 << 20)])
def test_repeats_against_brute_force(spark, seed, block):
    texts = noisy_texts(seed)
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(100, None, None, None, None), (101, "", None, None, None)]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, rows), block_bytes=block).collect()}
    raw = [(t or "").encode() for _, t, *_ in rows]
    for (key, *_), b, gone in zip(rows, raw, plain.removed_bytes(raw, 200), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        r = got[key]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), plain.spans(gone), plain.sha(kept))
    assert sum(r["n_removed"] for r in got.values()) > 0


def test_suffix_edges(spark):
    df = frame(spark, plain.awkward()).withColumn("block", F.lit(3)).withColumn("id", F.lit("x"))
    got = suffix_dedup.remove_repeats(df)
    assert got.count() == df.count() and got.where("doc_id is null").count() == 1 and suffix_dedup.remove_repeats(df.limit(0)).count() == 0


# chunks


def chunk_bounds(b):
    gear, h, ends = chunk_dedup._GEAR.tolist(), 0, []
    for i, x in enumerate(b):
        h = ((h << 1) + gear[x]) & 0xFFFFFFFF
        if i >= 31 and h >> (32 - chunk_dedup.MASK_BITS) == 0:
            ends.append(i)
    kept = [e for k, e in enumerate(ends) if not (k and e - ends[k - 1] < chunk_dedup.MIN_CHUNK)]
    out, start = [], 0
    for end in [*[e + 1 for e in kept if e + 1 < len(b)], len(b)]:
        while end - start > chunk_dedup.MAX_CHUNK:
            out.append((start, start + chunk_dedup.MAX_CHUNK))
            start += chunk_dedup.MAX_CHUNK
        if end > start:
            out.append((start, end))
        start = end
    return out


def test_chunk_borders_do_not_depend_on_neighbours():
    texts = [t.encode() for t in noisy_texts(3)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = chunk_dedup.borders(data, offsets).tolist()
    assert got == [o + a for o, t in zip(offsets.tolist(), texts, strict=False) for a, _ in chunk_bounds(t)]


def test_insertion_moves_few_chunks():
    rng = random.Random(4)
    b = bytes(rng.randrange(97, 123) for _ in range(5000))
    cut = lambda x: {x[i:j] for i, j in chunk_bounds(x)}
    assert len(cut(b) - cut(b[:2000] + b"zzz" + b[2000:])) <= 4


def random_words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 10))) for _ in range(n))


def test_planted_passages_are_found(spark):
    rng = random.Random(12)
    passages = [random_words(rng, 51) for _ in range(150)]
    rows = [(i, f"{random_words(rng, 40)} {p} {random_words(rng, 40)}", None, None, None) for i, p in enumerate(passages + passages)]
    got = {r["doc_id"]: r["n_removed"] for r in chunk_dedup.dedup_chunks(frame(spark, rows)).collect()}
    assert [i for i in range(300) if (got[i] >= chunk_dedup.MIN_RUN) != (i >= 150)] == []


def test_short_copies_go(spark):
    texts = ["a short text", "another", "a short text", "é", "é", "a short text, and more of it"]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_text"]) for r in chunk_dedup.dedup_chunks(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert got == {0: (0, 0, texts[0]), 1: (0, 0, texts[1]), 2: (12, 1, ""), 3: (0, 0, "é"), 4: (2, 1, ""), 5: (0, 0, texts[5])}


def test_an_owned_chunk_does_not_shield_the_rest_of_its_run(spark):
    b = random_words(random.Random(8), 200).encode()
    x, y = next((x, y) for x, y in chunk_bounds(b)[4:] if 32 <= y - x)
    before, after = b[x - 90 : x], b[y : y + 90]
    rest = random_words(random.Random(9), 60).encode()
    # the first text has what is around the chunk, the second all, the third the chunk with what is before it
    texts = [before + b[x : x + 20] + rest + b[y - 32 : y] + after, before + b[x:y] + after, before + b[x:y] + rest[:50]]
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_chunks(frame(spark, [(i, t.decode(), None, None, None) for i, t in enumerate(texts)])).collect()}
    first = {texts[0][i:j] for i, j in chunk_bounds(texts[0])}
    third = {texts[2][i:j] for i, j in chunk_bounds(texts[2])}
    chunks = [texts[1][i:j] for i, j in chunk_bounds(texts[1])]
    run = [c in first or c in third for c in chunks]
    assert b[x:y] in chunks and b[x:y] not in first and sum(len(c) for c, r in zip(chunks, run, strict=True) if r) >= 128
    assert got[1]["kept_text"] == b"".join(c for c in chunks if c not in first).decode()


@pytest.mark.parametrize("block", [1500, 1 << 20])
def test_first_copy_stays(spark, block):
    texts = noisy_texts(5)
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_chunks(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), block_bytes=block).collect()}
    raw = {i: t.encode() for i, t in enumerate(texts)}
    count, owner = {}, {}
    for i, b in raw.items():
        for x, y in chunk_bounds(b):
            count[b[x:y]] = count.get(b[x:y], 0) + 1
            owner.setdefault(b[x:y], (i, x))

    def runs(marks, chunks):
        out, i = [False] * len(chunks), 0
        while i < len(chunks):
            j = i
            while j < len(chunks) and marks[j]:
                j += 1
            if j > i and chunks[j - 1][1] - chunks[i][0] >= chunk_dedup.MIN_RUN:
                out[i:j] = [True] * (j - i)
            i = max(j, i + 1)
        return out

    for i, b in raw.items():
        chunks = chunk_bounds(b)
        seen = runs([count[b[x:y]] > 1 for x, y in chunks], chunks)
        gone = runs([s and owner[b[x:y]] != (i, x) for s, (x, y) in zip(seen, chunks, strict=True)], chunks)
        kept = b"".join(b[x:y] for g, (x, y) in zip(gone, chunks, strict=True) if not g)
        assert (got[i]["n_chunks"], got[i]["kept_sha256"], got[i]["kept_text"]) == (len(chunks), plain.sha(kept), kept.decode("utf-8", "replace"))
    assert got[len(texts) - 2]["n_removed"] > 0 and got[0]["n_removed"] < len(raw[0])


def test_chunk_edges(spark):
    df = frame(spark, plain.awkward())
    got = chunk_dedup.dedup_chunks(df)
    assert got.count() == df.count() and chunk_dedup.dedup_chunks(df.limit(0)).count() == 0


# Jaccard


def near_copies(seed, n=60):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 90))] for _ in range(6)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(300)}"
        out.append((i, " ".join(w)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "Word"), (n + 3, "word"), (n + 4, "two words")]


def test_packed_counts_are_within_a_tenth():
    counts = np.array([0, 1, 127, 128, 129, 1000, 123_456, 7_000_000], np.int32)
    back = near_duplicates._UNPACKED[np.frombuffer(zlib.decompress(near_duplicates._packed(counts)), np.uint8)].astype(float)
    assert (back <= counts).all() and (back >= 0.91 * counts).all() and back[:4].tolist() == [0, 1, 127, 128]


@pytest.mark.parametrize("words,percent,block,entries", [(3, 90, 2000, None), (5, 80, 7, 4), (2, 60, 2000, 2), (3, 90, 2000, 1)])
def test_classes_against_brute_force(spark, monkeypatch, words, percent, block, entries):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    if entries:  # lists are sorted in parts
        monkeypatch.setattr(near_duplicates, "LIST_ENTRIES", entries)
        monkeypatch.setattr(near_duplicates, "LIST_LOAD", 0)
        assert (near_duplicates.list_parts(1.0)[:8] > 1).any()
    docs = near_copies(words)
    got = near_duplicates.classes(frame(spark, docs, "doc_id long, text string"), words=words, percent=percent).collect()
    roots, sizes = plain.classes(docs, words, percent)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {k: (roots[k], sizes[k]) for k, _ in docs}
    assert len(set(roots.values())) < len(docs) - 5


def test_sets_that_meet_by_chance_are_no_candidates(spark):
    chain = [(token, -1, sid, 100, 0) for sid in range(200) for token in (sid, sid + 1)]
    close = [(1000 + token, -1, 500 + sid, 100, 0) for sid in range(2) for token in range(14)]
    hub = [(2000, -1, 600 + sid, 100 if sid < 40 else 300, 0) for sid in range(80)]
    entries = spark.createDataFrame(chain + close + hub, "token bigint, part int, sid bigint, n int, pos int")
    got = {tuple(r) for r in near_duplicates.candidate_edges(entries, 80, False).collect()}
    assert got == {(500, 501), *((600, 600 + i) for i in range(1, 40)), *((640, 640 + i) for i in range(1, 40))}


@pytest.mark.parametrize("paired", [2, 4, 32])
def test_candidates_tie_every_class(monkeypatch, paired):
    monkeypatch.setattr(near_duplicates, "PAIRED", paired)
    rng = np.random.default_rng(paired)
    for _ in range(60):
        percent = int(rng.choice([60, 80, 90]))
        base, sets = rng.integers(0, 90, int(rng.integers(3, 40))), []
        for _ in range(int(rng.integers(2, 20))):
            x = base[: int(rng.integers(len(base) * 3 // 4, len(base) + 1))].copy()
            k = int(rng.integers(0, 5))
            x[rng.integers(0, len(x), k)] = rng.integers(0, 120, k)
            sets.append(np.unique(x))
        n = np.array([len(s) for s in sets])
        rows = sorted((int(g), -1, int(n[i]), i) for i, s in enumerate(sets) for g in s[: near_duplicates.prefix_size(n[i], percent)])
        token, part, size, sid = (np.array(x) for x in zip(*rows, strict=True))
        needed, shared = {}, {}
        for a, b, need, *_ in near_duplicates._list_edges(token, part, sid, size, percent):
            for x, y, z in zip(a.tolist(), b.tolist(), need.tolist(), strict=True):
                shared[x, y] = shared.get((x, y), 0) + 1
                needed[x, y] = min(z, needed.get((x, y), z))
        f = near_duplicates._Forest(len(sets))
        for x, y in shared:
            if shared[x, y] >= needed[x, y]:
                f.join(x, y)
        for i in range(len(sets)):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                assert 100 * c < percent * (n[i] + n[j] - c) or f.find(i) == f.find(j)


def test_cluster_links_span_the_classes():
    rng = np.random.default_rng(0)

    def components(n, links):
        f = near_duplicates._Forest(n)
        for a, b in links:
            f.join(a, b)
        return [f.find(i) for i in range(n)]

    for _ in range(40):
        m, base = int(rng.integers(2, 25)), rng.integers(0, 200, int(rng.integers(5, 40)))
        sets = []
        for _ in range(m):
            x, k = base.copy(), int(rng.integers(0, 6))
            x[rng.integers(0, len(x), k)] = rng.integers(0, 300, k)
            sets.append(np.unique(x).astype(np.uint64))
        for percent in (80, 90):
            linked = lambda i, j: (lambda c: 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c))(len(np.intersect1d(sets[i], sets[j])))  # noqa: E731, B023
            pairs = [(i, j) for i in range(m) for j in range(i) if linked(i, j)]
            assert components(m, pairs) == components(m, near_duplicates.cluster_links(sets, None, percent))
            h = m // 2
            across = [(i, j) for i, j in pairs if (i < h) != (j < h)]
            assert components(m, across) == components(m, near_duplicates.cluster_links(sets[:h], sets[h:], percent))


def test_keep_first_and_edges(spark):
    df = frame(spark, plain.awkward()).withColumn("key", F.lit(1)).withColumn("component_id", F.lit(2))
    kept = near_duplicates.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 8, 9]
    assert near_duplicates.keep_first(df.limit(0)).count() == 0


# decontamination

ITEMS = [(1, "a b c d e f g h i j k l"), (2, "short item here"), (3, None), (4, "!!"), (5, "d e f g h i j k l m n o"), (2, "short item here"), (6, "x1")]


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_hits_against_brute_force(spark, block):
    rng = random.Random(8)
    texts = ["A b c d e, f g h i j", "a b c d e f g h i", "z a b c d e f g h i j k l m n o p", "A short  item-here x1", "", None, "d e f g h i j k l m"]
    texts += [" ".join(rng.choice("abcdefghijklmno") for _ in range(40)) + " " + " ".join("abcdefghijkl"[rng.randrange(3) : rng.randrange(9, 13)]) for _ in range(20)]
    docs = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    got = decontamination.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), block_bytes=block).collect()
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == plain.hit_words(texts[r["doc_id"]], ITEMS), texts[r["doc_id"]]


def test_decontamination_edges(spark):
    df = frame(spark, plain.awkward(((11, "a b c d e f g h i j", "en", "s", 1),))).withColumn("items", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontamination.drop_contaminated(df, items)
    assert kept.columns == df.columns and kept.count() == df.count() - 1
    assert decontamination.drop_contaminated(df, items.limit(0)).count() == df.count() and decontamination.decontaminate(df.limit(0), items).count() == 0


def test_shared_fingerprint_is_guaranteed():
    rng = np.random.default_rng(9)
    for _ in range(200):
        shared = rng.integers(0, 50, 10).astype(np.uint64)
        both = [np.concatenate([rng.integers(0, 50, int(rng.integers(0, 9))).astype(np.uint64), shared, rng.integers(0, 50, int(rng.integers(0, 9))).astype(np.uint64)]) for _ in range(2)]
        prints = []
        for w in both:
            g = tb.grams(tb.mix(w), decontamination.K)
            prints.append(set(g[decontamination.fingerprints(g, np.ones(len(g), bool), 6)].tolist()))
        assert prints[0] & prints[1]


PASSAGE = "".join(f"{i * 7919 % 1000} walked along the shore of lake {i * 31 % 77} and " for i in range(20))


def test_texts_of_one_id_share_passages(spark):
    """Different texts under one id, null ids too, are different texts; equal rows are one text."""
    rows = [(None, "first of none " + PASSAGE), (None, PASSAGE + " second of none"), (4, "one " + PASSAGE), (4, PASSAGE + " two"), (4, PASSAGE + " two"), (9, "alone " + PASSAGE)]
    for given in (rows[:2], rows[2:5], rows):
        got = chunk_dedup.dedup_chunks(frame(spark, given, "doc_id long, text string").repartition(3), block_bytes=600).collect()
        kept = {(r["doc_id"], r["n_bytes"]) for r in got if r["n_removed"] < 100}
        owner = kept.pop()
        assert not kept and owner[0] == (None if given == rows[:2] else 4)
        assert all(r["n_removed"] > 600 for r in got if (r["doc_id"], r["n_bytes"]) != owner)


def test_the_shortest_run_is_an_argument(spark):
    line = "a line of fifty-six bytes which four of the documents.. "
    rows = [(i, f"{i * 7919} words of its own {i} " * 3 + line + f" and more of {i} {i * 31337}" * 3) for i in range(4)]
    for least, gone in ((64, 0), (0, 12)):
        got = chunk_dedup.dedup_chunks(frame(spark, rows, "doc_id long, text string"), min_run=least).collect()
        assert min(r["n_removed"] for r in got if r["doc_id"]) >= gone and sum(r["n_removed"] for r in got if not r["doc_id"]) == 0
        if not gone:
            assert sum(r["n_removed"] for r in got) == 0


def test_a_text_above_a_batch(spark):
    """Three megabytes in one text, twice, and a part of it in another."""
    long = " ".join(f"w{i * 7919 % 100003}x{i}" for i in range(230_000))
    assert len(long) > 3_000_000
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_chunks(frame(spark, [(1, long), (2, long), (3, "own words " + long[1000:3000]), (4, "quite another")], "doc_id long, text string"), with_text=False).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == len(long) and got[3]["n_removed"] > 1700 and got[4]["n_removed"] == 0
