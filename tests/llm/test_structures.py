"""Divergence of sources, packing of sequences, the trie of conversations."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import plain
from tidemark.llm import divergence, packing, prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def told(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- divergence


def plain_audit(docs, min_docs=3, top=200):
    import re

    df, count, groups = collections.Counter(), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source, _ in docs:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", plain.lower(text or ""))
        groups.add((lang, source))
        count[lang, source].update(words)
        df.update((lang, w) for w in set(words))
    out = []
    for lang, source in groups:
        kept = sorted(w for (g, w), n in df.items() if g == lang and n >= min_docs)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(names, lang=lang, kept=kept):
            n = {w: sum(count[lang, s][w] for s in names) for w in kept}
            total = sum(n.values()) + len(kept)
            return {w: 1 + 10**9 * (n[w] + 1) // total for w in kept}

        own, every = shares([source]), shares(sources)
        f = lambda p, q: (p - q) ** 2 // q
        pairs = [(sum(f(own[w], q) for w, q in shares([s]).items()), s) for s in sources if s != source]
        terms = [(f(own[w], every[w]), w) for w in kept if count[lang, source][w] and own[w] > every[w]]
        for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(rows, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def worded(seed, n=60):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdéßxyz") for _ in range(rng.randint(1, 14))) for _ in range(120)] + ["z" * 90, "z" * 91]
    return [
        (i, " ".join(rng.choice(stock).title() if rng.random() < 0.2 else rng.choice(stock) for _ in range(rng.randint(0, 40))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None, "é"]), 0)
        for i in range(n)
    ]


AUDIT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("limits", [{}, {"pass_bytes": 500, "dense_cells": 30}, {"min_docs": 1, "top": 3}])
def test_audit_is_the_plain_one(spark, limits, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_KEYS", 16)
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)
    monkeypatch.setattr(divergence, "FAN", 2)
    monkeypatch.setattr(divergence, "LISTED", 20)
    docs = [*worded(1), *plain.awkward()]
    got = divergence.audit(spark.createDataFrame(docs, plain.DOCS).repartition(3), **limits)
    assert told(got, *AUDIT) == plain_audit(docs, **{k: v for k, v in limits.items() if k in ("min_docs", "top")})


def test_audit_of_nothing_and_of_clashing_columns(spark):
    assert divergence.audit(spark.createDataFrame([], plain.DOCS)).count() == 0
    docs = worded(2, 20)
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], plain.DOCS + ", item int, shard int, value int")
    assert told(divergence.audit(frame), *AUDIT) == plain_audit(docs)


def test_perfect_hash_finds_its_keys_and_no_others():
    rng = random.Random(3)
    words = list({bytes(rng.choices(b"abcdefgh", k=rng.randint(1, 12))) for _ in range(5000)})
    keys, others = words[:3000], words[3000:]
    lay = lambda ws: (np.frombuffer(b"".join(ws), np.uint8), np.cumsum([len(w) for w in ws]) - [len(w) for w in ws], np.cumsum([len(w) for w in ws]))
    hashes = lambda d: divergence.tb.span_hashes(*d)
    shard = divergence._placed(hashes(lay(keys)), 3)
    blobs = [(s, divergence.build_shard([k for k, t in zip(keys, shard, strict=True) if t == s])) for s in range(3)]
    found = divergence.PerfectHash(3, blobs)
    slots = found.find(*lay(keys), hashes(lay(keys)))
    assert sorted(slots.tolist()) == list(range(3000))
    assert (found.find(*lay(others), hashes(lay(others))) == -1).all()
    part = divergence.PerfectHash(3, blobs[1:2])
    some = part.find(*lay(keys), hashes(lay(keys)))
    assert ((some >= 0) == (shard == 1)).all()


def test_keys_of_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(divergence.tb, "span_hashes", lambda d, s, e: np.full(len(s), 12345, np.uint64))
    data, at = np.frombuffer(b"abcdx", np.uint8), np.arange(5)
    found = divergence.PerfectHash(1, [(0, divergence.build_shard([b"a", b"b", b"c", b"d"]))])
    assert sorted(found.find(data, at[:4], at[:4] + 1, np.full(4, 12345, np.uint64)).tolist()) == [0, 1, 2, 3]
    assert found.find(data, at[4:], at[4:] + 1, np.full(1, 12345, np.uint64)).tolist() == [-1]


# --- packing


def best_fit(lengths, size):
    """Remaining room of every sequence, piece by piece."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(size - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 64, 200])
    lengths = [min(size, int(rng.paretovariate(0.6))) if seed % 2 else rng.randint(1, size) for _ in range(rng.randint(1, 900))]
    counts = collections.Counter(lengths)
    plan = packing.Plan(packing.best_fit_runs(counts, size))
    used = collections.defaultdict(list)
    for n, c in counts.items():
        sequence, offset = plan.places(np.full(c, n), np.arange(c))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            used[s].append((o, n))
    room = []
    for own in used.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        room.append(size - at)
    assert sorted(room) == best_fit(lengths, size)


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b  c", "naïve 'll 12\n\n\t é ß 你好 　x", "ab " * 5000, " " * 9000 + "x", "é" * 7000, "\r\n" * 50 + "1234567" * 30])
def test_ids_are_the_tokenizers_own(text):
    with open(TOKENIZER) as f:
        raw = f.read()
    assert packing.encoder(raw)(text).tolist() == Tokenizer.from_str(raw).encode(text, add_special_tokens=False).ids


def plain_pieces(docs, size):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    out = []
    for d, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % size + 1
        cuts = [0, *range(first, len(ids) + 1, size)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out.append((d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")
none_last = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("size", [2048, 50])
def test_packed_documents(spark, size, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 5)
    docs = [*plain.awkward(), *worded(5, 40)]
    packed = packing.pack(spark.createDataFrame(docs, plain.DOCS).repartition(3), packing.tokenizer_text(TOKENIZER), size, with_ids=True)
    rows = packed.collect()
    want = plain_pieces([(d[0], d[1]) for d in docs], size)
    assert sorted((tuple(r[c] for c in PIECE) for r in rows), key=none_last) == sorted(want, key=none_last)
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
    for own in used.values():
        at = 0
        for o, n, _ in sorted(own):
            assert o == at
            at += n
        assert at <= size
    assert sorted(size - sum(n for _, n, _ in own) for own in used.values()) == best_fit([w[3] for w in want], size)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert whole == {s: [i for _, _, ids in sorted(own) for i in ids] for s, own in used.items()}


def test_packing_of_nothing_other_ids_and_clashing_columns(spark):
    raw = packing.tokenizer_text(TOKENIZER)
    assert packing.pack(spark.createDataFrame([], plain.DOCS), raw).count() == 0
    frame = spark.createDataFrame([("x", "one two", 1, 2, 3)], "doc_id string, text string, row int, length int, sequence_id int")
    assert [r["doc_id"] for r in packing.pack(frame, raw).collect()] == ["x"]


# --- conversations


def plain_trie(turns):
    convs = collections.defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, own in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(own) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(whole[c]) == len(n))))
        out.append((min(own), len(n), min(members[n[:-1]]) if n else -1, len(own), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in NODE) for r in df.collect())


def talks(seed, n=150):
    rng = random.Random(seed)
    stock = [(rng.choice(["user", "assistant", None]), rng.choice(["é" * rng.randint(0, 9), "yes", None, "a b" * rng.randint(1, 4)])) for _ in range(6)]
    out = []
    for c in rng.sample(range(700), n):
        path = [rng.choice(stock[:2]) for _ in range(rng.randint(1, 3))] + [rng.choice(stock) for _ in range(rng.randint(0, 4))]
        out += [(c, t if rng.random() < 0.9 else None, *x) for t, x in enumerate(path)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("container", [1 << 20, 200, 1])
def test_trie_is_the_plain_one(spark, container):
    turns = [*talks(container), (None, 1, "user", "of nobody"), (900, 1, "user", "alone"), (900, 1, "user", "alone"), *((c, t, "user", f"t{t}") for c in range(1000, 1012) for t in range(30))]
    got = prefix_trie.conversation_trie(spark.createDataFrame(turns, TURNS).repartition(3), container, 4000)
    assert nodes(got) == plain_trie(turns)


def test_copies_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    turns = [(c, 1, "user", "hello") for c in range(100, 160)] + [(c, 2, "user", "bye") for c in range(100, 130)]
    assert nodes(prefix_trie.conversation_trie(spark.createDataFrame(turns, TURNS), 1)) == plain_trie(turns)


def test_trie_of_nothing_of_one_and_of_clashing_columns(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    one = [(7, 1, "user", "x")]
    assert nodes(prefix_trie.conversation_trie(spark.createDataFrame(one, TURNS))) == plain_trie(one)
    frame = spark.createDataFrame([(*t, b"1", 2, 3) for t in talks(9, 20)], TURNS + ", seq binary, head int, n int")
    assert nodes(prefix_trie.conversation_trie(frame)) == plain_trie(talks(9, 20))


def test_texts_above_a_batch(spark):
    """Three megabytes in one text are packed, and audited, whole."""
    long = " ".join(f"w{i * 7919 % 100003}x{i}" for i in range(230_000))
    docs = [(1, long, "en", "a", 0), (2, "wx wx wx", "en", "b", 0), (3, "wx", "en", "b", 0)]
    packed = packing.pack(spark.createDataFrame(docs[:2], plain.DOCS), packing.tokenizer_text(TOKENIZER)).collect()
    assert sorted(tuple(r[c] for c in PIECE) for r in packed) == sorted(plain_pieces([(d[0], d[1]) for d in docs[:2]], 2048))
    assert told(divergence.audit(spark.createDataFrame(docs, plain.DOCS)), *AUDIT) == plain_audit(docs)
