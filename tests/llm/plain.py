"""Slow, plain versions of the operators, and the awkward rows that all of them meet."""

import collections
import hashlib
import math
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(extra=()):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(6000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s1", 0), (3, "   \n\t", "en", "s1", 3), (None, "some words without an id at all", "en", None, 5),
        (5, "one two three four five six seven", "en", "s2", 1), (5, "one two three four five six seven", "en", "s2", 1),
        (6, "one two three four five six seven", "fr", "s2", 1), (7, "é ñ ß 12 !!", None, "s3", 1), (8, long, "en", "s3", 1), (9, "x", "en", "s1", 1),
    ]
    return [*rows, *extra]


def removed_bytes(texts, length):
    """Per text: marks of bytes that a repeated string of `length` bytes covers."""
    seen = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return out


def spans(marks):
    return sum(1 for i, m in enumerate(marks) if m and not (i and marks[i - 1]))


def sha(x):
    return hashlib.sha256(x).hexdigest()


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(docs, n, percent):
    """Smallest key of each text's class; docs is a list of (key, text) with keys that differ."""
    sets = {k: shingles(t, n) for k, t in docs}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: find(k) for k in keys}, {k: len(s) for k, s in sets.items()}


def hit_words(text, items, span=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    w = words(text)
    hit, found = set(), set()
    for name, t in items:
        x = words(t)
        n = min(span, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by sharing the excess out again until no source is above its cap; sizes is a list in source order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, target, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(w[i] for i in free)
        over = [i for i in free if w[i] * unit > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = w[i] * unit
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            left -= target[i]
            free.discard(i)
    return target


def _alone(text):
    import pyarrow as pa

    from tidemark.llm import textbytes as tb

    return tb.utf8(pa.array([text]))


def grade(text, model, features):
    """(expected grade, probability of more than the lowest) by adding up the weights of one text's features."""
    ids = features(*_alone(text))[0].tolist()
    eta = sum(float(model.weights[i]) for i in ids) / max(1, len(ids))
    above = [1 / (1 + math.exp(-(eta - t))) for t in model.thresholds.tolist()]
    likely = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
    return sum(g * p for g, p in zip(model.grades, likely, strict=True)), above[0]


def language(text, model, ngrams):
    """(language, probability) by adding up the weights of one text's n-grams."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    count = collections.Counter(ngrams(*_alone(text))[0].tolist())
    total = sum(count.values())
    z = [(sum(n * float(model.values[i, c]) for i, n in count.items()) / total + float(model.bias[c])) / model.temperature for c in range(len(model.languages))]
    e = [math.exp(x - max(z)) for x in z]
    best = max(range(len(z)), key=lambda c: (e[c], -c))
    return model.languages[best], e[best] / sum(e)


def toxicity(text, model, bins):
    """Score of one text: the trees' votes one by one, then the step of the calibration in which they fall."""
    from pyspark.ml.linalg import Vectors

    x = Vectors.dense(model.lexicon.features(*_alone(text))[0].tolist())
    margin = sum(w * t.predict(x) for w, t in zip(model.trees.treeWeights, model.trees.trees, strict=True))
    raw = 1 / (1 + math.exp(-2 * margin))
    level = next((y for top, y in model.steps if raw <= top + 0.5 / bins), model.steps[-1][1] if model.steps else raw)
    return min(1.0, max(0.0, 0.98 * level + 0.02 * raw))
