"""Quality: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector w over hashed features is shared by all grades; ordered
thresholds t split the line, P(grade > k) = logistic(w.x - t[k]).  Features are
hashed words as written, pairs of byte classes of neighbouring words (their
casing, signs and length) with a mark where a word repeats the one before, and
byte trigrams, each as its mean over the text.  A bounded sample of each grade
trains weights and thresholds; every whole text gets its expected grade and the
probability of the top grades, which selection uses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import linear
from tidemark.llm import textbytes as tb
from tidemark.llm.common import bound_batches, table

BITS = 16
DIMS = 1 << BITS
#: Training texts of each grade, about.
PER_GRADE = 3_000
EPOCHS, BATCH, RATE, SHRINK = 6, 32, 0.5, 1e-6
SCALE = 20.0
#: A text is kept if the probability of a grade above the lowest is this or more.
KEEP = 0.5

_CLASS = np.full(256, 5, np.uint8)  # other signs
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x80:] = 1
_CLASS[[ord(x) for x in ".,;:'-"]] = 4


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each row: words, shapes of word pairs, byte trigrams."""
    rows = len(offsets) - 1
    words = tb.Words(data, offsets, tb.NOT_SPACE, lower=False)
    shift = np.uint64(64 - BITS)
    row_of = words.row_of()
    parts, at_rows = [], []
    if len(row_of):
        h = words.hashes()
        parts.append(h >> shift)
        at_rows.append(row_of)
        kinds = np.zeros(len(h), np.uint64)
        for c in range(1, 6):
            count = np.concatenate(([0], np.cumsum(_CLASS[data] == c)))
            n = count[words.end] - count[words.start]
            kinds = kinds * np.uint64(4) + np.minimum(n, 3).astype(np.uint64)
        before, repeated = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
        before[1:] = np.where(row_of[1:] == row_of[:-1], kinds[:-1] + np.uint64(1), 0)
        repeated[1:] = (h[1:] == h[:-1]) & (row_of[1:] == row_of[:-1])
        repeated[2:] += np.uint64(2) * ((h[2:] == h[:-2]) & (row_of[2:] == row_of[:-2]))
        parts.append(tb.mix((kinds * np.uint64(2048) + before) * np.uint64(4) + repeated + np.uint64(1 << 40)) >> shift)
        at_rows.append(row_of)
    if len(data) > 2:
        row = np.repeat(np.arange(rows), np.diff(offsets))
        d = data.astype(np.uint64)
        tri = tb.mix((d[:-2] << np.uint64(16)) + (d[1:-1] << np.uint64(8)) + d[2:] + np.uint64(1 << 50)) >> shift
        same = row[2:] == row[:-2]
        parts.append(tri[same])
        at_rows.append(row[2:][same])
    counts = [np.bincount(r, minlength=rows) for r in at_rows]
    total = np.concatenate(([0], np.cumsum(sum(counts) if counts else np.zeros(rows, np.int64)))).astype(np.int64)
    out = np.empty(total[-1], np.uint32)
    base = total[:-1].copy()
    for part, n in zip(parts, counts, strict=True):  # a row's features lie together
        start = np.concatenate(([0], np.cumsum(n)))[:-1]
        out[np.repeat(base - start, n) + np.arange(len(part))] = part
        base = base + n
    return out, total


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each of the lower grades k."""
        return logistic(eta[:, None] - self.thresholds)


def fit_ordinal(x: linear.Csr, y: np.ndarray, grades: int, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by adaptive gradient steps on the likelihood.

    The first threshold and the logarithms of the gaps are free, so the order of
    thresholds holds at every step.
    """
    w, seen = np.zeros((dims, 1)), np.full((dims, 1), 1e-6)
    first, gaps = 0.0, np.zeros(max(0, grades - 2))
    rng = np.random.default_rng(23)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            eta = x.dot(w, own)[:, 0]
            t = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
            cdf = np.hstack([np.zeros((len(own), 1)), logistic(t - eta[:, None]), np.ones((len(own), 1))])
            density = cdf * (1 - cdf)
            r = np.arange(len(own))
            p = np.maximum(cdf[r, y[own] + 1] - cdf[r, y[own]], 1e-9)
            to_eta = (density[r, y[own] + 1] - density[r, y[own]]) / p  # of the loss
            used, g = x.back(own, to_eta[:, None] / len(own), dims)
            g += SHRINK * w[used]
            seen[used] += g * g
            w[used] -= RATE * g / np.sqrt(seen[used])
            to_t = np.zeros(grades - 1)
            for k in range(grades - 1):
                to_t[k] = (-(density[:, k + 1] / p) * (y[own] == k) + (density[:, k + 1] / p) * (y[own] == k + 1)).mean()
            step = 0.2 / (1 + epoch)
            first -= step * to_t.sum()
            for k in range(len(gaps)):
                gaps[k] -= step * to_t[k + 1 :].sum() * np.exp(gaps[k])
    return w[:, 0], first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "quality", per_grade: int = PER_GRADE) -> Model | None:
    """Learns from documents (doc_id, text) with ratings (doc_id, grade); None below two grades.

    A document that was rated more than once counts with its lowest grade.
    """
    rated = ratings.where(F.col(grade).isNotNull()).groupBy("doc_id").agg(F.min(grade).cast("int").alias("grade"))
    picked = linear.sample_by_class(rated, "grade", per_grade, "doc_id")
    # the sample is of bounded size: per_grade of each grade, about
    sample = linear.sparse_rows(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "grade", features)
    grades = sorted({g for g, _, _ in sample})
    if len(grades) < 2:
        return None
    x = linear.Csr([(ids, vals * np.float32(SCALE)) for _, ids, vals in sample])
    w, t = fit_ordinal(x, np.array([grades.index(g) for g, _, _ in sample]), len(grades))
    return Model(grades, (w * SCALE).astype(np.float32), t)


def grade(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade above the lowest) and keep for each row.

    A null or empty text has no features and gets the grade that the thresholds alone
    give.  Where nothing could be learned the grade and probability are null and every
    row is kept.  Equal texts get equal grades; other columns are not read.
    """
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("keep"))
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        values, steps = m.weights[:, None], np.diff(np.array(m.grades, float))
        for batch in batches:
            for rows, data, offsets in tb.segments(batch, "text"):
                f, at = features(data, offsets)
                tails = m.tails(linear.row_means(values, f, at)[:, 0])
                expected = m.grades[0] + tails @ steps
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(expected), pa.array(tails[:, 0])], ["doc_id", "expected_grade", "tail_probability"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, expected_grade double, tail_probability double")
    return scored.withColumn("keep", F.col("tail_probability") >= keep)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, fit(docs, table(spark, sf_dir, "labels")))
