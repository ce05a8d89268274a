"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Lower-cased n-grams of one to three characters are hashed; their inverse document
frequencies are counted over every document that may be learned from.  A bounded
sample of each language trains the weights by follow-the-regularised-leader with
elastic-net penalties (the l1 part keeps most weights at zero); a temperature,
fitted on a part of the sample that is held back, calibrates the probabilities.
Prediction reads whole texts: the mean over a text's n-grams of weight times
inverse document frequency is its TF-IDF vector's product with the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import linear
from tidemark.llm import textbytes as tb
from tidemark.llm.common import bound_batches, fold, table

BITS = 16
DIMS = 1 << BITS
#: Training texts of each language, about.
PER_LANGUAGE = 800
EPOCHS = 4
BATCH = 32
#: Brings mean TF-IDF values, of the order of a hundredth, near one.
SCALE = 20.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
HELD_OUT = (3, 1)
UNKNOWN = "und"


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one, two and three characters of each row."""
    raw = data.tobytes()
    points = [np.frombuffer(raw[offsets[r] : offsets[r + 1]].decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for r in range(len(offsets) - 1)]
    sizes = np.array([len(p) for p in points], np.int64)
    if len(points) == 1:
        return _alone(points[0])
    c = np.concatenate(points) if points else np.zeros(0, np.uint32)
    at = np.concatenate(([0], np.cumsum(sizes)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    one = c * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - BITS)
    parts, rows = [one >> shift], [row]
    hashed = one
    for k, salt in ((1, np.uint32(0x85EBCA6B)), (2, np.uint32(0xC2B2AE35))):
        if len(c) <= k:
            break
        hashed = (hashed[: len(c) - k] ^ (c[k:] + np.uint32(k))) * salt
        same = row[k:] == row[:-k]
        parts.append((hashed >> shift)[same])
        rows.append(row[k:][same])
    counts = [np.bincount(r, minlength=len(sizes)) for r in rows]
    total = np.concatenate(([0], np.cumsum(sum(counts)))).astype(np.int64)
    out = np.empty(total[-1], np.uint32)
    base = total[:-1].copy()
    for part, n in zip(parts, counts, strict=True):  # a row's n-grams lie together
        start = np.concatenate(([0], np.cumsum(n)))[:-1]
        out[np.repeat(base - start, n) + np.arange(len(part))] = part
        base += n
    return out, total


def _alone(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of one row, which may be very long."""
    n, shift = len(c), np.uint32(32 - BITS)
    out = np.empty(n + max(0, n - 1) + max(0, n - 2), np.uint32)
    hashed = c * np.uint32(0x9E3779B1)
    out[:n], at = hashed >> shift, n
    for k, salt in ((1, np.uint32(0x85EBCA6B)), (2, np.uint32(0xC2B2AE35))):
        if n <= k:
            break
        hashed = (hashed[: n - k] ^ (c[k:] + np.uint32(k))) * salt
        out[at : at + n - k] = hashed >> shift
        at += n - k
    return out, np.array([0, len(out)])


@dataclass
class Model:
    languages: list[str]
    values: np.ndarray  # weight times inverse document frequency, by feature and language
    bias: np.ndarray
    temperature: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        features, at = ngrams(data, offsets)
        return softmax((linear.row_means(self.values, features, at) + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def follow_the_leader(x: linear.Csr, y: np.ndarray, rows: np.ndarray, classes: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal over the given rows; weights and biases by class."""
    z, n = np.zeros((dims, classes)), np.zeros((dims, classes))
    w, bias = np.zeros((dims, classes)), np.zeros(classes)
    rng = np.random.default_rng(17)
    for _ in range(EPOCHS):
        order = rng.permutation(rows)
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            errors = softmax(x.dot(w, own) + bias)
            errors[np.arange(len(own)), y[own]] -= 1
            used, g = x.back(own, errors, dims)
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / ALPHA
            z[used] += g - sigma * w[used]
            n[used] += g * g
            zu = z[used]
            w[used] = np.where(np.abs(zu) <= L1, 0.0, -(zu - np.sign(zu) * L1) / ((BETA + np.sqrt(n[used])) / ALPHA + L2))
            bias -= 0.01 * errors.mean(axis=0)
    return w, bias


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that were not trained on."""
    if not len(y):
        return 1.0
    tried = np.geomspace(0.05, 20, 200)
    doubt = 1 / (len(y) + 2)  # as if one more row had been wrong, or a faultless fit would ask for certainty
    logs = [np.log(np.maximum(softmax(logits / t), 1e-300)) for t in tried]
    loss = [-((1 - doubt) * x[np.arange(len(y)), y].mean() + doubt * x.mean()) for x in logs]
    return float(tried[int(np.argmin(loss))])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learns from rows (doc_id, text, lang); None if there is nothing to learn from.

    The model is bounded: more than linear.MAX_CLASSES languages are an error.
    """
    linear.check_classes(docs, "lang")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    bound_batches(docs.sparkSession)
    n, df = linear.document_frequencies(rows, ngrams, DIMS)
    if not n:
        return None
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    sample = linear.sparse_rows(linear.sample_by_class(rows, "lang", per_language, "doc_id", "text"), "lang", ngrams)
    languages = sorted({label for label, _, _ in sample})
    x = linear.Csr([(ids, (vals * idf[ids] * SCALE).astype(np.float32)) for _, ids, vals in sample])
    y = np.array([languages.index(label) for label, _, _ in sample])
    back = np.arange(len(y)) % 5 == 0
    if len(y) < 20:
        back[:] = False
    w, bias = follow_the_leader(x, y, np.flatnonzero(~back), len(languages), DIMS)
    held = np.flatnonzero(back)
    temperature = fit_temperature(x.dot(w, held) + bias, y[held])
    return Model(languages, (w * idf[:, None] * SCALE).astype(np.float32), bias, temperature)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of each row.

    A null text, or one without a letter, is `und` with score 0, as is everything
    where nothing could be learned.  Repeated rows and ties are each answered alike
    (the first language in order wins a tie); columns besides doc_id and text are not read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for rows, data, offsets in tb.segments(batch, "text"):
                known = rows.column(2).to_numpy(zero_copy_only=False)
                if m is None:
                    names, score = [UNKNOWN] * rows.num_rows, np.zeros(rows.num_rows)
                else:
                    p = m.probabilities(data, offsets)
                    names = [m.languages[i] if ok else UNKNOWN for i, ok in zip(p.argmax(axis=1).tolist(), known.tolist(), strict=True)]
                    score = np.where(known, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", has_letter.alias("known")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, by a model that learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    modulus, out = HELD_OUT
    model = fit(docs.where(fold("doc_id", modulus) != out).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", (fold("doc_id", modulus) == out).alias("held_out"), "lang_pred", "score")
