"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon has two parts: a short list of common insults, and words and word
beginnings learned from the labelled rows that may be learned from, those whose
share of toxic texts is surely above a half.  Features are hit counts and
densities of the lexicon, hits near second-person pronouns, hits that show only
after undoing obfuscation (digits and signs for letters, signs inside words), and
rates of capitals, punctuation and repeated letters.  Trees and calibration are
fitted by Spark on a bounded sample; every whole text is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemark.llm import textbytes as tb
from tidemark.llm.common import bound_batches, cut, fold, table, unit_hash

INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "garbage", "imbecile", "hate", "ugly", "filth")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "vous", "du", "dich", "dir", "dein", "usted", "ustedes")

#: Labelled rows, about, that the lexicon is learned from, and that the trees are fitted on.
LEXICON_ROWS = 12_000
FIT_ROWS = 20_000
#: Beginnings of words, in bytes, that are tried as entries; 0 is the whole word.
STEMS = (0, 4, 5, 6)
MIN_TOXIC = 5
NEAR = 5
TREES, DEPTH = 20, 3
CALIBRATION_BINS = 1_000
FEATURES = ("hits", "hit_share", "distinct", "listed", "listed_share", "near_you", "hidden", "capitals", "shouted", "marks", "exclaims", "signs", "mixed", "repeats", "log_words", "has_hit")
HELD_OUT = (5, 0)
#: Columns of the work.
VALUES, VECTOR, RAW = "_tox_values", "_tox_vector", "_tox_raw"
MARGIN, PROBABILITY, PREDICTION = "_tox_margin", "_tox_probability", "_tox_prediction"

#: What stands for a letter, undone before the lexicon is looked up again.
_PLAIN = np.arange(256, dtype=np.uint8)
for _sign, _letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}.items():
    _PLAIN[ord(_sign)] = ord(_letter)
_DROPPED = np.zeros(256, bool)
_DROPPED[[ord(x) for x in "*.-_'`^~"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(x) for x in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def word_hashes(words) -> np.ndarray:
    data, offsets = tb.utf8(pa.array(list(words), pa.large_string()))
    return np.unique(tb.span_hashes(data, offsets[:-1], offsets[1:]))


def entry_keys(words: tb.Words) -> list[np.ndarray]:
    """For each kind of entry the key of every word: of the whole, and of beginnings (0 if the word is no longer)."""
    if not len(words.start):
        return [np.zeros(0, np.uint64) for _ in STEMS]
    out = []
    for n in STEMS:
        if n == 0:
            out.append(words.hashes())
        else:
            key = tb.span_hashes(words.data, words.start, np.minimum(words.start + n, words.end))
            out.append(np.where(words.end - words.start > n, tb.mix(key + np.uint64(n)), np.uint64(0)))
    return out


def learn_lexicon(labelled: DataFrame) -> np.ndarray:
    """Sorted keys of words and beginnings that mark toxic texts in rows (text, toxic).

    An entry is in MIN_TOXIC toxic texts at least, and the lower bound of its share of
    toxic texts (Wilson, two deviations) is over a half.  Their number is bounded by the
    bounded sample.
    """

    def run(batches):
        for batch in batches:
            keys, marks = [], []
            for rows, data, offsets in tb.segments(batch, "text"):
                words = tb.Words(data, offsets, tb.ALNUM_LOWER)
                kinds, first = entry_keys(words), words.first
                toxic = rows.column(1).to_numpy(zero_copy_only=False)
                for r in range(rows.num_rows):
                    own = np.unique(np.concatenate([k[first[r] : first[r + 1]] for k in kinds]))
                    keys.append(own)
                    marks.append(np.full(len(own), toxic[r], np.int64))
            if keys:
                used, place = np.unique(np.concatenate(keys), return_inverse=True)
                marks = np.concatenate(marks)
                yield pa.RecordBatch.from_arrays([pa.array(used.view(np.int64)), pa.array(np.bincount(place, marks, len(used)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(used)).astype(np.int64))], ["key", "t", "n"])

    counts = labelled.select("text", F.col("toxic").cast("bigint").alias("toxic")).mapInArrow(run, "key bigint, t bigint, n bigint").groupBy("key").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    share, z2 = F.col("t") / F.col("n"), F.lit(4.0)
    low = (share + z2 / (2 * F.col("n")) - F.sqrt(z2 * (share * (1 - share) + z2 / (4 * F.col("n"))) / F.col("n"))) / (1 + z2 / F.col("n"))
    best = counts.where((F.col("t") >= MIN_TOXIC) & (F.col("key") != 0) & (low > 0.5))
    return np.unique(np.array([r["key"] for r in best.select("key").collect()], np.int64).view(np.uint64))


class Lexicon:
    def __init__(self, learned: np.ndarray):
        self.learned = learned
        self.listed = word_hashes(INSULTS)
        self.you = word_hashes(SECOND_PERSON)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of FEATURES for each text of a segment."""
        rows = len(offsets) - 1
        words = tb.Words(data, offsets, tb.ALNUM_LOWER)
        kinds, row_of, n_words = entry_keys(words), words.row_of(), words.counts
        known = np.zeros(len(row_of), bool)
        for k in kinds:
            known |= tb.member(k, self.learned)
        listed = tb.member(kinds[0], self.listed)
        hit = known | listed
        total = lambda mask: np.bincount(row_of[mask], minlength=rows).astype(float)
        place = np.flatnonzero(hit)
        distinct = np.zeros(rows)
        if len(place):
            pairs = np.unique(np.stack([row_of[place].astype(np.uint64), kinds[0][place]], axis=1), axis=0)
            distinct = np.bincount(pairs[:, 0].astype(np.int64), minlength=rows).astype(float)
        near = np.zeros(len(row_of), bool)
        for p in np.flatnonzero(tb.member(kinds[0], self.you)):
            a, b = max(0, p - NEAR), min(len(row_of), p + NEAR + 1)
            near[a:b] |= row_of[a:b] == row_of[p]
        per_row = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets]).astype(float)
        size = np.maximum(np.diff(offsets), 1)
        upper = (data >= 0x41) & (data <= 0x5A)
        lower = (data >= 0x61) & (data <= 0x7A)
        again = np.zeros(len(data), bool)
        again[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[tb.LOWER[data[2:]]]
        ends = words.end
        shouted = np.zeros(len(row_of), bool)
        mixed = np.zeros(len(row_of), bool)
        if len(ends):
            up, digit, letter = (np.concatenate(([0], np.cumsum(x))) for x in (upper, (data >= 0x30) & (data <= 0x39), upper | lower))
            span = lambda c: c[ends] - c[words.start]
            shouted = (span(up) >= 3) & (span(up) == ends - words.start)
            mixed = (span(digit) > 0) & (span(letter) > 0)
        n = np.maximum(n_words, 1)
        hits = total(hit)
        return np.stack(
            [hits, hits / n, distinct, total(listed), total(listed) / n, total(hit & near), self._hidden(data, offsets, hits), per_row(upper) / size, total(shouted) / n, per_row(_MARK[data]) / size,
             per_row(data == 0x21) / size, per_row(_DROPPED[data] | (data == 0x40) | (data == 0x24)) / size, total(mixed) / n, per_row(again) / size, np.log1p(n_words), (hits > 0).astype(float)],
            axis=1,
        )

    def _hidden(self, data: np.ndarray, offsets: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Hits that are there only when signs for letters are undone and signs in words dropped."""
        kept = ~_DROPPED[data]
        at = np.concatenate(([0], np.cumsum(kept)))[offsets]
        plain = _PLAIN[tb.LOWER[data[kept]]]
        words = tb.Words(plain, at, _LETTER)
        if not len(words.start):
            return np.zeros(len(hits))
        hit = tb.member(words.hashes(), self.listed)
        kinds = entry_keys(words)
        hit |= tb.member(kinds[0], self.learned)
        return np.maximum(0, np.bincount(words.row_of()[hit], minlength=len(hits)) - hits)


def dense(docs: DataFrame, lexicon: Lexicon, *carried: str) -> DataFrame:
    """The carried columns and VALUES, the features of each row's text."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    fields = docs.select(*[F.col(f"`{c}`") for c in carried]).schema

    def run(batches):
        for batch in batches:
            for rows, data, offsets in tb.segments(batch, VALUES):
                values = shared.value.features(data, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], flat], [*carried, VALUES])

    out = type(fields)([*fields.fields]).add(VALUES, ArrayType(DoubleType()))
    return docs.select(F.col("text").alias(VALUES), *[F.col(f"`{c}`") for c in carried]).mapInArrow(run, out)


class Model:
    def __init__(self, lexicon: Lexicon, trees, steps: list[tuple[float, float]]):
        self.lexicon, self.trees, self.steps = lexicon, trees, steps


def isotonic(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Pool adjacent violators over (value, mean label, weight): the non-decreasing fit as (value, level)."""
    pools: list[list[float]] = []
    for x, y, w in sorted(points):
        pools.append([x, y * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            x1, s, n = pools.pop()
            pools[-1] = [x1, pools[-1][1] + s, pools[-1][2] + n]
    return [(x, s / n) for x, s, n in pools]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learns from the documents (doc_id, text) that `labels` (doc_id, toxic) marks; None if there are none."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    n = marks.count()
    if not n:
        return None
    picked = marks.withColumn("_u", unit_hash("doc_id")).where(F.col("_u") < min(1.0, FIT_ROWS / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # of bounded size: FIT_ROWS, about
    # calibration is by rows that taught neither the lexicon nor the trees
    back = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    marked, marked_rest = rows.agg(F.countDistinct("toxic"), F.countDistinct(F.when(~back, F.col("toxic")))).first()
    if marked < 2:
        return None
    if marked_rest < 2:  # too few rows to hold any back
        back = F.lit(False)
    lexicon = Lexicon(learn_lexicon(rows.where(~back & (F.col("_u") < min(1.0, LEXICON_ROWS / n)))))
    points = cut(dense(rows, lexicon, "doc_id", "toxic")).withColumn(VECTOR, array_to_vector(VALUES))
    learner = GBTClassifier(labelCol="toxic", featuresCol=VECTOR, predictionCol=PREDICTION, maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, seed=5)
    trees = learner.setRawPredictionCol(MARGIN).setProbabilityCol(PROBABILITY).fit(points.where(~back).coalesce(6))
    held = trees.transform(points.where(back)).select(F.round(vector_to_array(PROBABILITY)[1] * CALIBRATION_BINS).alias("bin"), "toxic")
    bins = held.groupBy("bin").agg(F.avg("toxic").alias("y"), F.count("*").alias("w")).collect()
    return Model(lexicon, trees, isotonic([(r["bin"] / CALIBRATION_BINS, r["y"], float(r["w"])) for r in bins]))


def score(docs: DataFrame, model: Model | None, *carried: str, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """The carried columns, the score (0 to 1) and the prediction (1 from a half on) of each row.

    A null or empty text has no hits and gets the score of such texts; where nothing
    could be learned every score is 0.  Rows with equal texts get equal scores.
    Carried columns keep their values whatever their names; one named like the score or
    the prediction makes an error, to be settled by other names for these.
    """
    if {score_col, predicted_col} & set(carried):
        raise ValueError(f"a carried column is named {score_col} or {predicted_col}")
    own = [F.col(f"_tox_c{i}").alias(c) for i, c in enumerate(carried)]
    renamed = docs.select("text", *[F.col(f"`{c}`").alias(f"_tox_c{i}") for i, c in enumerate(carried)])
    if model is None:
        return renamed.select(*own, F.lit(0.0).alias(score_col), F.lit(0).alias(predicted_col))
    values = dense(renamed, model.lexicon, *[f"_tox_c{i}" for i in range(len(carried))]).withColumn(VECTOR, array_to_vector(VALUES))
    scored = model.trees.transform(values).withColumn(RAW, vector_to_array(PROBABILITY)[1])
    level = F.lit(model.steps[-1][1]) if model.steps else F.col(RAW)
    for x, y in reversed(model.steps[:-1]):
        level = F.when(F.col(RAW) <= x + 0.5 / CALIBRATION_BINS, F.lit(y)).otherwise(level)
    # within a level the trees' own order shows
    result = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.98 * level + 0.02 * F.col(RAW)))
    return scored.select(*own, result.alias(score_col), (result >= 0.5).cast("int").alias(predicted_col))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, by a model that learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    modulus, out = HELD_OUT
    learnable = fold("doc_id", modulus) != out
    model = fit(docs.where(learnable), table(spark, sf_dir, "labels").where(learnable))
    return score(docs, model, "doc_id").select("doc_id", (fold("doc_id", modulus) == out).alias("held_out"), "score", "predicted")
