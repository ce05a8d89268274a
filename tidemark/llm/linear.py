"""Shared parts of the hashed-text linear models: sparse rows, corpus counts, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.common import unit_hash

#: From the bytes and row offsets of a segment to hashed feature numbers and the offsets of each row's.
Featurise = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

_CHUNKS = 64


#: Values that are gathered at once.
_GATHERED = 1 << 20


def row_means(values: np.ndarray, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean over each row's features of their rows of `values` (rows without any: zeros), some features at a time."""
    out = np.zeros((len(offsets) - 1, values.shape[1]))
    step = max(1, _GATHERED // values.shape[1])
    for a in range(0, len(features), step):
        b = min(a + step, len(features))
        first, last = int(np.searchsorted(offsets, a, side="right")) - 1, int(np.searchsorted(offsets, b, side="left"))
        starts, ends = np.maximum(offsets[first:last], a) - a, np.minimum(offsets[first + 1 : last + 1], b) - a
        some = np.flatnonzero(ends > starts)
        out[first + some] += np.add.reduceat(values[features[a:b]], starts[some], axis=0)
    return out / np.maximum(np.diff(offsets), 1)[:, None]


def document_frequencies(docs: DataFrame, featurise: Featurise, dims: int) -> tuple[int, np.ndarray]:
    """Number of texts, and for each feature of how many it is in, over every row of `docs`.

    A task adds up a vector of fixed size, and the vectors are summed in slices.
    """

    def count(batches: Iterator[pa.RecordBatch]):
        seen, total, rows_seen = np.zeros(dims, np.uint8), np.zeros(dims, np.int64), 0
        for batch in batches:
            for rows, data, offsets in tb.segments(batch, "text"):
                features, at = featurise(data, offsets)
                rows_seen += rows.num_rows
                for r in range(rows.num_rows):
                    own = features[at[r] : at[r + 1]]
                    seen[own] = 1
                    total += seen
                    seen[own] = 0
        width = dims // _CHUNKS
        if rows_seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, _CHUNKS), pa.int32()), pa.array([np.int64(rows_seen).tobytes()] + [total[i * width : (i + 1) * width].tobytes() for i in range(_CHUNKS)], pa.binary())], ["chunk", "counts"]
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in pdf["counts"]], axis=0)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "counts": [total.tobytes()]})

    schema = "chunk int, counts binary"
    texts = docs.select("text")
    parts = 1 + isqrt(texts.rdd.getNumPartitions())
    slices = texts.mapInArrow(count, schema).withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(parts)))
    once = slices.groupBy("chunk", "part").applyInPandas(add, schema)  # in two steps: a group has about the square root of the tasks
    got = dict(once.groupBy("chunk").applyInPandas(add, schema).collect())
    if -1 not in got:
        return 0, np.zeros(dims, np.int64)
    return int(np.frombuffer(got[-1], np.int64)[0]), np.concatenate([np.frombuffer(got[i], np.int64) for i in range(_CHUNKS)])


#: Classes that a model can tell apart; more are an error.
MAX_CLASSES = 256


def check_classes(rows: DataFrame, label: str) -> None:
    """A model of more classes than its bound would leave some out, whose rows it could never answer."""
    if rows.select(label).distinct().limit(MAX_CLASSES + 2).count() > MAX_CLASSES + 1:  # a null is no class
        raise ValueError(f"{label} has more than {MAX_CLASSES} values, which is what a model tells apart")


def sample_by_class(rows: DataFrame, label: str, per_class: int, *key: str) -> DataFrame:
    """About per_class rows of each class, those of the smallest hashes of `key`: the same ones each time."""
    counts = rows.groupBy(F.col(label).alias("_class")).count()
    shares = F.broadcast(counts.select("_class", (F.lit(float(per_class)) / F.col("count")).alias("_share")))
    return rows.join(shares, F.col(label) == F.col("_class")).where(unit_hash(*key) < F.col("_share")).select(*rows.columns)


def sparse_rows(rows: DataFrame, label: str, featurise: Featurise) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """Collects a bounded sample as (label, feature numbers, mean of each over the row's features)."""
    kind = rows.schema[label].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, data, offsets in tb.segments(batch, "text"):
                features, at = featurise(data, offsets)
                ids, values = [], []
                for r in range(part.num_rows):
                    own, n = np.unique(features[at[r] : at[r + 1]], return_counts=True)
                    ids.append(own.astype(np.int32).tobytes())
                    values.append((n / max(1, n.sum())).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["label", "ord", "ids", "vals"])

    keyed = rows.select(F.col(label).alias("label"), "text", F.xxhash64("text").alias("ord"))
    got = keyed.mapInArrow(run, f"label {kind}, ord bigint, ids binary, vals binary").collect()
    got.sort(key=lambda r: (r["ord"], str(r["label"])))  # the order of training must not depend on the run
    return [(r["label"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["vals"], np.float32)) for r in got]


class Csr:
    """Sparse rows laid end to end."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.at = np.concatenate(([0], np.cumsum([len(i) for i, _ in rows]))).astype(np.int64)
        self.ids = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int32)
        self.vals = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.float32)

    def __len__(self) -> int:
        return len(self.at) - 1

    def dot(self, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), weights.shape[1]))
        for k, r in enumerate(rows):
            own = slice(self.at[r], self.at[r + 1])
            out[k] = self.vals[own] @ weights[self.ids[own]]
        return out

    def back(self, rows: np.ndarray, errors: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers in use and the sum over rows of value times error for each."""
        ids = np.concatenate([self.ids[self.at[r] : self.at[r + 1]] for r in rows])
        vals = np.concatenate([self.vals[self.at[r] : self.at[r + 1]] for r in rows])
        of = np.repeat(np.arange(len(rows)), self.at[rows + 1] - self.at[rows])
        used, place = np.unique(ids, return_inverse=True)
        grad = np.stack([np.bincount(place, vals * errors[of, c], len(used)) for c in range(errors.shape[1])], axis=1)
        return used, grad
