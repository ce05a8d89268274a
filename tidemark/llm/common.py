"""What the operators of this subpackage share: tables, checkpoints, sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import stored as cut

__all__ = ["BATCH_BYTES", "BROADCAST_KEYS", "bound_batches", "cut", "fold", "free_names", "partitions", "small", "table", "unit_hash", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that Spark hands to a Python task at once.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch, so that long texts don't add up in a task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(key: str, modulus: int):
    """crc32 of a key's decimal text, modulo `modulus`; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """Names for working columns, of which no one is among those taken, whatever their case."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        name = f"__{name}"
        while name in used:
            name += "_"
        out.append(name)
    return out


def unit_hash(*columns: str):
    """A uniform number in [0, 1) that depends on the given columns only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


#: Keys that may be broadcast to every task; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def small(keys: DataFrame, rows: int = BROADCAST_KEYS) -> DataFrame:
    """Stores narrow keys and marks them for broadcast if they are few enough."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= rows else keys


def without(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose (key, hash of text) isn't among `keys` (key, text_key)."""
    own, own_text = free_names(docs.columns, "key", "text_key")
    gone = small(keys.select(F.col(key).alias(own), F.col("text_key").alias(own_text)).distinct())
    return docs.join(gone, F.col(f"`{key}`").eqNullSafe(F.col(own)) & F.xxhash64("text").eqNullSafe(F.col(own_text)), "left_anti")
