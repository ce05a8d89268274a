"""Consistent placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size:
slot (offset + j * skip) mod M for j = 0, 1, ..., with offset and skip from two
digests of the shard's name.  Shards take turns, each claiming the first slot of
its order that is still free, until the table is full, so no two shards differ
by more than one slot and a change of the shard list moves few slots.  A row's
key picks a slot by its digest; the broadcast table gives the shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_names

#: Slots of the production table, a prime of more than a hundred slots a shard.
TABLE_SIZE = 2039
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
#: The table is broadcast, so its size is bounded.
MAX_TABLE_SIZE = 1 << 20


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not is_prime(size) or not len(shards) <= size <= MAX_TABLE_SIZE:
        raise ValueError(f"the table size must be a prime from {len(shards)} to {MAX_TABLE_SIZE}")
    offset = [_digest(f"{s}:offset") % size for s in shards]
    skip = [_digest(f"{s}:skip") % (size - 1) + 1 for s in shards]
    step = [0] * len(shards)
    owner = [-1] * size
    claimed = 0
    while True:
        for i in range(len(shards)):
            slot = (offset[i] + step[i] * skip[i]) % size
            while owner[slot] >= 0:
                step[i] += 1
                slot = (offset[i] + step[i] * skip[i]) % size
            owner[slot] = i
            step[i] += 1
            claimed += 1
            if claimed == size:
                return owner


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as rows (slot, shard)."""
    owner = ",".join(map(str, lookup_table(shards, size)))
    names = F.split(F.lit("\n".join(shards)), "\n")
    return spark.range(1).select(F.posexplode(F.split(F.lit(owner), ",")).alias("slot", "_owner")).select(
        "slot", F.element_at(names, F.col("_owner").cast("int") + 1).alias("shard")
    )


def slot_of(key: str, size: int = TABLE_SIZE):
    """The slot that a key's decimal or plain text falls in; null counts as empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(size)).cast("int")


def shard(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Adds the slot and the shard of every row.  No shuffle: the bounded table is broadcast.

    Nulls: a null key is placed like empty text.  Rows with equal keys share a
    shard, repeated rows stay repeated, an empty table stays empty.  Columns named
    like the two new ones are replaced; all others pass through untouched, whatever
    their names.
    """
    kept = [c for c in df.columns if c not in (slot_col, shard_col)]
    at, slot, name = free_names(df.columns, "at", "slot", "shard")
    placed = df.select(*[F.col(f"`{c}`") for c in kept], slot_of(f"`{key}`", size).alias(slot))
    lookup = table_frame(df.sparkSession, shards, size).select(F.col("slot").alias(at), F.col("shard").alias(name))
    joined = placed.join(F.broadcast(lookup), F.col(slot) == F.col(at), "inner")
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.col(slot).alias(slot_col), F.col(name).alias(shard_col))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(documents.select("doc_id"))


OP1_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS name FROM range({len(SHARDS)}) t(i)
), params AS (
  SELECT i, name,
    CAST('0x' || substr(md5(name || ':offset'), 1, 13) AS BIGINT) % {TABLE_SIZE} AS o,
    CAST('0x' || substr(md5(name || ':skip'), 1, 13) AS BIGINT) % {TABLE_SIZE - 1} + 1 AS s
  FROM shards
), orders AS (
  SELECT i, list((o + j * s) % {TABLE_SIZE} ORDER BY j) AS slots
  FROM params, range({TABLE_SIZE}) t(j) GROUP BY i
), claims AS (
  SELECT 0 AS turn, CAST(-1 AS BIGINT) AS slot, [false FOR x IN range({TABLE_SIZE})] AS taken
  UNION ALL
  SELECT turn + 1, slot, list_transform(taken, lambda x, k: x OR k = slot + 1)
  FROM (
    SELECT c.turn, c.taken, list_filter(o.slots, lambda z: NOT c.taken[z + 1])[1] AS slot
    FROM claims c JOIN orders o ON o.i = c.turn % {len(SHARDS)}
    WHERE c.turn < {TABLE_SIZE}
  )
), lookup AS (
  SELECT c.slot, s.name AS shard FROM claims c JOIN shards s ON s.i = (c.turn - 1) % {len(SHARDS)} WHERE c.turn > 0
), placed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) % {TABLE_SIZE} AS INTEGER) AS slot
  FROM documents
)
SELECT p.doc_id, p.slot, l.shard FROM placed p JOIN lookup l ON l.slot = p.slot
"""
