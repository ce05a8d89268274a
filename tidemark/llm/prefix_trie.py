"""The prefix trie of conversations, by bursting containers of suffixes.

A conversation is the sequence of its turns' ids (128-bit digests of role and text);
exact copies are one sequence that carries its conversations.  A container holds the
sequences that begin with one path of turns, its head.  A container that is too large
bursts: the run of turns that all its sequences share becomes trie nodes at once (it is
what the least and the greatest sequence share), and the next turn's id deals the rest
into containers below.  Those that remain are dealt over shards by their heads; a task
sorts a shard's sequences and sweeps them once, each new turn against the sequence
before being a node.  Counts of the nodes above containers are sums over these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, cut, partitions, table
from tidemark.sources.tables import Scratch

#: Conversations that share a head: those of one hundred.
FAMILY = 100
#: Turns that a conversation takes from its family's first one at most, and one.
HEADS = 6
#: Bytes of sequences from which a container bursts.
CONTAINER_BYTES = 1 << 20
#: Bytes of sequences that a shard's task sorts, on average.
SHARD_BYTES = 8 << 20
#: Containers that burst in one round are sent to every task up to this number; more are joined by a shuffle.
BROADCAST_HEADS = 50_000
#: Ids of one row while copies of a sequence are digested.
CHUNK_IDS = 1 << 16

#: Bytes of a turn's id.
WIDTH = 16
NOTHING = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes): each conversation's turns after its head is exchanged, as ids end to end and code points.

    conversations: conv_id, turn, role, text.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    told = F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.md5(told.cast("binary")).alias("_t"), F.char_length(text("text")).cast("bigint").alias("_n"), text("role").alias("_r"), text("text").alias("_x")
    )
    # turns of one number are in the order of role and text
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "_r", "_x"))
    placed = turns.withColumn("_at", at).select("conv_id", F.struct("_at", "_t", "_n").alias("_turn"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    own = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("_turn._at") > taken, F.col("_turn")))).alias("_own"))
    head = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("_turn._at") < HEADS)).groupBy(F.col("conv_id").alias("_first")).agg(F.array_sort(F.collect_list("_turn")).alias("_head"))
    met = own.join(head, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("_first"), "left")
    none = F.array().cast("array<struct<_at:int,_t:string,_n:bigint>>")
    turns_of = F.concat(F.slice(F.coalesce("_head", none), F.lit(1), taken), F.col("_own"))
    whole = met.select("conv_id", turns_of.alias("_turns"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("_turns", lambda t: t["_t"]), "")).alias("seq"), F.transform("_turns", lambda t: t["_n"]).alias("sizes"))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(seq, sizes, n, low, ends): each sequence once, with how many conversations have it, the smallest, and the digest of all.

    Copies are sorted by range, so one group of them lies in several partitions; each
    joins its ids to chunks, and the chunks of a sequence run through one digest, which
    can't be had otherwise.  Neither holds more than a chunk.
    """

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = sizes = None
        ids: list[int] = []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([seq], pa.binary()), pa.array([sizes], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["seq", "sizes", "n", "low", "ids"]
            )

        for batch in batches:
            out = []
            for s, z, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if ids and (s != seq or len(ids) == CHUNK_IDS):
                    out.append(row())
                    ids = []
                if s != seq or sizes is None:
                    seq, sizes = s, z.as_py()
                ids.append(c)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if ids:
            yield row()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seq", "sizes", "n", "low", "ends"]
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        now: list | None = None

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out = []
            for s, z, n, low, ids in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if now is not None and s == now[0]:
                    now[2] += n
                    now[4].update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append([*now[:4], now[4].hexdigest()])
                now = [s, z.as_py(), n, low, hashlib.sha256(ids.encode())]
            if out:
                yield made(out)
        if now is not None:
            yield made([[*now[:4], now[4].hexdigest()]])

    n = partitions(convs.sparkSession)
    ranged = convs.select("seq", "sizes", "conv_id").repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    chunks = ranged.mapInArrow(chunked, "seq binary, sizes array<bigint>, n bigint, low bigint, ids string")
    return chunks.repartition(n, "seq").sortWithinPartitions("seq", "low").mapInArrow(digested, "seq binary, sizes array<bigint>, n bigint, low bigint, ends string")


def _shared_turns(least: bytes, greatest: bytes) -> int:
    n = min(len(least), len(greatest)) // WIDTH
    a, b = (np.frombuffer(x, np.uint64, n * WIDTH // 8).reshape(n, WIDTH // 8) for x in (least, greatest))
    differ = np.flatnonzero((a != b).any(axis=1))
    return int(differ[0]) if len(differ) else n


def _bursts(state: DataFrame, container_bytes: int) -> DataFrame:
    """(head, path, from_depth, to_depth, n_convs, low, sizes, parent_low) of the containers that are too large, and always of the root.

    from_depth turns are above the container; to_depth are shared by all of it.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, greatest = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("least", "greatest"))
            depth = [_shared_turns(a, b) for a, b in zip(least, greatest, strict=True)]
            sizes = [z[:d] for z, d in zip(batch.column(batch.schema.get_field_index("sizes")).to_pylist(), depth, strict=True)]
            own = {c: batch.column(batch.schema.get_field_index(c)) for c in ("head", "path", "from_depth", "n_convs", "low", "parent_low")}
            yield pa.RecordBatch.from_arrays([*own.values(), pa.array(depth, pa.int64()), pa.array(sizes, pa.list_(pa.int64()))], [*own, "to_depth", "sizes"])

    found = state.groupBy("head").agg(
        F.first("path").alias("path"), F.first("depth").alias("from_depth"), F.first("parent_low").alias("parent_low"), F.sum("n").alias("n_convs"), F.min("low").alias("low"),
        F.min("seq").alias("least"), F.max("seq").alias("greatest"), F.min_by("sizes", "seq").alias("sizes"), F.sum(F.length("seq")).alias("_bytes"), F.count("*").alias("_rows"),
    )
    large = found.where((F.size("path") == 0) | (F.col("_rows") > 1) & (F.col("_bytes") > container_bytes))
    return large.mapInArrow(shared, "head string, path array<string>, from_depth bigint, n_convs bigint, low bigint, parent_low bigint, to_depth bigint, sizes array<bigint>")


def _sweep(rows: pa.Table) -> pa.Table:
    """Nodes of all containers of a shard, in one pass over their sorted sequences; top nodes carry their path."""
    order = np.argsort(np.array([*rows["seq"].to_pylist(), None], object)[:-1], kind="stable")
    told = {c: rows[c].to_pylist() for c in ("head", "seq", "sizes", "n", "low", "ends", "depth", "parent_low", "path")}
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path"]
    done: dict[str, list] = {c: [] for c in names}
    # an open node: [smallest member, members, children, leaves, saved below, digest, code points]
    stack: list[list] = []
    above = top = 0
    head = path = above_low = None

    def close(to: int) -> None:
        """Closes nodes until `to` are open."""
        while len(stack) > to:
            low, n, children, leaves, saved, ends, size, kids = stack.pop()
            leaves += not children
            saved += (n - 1) * size
            depth = top + len(stack)
            row = len(done["depth"])
            for c, v in zip(names, (low, depth, None, n, children, leaves, saved, ends, None), strict=True):
                done[c].append(v)
            for kid in kids:
                done["parent_conv_id"][kid] = low
            if stack:
                up = stack[-1]
                up[0] = min(up[0], low)
                up[1] += n
                up[2] += 1
                up[3] += leaves
                up[4] += saved
                up[7].append(row)
            else:
                done["parent_conv_id"][row], done["path"][row] = above_low, path

    before = b""
    for i in order.tolist():
        seq, sizes = told["seq"][i], told["sizes"][i]
        if told["head"][i] != head:
            close(0)
            head, path, above_low, above = told["head"][i], told["path"][i], told["parent_low"][i], told["depth"][i]
            top, before = above + 1, b""
        shared = _shared_turns(before, seq) if before else above
        close(shared - above)
        for k in range(shared, len(seq) // WIDTH):
            stack.append([told["low"][i], 0, 0, 0, 0, NOTHING, sizes[k], []])
        last = stack[-1]
        last[0] = min(last[0], told["low"][i])
        last[1] += told["n"][i]
        last[5] = told["ends"][i]
        before = seq
    close(0)
    kinds = {"ends_sha256": pa.string(), "path": pa.list_(pa.string())}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in done.items()})


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of burst containers' shared turns, from the container's top to where it branches."""
    for batch in batches:
        out: dict[str, list] = {c.split()[0]: [] for c in _NODE.split(", ")}
        for r in batch.to_pylist():
            saved, rows = r["below_saved"], []
            root = not r["path"]
            for depth in range(r["to_depth"], r["from_depth"] - (1 if root else 0), -1):
                saved += (r["n_convs"] - 1) * r["sizes"][depth - 1] if depth else 0
                branch = depth == r["to_depth"]
                rows.append((r["low"], depth, r["parent_low"] if depth == r["from_depth"] + (not root) else r["low"], r["n_convs"], r["children"] if branch else 1, r["below_leaves"] + (r["children"] == 0), saved, r["ends"] if branch and r["ends"] else NOTHING))
            for row in rows:
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if c == "ends_sha256" else pa.int64()) for c, v in out.items()], list(out))


def trie(sequences: DataFrame, container_bytes: int = CONTAINER_BYTES, shard_bytes: int = SHARD_BYTES, max_rounds: int = 10_000) -> DataFrame:
    """The nodes of the trie of distinct sequences (seq, sizes, n, low, ends), as in the query's contract.

    A round of bursts handles every container that is still too large, whatever the length
    of the turns that it shares, so rounds follow the number of branchings that very many
    sequences lie under.
    """
    spark = sequences.sparkSession
    with Scratch() as keep:
        no_path = F.array().cast("array<string>")
        state = keep(sequences.select(F.lit("").alias("head"), no_path.alias("path"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_low"), "seq", "sizes", "n", "low", "ends"))
        bursts, ended, settled = [], [], []
        for _ in range(max_rounds):
            found = keep(_bursts(state, container_bytes))
            n = found.count()
            if not n:
                break
            bursts.append(found)
            down = found.select(F.col("head").alias("_head"), F.col("to_depth").alias("_to"), F.col("low").alias("_low"))
            down = F.broadcast(down) if n <= BROADCAST_HEADS else down
            met = state.join(down, F.col("head") == F.col("_head"), "left")
            turns = F.length("seq") / WIDTH
            next_head = F.md5(F.substring("seq", F.lit(1), ((F.col("_to") + 1) * WIDTH).cast("int")))
            step = keep(
                met.select(
                    (F.col("_to").isNotNull()).alias("_burst"), (turns == F.col("_to")).alias("_end"), F.when(F.col("_to").isNull() | (turns == F.col("_to")), F.col("head")).otherwise(next_head).alias("head"),
                    F.when(F.col("_to").isNull() | (turns == F.col("_to")), F.col("path")).otherwise(F.concat("path", F.array("head"))).alias("path"), F.coalesce("_to", "depth").alias("depth"),
                    F.when(F.col("_to").isNull(), F.col("parent_low")).otherwise(F.col("_low")).alias("parent_low"), "seq", "sizes", "n", "low", "ends",
                )
            )
            columns = ("head", "path", "depth", "parent_low", "seq", "sizes", "n", "low", "ends")
            settled.append(step.where(~F.col("_burst")).select(*columns))
            ended.append(step.where("_end").select("head", "ends"))
            state = step.where(F.col("_burst") & ~F.col("_end")).select(*columns)
        else:
            raise RuntimeError(f"containers did not settle in {max_rounds} rounds")
        settled.append(state)
        if not bursts:
            return spark.createDataFrame([], _NODE)
        union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
        rows, burst = union(settled), union(bursts)
        total = int(rows.agg(F.sum(F.length("seq"))).first()[0] or 0)
        shards = max(partitions(spark), -(-total // shard_bytes))
        dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("head"), F.lit(shards)).cast("int"))
        swept = keep(dealt.groupBy("_shard").applyInArrow(_sweep, f"{_NODE}, path array<string>"))
        tops = swept.where(F.col("path").isNotNull())
        parent = F.element_at("path", -1)
        children = tops.select(parent.alias("head")).unionByName(burst.where(F.size("path") > 0).select(parent.alias("head"))).groupBy("head").agg(F.count("*").alias("children"))
        own = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
        above = F.when(F.col("from_depth") > 0, F.aggregate(F.slice("sizes", F.lit(1), F.col("from_depth").cast("int")), F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(0)
        below = (
            tops.select(F.explode("path").alias("head"), "n_leaves", "saved_tokens")
            .unionByName(burst.select(F.explode("path").alias("head"), F.lit(0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * (own - above)).alias("saved_tokens")))
            .groupBy("head").agg(F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved"))
        )
        zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
        heads = (
            burst.join(children, "head", "left").join(below, "head", "left").join(union(ended), "head", "left")
            .select("path", "from_depth", "to_depth", "n_convs", "low", "parent_low", "sizes", zero("children"), zero("below_leaves"), zero("below_saved"), "ends")
        )
        return cut(heads.mapInArrow(_chains, _NODE).unionByName(swept.drop("path")))


def conversation_trie(conversations: DataFrame, container_bytes: int = CONTAINER_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) after their heads are exchanged: see the query's contract.

    Null turns come first; turns of one number (repeated rows too) are in the order of
    role and text; null roles and texts are empty.  Rows without a conv_id are of no
    conversation and are left out.  An empty table has no nodes, not even a root.  One
    conversation's turns are never cut, so a task holds some 30 bytes for each of them.
    A family's first id is conv_id - conv_id % 100 with the sign of conv_id, as in SQL.
    Other columns are not read.
    """
    bound_batches(conversations.sparkSession)
    with Scratch() as keep:
        convs = keep(rebuilt(conversations))
        return trie(distinct_sequences(convs), container_bytes, shard_bytes)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with what sharing it saves."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)),
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END)) AS t
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), CAST(4294967295 AS BIGINT)) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc
), placed AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % {FAMILY} AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM placed
), whole AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY d) FILTER (d IS NOT NULL), []) AS turns
  FROM convs c LEFT JOIN numbered n ON n.conv_id = c.conv_id GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, depth, turns[1:depth] AS node, turns[1:depth - 1] AS up, len(turns) = depth AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM whole)
), nodes AS (
  SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(node[depth].text) END AS own
  FROM prefixes GROUP BY depth, node
), children AS (
  SELECT depth - 1 AS depth, up AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
), above AS (
  SELECT depth AS d, own, n_children, node, unnest(range(depth + 1)) AS a FROM counted
), below AS (
  SELECT a AS depth, node[1:a] AS node, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY ALL
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN below b ON b.depth = n.depth AND b.node = n.node
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.up AND n.depth > 0
"""
