"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every row is then put into the leaf whose
centroids are nearest on the way down.  A query descends with a priority queue of
nodes by inner product with their centroids, so the most promising leaf of the
whole tree comes next, whichever branch it is in.  How many leaves are visited is
calibrated: a bounded set of queries is answered exactly, over all rows, and the
visits are widened until these would have reached the recall that is asked for.
A query whose leaves hold too few other rows for all its neighbours visits more.

Rows and queries meet in buckets.  A bucket holds the rows of neighbouring leaves,
or a part of the rows of a large leaf, so its size is bounded; a query goes once to
every bucket that has rows of a leaf that it visits, and a bucket that very many
queries visit is dealt out to several tasks, a block of queries each.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.common import cut, table, unit_hash

SAMPLE_ROWS = 20_000
LEAF_ROWS = 128
BRANCH = 8
#: Queries that calibrate, and the recall that they must reach; the contract asks for 0.9.
CALIBRATION_QUERIES = 128
RECALL = 0.95
NEIGHBOURS = 20
#: Rows of a bucket, about, and queries that one task answers from it.
BUCKET_ROWS = 1 << 15
QUERY_BLOCK = 1 << 14


class Tree:
    """Centroids of every node; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS, branch: int = BRANCH):
        self.children: list[list[int]] = []
        self.centroids: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._rng = np.random.default_rng(31)
        self._grow(points, leaf_rows, branch)
        self.centres = np.array(self.centroids)

    def _add(self, centroid: np.ndarray) -> int:
        self.children.append([])
        self.centroids.append(centroid)
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def _grow(self, points: np.ndarray, leaf_rows: int, branch: int) -> None:
        todo = [(self._add(points.mean(axis=0)), points)]
        while todo:
            node, own = todo.pop()
            parts = self._split(own, branch) if len(own) > leaf_rows else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for part in parts:
                child = self._add(part.mean(axis=0))
                self.children[node].append(child)
                todo.append((child, part))

    def _split(self, points: np.ndarray, branch: int) -> list[np.ndarray]:
        centres = points[self._rng.choice(len(points), branch, replace=False)]
        for _ in range(8):
            near = self._nearest(points, centres)
            centres = np.array([points[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(branch)])
        near = self._nearest(points, centres)
        return [points[near == c] for c in range(branch) if (near == c).any()]

    @staticmethod
    def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres * centres).sum(axis=1) / 2 - points @ centres.T).argmin(axis=1)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(points), np.int64)
        out = np.full(len(points), self.leaf[0], np.int64)
        open_nodes = [0] if self.children[0] else []
        while open_nodes:
            at = open_nodes.pop()
            own = np.flatnonzero(node == at)
            if not len(own):
                continue
            children = np.array(self.children[at])
            node[own] = children[self._nearest(points[own], self.centres[children])]
            for c in children.tolist():
                if self.children[c]:
                    open_nodes.append(c)
                else:
                    out[own[node[own] == c]] = self.leaf[c]
        return out

    def visit(self, query: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """`most` leaves, best bin first, and further ones while those hold fewer than `least` rows."""
        worth = self.centres @ query
        heap, out, held = [(0.0, 0)], [], 0
        while heap and (len(out) < most or held < least):
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                held += int(sizes[self.leaf[node]]) if sizes is not None else 0
            for c in self.children[node]:
                heapq.heappush(heap, (-worth[c], c))
        return out


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: non-null id, a vector that isn't null or zero and has only finite numbers.

    Where lengths differ, the vectors of the commonest length take part (of several, the
    longest), as inner products of vectors of other lengths have no meaning.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    limit = F.lit(float("inf"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(good)
    best = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (best[0] if best else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Rows:
    """Candidates: leaf, row number, id and vector of each, with the largest norm among them."""

    def __init__(self, leaf: np.ndarray, row: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.leaf, self.row, self.ids, self.vectors = leaf, row, ids, vectors
        self.norm = float(np.sqrt((vectors * vectors).sum(axis=1)).max()) if len(vectors) else 0.0

    def at(self, some: np.ndarray) -> Rows:
        return Rows(self.leaf[some], self.row[some], self.ids[some], self.vectors[some])

    def best(self, own: int, query: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best rows but the query's own by exact score, ties to smaller ids, as (ids, scores, leaves).

        `rough` are the scores up to rounding, which is within a part of 10^12 of the norms' product.
        """
        near = np.arange(len(rough))
        if len(rough) > k + 1:
            least = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
            near = np.flatnonzero(rough >= least - 1e-12 * self.norm * float(np.sqrt(query @ query)))
        near = near[self.row[near] != own]
        score = (self.vectors[near] * query).sum(axis=1)  # each row is summed in the same order
        order = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near][order], score[order], self.leaf[near][order]


def better(a: tuple | None, b: tuple, k: int) -> tuple:
    if a is None:
        return b
    ids, score, leaf = (np.concatenate(p) for p in zip(a, b, strict=True))
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order], leaf[order]


_FOUND = "query bigint, query_id bigint, found array<struct<score:double,vec_id:bigint,leaf:int>>"


def _answers(queries: list[tuple[int, int]], best: list[tuple]) -> pa.Table:
    """Rows (query, query_id, found) of the given queries' best candidates."""
    at = np.concatenate(([0], np.cumsum([len(b[0]) for b in best]))).astype(np.int32)
    ids, score, leaf = (np.concatenate([b[c] for b in best]) if best else np.zeros(0) for c in range(3))
    found = pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(ids.astype(np.int64)), pa.array(leaf.astype(np.int32))], ["score", "vec_id", "leaf"])
    return pa.table({"query": pa.array([q for q, _ in queries], pa.int64()), "query_id": pa.array([q for _, q in queries], pa.int64()), "found": pa.ListArray.from_arrays(pa.array(at), found)})


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all its lists, in two steps, so that no list grows with the buckets."""
    first = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("found")), first), 1, k)
    some = found.withColumn("part", F.pmod(F.xxhash64("found"), F.lit(64)))
    return some.groupBy("query", "query_id", "part").agg(merged.alias("found")).groupBy("query", "query_id").agg(merged.alias("found"))


def exact(rows: DataFrame, queries: list[tuple[int, int, np.ndarray]], k: int) -> DataFrame:
    """The k best of a few queries (row, id, vector) among all rows (leaf, row, vec_id, v), for calibration."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        asked = shared.value
        vectors = np.array([v for _, _, v in asked])
        best: list[tuple | None] = [None] * len(asked)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = Rows(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3)))
            rough = vectors @ own.vectors.T
            for i, (row, _, v) in enumerate(asked):
                best[i] = better(best[i], own.best(row, v, rough[i], k), k)
        if best and best[0] is not None:
            yield from _answers([(row, q) for row, q, _ in asked], best).to_batches()

    return _merged(rows.select("leaf", "row", "vec_id", "v").mapInArrow(run, _FOUND), k)


def calibrate(tree: Tree, answers: list, queries: dict[int, np.ndarray], recall: float) -> int:
    """The fewest leaf visits with which the exactly answered queries reach the recall."""
    reached, total = np.zeros(tree.leaves + 1), 0
    for row in answers:
        place = {leaf: i for i, leaf in enumerate(tree.visit(queries[row["query"]], tree.leaves))}
        for x in row["found"]:
            reached[place[x["leaf"]] + 1] += 1
            total += 1
    share = np.cumsum(reached) / max(1, total)
    return int(np.argmax(share >= recall)) if total else 1


class Buckets:
    """Where rows and queries meet: consecutive leaves up to BUCKET_ROWS rows, a larger leaf in parts of its own."""

    def __init__(self, sizes: np.ndarray, rows: int = BUCKET_ROWS):
        self.first, self.parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        bucket, held = 0, 0
        for leaf, n in enumerate(sizes.tolist()):
            if held and held + n > rows:
                bucket, held = bucket + 1, 0
            self.first[leaf], self.parts[leaf] = bucket, max(1, -(-n // rows))
            held += n
            if self.parts[leaf] > 1:
                bucket, held = bucket + int(self.parts[leaf]), 0
        self.count = bucket + 1

    def of_rows(self, leaf: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[leaf] + tb.mix(row.astype(np.uint64)).astype(np.int64) % self.parts[leaf]

    def of_query(self, leaves: list[int]) -> list[int]:
        return sorted({b for x in leaves for b in range(int(self.first[x]), int(self.first[x] + self.parts[x]))})


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query.

    Queries are the rows whose key is divisible by `every`; candidates all rows but the
    query's own, of which the index holds every one.  Rows with a null key or without a
    proper vector (see valid_vectors) take no part.  Of rows that repeat a key each asks
    for itself and finds the others.  A query has fewer than k rows only if there are
    fewer other rows.  Ties go to smaller keys.  An empty table gives an empty result;
    other columns are not read.
    """
    spark = df.sparkSession
    rows = cut(valid_vectors(df, key, vector).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = rows.where(unit_hash("vec_id", "v") < min(1.0, SAMPLE_ROWS / n)).orderBy("vec_id", "v").select("v").limit(2 * SAMPLE_ROWS).toArrow()["v"].combine_chunks()
    if not len(sample):
        sample = rows.select("v").orderBy("vec_id", "v").limit(1).toArrow()["v"].combine_chunks()
    tree = Tree(matrix(sample))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.place(matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *batch.columns], ["leaf", "row", "vec_id", "v"])

    placed = cut(rows.select("row", "vec_id", "v").mapInArrow(place, "leaf int, row bigint, vec_id bigint, v array<double>"))
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # bounded by the leaves
        sizes[r["leaf"]] = r["count"]
    buckets = spark.sparkContext.broadcast((sizes, Buckets(sizes)))
    asked = placed.where(F.col("vec_id") % every == 0)

    chosen = asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id", "row").limit(CALIBRATION_QUERIES).collect()
    tried = [(r["row"], r["vec_id"], np.array(r["v"])) for r in chosen]
    visits = calibrate(tree, exact(placed, tried, k).collect(), {row: v for row, _, v in tried}, recall)

    def plan(batches):
        held, places = buckets.value
        for batch in batches:
            leaves = [shared.value.visit(q, visits, held, k + 1) for q in matrix(batch.column(2))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([places.of_query(x) for x in leaves], pa.list_(pa.int64())), pa.array([np.array(x, np.int32).tobytes() for x in leaves], pa.binary())], ["row", "vec_id", "v", "buckets", "leaves"]
            )

    planned = cut(asked.select("row", "vec_id", "v").mapInArrow(plan, "row bigint, vec_id bigint, v array<double>, buckets array<bigint>, leaves binary"))
    # buckets that more queries visit than one task answers are dealt to several
    visited = planned.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count()
    dealt = visited.select("bucket", F.ceil(F.col("count") / QUERY_BLOCK).cast("int").alias("blocks"))

    def bucketed(batches):
        _, places = buckets.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(places.of_rows(batch.column(0).to_numpy(), batch.column(1).to_numpy())), *batch.columns], ["bucket", "leaf", "row", "vec_id", "v"])

    ours = placed.select("leaf", "row", "vec_id", "v").mapInArrow(bucketed, "bucket bigint, leaf int, row bigint, vec_id bigint, v array<double>")
    ours = ours.join(dealt, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "leaf", "row", "vec_id", "v")
    again = dealt.select(F.col("bucket").alias("at"), F.col("blocks").alias("of"))
    theirs = planned.select(F.explode("buckets").alias("at"), "row", "vec_id", "v", "leaves").join(again, "at")
    theirs = theirs.select("at", F.pmod(F.xxhash64("row"), F.col("of")).cast("int").alias("nth"), "row", "vec_id", "v", "leaves")

    def answer(key, have: pa.Table, ask: pa.Table) -> pa.Table:
        if not have.num_rows or not ask.num_rows:
            return _answers([], [])
        whole = Rows(*(have[c].to_numpy() for c in ("leaf", "row", "vec_id")), matrix(have["v"]))
        numbers, ids, vectors = ask["row"].to_numpy(), ask["vec_id"].to_numpy(), matrix(ask["v"])
        leaves = [set(np.frombuffer(x, np.int32).tolist()) for x in ask["leaves"].to_pylist()]
        best: list[tuple | None] = [None] * len(ids)
        for x in np.unique(whole.leaf).tolist():
            own = whole.at(np.flatnonzero(whole.leaf == x))
            some = [i for i, visits_ in enumerate(leaves) if x in visits_]
            for a in range(0, len(some), 1024):
                part = some[a : a + 1024]
                rough = vectors[part] @ own.vectors.T
                for j, i in enumerate(part):
                    best[i] = better(best[i], own.best(int(numbers[i]), vectors[i], rough[j], k), k)
        got = [i for i, b in enumerate(best) if b is not None]
        return _answers([(int(numbers[i]), int(ids[i])) for i in got], [best[i] for i in got])

    found = ours.groupBy("bucket", "block").cogroup(theirs.groupBy("at", "nth")).applyInArrow(answer, _FOUND)
    hits = _merged(found, k).select("query_id", F.posexplode("found").alias("at", "hit"))
    return hits.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest rows of every twentieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"))
