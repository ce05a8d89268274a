"""Mixing sources to target weights by entropy balancing.

The mix should take a given number of words from every source while staying as
near to the corpus as it can: among all document rates r with
sum(size * r) = target in each source, it takes those of least relative entropy
weighted by words, sum(size * (r * log(r) - r + 1)), which are exponential tilts
r = exp(lambda[source]).  (Weighted by documents, the tilt would be
exp(lambda[source] * size), which is not what this does.)  With one constraint a
source, lambda is log(target / source_size); it is solved for as if there were
more.  The dual in lambda is convex; damped Newton steps solve it, each one a distributed sum of the tilted
sizes and of their derivative over a histogram of the corpus.  Rates are then
rounded into whole copies: within a source, documents of one size are alike, and
sizes are rounded from the largest to the smallest, each carrying on the words
that the ones before it took too many or too few.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, free_names, table
from tidemark.sources.tables import Rounds

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this.
MAX_RATE = 3
#: Sources, in order, weigh these, again and again.
WEIGHTS = (1, 2, 3)
TOLERANCE = 1e-9
MAX_STEPS = 60
#: Documents of one source and size that one task ranks at once.
CELL_ROWS = 1024


def source_targets(sources: DataFrame, max_rate: int = MAX_RATE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds `target` to rows (source, source_size): shares by weight, no more than max_rate times the size.

    The excess of a source that is capped goes to the others by weight.  That ends in
    min(cap, weight * level) with one level for all; with sources ordered by
    cap / weight the capped ones come first, so the level follows from running sums.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(max_rate))
    filling = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    upto = filling.rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - (F.sum("_cap").over(upto) - F.col("_cap"))) / (F.sum("_w").over(everything) - F.sum("_w").over(upto) + F.col("_w"))
    ranked = ranked.withColumn("_level", level)
    full_at = F.col("_cap") / F.col("_w")
    # the level at the first source that it does not fill
    fixed = F.min(F.when(F.col("_level") <= full_at, F.struct(full_at, F.col("_level").alias("level")))).over(everything)["level"]
    return ranked.withColumn("target", F.least("_cap", F.col("_w") * F.coalesce(fixed, F.lit(float("inf"))))).drop("_w", "_cap", "_level")


def solve_dual(histogram: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds `lam` to rows (source, source_size, target): Newton steps on the convex dual.

    Each step sums the tilted sizes of the histogram (source, size, n) by source; the
    step is damped to one unit, so that it can't overshoot where the tilt is flat.
    """
    rounds = Rounds()
    state = rounds.store(targets.withColumn("lam", F.lit(0.0)))
    for _ in range(MAX_STEPS):
        tilted = (
            histogram.join(state.select(F.col("source").alias("_s"), "lam"), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("_s")
            .agg(F.sum(F.col("n") * F.col("size") * F.exp("lam")).alias("_sum"))
        )
        off = F.col("_sum") - F.col("target")
        step = F.when(F.col("_sum") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), off / F.col("_sum")))).otherwise(0.0)
        stepped = state.join(tilted, state["source"].eqNullSafe(tilted["_s"])).select("source", "source_size", "target", "lam", step.alias("_step"))
        state = rounds.store(stepped.select("source", "source_size", "target", (F.col("lam") - F.col("_step")).alias("lam"), "_step"))
        worst = state.agg(F.max(F.abs("_step"))).first()[0]
        state = state.drop("_step")
        if worst is None or worst <= tolerance:
            return state
    raise RuntimeError(f"the dual did not settle in {MAX_STEPS} steps")


def round_cells(cells: pd.DataFrame, max_rate: int = MAX_RATE) -> pd.DataFrame:
    """Copies of each size of one source, largest size first, each carrying on the error so far.

    One row for each distinct size of a source, however many documents it has.
    """
    cells = cells.sort_values("size", ascending=False, kind="stable")
    owed, copies = 0.0, []
    for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
        owed += size * n * rate
        if size == 0:
            take = round(n * min(rate, max_rate))
        else:
            low, high = n * math.floor(rate + 1e-9), n * min(max_rate, math.ceil(rate - 1e-9))
            take = min(max(math.floor(owed / size + 0.5), low), max(low, high))
        owed -= take * size
        copies.append(take)
    return cells.assign(copies=copies)


#: Columns that a mix adds.
ADDED = ("size", "source_size", "target", "rate", "copies")


def mix(documents: DataFrame, max_rate: int = MAX_RATE, weights: tuple[int, ...] = WEIGHTS, names: Sequence[str] = ADDED) -> DataFrame:
    """The documents' columns plus size, source_size, target, rate and copies, under the given names.

    Needs doc_id, text and source.  A null or wordless text has size 0 and a source of
    no words a target of 0.  A null source is a source of its own, the last one.
    Repeated rows are mixed each by itself.  Other columns pass through; ones named
    like the added ones are replaced, so give other names to keep them.  An empty table
    gives an empty table.
    """
    kept = [c for c in documents.columns if c not in names]
    added = list(ADDED)
    key = F.xxhash64("doc_id", "text")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    narrow = cut(documents.select("source", size.alias("size"), key.alias("_key"), "doc_id"))
    histogram = cut(narrow.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), max_rate, weights)
    solved = solve_dual(histogram, targets).withColumn("rate", F.when(F.col("target") > 0, F.least(F.exp("lam"), F.lit(float(max_rate)))).otherwise(0.0))

    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        return round_cells(pdf, max_rate)[["source", "source_size", "target", "rate", "size", "n", "copies"]]

    cells = (
        histogram.join(solved.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select("source", "source_size", "target", "rate", "size", "n")
        .groupBy("source")
        .applyInPandas(rounded, "source string, source_size bigint, target double, rate double, size bigint, n bigint, copies bigint")
    )
    # A cell's copies: the whole part to each of its documents, the rest to those of the smallest keys.
    # Large cells are dealt into parts by key, and the rest to the parts in proportion.
    cells = cut(cells.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "rate", "n", "copies", F.ceil(F.col("n") / CELL_ROWS).alias("_parts")))
    large = cells.where(F.col("_parts") > 1).select(F.col("_s").alias("_ls"), F.col("_z").alias("_lz"), "_parts", F.col("n").alias("_n"), (F.col("copies") % F.col("n")).alias("_rest"))
    dealt = narrow.join(large, F.col("source").eqNullSafe(F.col("_ls")) & (F.col("size") == F.col("_lz"))).select("source", "size", "_n", "_rest", F.pmod(F.xxhash64("_key", F.lit(7)), "_parts").alias("_part"))
    running = W.partitionBy("source", "size").orderBy("_part")
    shares = dealt.groupBy("source", "size", "_part").agg(F.count("*").alias("_m"), F.first("_n").alias("_n"), F.first("_rest").alias("_rest")).withColumn("_upto", F.sum("_m").over(running))
    quota = F.floor(F.col("_rest") * F.col("_upto") / F.col("_n")) - F.floor(F.col("_rest") * (F.col("_upto") - F.col("_m")) / F.col("_n"))
    shares = shares.select(F.col("source").alias("_ps"), F.col("size").alias("_pz"), F.col("_part").alias("_pp"), quota.alias("_quota"))

    full = narrow.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    full = full.withColumn("_part", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("_key", F.lit(7)), "_parts")).otherwise(F.lit(0)))
    full = full.join(shares, F.col("source").eqNullSafe(F.col("_ps")) & (F.col("size") == F.col("_pz")) & (F.col("_part") == F.col("_pp")), "left")
    rank = F.row_number().over(W.partitionBy("source", "size", "_part").orderBy("_key", "doc_id"))
    rest = F.coalesce("_quota", F.col("copies") % F.col("n"))
    copies = (F.floor(F.col("copies") / F.col("n")) + (rank <= rest).cast("bigint")).cast("bigint")
    f_key, f_id, f_source, f_no, f_own, f_at, *f_added = free_names(documents.columns, "key", "id", "source", "no", "own", "at", *added)
    decided = full.select(F.col("_key").alias(f_key), F.col("doc_id").alias(f_id), F.col("source").alias(f_source), *[c.alias(n) for c, n in zip([F.col("size"), F.col("source_size"), F.col("target"), F.col("rate"), copies], f_added, strict=True)])

    # back to the whole rows, moved once; rows that repeat id, text and source are told apart by number
    decided = decided.withColumn(f_no, F.row_number().over(W.partitionBy(f_id, f_key, f_source).orderBy(f_added[-1])))
    whole = documents.select(*[F.col(f"`{c}`") for c in kept], key.alias(f_own))
    hashable = [F.col(f"`{f.name}`") for f in documents.schema if f.name in kept and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    whole = whole.withColumn(f_at, F.row_number().over(W.partitionBy("doc_id", f_own, "source").orderBy(F.xxhash64(*hashable))))
    same = F.col("doc_id").eqNullSafe(F.col(f_id)) & (F.col(f_own) == F.col(f_key)) & F.col("source").eqNullSafe(F.col(f_source)) & (F.col(f_at) + F.lit(0) == F.col(f_no) + F.lit(0))
    return whole.join(decided, same).select(*[F.col(f"`{c}`") for c in kept], *[F.col(n).alias(a) for n, a in zip(f_added, names, strict=True)])


def repeat_copies(mixed: DataFrame, names: Sequence[str] = ADDED) -> DataFrame:
    """The rows of a mix, each as often as it has copies, without the mix's own columns."""
    kept = [F.col(f"`{c}`") for c in mixed.columns if c not in names]
    (turn,) = free_names(mixed.columns, "copy")
    copies = F.col(names[-1])
    return mixed.where(copies > 0).select(*kept, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias(turn)).drop(turn)


def mixed_copies(documents: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns only, whatever their names."""
    names = free_names(documents.columns, *ADDED)
    return repeat_copies(mix(documents, names=names), names)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document, its source's size and target, and the words that the mix takes of it."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
