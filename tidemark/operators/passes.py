"""Incremental passes: what is left to do, given what was answered before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unanswered(rows: DataFrame, answers: DataFrame, key: str, model: str | None = None) -> DataFrame:
    """One row for each distinct key without an answer (of a model, if given), the first by id."""
    known = answers if model is None else answers.where(F.col("model") == model)
    return rows.where(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min("id").alias("id"))


def changed_inputs(rows: DataFrame, answers: DataFrame, key: str = "id", mark: str = "fingerprint") -> DataFrame:
    """Rows never answered or whose fingerprint is another than the latest answer's; null equals null.  answers: (key, mark, seq)."""
    last = answers.groupBy(key).agg(F.max_by(F.struct(mark), "seq").alias("_last"))
    joined = rows.join(last, key, "left")
    return joined.where(F.col("_last").isNull() | ~F.col(mark).eqNullSafe(F.col(f"_last.{mark}"))).select(*rows.columns)


def within_budget(rows: DataFrame, narrow: str, order: str, limit: int) -> DataFrame:
    """The first `limit` rows of a pass, narrow asks before full ones: a feature of the pass, not of its size."""
    return rows.orderBy(F.desc(narrow), F.asc(order)).limit(limit)


def with_source_sets(pairs: DataFrame, snapshots: DataFrame, key: str = "entity") -> DataFrame:
    """Pairs (a, b) with both sides' sources, sorted and joined; a side without a snapshot stays, with null."""
    named = snapshots.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    left = named.select(F.col(key).alias("a"), F.col("sources").alias("a_sources"))
    right = named.select(F.col(key).alias("b"), F.col("sources").alias("b_sources"))
    return pairs.join(left, "a", "left").join(right, "b", "left").select("a", "b", "a_sources", "b_sources")


def overview(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Per search: runs, completed ones, the last completed, and how many of its runs had a source that wasn't ok."""
    bad = sources.groupBy("run_seq").agg(F.bool_or(F.col("outcome") != "ok").alias("_bad"))
    done = F.col("status") == "completed"
    return runs.join(bad, "run_seq", "left").groupBy("search").agg(
        F.count("*").alias("runs"), F.count_if(done).alias("completed"), F.max(F.when(done, F.col("finished_at"))).alias("last_completed_at"), F.count_if(F.coalesce("_bad", F.lit(False))).alias("with_problems")
    )


def first_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct by key, the first by order, with all columns."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def hidden_by_default(rows: DataFrame, include_passed: bool) -> DataFrame:
    """Adds whether a table hides the row at first: those judged `pass`, unless they are asked for."""
    passed = F.coalesce(F.col("judgment") == "pass", F.lit(False))
    return rows.withColumn("hidden", passed & F.lit(not include_passed))


def project(rows: DataFrame, registry: dict, names: list[str]) -> DataFrame:
    """The named columns of a registry, in order; a name that isn't registered is an error."""
    unknown = [n for n in names if n not in registry]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return rows.select(*[registry[n].alias(n) for n in names])
