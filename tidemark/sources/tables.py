"""Reading and writing: explicit schemas, append-only tables, shared intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary one, which only a local session can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def store_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes rows to the shared folder, where they outlive executors; the rows read back, and where they lie."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage: rows written to the shared folder and read on from there."""
    return store_at(df)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Stores tables of one piece of work: `with Scratch() as keep: ... keep(df)`.  All of them go when it ends, well or not.

    What is to outlive it is stored by `stored` before, as rows are read when they are asked for.
    """

    def __init__(self) -> None:
        self._held: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        out, path = store_at(df)
        self._held.append((df.sparkSession, path))
        return out

    def __exit__(self, *_: object) -> None:
        for spark, path in self._held:
            delete(spark, path)


class Rounds:
    """The state of an iteration: each round's is stored, and then the one before it deleted."""

    def __init__(self) -> None:
        self._last: str | None = None

    def store(self, df: DataFrame) -> DataFrame:
        out, path = store_at(df)
        if self._last:
            delete(df.sparkSession, self._last)
        self._last = path
        return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """A CSV with a header, by an explicit schema; a missing column or a bad cell is an error, not a guess."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    names = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.option("header", True).schema(names).csv(path)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines by an explicit schema; broken lines stop the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append(df: DataFrame, path: str, *partition: str) -> None:
    """Adds to a history table, which is never rewritten."""
    df.write.mode("append").partitionBy(*partition).parquet(path)


def replace_partitions(df: DataFrame, path: str, *partition: str) -> None:
    """Replaces whole partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def write_csv(df: DataFrame, path: str, guard) -> None:
    """CSV with every text cell passed through a guard against formulas."""
    kinds = dict(df.dtypes)
    df.select(*[guard(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def page_dedupe(rows: DataFrame, key: str, page: str) -> DataFrame:
    """Drops repeats on later pages, keeps repeats within a key's first page; null keys are never repeats.

    One exchange brings a key's rows together; those without a key stay where they are.
    """
    first = F.min(page).over(Window.partitionBy(key))
    kept = rows.where(F.col(key).isNotNull()).withColumn("_first", first).where(F.col(page) == F.col("_first")).select(*rows.columns)
    return kept.unionByName(rows.where(F.col(key).isNull()))


def overlap_dedupe(rows: DataFrame, identity: Column, order: str) -> DataFrame:
    """Drops what several queries of one run brought twice: the first row of each identity stays, rows without one all do."""
    marked = rows.withColumn("_identity", identity)
    known = marked.where(F.col("_identity").isNotNull())
    first = known.groupBy("_identity").agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns]), order).alias("_row"))
    return first.select("_row.*").unionByName(marked.where(F.col("_identity").isNull()).drop("_identity"))


def row_identity(source_id: Column, address: Column, unit: Column, postal: Column) -> Column:
    """A source's own id, else the folded address with unit and postal code, else null."""
    folded = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    own = F.when(F.coalesce(source_id, F.lit("")) != "", F.concat(F.lit("id|"), source_id))
    return F.coalesce(own, F.when(folded(address) != "", F.concat_ws("|", F.lit("at"), folded(address), folded(unit), folded(postal))))


def source_report(rows: DataFrame, outcomes: DataFrame, source: str, ceiling: int) -> DataFrame:
    """(source, row_count, truncated, outcome, detail) of a scan, for every source that was asked.

    `outcomes` has each source's outcome.  Of a failed or unavailable source no row
    counts; a source at the ceiling has more than it gave.
    """
    n = rows.groupBy(source).agg(F.count("*").alias("_n"))
    given = F.when(F.col("outcome") == "ok", F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    told = outcomes.join(n, source, "left").withColumn("row_count", given).withColumn("truncated", F.col("row_count") >= ceiling)
    detail = F.when(F.col("outcome") != "ok", F.concat(F.lit("no rows: "), F.col("outcome"))).when(F.col("truncated"), F.concat(F.lit("at the ceiling of "), F.lit(str(ceiling))))
    return told.select(source, "row_count", "truncated", "outcome", detail.alias("detail"))


def worst_outcome(outcomes: DataFrame, key: str) -> DataFrame:
    """failed over unavailable over ok."""
    rank = F.when(F.col("outcome") == "failed", 2).when(F.col("outcome") == "unavailable", 1).otherwise(0)
    return outcomes.groupBy(key).agg(F.max(rank).alias("_r")).select(key, F.element_at(F.array(F.lit("ok"), F.lit("unavailable"), F.lit("failed")), F.col("_r") + 1).alias("outcome"))
