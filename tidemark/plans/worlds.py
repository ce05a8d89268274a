"""The given tables seen as the observed-entity model, in Spark and in the SQL of the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.history import first_per_key, healthy_runs

#: Two decimals as Spark's round has them: of the shortest decimal form of the double, halves away from zero.
CENTS_SQL = "CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: the user is the entity, the day since 2024-01-01 the run."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("entity"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("run_seq"), "event_id", "ts",
        F.col("event_type").alias("status"), F.col("value").alias("price"), F.floor(F.col("value") / 25).alias("bucket"), F.concat(F.lit("s"), F.col("event_id") % 3).alias("source"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first observation of each entity in each run, with the source behind it."""
    return first_per_key(observations(spark, sf_dir), ["entity", "run_seq"], ["ts", "event_id"]).withColumn("sources", F.array("source"))


def run_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of runs: one source fails every seventh run."""
    counted = observations(spark, sf_dir).groupBy("run_seq", "source").agg(F.count("*").alias("row_count"))
    failed = (F.col("run_seq") % 7 == 3) & (F.col("source") == "s1")
    return counted.select("run_seq", "source", F.when(failed, "failed").otherwise("ok").alias("outcome"), "row_count", F.lit(False).alias("truncated"))


def healthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return healthy_runs(run_sources(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two searches; every fifth failed, revisions change at run 12 and are null before 4."""
    r = observations(spark, sf_dir).groupBy("run_seq").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"))
    revision = F.when(F.col("run_seq") >= 12, "r2").when(F.col("run_seq") >= 4, "r1")
    return r.select("run_seq", F.when(F.col("run_seq") % 2 == 0, "even").otherwise("odd").alias("search"), revision.alias("revision"), F.when(F.col("run_seq") % 5 == 4, "failed").otherwise("completed").alias("status"), "started_at", "finished_at")


def _coordinate(key: str, factor: int, base: float):
    return F.lit(base) + (F.col(key) * factor % 10000) / F.lit(2000.0)


def places(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Rows of a table with coordinates made from their key."""
    return table(spark, sf_dir, name).select("*", F.col(key).alias("id"), _coordinate(key, 7919, 30.0).alias("latitude"), _coordinate(key, 104729, -105.0).alias("longitude"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = places(spark, sf_dir, "supplier", "s_suppkey")
    return s.select(F.col("id").alias("site"), "latitude", "longitude", (F.col("id") % 4).alias("condition"))


#: Literal shapes (longitude, latitude) over the made coordinates.
SHAPES = {
    "west": [(-105.0, 30.0), (-103.5, 30.5), (-103.2, 33.7), (-104.6, 34.6)],
    "notch": [(-104.0, 31.0), (-101.0, 31.2), (-102.5, 32.5), (-100.8, 34.1), (-103.9, 33.9)],
    "south": [(-103.05, 30.02), (-100.21, 30.11), (-101.13, 31.37)],
}

OBS_SQL = """
obs AS (
  SELECT user_id AS entity, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS run_seq, event_id, ts, event_type AS status,
    value AS price, CAST(floor(value / 25) AS BIGINT) AS bucket, 's' || (event_id % 3) AS source
  FROM events
), snap AS (
  SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY entity, run_seq ORDER BY ts, event_id) = 1
), health AS (
  SELECT run_seq, bool_and(NOT (run_seq % 7 = 3 AND source = 's1')) AS healthy FROM obs GROUP BY run_seq
), runs AS (
  SELECT run_seq, CASE WHEN run_seq % 2 = 0 THEN 'even' ELSE 'odd' END AS search,
    CASE WHEN run_seq >= 12 THEN 'r2' WHEN run_seq >= 4 THEN 'r1' END AS revision,
    CASE WHEN run_seq % 5 = 4 THEN 'failed' ELSE 'completed' END AS status, min(ts) AS started_at, max(ts) AS finished_at
  FROM obs GROUP BY run_seq
)"""


def places_sql(name: str, key: str) -> str:
    return f"SELECT *, {key} AS id, 30.0::DOUBLE + ({key} * 7919 % 10000) / 2000.0::DOUBLE AS latitude, -105.0::DOUBLE + ({key} * 104729 % 10000) / 2000.0::DOUBLE AS longitude FROM {name}"


def miles_sql(a: str, b: str, radius: float) -> str:
    h = f"power(sin((radians({b}.latitude) - radians({a}.latitude)) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * power(sin(radians({b}.longitude - {a}.longitude) / 2), 2)"
    return f"{2 * radius} * asin(least(1.0, sqrt({h})))"
