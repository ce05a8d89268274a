"""Criteria, results, tags and table filters over orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.functions.criteria import Rule, evaluate, field
from tidemark.operators import results as r
from tidemark.operators.spatial import rank_within
from tidemark.plans import worlds as w

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


_ROWS = """rows AS (
  SELECT o_orderkey AS entity, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 7 <> 0 THEN c_acctbal END AS balance,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 4 END AS units, o_orderdate
  FROM orders JOIN customer ON c_custkey = o_custkey
)"""


def _rows(spark, sf_dir):
    o, c = w.table(spark, sf_dir, "orders"), w.table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        k.alias("entity"), "o_custkey", F.when(k % 5 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 7 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 11 != 0, k % 4).alias("units"), "o_orderdate",
    )


def rules():
    price, balance, status, units = field("price"), field("balance"), field("status"), field("units")
    return [
        Rule("dear", "drop", (price > 200000) & (balance < 1000)),
        Rule("either", "flag", (price > 250000) | (balance > 8000)),
        Rule("per_unit", "boost", price / units > 60000),
        Rule("listed", "demote", status.one_of("O", "P")),
        Rule("odd", "flag", ~(units.equals(2))),
        Rule("no_ratio", "boost", (price / units).is_null()),
        Rule("maybe", "drop", status.one_of("F", status) & (price + balance < 50000)),
        Rule("over", "boost", price * 1e12 > 1),
    ]


def _rule(name: str, severity: str, expr: str, missing: str) -> str:
    return f"SELECT entity, '{name}' AS rule_id, '{severity}' AS severity, {expr} AS v, {missing} AS m FROM rows"


def _names(*names: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in names) + ")"


_RULES_SQL = " UNION ALL ".join(
    [
        _rule("dear", "drop", "price > 200000 AND balance < 1000", _names("balance", "price")),
        _rule("either", "flag", "price > 250000 OR balance > 8000", _names("balance", "price")),
        _rule("per_unit", "boost", "price / nullif(units, 0) > 60000", _names("price", "units")),
        _rule("listed", "demote", "status IN ('O', 'P')", _names("status")),
        _rule("odd", "flag", "units <> 2", _names("units")),
        _rule("no_ratio", "boost", "price / nullif(units, 0) IS NULL", "''"),
        _rule("maybe", "drop", "(CASE WHEN status IS NOT NULL THEN true END) AND price + balance < 50000", _names("balance", "price", "status")),
        _rule("over", "boost", "CASE WHEN abs(price * 1e12) <= 1e15 THEN price * 1e12 END > 1", _names("price")),
    ]
)
_VERDICTS = f"{_ROWS}, told AS ({_RULES_SQL}), verdicts AS (SELECT entity, rule_id, severity, CASE WHEN v IS NULL THEN 'undetermined' WHEN v THEN 'fired' ELSE 'not-fired' END AS verdict, CASE WHEN v IS NULL THEN m ELSE '' END AS missing FROM told)"


def _verdicts(spark, sf_dir):
    return evaluate(_rows(spark, sf_dir), rules())


@query("rule_verdicts", f"WITH {_VERDICTS} SELECT * FROM verdicts")
def rule_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir).withColumn("missing", F.array_join("missing", ","))


@query("rule_summary", f"""WITH {_VERDICTS} SELECT entity, count(*) FILTER (verdict = 'fired' AND severity = 'boost') - count(*) FILTER (verdict = 'fired' AND severity = 'demote') AS score,
coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (verdict = 'fired' AND severity = 'drop'), '') AS drops, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (verdict = 'fired' AND severity = 'flag'), '') AS flags FROM verdicts GROUP BY entity""")
def rule_summary(spark, sf_dir):
    s = r.summarise(_verdicts(spark, sf_dir))
    return s.select("entity", "score", F.array_join("drops", ",").alias("drops"), F.array_join("flags", ",").alias("flags"))


@query("exclusion_counts", f"WITH {_VERDICTS} SELECT rule_id, count(*) AS n FROM verdicts WHERE verdict = 'fired' AND severity = 'drop' GROUP BY rule_id")
def exclusion_counts(spark, sf_dir):
    return r.exclusion_counts(_verdicts(spark, sf_dir))


@query("excluded_rows", f"WITH {_VERDICTS} SELECT DISTINCT entity FROM verdicts WHERE verdict = 'fired' AND severity = 'drop'")
def excluded_rows(spark, sf_dir):
    return r.summarise(_verdicts(spark, sf_dir)).where("dropped").select("entity")


@query("newly_fired", f"""WITH {_VERDICTS} SELECT entity, rule_id FROM verdicts WHERE verdict = 'fired' AND NOT (entity % 2 = 0 AND rule_id <> 'odd')""")
def newly_fired(spark, sf_dir):
    now = _verdicts(spark, sf_dir)
    return r.newly_fired(now, now.where((F.col("entity") % 2 == 0) & (F.col("rule_id") != "odd")))


@query("ranked_results", f"""WITH {_VERDICTS}, s AS (SELECT entity, count(*) FILTER (verdict = 'fired' AND severity = 'boost') - count(*) FILTER (verdict = 'fired' AND severity = 'demote') AS score FROM verdicts GROUP BY entity)
SELECT o_custkey, entity, score, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderdate, entity) AS place FROM s JOIN rows USING (entity)""")
def ranked_results(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("entity", "o_custkey", "o_orderdate")
    scored = r.summarise(_verdicts(spark, sf_dir)).select("entity", "score").join(rows, "entity")
    from pyspark.sql import Window as W

    order = W.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderdate", "entity")
    return scored.select("o_custkey", "entity", "score", F.row_number().over(order).alias("place"))


@query("top_results", f"WITH {_ROWS} SELECT entity, price FROM rows ORDER BY price DESC NULLS LAST, entity LIMIT 50")
def top_results(spark, sf_dir):
    return r.order_by(_rows(spark, sf_dir).select("entity", "price"), "price", True, ["entity"]).limit(50)


@query("drive_status", f"""WITH {_ROWS}, s AS (SELECT entity, CASE WHEN price IS NULL AND entity % 2 = 0 THEN 'unavailable' WHEN price IS NULL THEN 'pending' WHEN price < 50000 OR price > 220000 THEN 'excluded' ELSE 'match' END AS a,
CASE WHEN balance IS NULL AND entity % 2 = 0 THEN 'unavailable' WHEN balance IS NULL THEN 'pending' WHEN balance > 7000 THEN 'excluded' ELSE 'match' END AS b FROM rows)
SELECT CASE WHEN 'excluded' IN (a, b) THEN 'excluded' WHEN 'pending' IN (a, b) THEN 'pending' WHEN 'unavailable' IN (a, b) THEN 'unavailable' ELSE 'match' END AS status, count(*) AS n FROM s GROUP BY 1""")
def drive_status(spark, sf_dir):
    asked = F.col("entity") % 2 == 0
    status = r.overall_status([r.bound_status(F.col("price"), 50000, 220000, asked), r.bound_status(F.col("balance"), None, 7000, asked)])
    return _rows(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("null_tolerant_filter", f"WITH {_ROWS} SELECT entity FROM rows WHERE (price IS NULL OR price >= 100000) AND (balance IS NULL OR balance <= 5000) AND (status IS NULL OR status IN ('O', 'F'))")
def null_tolerant_filter(spark, sf_dir):
    from tidemark.functions.values import at_least, at_most, one_of

    return _rows(spark, sf_dir).where(at_least(F.col("price"), 100000) & at_most(F.col("balance"), 5000) & one_of(F.col("status"), ["O", "F"])).select("entity")


@query("freshness_filter", "SELECT user_id FROM events GROUP BY user_id HAVING floor(epoch(TIMESTAMP '2024-01-31' - min(ts)) / 86400) < 30 OR user_id % 10 = 0")
def freshness_filter(spark, sf_dir):
    from tidemark.functions.values import floor_days

    first = w.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    return first.where((floor_days(F.col("first"), F.lit("2024-01-31").cast("timestamp_ntz")) < 30) | (F.col("user_id") % 10 == 0)).select("user_id")


_TAGS = """tags(tag) AS (VALUES ('Building'), ('machinery'), ('Other'), ('automobile')), uses AS (SELECT c_custkey AS entity, lower(c_mktsegment) AS tag FROM customer)"""


def _tags(spark, sf_dir):
    names = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("Building", "machinery", "Other", "automobile")])).alias("tag"))
    return names, w.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.lower("c_mktsegment").alias("tag"))


@query("tag_counts", f"WITH {_TAGS} SELECT t.tag, count(DISTINCT entity) AS n FROM tags t LEFT JOIN uses u ON lower(t.tag) = u.tag GROUP BY t.tag")
def tag_counts(spark, sf_dir):
    return r.tag_counts(*_tags(spark, sf_dir))


@query("rename_tag", f"WITH {_TAGS} SELECT DISTINCT entity, CASE WHEN tag = 'machinery' THEN 'building' ELSE tag END AS tag FROM uses")
def rename_tag(spark, sf_dir):
    return r.rename_tag(_tags(spark, sf_dir)[1], "Machinery", "building")


@query("replace_tags", f"""WITH {_TAGS}, wanted AS (SELECT 9 AS entity, t AS tag FROM (VALUES ('Building'), ('shed')) x(t)),
held AS (SELECT entity, tag FROM uses WHERE entity % 3 = 0 AND tag IN (SELECT lower(tag) FROM wanted))
SELECT entity, tag FROM uses WHERE entity % 3 <> 0 UNION ALL SELECT * FROM held UNION ALL SELECT entity, tag FROM wanted WHERE lower(tag) NOT IN (SELECT tag FROM held)""")
def replace_tags(spark, sf_dir):
    uses = _tags(spark, sf_dir)[1]
    family = uses.where(F.col("entity") % 3 == 0).select("entity").distinct()
    wanted = spark.range(1).select(F.lit(9).cast("bigint").alias("entity"), F.explode(F.array(F.lit("Building"), F.lit("shed"))).alias("tag"))
    return r.replace_tags(uses, wanted, family)


@query("place_counts", "SELECT 'city' AS kind, n_name AS name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 2 UNION ALL SELECT 'county', c_mktsegment, count(*) FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 2")
def place_counts(spark, sf_dir):
    c, n = w.table(spark, sf_dir, "customer"), w.table(spark, sf_dir, "nation")
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("n_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).otherwise("").alias("segment"))
    return r.place_counts(rows, "n_name", "segment")


@query("states_seen", "SELECT DISTINCT upper(substr(n_name, 1, 2)) AS state FROM nation WHERE upper(substr(n_name, 1, 2)) IN ('AL', 'AR', 'IN', 'ID', 'CA', 'MO') OR n_regionkey = 2")
def states_seen(spark, sf_dir):
    state = F.upper(F.trim(F.substring("n_name", 1, 2)))
    return w.table(spark, sf_dir, "nation").where(state.isin("AL", "AR", "IN", "ID", "CA", "MO") | (F.col("n_regionkey") == 2)).select(state.alias("state")).where(F.length("state") == 2).distinct()


@query("empty_columns", f"WITH {_ROWS} SELECT 'price' AS \"column\", bool_or(price IS NOT NULL) AS has_values FROM rows UNION ALL SELECT 'status', bool_or(coalesce(status, '') <> '') FROM rows UNION ALL SELECT 'nothing', false")
def empty_columns(spark, sf_dir):
    return r.empty_columns(_rows(spark, sf_dir).select("price", "status", F.lit(None).cast("string").alias("nothing")))


@query("search_box", "SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%ma%' OR lower(c_mktsegment) LIKE '%ma%' OR CAST(c_custkey AS VARCHAR) LIKE '%ma%'")
def search_box(spark, sf_dir):
    return w.table(spark, sf_dir, "customer").where(t.any_column_contains(["c_name", "c_mktsegment", "c_custkey"], "MA")).select("c_custkey")


@query("column_filter", "SELECT o_orderkey FROM orders WHERE CAST(o_custkey * 1000 AS VARCHAR) LIKE '%12000%'")
def column_filter(spark, sf_dir):
    o = w.table(spark, sf_dir, "orders")
    return o.where(t.matches_shown(F.col("o_custkey") * 1000, "12,000")).select("o_orderkey")


@query("natural_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS place FROM part")
def natural_order(spark, sf_dir):
    from pyspark.sql import Window as W

    key = t.natural_key(F.concat(F.lit("Lot "), F.col("p_size"), F.lit(" #"), F.col("p_partkey")))
    return w.table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(W.partitionBy("p_brand").orderBy(key)).alias("place"))


@query("top_examples", f"WITH {_ROWS} SELECT o_custkey, entity FROM rows QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY status IS NULL, entity) <= 3")
def top_examples(spark, sf_dir):
    return r.top_examples(_rows(spark, sf_dir).select("o_custkey", "entity", "status"), "o_custkey", "status", "entity", 3).select("o_custkey", "entity")


@query("worst_concern", """WITH a AS (SELECT o_custkey, o_orderkey AS seq, o_orderkey % 6 AS k, o_orderpriority AS p FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT o_custkey, CASE k WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 2 END AS n, CASE WHEN k <= 1 THEN NULL WHEN k % 2 = 0 THEN 'major' ELSE 'minor' END AS worst FROM a""")
def worst_concern(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    lists = F.when(k == 0, None).when(k == 1, F.array().cast("array<string>")).when(k % 2 == 0, F.array(F.lit("minor"), F.lit("major"))).otherwise(F.array(F.lit("minor"), F.lit("minor")))
    rows = w.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), lists.alias("concerns"))
    return r.worst_concern(rows, "o_custkey", ["minor", "major"])


@query("shared_parts", "SELECT l_partkey FROM lineitem WHERE l_suppkey % 4 = 0 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey % 4 = 1")
def shared_parts(spark, sf_dir):
    li = w.table(spark, sf_dir, "lineitem")
    return li.where("l_suppkey % 4 = 0").select("l_partkey").intersect(li.where("l_suppkey % 4 = 1").select("l_partkey"))


@query("dropped_parts", "SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1993 EXCEPT SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1994")
def dropped_parts(spark, sf_dir):
    li = w.table(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"))
    return li.where("y = 1993").select("l_partkey").distinct().join(li.where("y = 1994").select("l_partkey"), "l_partkey", "left_anti")


@query("newest_per_search", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY 1")
def newest_per_search(spark, sf_dir):
    return w.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("first_claim", "SELECT l_partkey, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_orderkey) = 1")
def first_claim(spark, sf_dir):
    li = w.table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey")
    return rank_within(li, ["l_partkey"], [F.col("l_suppkey"), F.col("l_orderkey")], 1).select("l_partkey", "l_orderkey")
