"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.functions import values as v
from tidemark.operators.extract import claims
from tidemark.plans import worlds as w

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f, sql
        return f

    return add


_CLEAN = r"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9/ ]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query("clean_names", f"SELECT p_partkey, {_CLEAN.format(x='p_name')} AS name, {_CLEAN.format(x='p_brand')} AS brand FROM part")
def clean_names(spark, sf_dir):
    return w.table(spark, sf_dir, "part").select("p_partkey", t.clean(F.col("p_name")).alias("name"), t.clean(F.col("p_brand")).alias("brand"))


@query("text_digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def text_digests(spark, sf_dir):
    return w.table(spark, sf_dir, "documents").select("doc_id", t.digest(F.col("text")).alias("digest"))


@query("sheet_cells", rf"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '=' || text WHEN doc_id % 3 = 1 THEN ' -' || text ELSE text END AS x FROM documents),
p AS (SELECT doc_id, regexp_replace(x, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS x FROM x),
g AS (SELECT doc_id, CASE WHEN regexp_matches(ltrim(x), '^[=+@-]') THEN '''' || x ELSE x END AS x FROM p)
SELECT doc_id, sha256(CASE WHEN length(x) > {t.CELL_LIMIT} THEN substr(x, 1, {t.CELL_LIMIT - len(t.CELL_MARK)}) || '{t.CELL_MARK}' ELSE x END) AS cell FROM g""")
def sheet_cells(spark, sf_dir):
    x = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), F.col("text"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" -"), F.col("text"))).otherwise(F.col("text"))
    return w.table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.sheet_cell(x).cast("binary"), 256).alias("cell"))


@query("sentence_counts", """SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len(list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) END AS n FROM documents""")
def sentence_counts(spark, sf_dir):
    return w.table(spark, sf_dir, "documents").select("doc_id", F.size(t.sentences(F.col("text"))).alias("n"))


@query("address_keys", "SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN c_nationkey || '|' || c_custkey % 100 || '|' || lower(c_mktsegment) END AS k FROM customer")
def address_keys(spark, sf_dir):
    street = F.when(F.col("c_custkey") % 6 != 0, t.clean(F.col("c_mktsegment")))
    return w.table(spark, sf_dir, "customer").select("c_custkey", t.address_key((F.col("c_custkey") % 100).cast("string"), street, F.col("c_nationkey").cast("string")).alias("k"))


@query("parcel_forms", "SELECT p_partkey, CASE WHEN length(x) >= 4 THEN x END AS parcel FROM (SELECT p_partkey, regexp_replace(lower(p_partkey || '-' || p_size), '[^a-z0-9]', '', 'g') AS x FROM part)")
def parcel_forms(spark, sf_dir):
    return w.table(spark, sf_dir, "part").select("p_partkey", t.parcel_form(F.concat_ws("-", "p_partkey", "p_size")).alias("parcel"))


@query("unit_forms", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'lot ' || p_size WHEN 1 THEN 'b ' || p_size WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN 'space ' || p_size END AS unit FROM part")
def unit_forms(spark, sf_dir):
    forms = F.array(F.lit("Lot "), F.lit("Unit B-"), F.lit("APT. #"), F.lit("Suite Space "), F.lit("No. "))
    size = F.when(F.col("p_partkey") % 5 != 4, F.col("p_size").cast("string")).otherwise("")
    return w.table(spark, sf_dir, "part").select("p_partkey", t.unit_form(F.concat(F.element_at(forms, (F.col("p_partkey") % 5 + 1).cast("int")), size)).alias("unit"))


@query("bare_counties", "SELECT n_nationkey, lower(n_name) AS county FROM nation")
def bare_counties(spark, sf_dir):
    ending = F.element_at(F.array(F.lit(" County"), F.lit(" PARISH"), F.lit("")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return w.table(spark, sf_dir, "nation").select("n_nationkey", t.bare_county(F.concat("n_name", ending)).alias("county"))


@query("wind_names", "SELECT c_custkey, (['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'])[CAST(round((c_custkey * 7 % 360) / 22.5) AS INT) % 16 + 1] AS wind FROM customer")
def wind_names(spark, sf_dir):
    return w.table(spark, sf_dir, "customer").select("c_custkey", t.wind_name(F.col("c_custkey") * 7 % 360).alias("wind"))


@query("city_states", "SELECT c_custkey, lower(c_mktsegment) AS city, CASE WHEN c_custkey % 2 = 0 THEN 'NM' END AS state FROM customer")
def city_states(spark, sf_dir):
    x = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(", nm"))).otherwise(F.col("c_mktsegment"))
    return w.table(spark, sf_dir, "customer").select("c_custkey", t.city_and_state(x).alias("p")).select("c_custkey", "p.city", "p.state")


@query("weighted_sums", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 3 = 0 THEN NULL ELSE coalesce(CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey END, 0) * 1.0::DOUBLE + coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 4 END, 0) * 0.5::DOUBLE END AS baths FROM supplier")
def weighted_sums(spark, sf_dir):
    rows = w.table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey")).alias("full"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 4).alias("half"))
    return rows.select("s_suppkey", v.weighted_sum({"full": 1.0, "half": 0.5}).alias("baths"))


@query("recoded", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN NULL ELSE o_orderstatus END AS status FROM orders")
def recoded(spark, sf_dir):
    return w.table(spark, sf_dir, "orders").select("o_orderkey", v.recode(F.col("o_orderstatus"), {"O": "open", "F": ""}).alias("status"))


@query("areas", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN round(p_size * 43560) ELSE round(p_retailprice) END AS BIGINT) AS sqft FROM part")
def areas(spark, sf_dir):
    even = F.col("p_partkey") % 2 == 0
    return w.table(spark, sf_dir, "part").select("p_partkey", v.to_square_feet(F.when(even, F.col("p_size").cast("double")).otherwise(F.col("p_retailprice")), F.when(even, "Acres").otherwise("sqft")).alias("sqft"))


@query("price_per_area", f"SELECT o_orderkey, {w.CENTS_SQL.format(x='o_totalprice / nullif(o_orderkey % 4, 0)')} AS per FROM orders")
def price_per_area(spark, sf_dir):
    return w.table(spark, sf_dir, "orders").select("o_orderkey", v.price_per_area(F.col("o_totalprice"), F.col("o_orderkey") % 4).alias("per"))


@query("pair_keys", "SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_partkey AS VARCHAR) <= CAST(l_suppkey AS VARCHAR) THEN l_partkey || ',' || l_suppkey ELSE l_suppkey || ',' || l_partkey END AS k FROM lineitem")
def pair_keys(spark, sf_dir):
    return w.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.pair_key(F.col("l_partkey"), F.col("l_suppkey")).alias("k"))


@query("json_values", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_values(spark, sf_dir):
    return w.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("json_pairs", "SELECT k % 5 AS k, count(*) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def json_pairs(spark, sf_dir):
    k = F.from_json(F.concat(F.lit("["), F.col("props"), F.lit("]")), "array<struct<k bigint>>")
    return w.table(spark, sf_dir, "events").select(F.inline(k)).groupBy((F.col("k") % 5).alias("k")).agg(F.count("*").alias("n"))


@query("kleene_in", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus IN ('O', o_orderpriority) END AS hit FROM orders")
def kleene_in(spark, sf_dir):
    k = F.col("o_orderkey")
    hit = v.kleene_in(F.when(k % 3 != 0, F.col("o_orderstatus")), ["O", F.when(k % 4 != 0, F.col("o_orderpriority"))])
    return w.table(spark, sf_dir, "orders").select("o_orderkey", hit.alias("hit"))


@query("fingerprint_skips", "SELECT o_custkey, count(*) AS n, count(DISTINCT (o_orderstatus, o_orderpriority)) AS distinct_inputs FROM orders GROUP BY 1")
def fingerprint_skips(spark, sf_dir):
    o = w.table(spark, sf_dir, "orders").withColumn("f", v.fingerprint("o_orderstatus", "o_orderpriority"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("f").alias("distinct_inputs"))


@query("status_labels", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || ' (disappeared)' ELSE o_orderstatus END AS label FROM orders")
def status_labels(spark, sf_dir):
    presence = F.when(F.col("o_orderkey") % 3 == 0, "disappeared").otherwise("observed")
    return w.table(spark, sf_dir, "orders").select("o_orderkey", t.status_label(F.col("o_orderstatus"), presence).alias("label"))


@query("url_lists", "SELECT page_id, CASE WHEN page_id % 2 = 0 AND regexp_matches(url, '^https?://') THEN url || ',' || url || '?p=2' END AS urls FROM pages")
def url_lists(spark, sf_dir):
    url = F.col("url")
    urls = F.when(F.col("page_id") % 2 == 0, F.array(url, F.lit("n/a"), F.concat(url, F.lit("?p=2")), url)).otherwise(F.array(F.lit("none"), F.concat(F.lit("ftp:"), url)))
    return w.table(spark, sf_dir, "pages").select("page_id", F.array_join(v.url_list(urls), ",").alias("urls"))


#: Claims that the given texts do make.
LICENCES = {
    "licence": {"apache": ("under the apache license", "apache license"), "gnu": ("gnu? general public license",), "mit": ("mit license",), "cc": ("creative commons",)},
    "rights": {"reserved": ("all? rights reserved",)},
}
#: What the texts say about them: denied, hoped for, and said twice, as well as plainly.
_SAID = ("without the mit license, all rights reserved", "under the mit license, planned, not the apache license", "apache license; the mit license, no longer", "all  rights reserved, rights reserved")
# The SQL states its patterns by itself, so that what is wrong in the library's shows.
_DENIED_SQL = r"\b(no|not|nor|neither|never|cannot|without|lack|lacks|lacking|minus)\b[^.;,]{0,12}$"
_GONE_SQL = r"^[^.;]{0,24}\b(removed|abandoned|disconnected|decommissioned|capped|dry|dead|failed|unusable|inoperable|nonfunctional|non[ -]functional|not working|does not work|no longer|out of order|out of service|shut off|torn out)\b"
_HOPED_SQL = (
    r"\b(need|needed|needs|requires|required to|nearby|close by|available|availability|would|could|might|can be|may be|must be|will be|to be \w+ed|future|planned|proposed|someday|yet|coming"
    r"|at the road|in the road|at the street|in the street|to the lot line|to the property line|extends|extending|approximately|[0-9]+ ?(ft|feet|mile|miles)"
    r"|(spot|space|venting|vent|plumbing|plumbed|wiring|wired|roughed in|stubbed in|stubbed out) for)\b"
)
_FIELD_SQL = "SELECT doc_id, s, '{0}' AS field, regexp_extract_all(s, '{1}') AS hits, string_split_regex(s, '{1}') AS gaps FROM sentences"


@query("text_claims", rf"""WITH said AS (
  SELECT doc_id, lower(text || CASE doc_id % 5 WHEN 0 THEN '' {"".join(f"WHEN {k} THEN ' {x}' " for k, x in enumerate(_SAID, 1))}END) AS x FROM documents
), sentences AS (
  SELECT doc_id, trim(regexp_replace(unnest(string_split(regexp_replace(x, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1))), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS s FROM said
), fields AS (
  {_FIELD_SQL.format("licence", r"\b(under the apache license|apache license|gnu general public license|general public license|mit license|creative commons)\b")}
  UNION ALL {_FIELD_SQL.format("rights", r"\b(all rights reserved|rights reserved)\b")}
), hits AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM fields),
seen AS (
  SELECT doc_id, field, hits[i] AS phrase, s, length(hits[i]) AS n,
    list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS begins
  FROM hits
), told AS (
  SELECT doc_id, field, CASE WHEN phrase LIKE '%apache%' THEN 'apache' WHEN phrase LIKE '%public%' THEN 'gnu' WHEN phrase LIKE 'mit%' THEN 'mit' WHEN phrase LIKE 'creative%' THEN 'cc' ELSE 'reserved' END AS own,
    regexp_matches(s[1:CAST(begins AS BIGINT)], '{_DENIED_SQL}') OR regexp_matches(s[CAST(begins AS BIGINT) + n + 1:], '{_GONE_SQL}') AS denied,
    regexp_matches(s[greatest(CAST(begins AS BIGINT) - 59, 1):CAST(begins AS BIGINT) + n + 60], '{_HOPED_SQL}') AS hoped
  FROM seen
), found AS (SELECT doc_id AS id, field, CASE WHEN denied THEN 'none' WHEN NOT hoped THEN own END AS value FROM told)
SELECT id, field, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, count(DISTINCT value) > 1 AS conflict FROM found WHERE value IS NOT NULL GROUP BY 1, 2""")
def text_claims(spark, sf_dir):
    """Claims on licences in whole texts, with conflicts."""
    said = F.element_at(F.array(F.lit(""), *[F.lit(f" {x}") for x in _SAID]), (F.col("doc_id") % 5 + 1).cast("int"))
    return claims(w.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("text", said).alias("text")), LICENCES, limit=None)


#: What descriptions say, and what they claim by it.
_LISTED = (
    ("The house draws from its own private well.", [("water_source", "well")]), ("A well-tended orchard, as well as roses.", []), ("Town water and public sewer.", [("water_source", "city"), ("sewer", "city")]),
    ("Septic tank was pumped last May.", [("sewer", "septic")]), ("Septic needed.", []), ("There is no sewer.", [("sewer", "none")]), ("Two pellet stoves keep it warm.", [("heating", "pellet stove")]),
    ("Central heat and air throughout.", [("heating", "central"), ("cooling", "central")]), ("Swamp cooler on the porch.", [("cooling", "evaporative")]), ("The old boiler no longer runs.", [("heating", "none")]),
    ("Propane is available at the road.", []), ("Natural gas furnace, metal roof.", [("gas", "natural"), ("heating", "furnace"), ("roof", "metal")]), ("Standing-seam over the barn.", [("roof", "metal")]), ("A new roof in spring.", []),
    ("Mini split AC in the loft.", [("cooling", "mini-split")]), ("Irrigation well on the field.", [("water_source", "irrigation")]), ("Architectural shingles.", [("roof", "shingle")]),
)
_LISTED_SQL = ", ".join(f"({i}, '{f}', '{v}')" for i, (_, own) in enumerate(_LISTED) for f, v in own)


@query("listing_claims", f"""WITH said(i, field, value) AS (VALUES {_LISTED_SQL}), picked AS (SELECT p_partkey AS id, unnest([p_partkey % {len(_LISTED)}, (p_partkey * 7 + p_size) % {len(_LISTED)}]) AS i FROM part)
SELECT id, field, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, count(DISTINCT value) > 1 AS conflict FROM picked JOIN said USING (i) GROUP BY id, field""")
def listing_claims(spark, sf_dir):
    """Claims in made descriptions of parts, two sentences each, by the library's own vocabulary."""
    n, k = len(_LISTED), F.col("p_partkey")
    sentence = lambda i: F.element_at(F.array(*[F.lit(x) for x, _ in _LISTED]), (i % n + 1).cast("int"))
    text = F.concat_ws("  ", sentence(k), sentence(k * 7 + F.col("p_size")))
    return claims(w.table(spark, sf_dir, "part").select(k.alias("id"), text.alias("text")))
