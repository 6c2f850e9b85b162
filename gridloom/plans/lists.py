"""List queries: filters, visibility, facets, search, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import filters as op
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()


def day(c: str) -> F.Column:
    return F.to_date(F.col(c))


@REG.add("list_orders_page", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 1000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 51""")
def list_orders_page(spark: SparkSession, d: str) -> DataFrame:
    """First page of 50 orders of one segment by price, and the row that tells more follow."""
    orders = table(spark, d, "orders").where(op.list_filters({"o_orderstatus": ["O", "P"]}, at_least={"o_totalprice": 1000}))
    customers = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    orders = op.permitted(orders, customers, "o_custkey", F.col("c_mktsegment") == "BUILDING")
    return op.keyset_page(orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50, ascending=False)


@REG.add("list_orders_next_page", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 5000 OR (o_totalprice = 5000 AND o_orderkey > 100)
ORDER BY o_totalprice, o_orderkey LIMIT 51""")
def list_orders_next_page(spark: SparkSession, d: str) -> DataFrame:
    """The page after a cursor in ascending order."""
    cursor = op.encode_cursor(5000.0, 100)
    return op.keyset_page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50, cursor=cursor)


@REG.add("exact_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus IN ('F') AND o_totalprice <= 200000")
def exact_total(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(op.list_filters({"o_orderstatus": ["F"]}, at_most={"o_totalprice": 200000})).agg(F.count(F.lit(1)).alias("total"))


@REG.add("facet_counts", """
SELECT 'o_orderstatus' AS dimension, o_orderstatus AS "value", count(*) AS rows FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2""")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    """Value counts of three dimensions in one pass."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return op.facets(joined, "o_orderstatus", "o_orderpriority", "c_mktsegment")


@REG.add("search_rank", r"""
WITH s AS (SELECT p_partkey, p_name, translate(lower(p_name), ' .,-''&/()', '') AS q FROM part)
SELECT p_partkey, p_name, CASE WHEN q = 'smallring' THEN 0 WHEN starts_with(q, 'smallring') THEN 1 ELSE 2 END AS rank FROM s WHERE contains(q, 'smallring')""")
def search_rank(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose squashed name holds the query, equal before prefix before substring."""
    return table(spark, d, "part").select("p_partkey", "p_name", op.search_rank(F.col("p_name"), "Small-Ring").alias("rank")).where("rank is not null")


@REG.add("country_clause", """
SELECT r_name AS country, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE upper(split_part(r_name || '-' || n_name, '-', 1)) IN ('ASIA', 'EUROPE') GROUP BY 1""")
def country_clause(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the leading part of a hyphenated jurisdiction code."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.concat_ws("-", "r_name", "n_name")
    rows = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).where(op.country_of(code).isin("ASIA", "EUROPE"))
    return rows.groupBy(F.col("r_name").alias("country")).agg(F.count(F.lit(1)).alias("customers"))


@REG.add("exploded_any_of", r"""
WITH t AS (SELECT p_partkey, list_filter(string_split(lower(p_type), ' '), lambda x: x <> '') AS tags FROM part)
SELECT p_partkey, len(tags) AS n_tags FROM t WHERE list_has_any(tags, ['steel', 'promo', 'all_source'])""")
def exploded_any_of(spark: SparkSession, d: str) -> DataFrame:
    """Parts with one of several tags or the wildcard; a part without tags matches nothing."""
    tags = F.filter(F.split(F.lower("p_type"), " "), lambda x: x != "")
    rows = table(spark, d, "part").select("p_partkey", tags.alias("tags"))
    return rows.where(op.any_of(F.col("tags"), ["steel", "promo"], "all_source")).select("p_partkey", F.size("tags").cast("long").alias("n_tags"))


@REG.add("visibility_semi", """
SELECT o_orderkey FROM orders o WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '2000-06-30'
AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag <> 'R' AND l.l_quantity >= 10)""")
def visibility_semi(spark: SparkSession, d: str) -> DataFrame:
    """Orders in a public state and time with at least one permitted link."""
    orders = table(spark, d, "orders").where((F.col("o_orderstatus") != "P") & (F.col("o_orderdate") <= F.lit("2000-06-30").cast("timestamp_ntz")))
    links = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return op.permitted(orders.select("o_orderkey"), links, "o_orderkey", (F.col("l_returnflag") != "R") & (F.col("l_quantity") >= 10))


@REG.add("genuine_events", """
SELECT event_id, user_id, event_type FROM events e WHERE EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'signup' AND f.ts < e.ts)""")
def genuine_events(spark: SparkSession, d: str) -> DataFrame:
    """Events after their source's first good run."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return op.genuine_runs(events, "user_id", "ts", F.col("event_type") == "signup").select("event_id", "user_id", "event_type")


@REG.add("slip_bucket", """
WITH t AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS late, o_orderstatus = 'O' AS active FROM orders)
SELECT CASE WHEN active AND late > 30 AND late <= 365 THEN 'year' WHEN active AND late > 30 AND late <= 1095 THEN 'three_years' WHEN active AND late > 1095 THEN 'more' END AS bucket,
       count(*) AS orders FROM t GROUP BY 1""")
def slip_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Active orders by how late they are; the rest, and those without a date, in the null bucket."""
    bucket = op.slip_bucket(day("o_orderdate"), F.lit("2000-01-01").cast("date"), F.col("o_orderstatus") == "O", grace=30)
    return table(spark, d, "orders").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("orders"))


@REG.add("not_slipped", """
SELECT count(*) AS orders FROM orders WHERE NOT coalesce(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN NULL ELSE o_orderdate < TIMESTAMP '1999-01-01' END, false)""")
def not_slipped(spark: SparkSession, d: str) -> DataFrame:
    """The complement of a condition that can be unknown keeps the unknown rows."""
    at = F.col("o_orderdate")
    known = F.when(at >= F.lit("1996-01-01").cast("timestamp_ntz"), at)
    return table(spark, d, "orders").where(op.negated(known < F.lit("1999-01-01").cast("timestamp_ntz"))).agg(F.count(F.lit(1)).alias("orders"))
