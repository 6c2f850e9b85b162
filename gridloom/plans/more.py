"""Lookups, periods, assignment and further gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import dates
from gridloom.functions import text as tx
from gridloom.operators import change_data, graph, matching, series
from gridloom.operators.spatial import haversine_m, near_pairs, wrap_longitude
from gridloom.plans.changes import _VERSIONS, order_versions
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()


@REG.add("period_functions", """
WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS day, strftime(CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE), '%Y-%m-%d') AS month_end, strftime(CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH AS DATE), '%Y-%m-%d') AS quarter_end,
       strftime(CAST(date_trunc('year', d) + INTERVAL 12 MONTH AS DATE), '%Y-%m-%d') AS year_end, strftime(CAST(date_trunc('month', d) - INTERVAL 5 MONTH AS DATE), '%Y-%m') AS shifted,
       CASE WHEN day(CAST(d - INTERVAL 1 MONTH AS DATE)) = day(d) THEN strftime(CAST(d - INTERVAL 1 MONTH AS DATE), '%Y-%m-%d') END AS before FROM o""")
def period_functions(spark: SparkSession, d: str) -> DataFrame:
    """Ends of the periods of each day, a shifted month, and the same day a month before."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    month, year = F.date_format("d", "yyyy-MM"), F.date_format("d", "yyyy")
    quarter = F.concat(year, F.lit("-Q"), F.quarter("d").cast("string"))
    return days.select(
        text("d").alias("day"), text(dates.period_end(month)).alias("month_end"), text(dates.period_end(quarter)).alias("quarter_end"), text(dates.period_end(year)).alias("year_end"),
        dates.shift_period(month, -5).alias("shifted"), text(dates.same_day_before(F.col("d"), 1)).alias("before"),
    )


@REG.add("served_status", "SELECT CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '2000-01-01' THEN 'closed' WHEN o_orderstatus = 'O' THEN 'open' ELSE lower(o_orderstatus) END AS status, count(*) AS orders FROM orders GROUP BY 1")
def served_status(spark: SparkSession, d: str) -> DataFrame:
    """Open orders past a deadline are served as closed."""
    stored = F.when(F.col("o_orderstatus") == "O", "open").otherwise(F.lower("o_orderstatus"))
    status = dates.served_status(stored, F.col("o_orderdate"), F.lit("2000-01-01").cast("timestamp_ntz"))
    return table(spark, d, "orders").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("orders"))


@REG.add("unique_lookup", "WITH u AS (SELECT structure_city, min(structure_type) AS t FROM faa_cases WHERE structure_type IS NOT NULL GROUP BY 1 HAVING min(structure_type) = max(structure_type)) SELECT case_id, t AS structure_type FROM faa_cases LEFT JOIN u USING (structure_city)")
def unique_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A town's structure type where the town has only one."""
    cases = table(spark, d, "faa_cases")
    return matching.unique_match(cases.select("case_id", "structure_city"), cases, ["structure_city"], "structure_type").select("case_id", "structure_type")


@REG.add("margin_match", """
WITH s AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY l_partkey ORDER BY score DESC, l_suppkey))
SELECT l_partkey, l_suppkey, score FROM r WHERE r = 1 AND score >= 50 AND (nxt IS NULL OR score - nxt >= 10)""")
def margin_match(spark: SparkSession, d: str) -> DataFrame:
    """Each part's best supplier where it leads clearly."""
    scored = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("score"))
    return matching.with_margin(scored, "l_partkey", "l_suppkey", "score", 50, 10)


@REG.add("unambiguous_pairs", """
WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R' AND l_linestatus = 'O' AND l_discount >= 0.09),
a AS (SELECT l_partkey FROM p GROUP BY 1 HAVING count(*) = 1), b AS (SELECT l_suppkey FROM p GROUP BY 1 HAVING count(*) = 1) SELECT p.* FROM p SEMI JOIN a USING (l_partkey) SEMI JOIN b USING (l_suppkey)""")
def unambiguous_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that pass a rule and whose ends pass it with nobody else."""
    rule = "l_quantity >= 50 AND l_returnflag = 'R' AND l_linestatus = 'O' AND l_discount >= 0.09"
    return matching.unambiguous(table(spark, d, "lineitem").where(rule).select("l_partkey", "l_suppkey").distinct(), "l_partkey", "l_suppkey")


@REG.add("complete_days", """
WITH n AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) = (SELECT count(DISTINCT event_type) FROM events) AND min(n) >= 60 AS complete FROM n GROUP BY 1""")
def complete_days(spark: SparkSession, d: str) -> DataFrame:
    """Days on which every type has its rows."""
    rows = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return matching.complete_days(rows, "event_type", "day", 60).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@REG.add("weekday_baseline", """
WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, n AS rows, median(n) OVER (PARTITION BY dayofweek(day) ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS baseline FROM c""")
def weekday_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Rows a day against the median of the same weekdays before."""
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    return change_data.weekday_baseline(daily, "day", "rows").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@REG.add("nulled_fields", f"""
WITH {_VERSIONS}, j AS (SELECT a.amount AS x, b.amount AS y, a.d AS p, b.d AS q FROM a JOIN b USING (o_orderkey))
SELECT 'amount' AS field, count(x) AS had, count(*) FILTER (x IS NOT NULL AND y IS NULL) AS lost FROM j UNION ALL SELECT 'd', count(p), count(*) FILTER (p IS NOT NULL AND q IS NULL) FROM j""")
def nulled_fields(spark: SparkSession, d: str) -> DataFrame:
    """Values that the second version lost."""
    return change_data.nulled_fields(*order_versions(spark, d), "o_orderkey", ["amount", "d"])


@REG.add("converted_amounts", """
WITH q AS (SELECT c, d, max(x) / 100000 AS rate FROM (SELECT o_orderstatus AS c, CAST(o_orderdate AS DATE) AS d, o_totalprice AS x FROM orders WHERE dayofyear(o_orderdate) % 5 <> 0) GROUP BY 1, 2),
b AS (SELECT o.d, o.rate AS o, f.rate AS f FROM (SELECT * FROM q WHERE c = 'O') o JOIN (SELECT * FROM q WHERE c = 'F') f ON o.d = f.d), z AS (SELECT min_by(o, d) AS o, min_by(f, d) AS f FROM b),
l AS (SELECT l_orderkey, l_linenumber, l_linestatus AS c, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN c = 'O' THEN x ELSE round(x * coalesce(b.o, z.o) / coalesce(b.f, z.f), 2) END AS amount FROM l ASOF LEFT JOIN b ON l.d >= b.d CROSS JOIN z""")
def converted_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts in one currency: the cross rate of the latest day on which both currencies quote, identity for its own."""
    orders = table(spark, d, "orders").where(F.dayofyear("o_orderdate") % 5 != 0)
    quotes = orders.groupBy(F.col("o_orderstatus").alias("c"), F.to_date("o_orderdate").alias("rd")).agg((F.max("o_totalprice") / 100000).alias("per"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("c"), F.to_date("l_shipdate").alias("d"), F.col("l_extendedprice").alias("x"))
    return series.converted(lines, quotes, "c", "d", "x", "c", "rd", "per", "O").select("l_orderkey", "l_linenumber", F.col("converted").alias("amount"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "faa_cases").select("case_id", F.col("latitude").alias("lat"), wrap_longitude(F.col("longitude")).alias("lon"), "structure_city", "structure_type")


@REG.add("facility_match")
def facility_match(spark: SparkSession, d: str) -> DataFrame:
    """Turbine cases and other cases within 500 m matched one to one by distance and town."""
    cases = _cases(spark, d)
    name = tx.containment(tx.tokens(F.coalesce("a.structure_city", F.lit(""))), tx.tokens(F.coalesce("b.structure_city", F.lit(""))))
    wind, rest = cases.where("structure_type = 'WIND TURBINE'"), cases.where("structure_type <> 'WIND TURBINE'")
    return matching.matched_places(wind.withColumnRenamed("case_id", "turbine_id"), rest, "turbine_id", "case_id", "lat", "lon", name, 500.0, 0.6)


_USABLE = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 360 AND NOT (latitude = 0 AND longitude = 0)"


@REG.add("nearest_site", f"""
WITH c AS (SELECT case_id, structure_type, latitude AS la, CASE WHEN longitude >= 180 THEN longitude - 360 ELSE longitude END AS lo FROM faa_cases WHERE {_USABLE}),
p AS (SELECT a.case_id, b.case_id AS site_id, 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) AS m
      FROM c a JOIN c b ON a.structure_type = 'TOWER' AND b.structure_type = 'CRANE' AND b.la BETWEEN a.la - 0.02 AND a.la + 0.02)
SELECT case_id, arg_min(site_id, struct_pack(m := m, s := site_id)) AS site_id, round(min(m), 3) AS metres FROM p WHERE m <= 2000 GROUP BY 1""")
def nearest_site(spark: SparkSession, d: str) -> DataFrame:
    """The nearest crane case within 2 km of every tower case."""
    cases = _cases(spark, d)
    sites = cases.where("structure_type = 'CRANE'").select(F.col("case_id").alias("site_id"), "lat", "lon")
    near = matching.nearest_site(cases.where("structure_type = 'TOWER'"), sites, "case_id", "site_id", "lat", "lon", 2_000.0)
    return near.withColumn("metres", F.round("metres", 3))


@REG.add("bounded_clusters")
def bounded_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Cases linked within 1 km into clusters at most 3 km wide."""
    cases = _cases(spark, d)
    places = cases.select(F.col("case_id").alias("node"), "lat", "lon")
    near = near_pairs(cases, "case_id", "lat", "lon", 1_000.0)
    at = lambda k, n: cases.select(F.col("case_id").alias(k), F.col("lat").alias(f"la{n}"), F.col("lon").alias(f"lo{n}"))
    m = haversine_m(F.col("la1"), F.col("lo1"), F.col("la2"), F.col("lo2"))
    pairs = near.join(at("left_id", 1), "left_id").join(at("right_id", 2), "right_id").select(F.col("left_id").alias("left"), F.col("right_id").alias("right"), m.alias("metres"))
    return graph.bounded_clusters(pairs, graph.components(near, "left_id", "right_id"), places, 3_000.0)
