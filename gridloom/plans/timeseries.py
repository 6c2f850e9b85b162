"""Interval series over events, orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import series as op
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()

_DAILY = """
WITH r AS (SELECT event_type, {day} AS day, date_trunc('hour', ts) AS h, value FROM events WHERE value IS NOT NULL),
h AS (SELECT event_type, day, h, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi, count(*) FILTER (value < 0) AS neg FROM r GROUP BY ALL),
d AS (SELECT event_type, day, CAST(sum(n) AS BIGINT) AS n, sum(s) / sum(n) AS mean, min(lo) AS lowest, max(hi) AS highest, CAST(sum(neg) AS BIGINT) AS negatives, CAST(count(*) AS INTEGER) AS hours,
      list_sort(list(s / n)) AS ms, {hours} AS expected_hours FROM h GROUP BY 1, 2)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n, round(mean, 9) AS mean, lowest, highest, negatives, hours, expected_hours,
       CASE WHEN hours = expected_hours AND hours >= 8 THEN round(list_sum(ms[-4:]) / 4, 9) END AS top_mean, CASE WHEN hours = expected_hours AND hours >= 8 THEN round(list_sum(ms[1:4]) / 4, 9) END AS bottom_mean FROM d"""


def _daily(spark: SparkSession, d: str, zone: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = op.daily_summary(events, ["event_type"], "ts", "value", zone)
    return out.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), **{c: F.round(c, 9) for c in ("mean", "top_mean", "bottom_mean")}})


@REG.add("daily_summary", _DAILY.format(day="CAST(ts AS DATE)", hours="CAST(24 AS INTEGER)"))
def daily_summary(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, extremes and the means of the four highest and lowest hours per type and UTC day."""
    return _daily(spark, d, "UTC")


@REG.add("local_day_summary", _DAILY.format(day="CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE)", hours="CAST(date_diff('hour', timezone('America/New_York', CAST(day AS TIMESTAMP)), timezone('America/New_York', CAST(day + 1 AS TIMESTAMP))) AS INTEGER)"))
def local_day_summary(spark: SparkSession, d: str) -> DataFrame:
    """The same per local day of a zone with clock changes."""
    return _daily(spark, d, "America/New_York")


@REG.add("trailing_window_stats", """
WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2),
w AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n, count(*) * 2 AS expected, sum(mean * n) / sum(n) AS mean FROM c WHERE day < DATE '2024-01-25' AND day >= DATE '2024-01-25' - 14 GROUP BY 1)
SELECT user_id, n, expected, round(n / expected, 6) AS coverage, CASE WHEN n / expected >= 0.9 THEN round(mean, 9) END AS mean FROM w""")
def trailing_window_stats(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean of fourteen days a user, withheld where under 90 % of the expected rows are there."""
    daily = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).withColumn("expected", F.lit(2))
    out = op.trailing_mean(daily, ["user_id"], F.lit("2024-01-25").cast("date"), days=14)
    return out.withColumns({"coverage": F.round("coverage", 6), "mean": F.round("mean", 9)})


@REG.add("basis_to_reference", """
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT a.event_type, count(*) AS hours, round(avg(a.v - b.v), 8) AS basis FROM h a JOIN h b ON a.h = b.h AND b.event_type = 'view' WHERE a.event_type <> 'view' GROUP BY 1""")
def basis_to_reference(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference to a reference series over the intervals both have."""
    hourly = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("value").alias("v"))
    reference = hourly.where("event_type = 'view'").select("h", F.col("v").alias("r"))
    return hourly.where("event_type <> 'view'").join(reference, "h").groupBy("event_type").agg(F.count(F.lit(1)).alias("hours"), F.round(F.avg(F.col("v") - F.col("r")), 8).alias("basis"))


_MONTHS = "m AS (SELECT o_orderpriority AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n, CASE WHEN year(o_orderdate) < 1998 THEN 'old' ELSE 'new' END AS basis FROM orders WHERE month(o_orderdate) <> 5 OR year(o_orderdate) <> 1997 GROUP BY ALL)"


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where((F.month("o_orderdate") != 5) | (F.year("o_orderdate") != 1997))
    basis = F.when(F.year("o_orderdate") < 1998, "old").otherwise("new")
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.trunc(F.to_date("o_orderdate"), "month").alias("m"), basis.alias("basis")).agg(F.count(F.lit(1)).alias("n"))


@REG.add("mom_yoy", f"""
WITH {_MONTHS} SELECT a.k, strftime(a.m, '%Y-%m') AS month, a.n, CASE WHEN b.basis = a.basis THEN a.n - b.n END AS change_1m, CASE WHEN c.basis = a.basis THEN a.n - c.n END AS change_12m
FROM m a LEFT JOIN m b ON a.k = b.k AND b.m + INTERVAL 1 MONTH = a.m LEFT JOIN m c ON a.k = c.k AND c.m + INTERVAL 12 MONTH = a.m""")
def mom_yoy(spark: SparkSession, d: str) -> DataFrame:
    """Moves against the month and the year before, on the same basis and never over a gap."""
    return op.with_changes(_monthly(spark, d), ["k"], "m", "n", "basis").select("k", F.date_format("m", "yyyy-MM").alias("month"), "n", "change_1m", "change_12m")


@REG.add("series_breaks", f"WITH {_MONTHS}, l AS (SELECT *, lag(basis) OVER (PARTITION BY k ORDER BY m) AS p FROM m) SELECT k, strftime(m, '%Y-%m') AS month, p AS previous_basis, basis FROM l WHERE p <> basis")
def series_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Points where the basis of a series changes."""
    return op.basis_breaks(_monthly(spark, d), ["k"], "m", "basis").select("k", F.date_format("m", "yyyy-MM").alias("month"), "previous_basis", "basis")


@REG.add("series_zero_fill", """
WITH m AS (SELECT o_orderstatus AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY 1, 2),
g AS (SELECT k, CAST(unnest(generate_series((SELECT min(m) FROM m), (SELECT max(m) FROM m), INTERVAL 1 MONTH)) AS DATE) AS m FROM (SELECT DISTINCT k FROM m))
SELECT g.k, strftime(g.m, '%Y-%m') AS month, coalesce(n, 0) AS n FROM g LEFT JOIN m ON g.k = m.k AND g.m = m.m""")
def series_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    """A point for every key and month, zero where nothing was tallied."""
    rows = table(spark, d, "orders").where("o_totalprice > 150000").groupBy(F.col("o_orderstatus").alias("k"), F.trunc(F.to_date("o_orderdate"), "month").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return op.zero_filled(rows, "k", "m", "n").select("k", F.date_format("m", "yyyy-MM").alias("month"), "n")


@REG.add("complete_period", "WITH c AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT *, lag(n) OVER (ORDER BY y) AS p FROM c) SELECT CAST(max(y) AS INTEGER) AS y FROM l WHERE n >= 0.9 * p")
def complete_period(spark: SparkSession, d: str) -> DataFrame:
    """The newest year with at least 90 % of the rows of the year before."""
    counts = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return op.complete_period(counts, "y", "n")


@REG.add("asof_rate", """
WITH r AS (SELECT CAST(max(o_orderdate) AS DATE) AS d, max(o_totalprice) / 100000 AS rate FROM orders GROUP BY date_trunc('month', o_orderdate)), f AS (SELECT min_by(rate, d) AS rate FROM r),
l AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l.l_extendedprice * coalesce(r.rate, f.rate) AS converted FROM l ASOF LEFT JOIN r ON l.d >= r.d CROSS JOIN f""")
def asof_rate(spark: SparkSession, d: str) -> DataFrame:
    """Every line's amount at the latest rate on or before its date, before the first rate at the first."""
    rates = table(spark, d, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month")).agg(F.to_date(F.max("o_orderdate")).alias("rd"), (F.max("o_totalprice") / 100000).alias("rate"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.to_date("l_shipdate").alias("d"))
    out = op.as_of(lines, rates, "d", "rd", ["rate"])
    return out.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("rate")).alias("converted"))


@REG.add("weighted_trailing_avg", """
WITH m AS (SELECT l_returnflag AS k, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, sum(l_extendedprice) AS a, sum(l_quantity) AS b FROM lineitem GROUP BY 1, 2),
w AS (SELECT k, m, sum(a) OVER w / sum(b) OVER w AS r, count(*) OVER w = 12 AND min(m) OVER w = CAST(m - INTERVAL 11 MONTH AS DATE) AS whole FROM m WINDOW w AS (PARTITION BY k ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT k, strftime(m, '%Y-%m') AS month, CASE WHEN whole THEN round(r, 4) END AS ratio FROM w""")
def weighted_trailing_avg(spark: SparkSession, d: str) -> DataFrame:
    """Revenue over quantity of twelve consecutive months."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.trunc(F.to_date("l_shipdate"), "month").alias("m")).agg(F.sum("l_extendedprice").alias("a"), F.sum("l_quantity").alias("b"))
    return op.weighted_trailing(rows, ["k"], "m", "a", "b").select("k", F.date_format("m", "yyyy-MM").alias("month"), F.round("ratio", 4).alias("ratio"))


@REG.add("latest_price", "SELECT user_id, arg_max(value, struct_pack(a := ts, b := event_id)) AS value, strftime(max(ts), '%Y-%m-%d') AS day FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1")
def latest_price(spark: SparkSession, d: str) -> DataFrame:
    """The newest value on or before a time for each key."""
    rows = table(spark, d, "events").where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    return rows.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("day"))
