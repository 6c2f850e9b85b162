"""Change data: version diffs, quality gates, keys, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import change_data as op
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()

_STATE = "CASE o_orderstatus WHEN 'O' THEN 'filed' WHEN 'F' THEN 'built' ELSE 'permitted' END"
_VERSIONS = f"""
a AS (SELECT o_orderkey, {_STATE} AS state, o_orderpriority AS raw, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice <= 400000),
b AS (SELECT o_orderkey, CASE WHEN dayofyear(o_orderdate) % 7 = 0 THEN 'withdrawn' WHEN dayofyear(o_orderdate) % 13 = 0 THEN 'contracted' ELSE {_STATE} END AS state,
      CASE WHEN dayofyear(o_orderdate) % 3 = 0 THEN upper(o_orderpriority) || ' ' WHEN dayofyear(o_orderdate) % 17 = 0 THEN 'other words' ELSE o_orderpriority END AS raw,
      CASE WHEN dayofyear(o_orderdate) % 19 = 0 THEN NULL WHEN dayofyear(o_orderdate) % 5 = 0 THEN o_totalprice * 1.02 WHEN dayofyear(o_orderdate) % 4 = 0 THEN o_totalprice * 1.005 ELSE o_totalprice END AS amount,
      CASE WHEN dayofyear(o_orderdate) % 23 = 0 THEN NULL WHEN dayofyear(o_orderdate) % 29 = 0 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END AS d
      FROM orders WHERE o_totalprice >= 20000)"""


def order_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the orders: the dearest missing from the first, the cheapest from the second, others altered by date."""
    orders = table(spark, d, "orders")
    k = F.dayofyear("o_orderdate")
    state = F.when(F.col("o_orderstatus") == "O", "filed").when(F.col("o_orderstatus") == "F", "built").otherwise("permitted")
    price, date, words = F.col("o_totalprice"), F.to_date("o_orderdate"), F.col("o_orderpriority")
    before = orders.where(price <= 400_000).select("o_orderkey", state.alias("state"), words.alias("raw"), price.alias("amount"), date.alias("d"))
    after = orders.where(price >= 20_000).select(
        "o_orderkey", F.when(k % 7 == 0, "withdrawn").when(k % 13 == 0, "contracted").otherwise(state).alias("state"),
        F.when(k % 3 == 0, F.concat(F.upper(words), F.lit(" "))).when(k % 17 == 0, "other words").otherwise(words).alias("raw"),
        F.when(k % 19 == 0, None).when(k % 5 == 0, price * 1.02).when(k % 4 == 0, price * 1.005).otherwise(price).alias("amount"),
        F.when(k % 23 == 0, None).when(k % 29 == 0, F.date_add(date, 1)).otherwise(date).alias("d"),
    )
    return before, after


@REG.add("snapshot_diff_orders", f"""
WITH {_VERSIONS},
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k, a.o_orderkey AS ka, b.o_orderkey AS kb, a.state AS sa, b.state AS sb, a.raw AS ra, b.raw AS rb, a.amount AS xa, b.amount AS xb, a.d AS da, b.d AS db
      FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey),
e AS (
 SELECT 'new' AS event_type, k, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after FROM j WHERE ka IS NULL UNION ALL SELECT 'removed', k, NULL, NULL, NULL FROM j WHERE kb IS NULL
 UNION ALL SELECT CASE WHEN sb = 'withdrawn' AND sa <> 'withdrawn' THEN 'withdrawn' ELSE 'status_change' END, k, 'state', sa, sb FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND sa <> sb
 UNION ALL SELECT 'status_raw_change', k, 'raw', ra, rb FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND sa = sb AND trim(lower(ra)) <> trim(lower(rb))
 UNION ALL SELECT 'capacity_change', k, 'amount', CAST(xa AS VARCHAR), CAST(xb AS VARCHAR) FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND ((xa IS NULL) <> (xb IS NULL) OR (abs(xa - xb) > 0.5 AND abs(xa - xb) > 0.01 * greatest(abs(xa), abs(xb))))
 UNION ALL SELECT 'date_change', k, 'd', strftime(da, '%Y-%m-%d'), strftime(db, '%Y-%m-%d') FROM j WHERE ka IS NOT NULL AND kb IS NOT NULL AND da IS DISTINCT FROM db)
SELECT event_type, k AS o_orderkey, field, before, after FROM e""")
def snapshot_diff_orders(spark: SparkSession, d: str) -> DataFrame:
    """Change events between two versions of the orders, each with its values before and after."""
    before, after = order_versions(spark, d)
    return op.diff_events(before, after, "o_orderkey", "state", "raw", "amount", "d")


@REG.add("event_crosstab_by_type", f"""
WITH {_VERSIONS},
j AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, a.state AS sa, b.state AS sb FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT CASE WHEN ka IS NULL THEN 'new' WHEN kb IS NULL THEN 'removed' WHEN sb = 'withdrawn' AND sa <> 'withdrawn' THEN 'withdrawn' ELSE 'status_change' END AS event_type, count(*) AS events FROM j WHERE ka IS NULL OR kb IS NULL OR sa <> sb GROUP BY 1""")
def event_crosstab_by_type(spark: SparkSession, d: str) -> DataFrame:
    """How many records came, went, were withdrawn or changed their state."""
    events = op.diff_events(*order_versions(spark, d), "o_orderkey", "state", "raw", "amount", "d")
    return events.where(F.col("event_type").isin("new", "removed", "withdrawn", "status_change")).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@REG.add("dq_churn", f"""
WITH {_VERSIONS},
j AS (SELECT b.o_orderkey IS NOT NULL AS kept, a.state <> b.state AS moved FROM a LEFT JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT count(*) AS previous, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS removed, count(*) FILTER (moved) AS moved,
       CASE WHEN count(*) < 50 THEN 'not judged' WHEN count(*) FILTER (kept) / count(*) < 0.9 OR (count(*) FILTER (NOT kept) + count(*) FILTER (moved)) / count(*) > 0.15 THEN 'hold' ELSE 'pass' END AS verdict FROM j""")
def dq_churn(spark: SparkSession, d: str) -> DataFrame:
    """Kept, removed and moved keys between two versions, and the verdict."""
    return op.churn(*order_versions(spark, d), "o_orderkey", "state")


@REG.add("dq_row_drift", """
WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, lag(n) OVER (ORDER BY day) AS p FROM c)
SELECT strftime(day, '%Y-%m-%d') AS day, n, p AS previous, CASE WHEN p > 0 AND abs(n - p) / p > 0.3 THEN 'hold' WHEN p > 0 AND abs(n - p) / p >= 0.1 THEN 'warn' ELSE 'pass' END AS verdict FROM p""")
def dq_row_drift(spark: SparkSession, d: str) -> DataFrame:
    """Rows a day against the day before. The window runs over one row a day."""
    from pyspark.sql import Window

    counts = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("previous", F.lag("n").over(Window.orderBy("day")))
    return counts.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "previous", op.drift(F.col("previous"), F.col("n")).alias("verdict"))


@REG.add("dq_null_spike", """
WITH u AS (UNPIVOT (SELECT CAST(o_orderdate AS DATE) AS day0, date_trunc('month', o_orderdate) AS m, CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END AS price, CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 ELSE 0.0 END AS priority FROM orders)
 ON price, priority INTO NAME "column" VALUE missing),
r AS (SELECT m, "column", avg(missing) AS r FROM u GROUP BY 1, 2),
b AS (SELECT *, median(r) OVER (PARTITION BY "column" ORDER BY m ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS base FROM r)
SELECT strftime(m, '%Y-%m') AS month, "column", round(r, 6) AS null_rate, round(base, 6) AS baseline, CASE WHEN r - base > 0.1 THEN 'hold' WHEN r - base > 0.05 THEN 'warn' ELSE 'pass' END AS verdict FROM b""")
def dq_null_spike(spark: SparkSession, d: str) -> DataFrame:
    """Null rates a month against the median of the five months before."""
    rows = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.when(F.col("o_totalprice") <= 150000, F.col("o_totalprice")).alias("price"), F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("priority"),
    )
    rates = op.against_trailing_median(op.null_rates(rows, ["price", "priority"], "month"), ["column"], "month", "null_rate")
    rise = F.col("null_rate") - F.col("baseline")
    verdict = F.when(rise > 0.1, "hold").when(rise > 0.05, "warn").otherwise("pass")
    return rates.select("month", "column", F.round("null_rate", 6).alias("null_rate"), F.round("baseline", 6).alias("baseline"), verdict.alias("verdict"))


@REG.add("dq_weekday_profile", """
WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
g AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT dayofweek(g.day) + 1 AS weekday, count(*) AS days, CAST(sum(coalesce(n, 0)) AS BIGINT) AS rows, median(coalesce(n, 0)) AS median_rows FROM g LEFT JOIN c ON g.day = c.day GROUP BY 1""")
def dq_weekday_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows by weekday with empty days counted as zero."""
    days = op.zero_filled_days(table(spark, d, "events").where("event_type = 'error'").withColumn("day", F.to_date("ts")), "day")
    return days.groupBy(F.dayofweek("day").cast("long").alias("weekday")).agg(F.count(F.lit(1)).alias("days"), F.sum("rows").alias("rows"), F.median("rows").alias("median_rows"))


@REG.add("dup_disambiguate", r"""
WITH h AS (SELECT user_id, event_type, event_id, substr(sha1(event_type || chr(31) || CAST(event_id AS VARCHAR)), 1, 10) AS h, count(*) OVER (PARTITION BY user_id) AS n FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id, h ORDER BY event_type, event_id) AS i FROM h)
SELECT event_id, CAST(user_id AS VARCHAR) || CASE WHEN n > 1 THEN '#' || h || CASE WHEN i > 1 THEN '.' || i ELSE '' END ELSE '' END AS unique_key FROM i""")
def dup_disambiguate(spark: SparkSession, d: str) -> DataFrame:
    """Repeated keys told apart by a hash of their content."""
    return op.disambiguated(table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", ["event_type", "event_id"]).select("event_id", "unique_key")


_STORED = "s AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2), i AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice + 1 ELSE l_extendedprice END) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)"


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem")
    stored = lines.where("l_returnflag <> 'A'").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("v"))
    value = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice"))
    return stored, lines.where("l_linestatus = 'O'").groupBy("l_orderkey", "l_linenumber").agg(F.max(value).alias("v"))


@REG.add("upsert_incremental", f"""
WITH {_STORED}, m AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.l_orderkey = s.l_orderkey AND i.l_linenumber = s.l_linenumber) UNION ALL SELECT * FROM i)
SELECT l_orderkey, l_linenumber, v FROM m""")
def upsert_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows merged over the stored ones."""
    return op.upsert(*_stored(spark, d), ["l_orderkey", "l_linenumber"], "v")[0].select("l_orderkey", "l_linenumber", "v")


@REG.add("correction_log", f"WITH {_STORED} SELECT i.l_orderkey, i.l_linenumber, s.v AS before, i.v AS after FROM i JOIN s USING (l_orderkey, l_linenumber) WHERE abs(s.v - i.v) > 1e-9")
def correction_log(spark: SparkSession, d: str) -> DataFrame:
    """Stored values that an upsert corrected."""
    return op.upsert(*_stored(spark, d), ["l_orderkey", "l_linenumber"], "v")[1]


@REG.add("match_transitions", """
WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01')
SELECT CASE WHEN a.l_partkey IS NULL THEN 'added' WHEN b.l_partkey IS NULL THEN 'removed' ELSE 'kept' END AS transition, coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""")
def match_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs added, removed or kept between two runs."""
    lines, at = table(spark, d, "lineitem"), F.col("l_shipdate")
    old, new = lines.where(at < F.lit("1998-01-01").cast("timestamp_ntz")), lines.where(at >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return op.transitions(old, new, ["l_partkey", "l_suppkey"])


@REG.add("retention_sample", """
WITH f AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END AS seen, o_orderstatus = 'F' AS promoted, o_orderpriority LIKE '1%' AND o_orderkey % 11 = 0 AS used FROM orders),
l AS (SELECT *, seen < TIMESTAMP '2001-01-01' AS old, row_number() OVER (PARTITION BY o_custkey ORDER BY seen DESC NULLS LAST, o_orderkey DESC) AS l FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', seen), old ORDER BY promoted DESC, seen DESC, o_orderkey DESC) AS m FROM l)
SELECT o_orderkey, CASE WHEN seen IS NULL THEN 'undated' WHEN NOT old THEN 'young' WHEN l = 1 THEN 'latest' WHEN used THEN 'in_use' WHEN m = 1 THEN 'sample' ELSE 'delete' END AS reason FROM r""")
def retention_sample(spark: SparkSession, d: str) -> DataFrame:
    """Why each stored file is kept or deleted."""
    at = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderdate"))
    orders = table(spark, d, "orders")
    files = orders.select("o_custkey", "o_orderkey", at.alias("at"), (F.col("o_orderstatus") == "F").alias("promoted"))
    used = orders.where(F.col("o_orderpriority").startswith("1") & (F.col("o_orderkey") % 11 == 0)).select("o_orderkey")
    return op.retained(files, "o_orderkey", "o_custkey", "at", "promoted", F.lit("2001-01-01").cast("timestamp_ntz"), used)
