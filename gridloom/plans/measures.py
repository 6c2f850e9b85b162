"""Counts, sums and shares: blocks of measures over the orders, the events and the register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import measures as ms
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()

_TS = lambda t: F.lit(t).cast("timestamp_ntz")


@REG.add("activity_metrics", """
WITH w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11')
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS subjects, count(*) FILTER (value IS NULL OR value < 10) AS left_out FROM w GROUP BY 1""")
def activity_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Events, subjects and those left out by type in the last complete day."""
    day = ms.complete_day(table(spark, d, "events"), "ts", _TS("2024-01-11 07:30:00"))
    return day.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("subjects"), F.count_if(F.coalesce(F.col("value") < 10, F.lit(True))).alias("left_out"))


@REG.add("contributing_sources", """
SELECT l_suppkey, count(*) AS links, count(DISTINCT l_orderkey) AS records, strftime(max(l_shipdate), '%Y-%m-%d') AS latest FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderstatus = 'O') GROUP BY 1""")
def contributing_sources(spark: SparkSession, d: str) -> DataFrame:
    """Links, distinct records and the latest retrieval of each source of the open records."""
    open_ = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    links = table(spark, d, "lineitem").join(open_, "l_orderkey", "left_semi")
    return links.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("l_orderkey").alias("records"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("latest"))


@REG.add("daily_snapshot", """
SELECT CASE grouping_id(o_orderstatus, o_orderpriority) WHEN 3 THEN 'total' WHEN 1 THEN 'status' WHEN 2 THEN 'priority' ELSE 'status priority' END AS block, o_orderstatus, o_orderpriority, count(*) AS records, sum(CAST(o_totalprice AS DECIMAL(18, 3))) AS total
FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))""")
def daily_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """All blocks of a day's figures from one pass: total, by each dimension and by both."""
    return ms.blocks(table(spark, d, "orders"), {"status": "o_orderstatus", "priority": "o_orderpriority"}, [("status", "priority")], "o_totalprice").withColumnsRenamed({"status": "o_orderstatus", "priority": "o_orderpriority"})


@REG.add("capacity_summary", """
SELECT c_mktsegment, count(*) AS records, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total, rank() OVER (ORDER BY sum(CAST(o_totalprice AS DECIMAL(18, 2))) DESC NULLS LAST, count(*) DESC, c_mktsegment) AS place FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def capacity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Segments ranked by sum, count and name, unstated last."""
    both = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return ms.ranked(both, "c_mktsegment", F.col("o_totalprice").cast("decimal(18,2)"))


@REG.add("pulse_counts", """
WITH w AS (SELECT event_type, n_name FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey WHERE ts > TIMESTAMP '2024-01-23 12:00:00' AND ts <= TIMESTAMP '2024-01-30 12:00:00')
SELECT event_type, n_name, count(*) AS events FROM w GROUP BY GROUPING SETS ((event_type), (n_name))""")
def pulse_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last seven days by type and by country."""
    window = ms.recent(table(spark, d, "events"), "ts", _TS("2024-01-30 12:00:00"), 7)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey"))
    placed = window.join(customers, "user_id").join(table(spark, d, "nation"), "n_nationkey")
    return placed.groupingSets([["event_type"], ["n_name"]], "event_type", "n_name").agg(F.count(F.lit(1)).alias("events"))


@REG.add("distinct_per_source", """
SELECT l_suppkey, l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS records, strftime(max(l_shipdate), '%Y-%m-%d') AS latest, coalesce(max(CASE WHEN l_tax = 0 THEN l_linenumber END), -1) AS free FROM lineitem GROUP BY 1, 2, 3""")
def distinct_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Distinct records of each source and licence."""
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(
        F.count_distinct("l_orderkey").alias("records"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("latest"), F.coalesce(F.max(F.when(F.col("l_tax") == 0, F.col("l_linenumber"))), F.lit(-1)).alias("free")
    )


@REG.add("planned_against_built", """
WITH a AS (SELECT o_orderpriority AS k, count(*) AS planned, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS planned_total FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) AS built, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS built_total FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS dimension, coalesce(planned, 0) AS planned, coalesce(built, 0) AS built, CASE WHEN coalesce(built, 0) > 0 THEN coalesce(planned, 0) / built END AS ratio FROM a FULL JOIN b ON a.k = b.k""")
def planned_against_built(spark: SparkSession, d: str) -> DataFrame:
    """Two sides by one dimension: a key on one side only is a true zero on the other."""
    orders = table(spark, d, "orders")
    return ms.two_sides(orders.where("o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'"), orders.where("o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'"), "o_orderpriority", "planned", "built").withColumnRenamed("o_orderpriority", "dimension")


@REG.add("located_counts", """
SELECT status AS case_status, structure_type, count(*) AS cases, count(*) FILTER (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 360 AND NOT (latitude = 0 AND longitude = 0)) AS located FROM faa_cases GROUP BY 1, 2""")
def located_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cases and located cases by status and type."""
    from gridloom.operators.spatial import usable_position

    return table(spark, d, "faa_cases").groupBy(F.col("status").alias("case_status"), "structure_type").agg(F.count(F.lit(1)).alias("cases"), F.count_if(usable_position(F.col("latitude"), F.col("longitude"))).alias("located"))


@REG.add("source_freshness", "SELECT source_id, strftime(max(retrieved_at), '%Y-%m-%d %H:%M:%S') AS last_run, datediff('day', CAST(max(retrieved_at) AS DATE), DATE '2026-12-31') AS days FROM proposal_updates WHERE source_id IS NOT NULL GROUP BY 1")
def source_freshness(spark: SparkSession, d: str) -> DataFrame:
    """The last successful retrieval of each source and its age."""
    last = table(spark, d, "proposal_updates").where("source_id is not null").groupBy("source_id").agg(F.max("retrieved_at").alias("at"))
    return last.select("source_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("last_run"), F.date_diff(F.lit("2026-12-31").cast("date"), F.col("at").cast("date")).cast("long").alias("days"))


@REG.add("plant_rollup", """
WITH u AS (SELECT l_partkey AS plant, l_returnflag AS tech, CAST(l_quantity AS DECIMAL(18, 3)) AS mw, l_shipdate AS d, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS step FROM lineitem)
SELECT plant, tech, count(*) AS units, sum(mw) AS mw, strftime(max(d), '%Y-%m-%d') AS last, CASE max(step) WHEN 2 THEN 'built' ELSE 'filed' END AS state FROM u GROUP BY 1, 2 HAVING count(*) >= 2""")
def plant_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Units of a plant and technology as one row where there are two and more: sum, last date, most advanced state."""
    units = table(spark, d, "lineitem").select(F.col("l_partkey").alias("plant"), F.col("l_returnflag").alias("tech"), F.col("l_quantity").cast("decimal(18,3)").alias("mw"), "l_shipdate", F.when(F.col("l_linestatus") == "O", "filed").otherwise("built").alias("state"))
    step = F.when(F.col("state") == "built", 2).otherwise(1)
    g = units.groupBy("plant", "tech").agg(F.count(F.lit(1)).alias("units"), F.sum("mw").alias("mw"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last"), F.max_by("state", step).alias("state"))
    return g.where("units >= 2")


@REG.add("plant_extents", """
WITH t AS (SELECT l_partkey AS plant, l_returnflag AS tech, sum(CAST(l_quantity AS DECIMAL(18, 3))) AS mw FROM lineitem GROUP BY 1, 2) SELECT plant, tech, mw, sum(mw) OVER (PARTITION BY plant) AS plant_mw, max(mw) OVER (PARTITION BY plant) AS largest FROM t""")
def plant_extents(spark: SparkSession, d: str) -> DataFrame:
    """Each technology of a plant beside the plant's sum and its largest technology."""
    per = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("plant"), F.col("l_returnflag").alias("tech")).agg(F.sum(F.col("l_quantity").cast("decimal(18,3)")).alias("mw"))
    whole = per.groupBy("plant").agg(F.sum("mw").alias("plant_mw"), F.max("mw").alias("largest"))
    return per.join(whole, "plant").select("plant", "tech", "mw", "plant_mw", "largest")


@REG.add("plants_operating", """
WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, arg_max(l_returnflag, (n, -ascii(l_returnflag))) AS main FROM c GROUP BY 1)
SELECT l.l_partkey AS plant, sum(CAST(l_quantity AS DECIMAL(18, 3))) AS mw, count(*) AS units, min(l_suppkey) AS owner, max(m.main) AS main, bool_and(l_linestatus = 'F') AS retired, CASE WHEN bool_and(l_linestatus = 'F') THEN max(year(l_shipdate)) END AS retired_in
FROM lineitem l JOIN m ON m.l_partkey = l.l_partkey GROUP BY 1""")
def plants_operating(spark: SparkSession, d: str) -> DataFrame:
    """Units as plants: sums, most common technology, and whether and when all units had retired."""
    from gridloom.operators.ranking import mode_with_tie

    lines = table(spark, d, "lineitem")
    g = lines.groupBy(F.col("l_partkey").alias("plant")).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,3)")).alias("mw"), F.count(F.lit(1)).alias("units"), F.min("l_suppkey").alias("owner"), F.bool_and(F.col("l_linestatus") == "F").alias("retired"), F.max(F.year("l_shipdate")).alias("y")
    )
    main = mode_with_tie(lines, ["l_partkey"], "l_returnflag").select(F.col("l_partkey").alias("plant"), F.col("l_returnflag").alias("main"))
    return g.join(main, "plant").select("plant", "mw", "units", "owner", "main", "retired", F.when(F.col("retired"), F.col("y").cast("long")).alias("retired_in"))


@REG.add("capacity_factors", """
WITH p AS (SELECT l_partkey, sum(l_quantity) * 100 AS net, max(l_quantity) AS cap FROM lineitem GROUP BY 1) SELECT l_partkey, CASE WHEN cap > 0 THEN net / (cap * 8784) END AS factor, CASE WHEN cap > 0 AND net / (cap * 8784) > 0.15 THEN 'high' WHEN cap > 0 AND net / (cap * 8784) < 0.02 THEN 'low' ELSE 'usual' END AS flag FROM p""")
def capacity_factors(spark: SparkSession, d: str) -> DataFrame:
    """Generation over capacity times the hours of its year, with flags."""
    p = table(spark, d, "lineitem").groupBy("l_partkey").agg((F.sum("l_quantity") * 100).alias("net"), F.max("l_quantity").alias("cap"))
    factor = ms.capacity_factor(F.col("net"), F.col("cap"), F.lit(2024))
    return p.select("l_partkey", factor.alias("factor"), F.when(factor > 0.15, "high").when(factor < 0.02, "low").otherwise("usual").alias("flag"))


@REG.add("pivoted_shares", """
SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') / count(*) AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') / count(*) AS machinery, count(*) AS units FROM customer GROUP BY 1""")
def pivoted_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of two segments by nation, one column each."""
    return ms.shares(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", {"BUILDING": "building", "MACHINERY": "machinery"}, "units")


@REG.add("top_and_bottom", """
WITH s AS (SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') / count(*) AS building FROM customer GROUP BY 1)
(SELECT 'top' AS side, c_nationkey, building FROM s ORDER BY building DESC, c_nationkey LIMIT 5) UNION ALL (SELECT 'bottom', c_nationkey, building FROM s ORDER BY building, c_nationkey LIMIT 5)""")
def top_and_bottom(spark: SparkSession, d: str) -> DataFrame:
    """The five nations with the largest and the smallest share: the feature is a top-k report."""
    shares = ms.shares(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", {"BUILDING": "building"}, "units").select("c_nationkey", "building")
    side = lambda name, order: shares.orderBy(order, "c_nationkey").limit(5).select(F.lit(name).alias("side"), "c_nationkey", "building")
    return side("top", F.desc("building")).unionByName(side("bottom", F.asc("building")))


@REG.add("interval_checks", """
SELECT source_id, count(*) AS rows, count(*) - count(DISTINCT record_id) AS repeated, count(*) FILTER (price IS NULL) / count(*) AS missing, count(*) FILTER (price < -500 OR price > 5000) AS out_of_range,
       CASE WHEN count(*) FILTER (price IS NULL) / count(*) > 0.1 OR count(*) FILTER (price < -500 OR price > 5000) > 5 THEN 'hold' WHEN count(*) > count(DISTINCT record_id) THEN 'warn' ELSE 'pass' END AS verdict FROM price_intervals GROUP BY 1""")
def interval_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows, repeats, missing and impossible values of each source, and the verdict."""
    return ms.checked(table(spark, d, "price_intervals"), "source_id", "record_id", "price", -500.0, 5000.0)


@REG.add("match_metrics", """
WITH p AS (SELECT l_partkey % 100 AS score, l_returnflag = 'R' AS same, CASE WHEN l_linenumber > 4 THEN 'far' ELSE 'near' END AS band FROM lineitem)
SELECT band, count(*) FILTER (score >= 50 AND same) AS tp, count(*) FILTER (score >= 50 AND NOT same) AS fp, count(*) FILTER (score < 50 AND same) AS fn, count(*) FILTER (score >= 50 AND same) / count(*) FILTER (score >= 50) AS "precision", count(*) FILTER (score >= 50 AND same) / count(*) FILTER (same) AS recall FROM p GROUP BY 1""")
def match_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall at a threshold by band."""
    lines = table(spark, d, "lineitem").select((F.col("l_partkey") % 100).alias("score"), (F.col("l_returnflag") == "R").alias("same"), F.when(F.col("l_linenumber") > 4, "far").otherwise("near").alias("band"))
    return ms.precision_recall(lines, ["band"], F.col("score") >= 50, F.col("same"))


@REG.add("wilson_bounds", """
WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS s FROM events GROUP BY 1), p AS (SELECT *, s / n AS p, 1.96 AS z FROM g)
SELECT user_id, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 9) AS lo, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 9) AS hi FROM p""")
def wilson_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of each user's share of clicks."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("s"))
    lo, hi = ms.score_interval(F.col("s"), F.col("n"))
    return g.select("user_id", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@REG.add("linked_share", """
SELECT o_orderstatus, count(*) AS records, avg(CASE WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R') THEN 1.0 ELSE 0.0 END) AS share FROM orders o GROUP BY 1""")
def linked_share(spark: SparkSession, d: str) -> DataFrame:
    """The share of records that have a link, by state."""
    linked = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_l", F.lit(1.0))
    return table(spark, d, "orders").join(linked, "o_orderkey", "left").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("records"), F.avg(F.coalesce("_l", F.lit(0.0))).alias("share"))


@REG.add("clean_shares", """
WITH y AS (SELECT year(l_shipdate) AS year, CAST(sum(l_quantity) FILTER (l_returnflag IN ('A', 'N')) AS DOUBLE) AS c, sum(l_quantity) AS t FROM lineitem GROUP BY 1)
SELECT year, coalesce(c, 0) / t * 100 AS share, coalesce(c, 0) / t * 100 - lag(coalesce(c, 0) / t * 100) OVER (ORDER BY year) AS change FROM y""")
def clean_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of some sources in a year's total, and its change on the year before. The window runs over one row a year."""
    y = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year")).agg(ms.part_share(F.col("l_quantity"), F.col("l_returnflag").isin("A", "N")).alias("share"))
    return y.withColumn("change", F.col("share") - F.lag("share").over(Window.orderBy("year")))


@REG.add("latest_against_year_before", """
WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, l_returnflag AS s, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), t AS (SELECT s, max(m) AS m FROM m GROUP BY 1)
SELECT t.s AS source, strftime(t.m, '%Y-%m') AS month, a.v AS value, b.v AS year_before, (a.v - b.v) / b.v AS change FROM t JOIN m a ON a.s = t.s AND a.m = t.m LEFT JOIN m b ON b.s = t.s AND b.m = t.m - INTERVAL 12 MONTH""")
def latest_against_year_before(spark: SparkSession, d: str) -> DataFrame:
    """Each source's latest month against the same month of the year before."""
    months = table(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("m"), F.col("l_returnflag").alias("source")).agg(F.sum("l_quantity").alias("value"))
    return ms.latest_and_before(months, "source", "m", "value", 12).select("source", F.date_format("m", "yyyy-MM").alias("month"), "value", F.col("before").alias("year_before"), ((F.col("value") - F.col("before")) / F.col("before")).alias("change"))


@REG.add("bucketed_totals", """
SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'O') AS open_records, sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (o_orderstatus = 'O') AS open_total, count(*) FILTER (o_orderstatus = 'F') AS built_records, sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (o_orderstatus = 'F') AS built_total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def bucketed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Members and sums by bucket, one column each, in one pass."""
    both = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return ms.bucketed(both, ["c_nationkey"], {"open": F.col("o_orderstatus") == "O", "built": F.col("o_orderstatus") == "F"}, F.col("o_totalprice").cast("decimal(18,2)"))


@REG.add("cell_split", """
SELECT CAST(floor(longitude / 5) AS BIGINT) AS x, CAST(floor(latitude / 5) AS BIGINT) AS y, structure_type, count(*) AS cases, sum(CAST(agl_height AS DECIMAL(18, 3))) AS height FROM faa_cases WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 360 AND NOT (latitude = 0 AND longitude = 0) GROUP BY 1, 2, 3""")
def cell_split(spark: SparkSession, d: str) -> DataFrame:
    """Cases and heights of each grid cell by type."""
    from gridloom.operators.spatial import usable_position

    cases = table(spark, d, "faa_cases").where(usable_position(F.col("latitude"), F.col("longitude")))
    return cases.groupBy(F.floor(F.col("longitude") / 5).alias("x"), F.floor(F.col("latitude") / 5).alias("y"), "structure_type").agg(F.count(F.lit(1)).alias("cases"), F.sum(F.col("agl_height").cast("decimal(18,3)")).alias("height"))


@REG.add("trailing_counts", """
WITH y AS (SELECT l_suppkey, max(year(l_shipdate)) AS y FROM lineitem GROUP BY 1) SELECT l.l_suppkey, y.y AS year, count(*) FILTER (year(l_shipdate) BETWEEN y.y - 2 AND y.y) AS recent, count(*) AS rows FROM lineitem l JOIN y ON y.l_suppkey = l.l_suppkey GROUP BY 1, 2""")
def trailing_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each source in the three years up to its latest: counts by year first, so few rows meet the maximum."""
    years = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("_y")).agg(F.count(F.lit(1)).alias("n"))
    last = years.groupBy("l_suppkey").agg(F.max("_y").alias("year"))
    return years.join(last, "l_suppkey").groupBy("l_suppkey", "year").agg(F.coalesce(F.sum(F.when(F.col("_y") >= F.col("year") - 2, F.col("n"))), F.lit(0)).alias("recent"), F.sum("n").alias("rows"))


@REG.add("month_checks", """
WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, o_orderstatus AS basis, count(*) AS n, avg(CASE WHEN o_totalprice < 50000 THEN 1.0 ELSE 0.0 END) AS missing FROM orders GROUP BY 1, 2)
SELECT strftime(a.m, '%Y-%m') AS month, a.basis, a.n, b.n AS previous, CASE WHEN b.n IS NULL THEN 'no previous' WHEN abs(a.n - b.n) / b.n > 0.3 OR a.missing - b.missing > 0.1 THEN 'hold' WHEN abs(a.n - b.n) / b.n >= 0.1 OR a.missing - b.missing > 0.05 THEN 'warn' ELSE 'pass' END AS verdict FROM m a LEFT JOIN m b ON b.basis = a.basis AND b.m = a.m - INTERVAL 1 MONTH""")
def month_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each month's rows and missing values against the month before on the same basis."""
    orders = table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("m"), F.col("o_orderstatus").alias("basis"), (F.col("o_totalprice") < 50000).cast("double").alias("missing"))
    return ms.month_verdicts(orders.groupBy("m", "basis").agg(F.count(F.lit(1)).alias("n"), F.avg("missing").alias("missing")), "m", "basis")


@REG.add("length_weighted_bands", """
WITH s AS (SELECT l_orderkey AS line, l_linenumber AS i, l_quantity AS len, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_discount END AS share FROM lineitem), k AS (SELECT line, i, max(len) AS len, max(share) AS share FROM s GROUP BY 1, 2),
b AS (SELECT *, i - row_number() OVER (PARTITION BY line ORDER BY i) AS g FROM k)
SELECT line, min(i) AS first, max(i) AS last, sum(len) AS len, sum(len * coalesce(share, 0)) / sum(len) AS share, sum(CASE WHEN share IS NULL THEN len ELSE 0 END) AS unstated FROM b GROUP BY line, g""")
def length_weighted_bands(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive segments as bands with their length-weighted share, a missing share counting as 0, and the length without one."""
    from gridloom.operators.ranking import islands

    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("i")).agg(F.max("l_quantity").alias("len"), F.max(F.when(F.col("l_returnflag") != "A", F.col("l_discount"))).alias("share"))
    g = islands(s, ["line"], "i").groupBy("line", "island")
    return g.agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.sum("len").alias("len"), (F.sum(F.col("len") * F.coalesce("share", F.lit(0.0))) / F.sum("len")).alias("share"), F.sum(F.when(F.col("share").isNull(), F.col("len")).otherwise(0.0)).alias("unstated")
    ).drop("island")


@REG.add("asset_upsert", """
WITH a AS (SELECT p_partkey AS k, p_name AS name, CASE WHEN p_size > 10 THEN p_size END AS size FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE upper(p_name) END AS name, CASE WHEN p_size > 25 THEN p_size END AS size FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name, coalesce(b.size, a.size) AS size, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'kept' WHEN b.name IS NOT NULL AND b.name IS DISTINCT FROM a.name OR b.size IS NOT NULL AND b.size IS DISTINCT FROM a.size THEN 'updated' ELSE 'same' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def asset_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Stored assets with what a new delivery states about them."""
    from gridloom.operators.change_data import merged_assets

    k, parts = F.col("p_partkey"), table(spark, d, "part")
    a = parts.where(k % 3 != 0).select(k.alias("k"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"))
    b = parts.where(k % 5 != 0).select(k.alias("k"), F.when(k % 4 != 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("name"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    return merged_assets(a, b, ["k"], ["name", "size"])


@REG.add("snapshot_stats", """
SELECT strftime(snapshot_date, '%Y-%m-%d') AS day, count(*) AS rows, avg(CASE WHEN stage IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS stage_missing, avg(CASE WHEN mw_connected IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS mw_connected_missing, string_agg(DISTINCT plant_type, '|' ORDER BY plant_type) AS words FROM neso_tec_register GROUP BY 1""")
def snapshot_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows, missing values and vocabulary of each snapshot."""
    from gridloom.operators.change_data import snapshot_stats as stats

    rows = table(spark, d, "neso_tec_register").withColumn("day", F.date_format("snapshot_date", "yyyy-MM-dd"))
    return stats(rows, "day", ["stage", "mw_connected"], "plant_type")


@REG.add("vocabulary_drift", """
WITH a AS (SELECT DISTINCT user_id AS v FROM events WHERE ts < TIMESTAMP '2024-01-02'), b AS (SELECT DISTINCT user_id AS v FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND user_id % 2 = 0)
SELECT coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NULL THEN 'new' ELSE 'gone' END AS drift FROM a FULL JOIN b ON a.v = b.v WHERE a.v IS NULL OR b.v IS NULL""")
def vocabulary_drift(spark: SparkSession, d: str) -> DataFrame:
    """Values that came or went between two parts of the events."""
    from gridloom.operators.change_data import vocabulary_drift as drift

    events = table(spark, d, "events")
    return drift(events.where(F.col("ts") < _TS("2024-01-02")), events.where(F.col("ts") >= _TS("2024-01-29")).where("user_id % 2 = 0"), "user_id")


@REG.add("facets_with_unavailable", """
SELECT l_returnflag, l_linestatus, count(*) AS bands, sum(CAST(l_quantity AS DECIMAL(18, 2))) AS miles, coalesce(sum(CAST(l_quantity AS DECIMAL(18, 2))) FILTER (l_tax = 0), 0) AS unavailable FROM lineitem WHERE l_quantity >= 5 GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def facets_with_unavailable(spark: SparkSession, d: str) -> DataFrame:
    """Bands and miles of each facet, and the miles that lack data, from one pass."""
    miles = F.col("l_quantity").cast("decimal(18,2)")
    g = table(spark, d, "lineitem").where("l_quantity >= 5").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus")
    return g.agg(F.count(F.lit(1)).alias("bands"), F.sum(miles).alias("miles"), F.coalesce(F.sum(F.when(F.col("l_tax") == 0, miles)), F.lit(0).cast("decimal(18,2)")).alias("unavailable"))


@REG.add("daily_lines", """
WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE user_id % 40 = 1 GROUP BY 1, 2), s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT k.event_type, strftime(s.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM c) k CROSS JOIN s LEFT JOIN c ON c.event_type = k.event_type AND c.day = s.day""")
def daily_lines(spark: SparkSession, d: str) -> DataFrame:
    """A daily line for each type; days it is absent are zero."""
    from gridloom.operators.series import zero_filled

    counts = table(spark, d, "events").where("user_id % 40 = 1").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(counts, "event_type", "day", "n", "1 day").select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@REG.add("kept_lines", """
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_quantity < 3 THEN 'short' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'planned' WHEN l_discount > 0.08 THEN 'minor' ELSE 'kept' END AS reason FROM lineitem""")
def kept_lines(spark: SparkSession, d: str) -> DataFrame:
    """Whether each line is kept, and the first reason if it is not."""
    from gridloom.operators.linking import first_veto

    vetoes = [("short", F.col("l_quantity") < 3), ("planned", (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")), ("minor", F.col("l_discount") > 0.08)]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.coalesce(first_veto(vetoes), F.lit("kept")).alias("reason"))
