"""Windows, winners, graphs and rollups over orders, lines and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import graph, ranking, rollup
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()


@REG.add("islands_sessions", """
WITH s AS (SELECT user_id, event_id, ts, value, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000, true) THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, round(sum(value), 4) AS total FROM t GROUP BY 1, 2""")
def islands_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user with more than six hours between them."""
    events = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return ranking.sessions(events, ["user_id"], "ts", 21_600, "event_id").groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))


@REG.add("islands_bands", """
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'), i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM l)
SELECT l_orderkey, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line, count(*) AS lines FROM i GROUP BY l_orderkey, g""")
def islands_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands of consecutive line numbers that pass a filter."""
    lines = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber").distinct()
    bands = ranking.islands(lines, ["l_orderkey"], "l_linenumber").groupBy("l_orderkey", "island")
    return bands.agg(F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"), F.count(F.lit(1)).alias("lines")).drop("island")


@REG.add("topk_per_group", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's three largest orders."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.top_per_group(orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").desc()], 3).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@REG.add("global_topn_additions", """
WITH y AS (SELECT s_nationkey AS n, year(l_shipdate) AS y, sum(l_quantity) AS q, count(*) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
a AS (SELECT b.n, b.q - a.q AS added FROM y a JOIN y b ON a.n = b.n AND b.y = a.y + 1 AND b.y = 1999 WHERE b.c >= 0.5 * a.c)
SELECT n_name, round(added, 2) AS added FROM a JOIN nation ON n = n_nationkey ORDER BY added DESC, n_name LIMIT 10""")
def global_topn_additions(spark: SparkSession, d: str) -> DataFrame:
    """The ten nations with the largest additions over the year before, incomplete years left out."""
    per = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("n"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("c"))
    before = per.where("y = 1998").select("n", F.col("q").alias("q0"), F.col("c").alias("c0"))
    added = per.where("y = 1999").join(before, "n").where("c >= 0.5 * c0").select("n", (F.col("q") - F.col("q0")).alias("added"))
    named = added.join(table(spark, d, "nation"), F.col("n") == F.col("n_nationkey"))
    return named.orderBy(F.col("added").desc(), "n_name").limit(10).select("n_name", F.round("added", 2).alias("added"))


@REG.add("field_survivorship", """
SELECT o_custkey, arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderpriority, arg_max(o_totalprice, struct_pack(a := o_totalprice, b := o_orderkey)) AS o_totalprice,
       arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) FILTER (o_orderstatus <> 'P') AS o_orderstatus FROM orders GROUP BY 1""")
def field_survivorship(spark: SparkSession, d: str) -> DataFrame:
    """Per customer the surviving value of each field by its own rule."""
    newest = F.struct("o_orderdate", "o_orderkey")
    rules = {"o_orderpriority": newest, "o_totalprice": F.struct("o_totalprice", "o_orderkey"), "o_orderstatus": newest}
    return ranking.winners(table(spark, d, "orders"), ["o_custkey"], rules, {"o_orderstatus": F.col("o_orderstatus") != "P"})


@REG.add("lifecycle_precedence", """
WITH p AS (SELECT o_custkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE -1 END AS p, o_orderpriority = '1-URGENT' AS gone, o_orderstatus = 'O' AS live FROM orders),
g AS (SELECT o_custkey, max(p) AS far, max(p) FILTER (live) AS l, bool_or(gone) AS gone FROM p GROUP BY 1)
SELECT o_custkey, CASE WHEN gone AND coalesce(l, -1) < 1 THEN '1-URGENT' WHEN far >= 0 THEN ['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH'][far + 1] END AS state FROM g""")
def lifecycle_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The furthest state of a ladder unless a withdrawal stands."""
    ladder = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH")
    return ranking.most_advanced(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", ladder, "1-URGENT", F.col("o_orderstatus") == "O")


@REG.add("mode_with_tie", "SELECT l_suppkey, l_linenumber, n FROM (SELECT l_suppkey, l_linenumber, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def mode_with_tie(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's most frequent line number, ties to the least."""
    return ranking.mode_with_tie(table(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber")


@REG.add("capacity_sum_vs_max", """
WITH g AS (SELECT l_partkey, sum(l_quantity) FILTER (l_linestatus = 'O' AND l_returnflag <> 'A') AS live, sum(l_quantity) FILTER (l_returnflag = 'A' AND l_linenumber > 2) AS op, sum(l_quantity) FILTER (l_returnflag = 'A') AS al,
 sum(l_quantity) FILTER (l_linestatus <> 'O' AND l_returnflag <> 'A') AS rest, max(l_quantity) AS mx FROM lineitem GROUP BY 1)
SELECT l_partkey, coalesce(live + coalesce(op, 0), al, rest, mx) AS l_quantity FROM g""")
def capacity_sum_vs_max(spark: SparkSession, d: str) -> DataFrame:
    """Live amounts plus uncovered stock, else stock, else the rest, else the largest."""
    live, stock = F.col("l_linestatus") == "O", F.col("l_returnflag") == "A"
    return ranking.capacity_of(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity", live, stock, F.col("l_linenumber") <= 2)


@REG.add("stratified_sample", "SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('s' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 20")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty orders of each status, the same each time."""
    return ranking.keyed_sample(table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", 20, "s").select("o_orderstatus", "o_orderkey")


_TREE = "e AS (SELECT 'r' || r_regionkey AS p, 'n' || n_nationkey AS c FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), t AS (SELECT p AS ancestor, c AS node, 1 AS level FROM e UNION ALL SELECT t.ancestor, e.c, level + 1 FROM t JOIN e ON t.node = e.p WHERE level < 4)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    top = table(spark, d, "nation").select(name("r", "n_regionkey").alias("p"), name("n", "n_nationkey").alias("c"))
    return top.unionByName(table(spark, d, "customer").select(name("n", "c_nationkey").alias("p"), name("c", "c_custkey").alias("c")))


@REG.add("tree_closure", f"WITH RECURSIVE {_TREE} SELECT ancestor, level, count(*) AS nodes FROM t GROUP BY 1, 2")
def tree_closure(spark: SparkSession, d: str) -> DataFrame:
    """Nodes below each node by level, four levels deep at most."""
    return graph.closure(_tree(spark, d), "p", "c", 4).groupBy("ancestor", "level").agg(F.count(F.lit(1)).alias("nodes"))


@REG.add("org_rollup", f"""WITH RECURSIVE {_TREE}, f AS (SELECT 'c' || o_custkey AS node, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 3))) AS v FROM orders GROUP BY 1)
SELECT ancestor, CAST(sum(n) AS BIGINT) AS orders, CAST(sum(v) AS DOUBLE) AS total FROM t JOIN f USING (node) GROUP BY 1""")
def org_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Orders and their exact total of everything below a node."""
    facts = table(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("owner")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,3)")).alias("v"))
    return rollup.rolled_up(facts, graph.closure(_tree(spark, d), "p", "c", 4), "owner", [F.sum("n").alias("orders"), F.sum("v").cast("double").alias("total")])


@REG.add("owned_share", """
WITH s AS (SELECT l_partkey, l_returnflag, sum(l_quantity / 1000) AS s FROM lineitem GROUP BY 1, 2) SELECT l_partkey, round(least(max(s), 1.0), 6) AS share FROM s GROUP BY 1""")
def owned_share(spark: SparkSession, d: str) -> DataFrame:
    """Largest register's sum of shares, at most one."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", (F.col("l_quantity") / 1000).alias("share"))
    return rollup.owned_share(lines, "l_partkey", "l_returnflag", "share").withColumn("share", F.round("share", 6))


@REG.add("exact_decimal_tally", """
WITH v AS (SELECT l_returnflag, l_linestatus, CAST(CASE WHEN l_quantity > 2 THEN l_extendedprice END AS DECIMAL(18, 3)) AS x FROM lineitem)
SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS INTEGER) AS g, count(*) AS records, count(x) AS stated, CAST(sum(x) AS DOUBLE) AS total FROM v GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))""")
def exact_decimal_tally(spark: SparkSession, d: str) -> DataFrame:
    """Totals by two dimensions with exact sums, null where nothing is stated."""
    lines = table(spark, d, "lineitem").withColumn("x", F.when(F.col("l_quantity") > 2, F.col("l_extendedprice")))
    return rollup.tallies(lines, ["l_returnflag", "l_linestatus"], "x").withColumn("total", F.col("total").cast("double"))


@REG.add("crosswalk_unpivot", """
WITH w AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p FROM orders GROUP BY 1)
SELECT o_custkey, status, price FROM (UNPIVOT w ON o, f, p INTO NAME status VALUE price)""")
def crosswalk_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """A wide table as rows without the missing cells."""
    best = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))).alias(s.lower())
    wide = table(spark, d, "orders").groupBy("o_custkey").agg(best("O"), best("F"), best("P"))
    return rollup.long_form(wide, ["o_custkey"], ["o", "f", "p"], "status", "price")


@REG.add("event_crosstab", "SELECT event_type, count(*) FILTER (dayofweek(ts) IN (0, 6)) AS weekend, count(*) FILTER (dayofweek(ts) NOT IN (0, 6)) AS weekday FROM events GROUP BY 1")
def event_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type and kind of day."""
    events = table(spark, d, "events").select("event_type", F.when(F.dayofweek("ts").isin(1, 7), "weekend").otherwise("weekday").alias("kind"))
    return rollup.crosstab(events, "event_type", "kind", ["weekend", "weekday"])


@REG.add("weighted_share", "SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS share FROM lineitem GROUP BY 1")
def weighted_share(spark: SparkSession, d: str) -> DataFrame:
    """Quantity-weighted discount of each supplier."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(rollup.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("share"))
