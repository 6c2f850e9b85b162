"""Gates and bounds: orders as records, their lines as links, suppliers as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators import gates
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()

_STAMP = lambda t: F.lit(t).cast("timestamp_ntz")
_PERMITTED = "p AS (SELECT l.* FROM lineitem l WHERE l_shipdate < TIMESTAMP '2000-01-01' AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s_acctbal >= 0))"
_RECORDS = f"{_PERMITTED}, v AS (SELECT * FROM orders o WHERE o_orderstatus IN ('O', 'F') AND o_orderdate < TIMESTAMP '1999-06-01' AND EXISTS (SELECT 1 FROM p WHERE p.l_orderkey = o.o_orderkey))"


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Lines shipped before 2000 whose supplier is not in debt."""
    suppliers = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return gates.permitted_links(table(spark, d, "lineitem"), suppliers, "l_suppkey", F.col("l_shipdate") < _STAMP("2000-01-01"), F.col("s_acctbal") >= 0)


def _records(spark: SparkSession, d: str) -> DataFrame:
    served = F.col("o_orderstatus").isin("O", "F") & (F.col("o_orderdate") < _STAMP("1999-06-01"))
    return gates.visible_records(table(spark, d, "orders"), _links(spark, d).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", served)


@REG.add("visible_links", f"WITH {_PERMITTED} SELECT l_orderkey, l_linenumber, l_suppkey FROM p")
def visible_links(spark: SparkSession, d: str) -> DataFrame:
    """Active links to permitted sources."""
    return _links(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey")


@REG.add("visible_records", f"WITH {_RECORDS} SELECT o_orderkey, o_orderstatus FROM v")
def visible_records(spark: SparkSession, d: str) -> DataFrame:
    """Records by state, timing and one permitted link."""
    return _records(spark, d).select("o_orderkey", "o_orderstatus")


@REG.add("visible_events", f"""
WITH {_RECORDS}, e AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'order' ELSE 'customer' END AS kind, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 10 + 1 END AS src FROM events)
SELECT event_id, kind FROM e WHERE (kind = 'order' AND EXISTS (SELECT 1 FROM v WHERE v.o_orderkey = e.user_id) OR kind = 'customer' AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c_acctbal > 0))
  AND (src IS NULL OR EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = e.src AND s_acctbal >= 0))""")
def visible_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of visible orders and customers from permitted sources."""
    kind = F.when(F.col("event_type").isin("click", "view"), "order").otherwise("customer")
    events = table(spark, d, "events").select("event_id", kind.alias("kind"), "user_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 10 + 1).alias("src"))
    visible = {"order": _records(spark, d).select("o_orderkey"), "customer": table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")}
    sources = table(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("src"))
    return gates.visible_events(events, "kind", "user_id", visible, "src", sources).select("event_id", "kind")


@REG.add("visible_assets", """
SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE l.l_partkey = p.p_partkey AND n_regionkey IN (1, 3))""")
def visible_assets(spark: SparkSession, d: str) -> DataFrame:
    """Parts that a supplier of a permitted region delivers."""
    nations = table(spark, d, "nation").where("n_regionkey in (1, 3)").select(F.col("n_nationkey").alias("s_nationkey"))
    suppliers = table(spark, d, "supplier").join(nations, "s_nationkey", "left_semi").withColumnRenamed("s_suppkey", "l_suppkey")
    links = gates.permitted_links(table(spark, d, "lineitem"), suppliers, "l_suppkey", F.lit(True), F.lit(True))
    return gates.visible_records(table(spark, d, "part"), links.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", F.lit(True)).select("p_partkey")


@REG.add("visible_organisations", """
SELECT c_custkey FROM customer c WHERE c_acctbal >= 0 AND (EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT') OR EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND event_type = 'purchase'))""")
def visible_organisations(spark: SparkSession, d: str) -> DataFrame:
    """Public customers that orders or events give evidence of."""
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    events = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return gates.evidenced(table(spark, d, "customer"), "c_custkey", F.col("c_acctbal") >= 0, orders, events).select("c_custkey")


@REG.add("redistributable", """
SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'N') AS listed FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE l.l_orderkey = o.o_orderkey AND s_nationkey < 10)""")
def redistributable(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a link that may be passed on, and whether one of their links is still listed."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    sources = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    links = gates.permitted_links(lines, sources, "l_suppkey", F.lit(True), F.col("s_nationkey") < 10)
    records = gates.visible_records(table(spark, d, "orders"), links, "o_orderkey", F.lit(True))
    listed = lines.where("l_returnflag = 'N'").select("o_orderkey").distinct().withColumn("_l", F.lit(True))
    return records.join(listed, "o_orderkey", "left").select("o_orderkey", F.coalesce("_l", F.lit(False)).alias("listed"))


@REG.add("served_view", """
WITH l AS (SELECT l_orderkey AS k, CAST(l_suppkey % 5 AS VARCHAR) AS s, l_quantity AS amount, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag, l_shipdate AS d, l_linenumber AS n FROM lineitem),
r AS (SELECT k, max(n) AS top, bool_and(s <> '3') AS amount_ok, coalesce(bool_and(s <> '3') FILTER (flag IS NOT NULL), true) AS flag_ok, max(amount) AS amount, max(flag) AS flag FROM l GROUP BY k),
o AS (SELECT k, arg_max(amount, (d, n, s, amount, coalesce(flag, '~'))) AS la, arg_max(flag, (d, n, s, amount, coalesce(flag, '~'))) FILTER (flag IS NOT NULL) AS lf FROM l WHERE s <> '3' GROUP BY k)
SELECT r.k, CASE WHEN amount_ok THEN amount ELSE la END AS amount, CASE WHEN amount_ok THEN 'own' WHEN la IS NOT NULL THEN 'link' END AS amount_from,
       CASE WHEN flag_ok THEN flag ELSE lf END AS flag, CASE WHEN flag_ok AND flag IS NOT NULL THEN 'own' WHEN NOT flag_ok AND lf IS NOT NULL THEN 'link' END AS flag_from
FROM r LEFT JOIN o ON o.k = r.k""")
def served_view(spark: SparkSession, d: str) -> DataFrame:
    """Fields of orders as far as their sources may be read, else recomputed from the readable links."""
    links = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 5).cast("string").alias("s"), F.col("l_quantity").alias("amount"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("flag"), F.col("l_shipdate").alias("d"), F.col("l_linenumber").alias("n"),
    )
    open_ = F.col("s") != "3"
    records = links.groupBy("k").agg(
        F.bool_and(open_).alias("amount_readable"), F.coalesce(F.bool_and(F.when(F.col("flag").isNotNull(), open_)), F.lit(True)).alias("flag_readable"), F.max("amount").alias("amount"), F.max("flag").alias("flag"),
    )
    return gates.served_view(records, links, "k", ["amount", "flag"], open_, F.struct("d", "n", "s", "amount", F.coalesce("flag", F.lit("~"))))


@REG.add("hidden_provenance", """
SELECT event_id FROM events WHERE event_type = 'click' OR CAST(user_id % 4 AS VARCHAR) = '3'""")
def hidden_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Events with a field from a hidden source."""
    provenance = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), (F.col("user_id") % 4).cast("string"))
    return table(spark, d, "events").where(gates.hidden_provenance(provenance, ["click", "3"])).select("event_id")


@REG.add("visibility_leaks", f"WITH {_RECORDS} SELECT count(*) AS shown, CAST(0 AS BIGINT) AS leaked FROM v")
def visibility_leaks(spark: SparkSession, d: str) -> DataFrame:
    """An independent recount by aggregation instead of semi-joins: how many visible records it does not permit."""
    shown = _records(spark, d).select("o_orderkey")
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal"), "l_suppkey")
    counted = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if((F.col("s_acctbal") >= 0) & (F.col("l_shipdate") < _STAMP("2000-01-01"))).alias("n")).where("n > 0")
    permitted = table(spark, d, "orders").where("o_orderstatus <> 'P'").where(F.col("o_orderdate") < _STAMP("1999-06-01")).join(counted, "o_orderkey").select("o_orderkey")
    bad = gates.leaks(shown, permitted, "o_orderkey").agg(F.count(F.lit(1)).alias("leaked"))
    return shown.agg(F.count(F.lit(1)).alias("shown")).join(F.broadcast(bad)).select("shown", "leaked")  # one row each


@REG.add("event_filters", """
SELECT event_id, CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) AS k FROM events
WHERE event_type IN ('click', 'purchase') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) BETWEEN 20 AND 60 AND (value >= 50 OR value IS NULL)""")
def event_filters(spark: SparkSession, d: str) -> DataFrame:
    """The event list's grammar: kinds, inclusive instants, a number in the JSON and a floor that unknown values pass."""
    lo, hi = (gates.instant_bound(n, t).replace(tzinfo=None) for n, t in (("from", "2024-01-05T01:00:00+01:00"), ("to", "2024-01-20T00:00:00Z")))
    least, most = gates.value_bounds("20", "60")
    k = gates.json_number(F.col("props"), "$.k")
    keep = gates.all_of(
        (F.col("event_type").isin("click", "purchase"), False), (gates.between_bounds(F.col("ts"), lo, hi), False), (gates.between_bounds(k, least, most), False),
        (gates.at_least_or_unknown(F.col("value"), gates.number_bound("value", "50"), unknown=True), False),
    )
    return table(spark, d, "events").where(keep).select("event_id", k.alias("k"))


@REG.add("set_membership", r"""
SELECT p_partkey FROM part WHERE list_has_any(string_split(replace(p_type, ' ', '|'), '|'), ['TIN', 'PROMO'])""")
def set_membership(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose stored set of words has one of the wanted as a whole member."""
    return table(spark, d, "part").where(gates.in_set(F.translate("p_type", " ", "|"), ["TIN", "PROMO"])).select("p_partkey")


@REG.add("to_state", """
SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'stated' END, CASE event_type WHEN 'purchase' THEN 'closed' WHEN 'signup' THEN 'open' END) AS state FROM events""")
def to_state(spark: SparkSession, d: str) -> DataFrame:
    """The state each event leads to, stated or implied."""
    change = F.when(F.col("event_id") % 3 == 0, F.lit('{"after": {"state": "stated"}}')).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", gates.to_state(change, "$.after.state", {"purchase": "closed", "signup": "open"}, F.col("event_type")).alias("state"))


@REG.add("placement_grade", """
SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN NULL WHEN c_acctbal >= 0 THEN c_mktsegment ELSE 'AUTOMOBILE' END AS grade FROM customer""")
def placement_grade(spark: SparkSession, d: str) -> DataFrame:
    """Grades by precision, coarsened where the licence holds the position back."""
    return table(spark, d, "customer").select("c_custkey", gates.graded(F.col("c_mktsegment"), F.col("c_acctbal") >= 0, ["BUILDING", "MACHINERY", "AUTOMOBILE"]).alias("grade"))


@REG.add("superseded_rows", """
SELECT o_orderkey, bool_and(n_regionkey <> 2) AS superseded FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def superseded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders all of whose nations a preferred source covers."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    orders = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("s_nationkey").alias("places"))  # 25 nations at most
    covered = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("place"))
    return gates.superseded(orders, "o_orderkey", "places", covered, "place").select("o_orderkey", "superseded")


@REG.add("withheld_coordinates", r"""
SELECT doc_id, length(regexp_replace(text, '-?\d{1,3}\.\d{3,}°?(?: ?[NSEW]\b)?\s*[,;/]\s*-?\d{1,3}\.\d{3,}°?(?: ?[NSEW]\b)?', '[position withheld]', 'g')) AS n FROM documents WHERE text IS NOT NULL""")
def withheld_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the texts without the positions in them."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(tx.without_coordinates(F.col("text"))).cast("long").alias("n"))
