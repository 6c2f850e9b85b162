"""Rules, alerts, events in order and geometry columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geo, rules
from gridloom.operators import graph
from gridloom.registry import Registry
from gridloom.session import table
from gridloom.streaming import events as st

REG = Registry()

_TS = lambda t: F.lit(t).cast("timestamp_ntz")
_DOC = """{"version": 3, "threshold": 0.6, "rules": [
 {"name": "size", "weight": 2, "all": [["p_size", "at_most", 25], ["p_retailprice", "at_least", 50]]},
 {"name": "kind", "weight": 1, "credit": 0.5, "all": [["p_type", "in", ["SMALL", "PROMO"]]]},
 {"name": "name", "weight": 1, "all": [["p_name", "matches", "ring|bolt"]]}]}"""


@REG.add("ruled_matches", """
WITH c AS (SELECT p_partkey, p_size <= 25 AND p_retailprice >= 50 AS a, p_type IN ('SMALL', 'PROMO') AS b, regexp_matches(lower(p_name), 'ring|bolt') AS n FROM part),
s AS (SELECT p_partkey, round((CASE WHEN a THEN 2.0 ELSE 0 END + CASE WHEN b THEN 0.5 ELSE 0 END + CASE WHEN n THEN 1.0 ELSE 0 END) / 4, 3) AS score, concat_ws('|', CASE WHEN NOT a THEN 'size' END, CASE WHEN NOT b THEN 'kind' END, CASE WHEN NOT n THEN 'name' END) AS failed FROM c)
SELECT p_partkey, CAST(score AS DOUBLE) AS score, failed FROM s WHERE score >= 0.6""")
def ruled_matches(spark: SparkSession, d: str) -> DataFrame:
    """Parts that reach the threshold of a rule document, with the rules they fail."""
    doc = rules.parse_rules(_DOC)
    score, failed = rules.scored(doc)
    return table(spark, d, "part").select("p_partkey", score.alias("score"), failed.alias("failed")).where(F.col("score") >= doc["threshold"])


@REG.add("word_families", """
WITH w AS (SELECT p_partkey, regexp_split_to_array(lower(p_name), '[^a-z0-9]+') AS w FROM part)
SELECT p_partkey, concat_ws('|', CASE WHEN list_has_any(w, ['red', 'blue', 'green']) THEN 'colour' END, CASE WHEN list_has_any(w, ['ring', 'bolt', 'gear', 'widget']) THEN 'thing' END) AS families FROM w""")
def word_families(spark: SparkSession, d: str) -> DataFrame:
    """Families of a vocabulary that each name has words of."""
    found = rules.families({"colour": ["red", "blue", "green"], "thing": ["ring", "bolt", "gear", "widget"]}, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(found, "|").alias("families"))


@REG.add("credits", """
WITH o AS (SELECT o_orderkey, o_totalprice AS x, CASE WHEN o_orderkey % 5 <> 0 THEN 100000.0 * (1 + o_custkey % 4) END AS sought, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS due, 'US-' || ['TX', 'CA', 'NM'][o_orderkey % 3 + 1] AS place, ['US', 'US-TX', 'US-CA'][o_custkey % 3 + 1] AS wanted FROM orders)
SELECT o_orderkey, coalesce(sought IS NULL OR x BETWEEN sought * 0.5 AND sought * 2, false) AS fits, CASE WHEN due IS NULL OR datediff('day', DATE '1999-01-01', due) >= 90 THEN 1.0 WHEN datediff('day', DATE '1999-01-01', due) >= 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS timing,
       CASE WHEN place = wanted OR wanted = 'US' THEN 1.0 WHEN wanted = 'US-TX' AND place = 'US-NM' THEN 0.5 ELSE 0.0 END::DOUBLE AS place, coalesce(x > 0 AND sought > 0 AND greatest(x, sought) > 4 * least(x, sought), false) AS apart FROM o""")
def credits(spark: SparkSession, d: str) -> DataFrame:
    """Size window, timing and place credits, and the veto of amounts too far apart."""
    pick = lambda k, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    o = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("x"), F.when(F.col("o_orderkey") % 5 != 0, 100000.0 * (1 + F.col("o_custkey") % 4)).alias("sought"), F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("due"),
        F.concat(F.lit("US-"), pick(F.col("o_orderkey"), "TX", "CA", "NM")).alias("place"), pick(F.col("o_custkey"), "US", "US-TX", "US-CA").alias("wanted"),
    )
    return o.select(
        "o_orderkey", rules.size_window(F.col("x"), F.col("sought"), 0.5, 2.0).alias("fits"), rules.timing_credit(F.col("due"), F.lit("1999-01-01").cast("date"), 90).alias("timing"),
        rules.place_credit(F.col("place"), F.col("wanted"), {"US-TX": ["US-NM"]}).alias("place"), rules.too_far_apart(F.col("x"), F.col("sought"), 4.0).alias("apart"),
    )


@REG.add("squashed_names", r"SELECT c_custkey, translate(lower(c_name || ' & Co. (' || c_mktsegment || ')'), ' .,-''&/()', '') AS name FROM customer")
def squashed_names(spark: SparkSession, d: str) -> DataFrame:
    """The registered SQL function over a table."""
    rules.register_functions(spark)
    return spark.sql("SELECT c_custkey, squash(c_name || ' & Co. (' || c_mktsegment || ')') AS name FROM {c}", c=table(spark, d, "customer"))


@REG.add("stored_points", "SELECT case_id, CASE WHEN longitude IS NOT NULL AND latitude IS NOT NULL THEN longitude END AS lon, CASE WHEN longitude IS NOT NULL AND latitude IS NOT NULL THEN latitude END AS lat FROM faa_cases")
def stored_points(spark: SparkSession, d: str) -> DataFrame:
    """Positions through their stored text and back."""
    back = rules.point_of(rules.point_text(F.col("longitude"), F.col("latitude")))
    return table(spark, d, "faa_cases").select("case_id", back.alias("p")).select("case_id", "p.lon", "p.lat")


@REG.add("event_seq", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events")
def event_seq(spark: SparkSession, d: str) -> DataFrame:
    """A gapless sequence over all events without a single sorted task."""
    rows = table(spark, d, "events").select("event_id", F.struct("ts", "event_id").alias("o"))
    return graph.row_numbered(rows, "o").select("event_id", "seq")


@REG.add("saved_search_hits", """
WITH e AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events), s AS (SELECT c_custkey AS search, ['click', 'purchase', 'error'][c_custkey % 3 + 1] AS kind, c_custkey * 10 AS mark, c_custkey % 50 AS floor FROM customer WHERE c_custkey < 60)
SELECT search, event_id FROM s JOIN e ON event_type = kind AND seq > mark AND seq <= (SELECT max(seq) - 500 FROM e) AND value >= floor""")
def saved_search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Events past each search's watermark and up to the stable horizon that match it."""
    seq = event_seq(spark, d)
    events = table(spark, d, "events").select("event_id", "event_type", "value").join(seq, "event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("click", "purchase", "error")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    searches = table(spark, d, "customer").where("c_custkey < 60").select(F.col("c_custkey").alias("search"), kind.alias("kind"), (F.col("c_custkey") * 10).alias("mark"), (F.col("c_custkey") % 50).alias("floor"))
    horizon = events.agg(F.max("seq")).first()[0] - 500
    hits, _ = st.alerts(events, searches, (F.col("event_type") == F.col("kind")) & (F.col("value") >= F.col("floor")), "seq", "mark", horizon)
    return hits.select("search", "event_id")


@REG.add("searches_due", """
WITH s AS (SELECT c_custkey, ['immediate', 'daily', 'weekly', 'never'][c_custkey % 4 + 1] AS cadence, (SELECT max(ts) FROM events e WHERE e.user_id = c_custkey) AS last FROM customer)
SELECT c_custkey, CASE cadence WHEN 'immediate' THEN true WHEN 'daily' THEN last IS NULL OR TIMESTAMP '2024-01-30 12:00:00' >= last + INTERVAL 1 DAY WHEN 'weekly' THEN last IS NULL OR TIMESTAMP '2024-01-30 12:00:00' >= last + INTERVAL 7 DAY ELSE false END AS due FROM s""")
def searches_due(spark: SparkSession, d: str) -> DataFrame:
    """Which saved searches are to be run now."""
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last"))
    cadence = F.element_at(F.array(*[F.lit(k) for k in ("immediate", "daily", "weekly", "never")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").join(last, "c_custkey", "left").select("c_custkey", rules.is_due(cadence, F.col("last"), _TS("2024-01-30 12:00:00")).alias("due"))


@REG.add("deadline_sweep", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-06-01' THEN 'closed' ELSE o_orderstatus END AS status, o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-06-01' AS changed FROM orders""")
def deadline_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Open records past their deadline closed, and which the sweep changed."""
    past = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < _TS("1998-06-01"))
    return table(spark, d, "orders").select("o_orderkey", F.when(past, "closed").otherwise(F.col("o_orderstatus")).alias("status"), past.alias("changed"))


@REG.add("retirement_moves", """
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS b, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 61 - 30 AS INTEGER) END AS a FROM orders)
SELECT o_orderkey, CASE WHEN coalesce(a < DATE '1998-01-01', false) AND coalesce(b >= DATE '1998-01-01', b IS NULL) THEN 'retired' WHEN b IS NULL AND a IS NOT NULL THEN 'set' WHEN b IS NOT NULL AND a IS NULL THEN 'cancelled' WHEN a > b THEN 'delayed' WHEN a < b THEN 'brought_forward' END AS move FROM c""")
def retirement_moves(spark: SparkSession, d: str) -> DataFrame:
    """What the move of a date between two versions means."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    before, after = F.when(k % 4 != 0, day), F.when(k % 5 != 0, F.date_add(day, (k % 61 - 30).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", rules.retirement(before, after, F.lit("1998-01-01").cast("date")).alias("move"))


@REG.add("line_pieces", """
WITH p AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), w AS (SELECT l_orderkey, q, sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM p)
SELECT l_orderkey, CAST(greatest(1, round(sum(q) / 40)) AS BIGINT) AS pieces, sum(q) / greatest(1, round(sum(q) / 40)) AS each FROM w GROUP BY 1""")
def line_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Into how many equal pieces of about a target length each line is cut, and how long one is."""
    legs = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")).groupBy("l_orderkey").agg(F.sum("q").alias("length"))
    n, each = geo.equal_pieces(F.col("length"), 40.0)
    return legs.select("l_orderkey", n.alias("pieces"), each.alias("each"))
