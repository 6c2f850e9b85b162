"""Groups, leads, scopes and merges over cases, orders and the register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import sites
from gridloom.registry import Registry
from gridloom.session import table
from gridloom.sources import connectors as cn

REG = Registry()

_USABLE = "latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 360 AND NOT (latitude = 0 AND longitude = 0)"
_EDGES = f"""
c AS (SELECT case_id, study_asn, latitude AS la, CASE WHEN longitude >= 180 THEN longitude - 360 ELSE longitude END AS lo, CASE WHEN {_USABLE} THEN true ELSE false END AS ok FROM faa_cases),
d AS (SELECT a.case_id AS l, b.case_id AS r, 'distance' AS rule FROM c a JOIN c b ON a.ok AND b.ok AND a.case_id < b.case_id AND b.la BETWEEN a.la - 0.001 AND a.la + 0.001
      WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) <= 60),
s AS (SELECT m.l, c.case_id AS r, 'study' AS rule FROM c JOIN (SELECT study_asn, min(case_id) AS l FROM c WHERE trim(study_asn) <> '' GROUP BY 1) m ON m.study_asn = c.study_asn AND m.l <> c.case_id),
e AS (SELECT DISTINCT * FROM (SELECT * FROM d UNION ALL SELECT * FROM s))"""


def _site_edges(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "faa_cases")
    return sites.distance_edges(cases, "case_id", "latitude", "longitude", 60.0, "distance").unionByName(sites.star_edges(cases, "case_id", F.col("study_asn"), "study"))


@REG.add("site_edges", f'WITH {_EDGES} SELECT l AS "left", r AS "right", rule FROM e')
def site_edges(spark: SparkSession, d: str) -> DataFrame:
    """What joins two cases to one site: the same study, or at most 60 m between them."""
    return _site_edges(spark, d)


_ROOTS = "b AS (SELECT l AS x, r AS y FROM e UNION SELECT r, l FROM e), w AS (SELECT x AS node, x AS root FROM b UNION SELECT b.y, w.root FROM w JOIN b ON b.x = w.node WHERE w.root < b.y), r AS (SELECT node, min(root) AS root FROM w GROUP BY 1)"


@REG.add("site_groups", f"""
WITH RECURSIVE {_EDGES}, {_ROOTS},
f AS (SELECT root, min(CASE rule WHEN 'study' THEN 0 ELSE 1 END) AS k, string_agg(DISTINCT rule, '|' ORDER BY rule) AS rules FROM e JOIN r ON r.node = e.l GROUP BY 1)
SELECT node, root, CASE k WHEN 0 THEN 'study' ELSE 'distance' END AS strongest, rules FROM r JOIN f USING (root)""")
def site_groups(spark: SparkSession, d: str) -> DataFrame:
    """Cases of one site with the strongest evidence and all of it."""
    return sites.evidence_groups(_site_edges(spark, d), ["study", "distance"])


@REG.add("visible_site_groups", f"""
WITH RECURSIVE {_EDGES.replace('e AS (SELECT DISTINCT * FROM', 'e0 AS (SELECT DISTINCT * FROM')},
v AS (SELECT case_id FROM faa_cases WHERE case_id % 5 <> 0), e AS (SELECT * FROM e0 WHERE l IN (SELECT case_id FROM v) AND r IN (SELECT case_id FROM v)), {_ROOTS}
SELECT v.case_id AS node, coalesce(r.root, v.case_id) AS root FROM v LEFT JOIN r ON r.node = v.case_id""")
def visible_site_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the cases that may be seen, joined by what may be seen."""
    return sites.visible_groups(_site_edges(spark, d), table(spark, d, "faa_cases").where("case_id % 5 <> 0"), "case_id")


@REG.add("merge_gate", """
SELECT l_partkey AS plant, count(*) AS members, CASE WHEN min(l_discount) < 0.02 AND count(*) > 40 THEN 'score' WHEN count(DISTINCT l_returnflag) > 2 THEN 'kinds' WHEN max(l_quantity) > 40 * min(l_quantity) THEN 'size' END AS refused FROM lineitem GROUP BY 1""")
def merge_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the members of a group may become one record, and what refuses it."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "plant")
    return sites.gated_groups(lines, "plant", {
        "score": (F.min("l_discount") < 0.02) & (F.count(F.lit(1)) > 40), "kinds": F.count_distinct("l_returnflag") > 2, "size": F.max("l_quantity") > 40 * F.min("l_quantity"),
    })


@REG.add("coherence_ratio", """
WITH o AS (SELECT DISTINCT l_partkey, l_returnflag, l_suppkey, l_quantity, l_linestatus = 'F' AS built FROM lineitem), g AS (SELECT l_partkey, l_returnflag, sum(l_quantity) FILTER (NOT built) AS requested, sum(l_quantity) FILTER (built) AS built FROM o GROUP BY 1, 2)
SELECT l_partkey, l_returnflag, requested, built, requested / built AS ratio FROM g WHERE requested IS NOT NULL AND built > 0""")
def coherence_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Requests against plant by group and family, repeats of one source once."""
    return sites.coherence(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", "l_suppkey", "l_quantity", F.col("l_linestatus") == "F")


@REG.add("canonical_orders", "SELECT o_custkey, arg_max(o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderdate, o_orderkey)) AS canonical FROM orders GROUP BY 1")
def canonical_orders(spark: SparkSession, d: str) -> DataFrame:
    """The record that a group goes on under: a finished one first, then the most recent."""
    return sites.canonical_member(table(spark, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F", F.col("o_orderdate"))


@REG.add("current_merges", """
WITH g AS (SELECT event_id, user_id AS absorbed, event_id % 7 AS canonical, CASE WHEN event_type IN ('error', 'signup') THEN 'unmerge' ELSE 'merge' END AS action FROM events)
SELECT absorbed, arg_max(canonical, event_id) AS canonical FROM g GROUP BY 1 HAVING arg_max(action, event_id) = 'merge'""")
def current_merges(spark: SparkSession, d: str) -> DataFrame:
    """What a log of merges and unmerges says now."""
    action = F.when(F.col("event_type").isin("error", "signup"), "unmerge").otherwise("merge")
    log = table(spark, d, "events").select("event_id", F.col("user_id").alias("absorbed"), (F.col("event_id") % 7).alias("canonical"), action.alias("action"))
    return sites.current_merges(log, "absorbed", "canonical", "action", "event_id")


@REG.add("leads_and_labels", """
WITH m AS (SELECT *, first_value(o_orderkey) OVER w AS lead, first_value(o_totalprice) OVER w AS lp, first_value(o_orderpriority) OVER w AS lo FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_totalprice DESC, o_orderkey))
SELECT o_orderkey, lead, CASE WHEN o_orderkey = lead THEN 'lead' WHEN o_orderpriority = lo THEN 'same priority' WHEN o_totalprice > lp THEN 'larger' ELSE 'other' END AS label FROM m""")
def leads_and_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's lead order in a total order, and how the others stand to it."""
    order = [F.col("o_orderstatus") != "F", -F.col("o_totalprice"), F.col("o_orderkey")]
    labels = [("same priority", F.col("o_orderpriority") == F.col("lead_o_orderpriority")), ("larger", F.col("o_totalprice") > F.col("lead_o_totalprice"))]
    return sites.led(table(spark, d, "orders"), "o_custkey", order, labels, "o_orderkey", ["o_orderpriority", "o_totalprice"]).select("o_orderkey", "lead", "label")


@REG.add("requests_once", """
SELECT l_suppkey, l_returnflag, l_quantity, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_orderkey FROM lineitem GROUP BY 1, 2, 3""")
def requests_once(spark: SparkSession, d: str) -> DataFrame:
    """The newest of the requests that agree in source, technology and size."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", "l_orderkey", "l_linenumber", "l_shipdate")
    return sites.newest_of_each(rows, ["l_suppkey", "l_returnflag", "l_quantity"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_suppkey", "l_returnflag", "l_quantity", "l_orderkey")


@REG.add("folded_registrations", """
WITH p AS (SELECT o_orderkey, nullif(o_custkey % 50, 7) AS reg, o_orderpriority AS name, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS b FROM orders)
SELECT reg, name, min_by(o_orderkey, (-datediff('day', a, b), o_orderkey)) AS o_orderkey, count(*) AS folded FROM p WHERE reg IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT reg, name, o_orderkey, 1 FROM p WHERE reg IS NULL OR name IS NULL""")
def folded_registrations(spark: SparkSession, d: str) -> DataFrame:
    """Registrations of one registry id and name as the one that lasts longest."""
    day = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 50, F.lit(7)).alias("reg"), F.col("o_orderpriority").alias("name"), day.alias("a"), F.date_add(day, (F.col("o_orderkey") % 400).cast("int")).alias("b"))
    return sites.folded(rows, ["reg", "name"], "a", "b", "o_orderkey")


@REG.add("milestones_picked", """
SELECT o_custkey, strftime(max(o_orderdate) FILTER (o_orderstatus = 'F'), '%Y-%m-%d') AS latest, strftime(min(o_orderdate) FILTER (o_orderstatus <> 'F'), '%Y-%m-%d') AS next, count(*) AS milestones, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1""")
def milestones_picked(spark: SparkSession, d: str) -> DataFrame:
    """Milestone rows folded to one row a project."""
    from gridloom.sources.formats import folded_milestones

    got = folded_milestones(table(spark, d, "orders"), "o_custkey", F.struct("o_orderdate", "o_orderkey"), F.col("o_orderstatus"), "F")
    day = lambda c: F.date_format(f"{c}.o_orderdate", "yyyy-MM-dd").alias(c)
    return got.select("o_custkey", day("latest"), day("next"), "milestones", "finished")


@REG.add("primary_plant", "WITH s AS (SELECT l_suppkey, l_partkey, sum(CAST(l_quantity AS DECIMAL(18, 3))) AS mw FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, arg_max(l_partkey, (mw, -l_partkey)) AS plant, max(mw) AS mw FROM s GROUP BY 1")
def primary_plant(spark: SparkSession, d: str) -> DataFrame:
    """The plant that has most of each owner's capacity."""
    per = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,3)")).alias("mw"))
    best = per.groupBy("l_suppkey").agg(F.max(F.struct("mw", (-F.col("l_partkey")).alias("p"))).alias("b"))
    return best.select("l_suppkey", (-F.col("b.p")).alias("plant"), F.col("b.mw").alias("mw"))


@REG.add("forward_filled", """
SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value FROM events""")
def forward_filled(spark: SparkSession, d: str) -> DataFrame:
    """The last stated value of each user's series."""
    rows = table(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("o"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))
    return sites.forward_filled(rows, ["user_id"], "o", "value").select("event_id", "value")


@REG.add("neighbours_in_order", """
WITH n AS (SELECT c_nationkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS bucket, nullif(round(o_totalprice), 0) AS mw FROM orders JOIN customer ON c_custkey = o_custkey WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l_returnflag = 'R')),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY bucket, mw DESC NULLS LAST, o_orderkey) AS place FROM n) SELECT c_nationkey, o_orderkey, place FROM r WHERE place <= 12""")
def neighbours_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve neighbours of each place that are no members: by state, size and id. A top-k report."""
    from gridloom.operators.ranking import top_per_group

    members = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    near = table(spark, d, "orders").join(members, "o_orderkey", "left_anti").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    bucket = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    mw = F.nullif(F.round("o_totalprice"), F.lit(0.0))
    return top_per_group(near, ["c_nationkey"], [bucket, mw.desc_nulls_last(), F.col("o_orderkey")], 12).select("c_nationkey", "o_orderkey", F.col("rank").alias("place"))


_TREE = "t AS (SELECT DISTINCT l_suppkey AS p, l_partkey % 120 AS c FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 120 NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3))"


@REG.add("tree_scopes", f"""
WITH RECURSIVE {_TREE}, w AS (SELECT p AS a, c AS n, 1 AS level FROM t WHERE p % 10 = 0 UNION SELECT w.a, t.c, w.level + 1 FROM w JOIN t ON t.p = w.n WHERE w.level < 3 AND w.n <> w.a)
SELECT a AS ancestor, n AS node, min(level) AS level, a IN (SELECT a FROM w WHERE a = n) AS cyclic FROM w WHERE a <> n GROUP BY 1, 2""")
def tree_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Descents of three levels from some roots, stopped at hidden nodes, with a flag for cycles."""
    lines = table(spark, d, "lineitem").where("l_linenumber = 1")
    edges = lines.select(F.col("l_suppkey").alias("p"), (F.col("l_partkey") % 120).alias("c")).distinct()
    hidden = table(spark, d, "supplier").where("s_nationkey = 3").select("s_suppkey")
    return sites.scopes(edges, "p", "c", 3, hidden).where("ancestor % 10 = 0")


@REG.add("merge_chains", """
WITH RECURSIVE l AS (SELECT p_partkey AS n, p_partkey - 1 - p_partkey % 7 AS p FROM part WHERE p_partkey % 40 >= 8), w AS (SELECT n, p FROM l UNION ALL SELECT w.n, l.p FROM w JOIN l ON l.n = w.p)
SELECT n AS node, min(p) AS root FROM w GROUP BY 1""")
def merge_chains(spark: SparkSession, d: str) -> DataFrame:
    """Records followed along their merges to the one at the end."""
    from gridloom.operators.graph import chain_root

    links = table(spark, d, "part").where("p_partkey % 40 >= 8").select(F.col("p_partkey").alias("n"), (F.col("p_partkey") - 1 - F.col("p_partkey") % 7).alias("p"))
    return chain_root(links, "n", "p", 6)


@REG.add("phase_surplus", """
WITH e AS (SELECT DISTINCT l_orderkey % 500 AS l, 500 + l_partkey % 500 AS r FROM lineitem WHERE l_linenumber = 2), a AS (SELECT n AS node, CASE WHEN n < 500 THEN 250 + n % 150 ELSE n % 37 + 1 END AS amount FROM range(1000) t(n)),
b AS (SELECT l AS x, r AS y FROM e UNION SELECT r, l FROM e), s AS (SELECT x, count(*) AS n, sum(amount) AS total FROM b JOIN a ON a.node = b.y GROUP BY 1 HAVING count(*) >= 2)
SELECT x AS anchor, amount, n AS neighbours, CAST(total AS BIGINT) AS total FROM s JOIN a ON a.node = s.x WHERE abs(total - amount) <= amount * 0.2""")
def phase_surplus(spark: SparkSession, d: str) -> DataFrame:
    """Anchors whose neighbours add up to them."""
    edges = table(spark, d, "lineitem").where("l_linenumber = 2").select((F.col("l_orderkey") % 500).alias("left"), (500 + F.col("l_partkey") % 500).alias("right")).distinct()
    amounts = spark.range(1000).select(F.col("id").alias("node"), F.when(F.col("id") < 500, 250 + F.col("id") % 150).otherwise(F.col("id") % 37 + 1).alias("amount"))
    return sites.surplus(edges, amounts, 0.2)


@REG.add("kept_sample", """
WITH r AS (SELECT o_orderkey, o_totalprice > 490000 AS ok FROM orders) SELECT o_orderkey FROM r WHERE ok UNION ALL (SELECT o_orderkey FROM r WHERE NOT ok ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100)""")
def kept_sample(spark: SparkSession, d: str) -> DataFrame:
    """All accepted rows and a hundred of the rest: a sampling operator."""
    return sites.kept_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") > 490000, "o_orderkey", 100).select("o_orderkey")


@REG.add("canonical_union", r"""
SELECT 'register' AS source, CAST(row_id AS VARCHAR) AS record, coalesce(nullif(trim(project_name), ''), nullif(trim(customer_name), '')) AS name, coalesce(try_cast(mw_connected AS DOUBLE), try_cast(mw_increase_decrease AS DOUBLE)) AS mw, nullif(trim(stage), '') AS stage FROM neso_tec_register
UNION ALL SELECT 'atlas', CAST(atlas_id AS VARCHAR), coalesce(nullif(trim(name_a), ''), nullif(trim(city_a), '')), capacity_a, NULL FROM ethanol_atlas UNION ALL SELECT 'capacity', CAST(capacity_id AS VARCHAR), coalesce(nullif(trim(name_b), ''), nullif(trim(city_b), '')), capacity_b, NULL FROM ethanol_capacity""")
def canonical_union(spark: SparkSession, d: str) -> DataFrame:
    """Three sources in canonical columns: expressions, or the first column that states a value; absent ones are null."""
    number = lambda c: F.col(c).try_cast("double")
    register = cn.projected(table(spark, d, "neso_tec_register"), {"record": F.col("row_id").cast("string"), "name": ["project_name", "customer_name"], "mw": F.coalesce(number("mw_connected"), number("mw_increase_decrease")), "stage": ["stage"]}, "register")
    atlas = cn.projected(table(spark, d, "ethanol_atlas"), {"record": F.col("atlas_id").cast("string"), "name": ["name_a", "city_a"], "mw": F.col("capacity_a")}, "atlas")
    capacity = cn.projected(table(spark, d, "ethanol_capacity"), {"record": F.col("capacity_id").cast("string"), "name": ["name_b", "city_b"], "mw": F.col("capacity_b")}, "capacity")
    return cn.united(register, atlas, capacity)
