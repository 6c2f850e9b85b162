"""Links between records by ids, names, contained words and tiers of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators import linking, resolution
from gridloom.registry import Registry
from gridloom.session import table

REG = Registry()


@REG.add("shared_id_links", """
WITH e AS (SELECT event_id, event_type AS s, CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS a, props AS b FROM events),
x AS (SELECT event_id, s, 'user day' AS method, a AS id FROM e UNION ALL SELECT event_id, s, 'stated' AS method, unnest([b, b || CAST(event_id % 50 AS VARCHAR)]) AS id FROM e),
g AS (SELECT method, id, min(event_id) AS l FROM x GROUP BY 1, 2 HAVING count(DISTINCT s) > 1)
SELECT DISTINCT g.l AS left, x.event_id AS right, x.method FROM x JOIN g ON g.method = x.method AND g.id = x.id WHERE g.l <> x.event_id""".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def shared_id_links(spark: SparkSession, d: str) -> DataFrame:
    """Events of different kinds that share a user and day, or an id they state."""
    events = table(spark, d, "events")
    day = F.concat(F.col("user_id").cast("string"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd"))
    stated = F.array(F.col("props"), F.concat("props", (F.col("event_id") % 50).cast("string")))
    return linking.shared_id_links(events, "event_id", "event_type", {"user day": day, "stated": stated})


_NAMES = "n AS (SELECT p_partkey AS id, p_partkey % 3 AS s, p_brand AS b, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) >= 4)[1] AS w FROM part), z AS (SELECT b, w, count(*) AS n, min(s) AS lo, max(s) AS hi FROM n WHERE w IS NOT NULL GROUP BY 1, 2)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("s", F.col("p_partkey") % 3)


@REG.add("name_block_pairs", f'WITH {_NAMES} SELECT a.id AS "left", b.id AS "right" FROM n a JOIN z ON z.b = a.b AND z.w = a.w AND n BETWEEN 2 AND 60 AND lo <> hi JOIN n b ON b.b = a.b AND b.w = a.w AND a.id < b.id AND a.s <> b.s')
def name_block_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one brand and first long word from different sources."""
    return linking.name_block_pairs(_parts(spark, d), "p_partkey", "s", "p_name", ["p_brand"])[0]


@REG.add("name_blocks_left", f"WITH {_NAMES} SELECT n.id AS p_partkey FROM n JOIN z ON z.w = n.w AND z.b = n.b WHERE z.n > 8")
def name_blocks_left(spark: SparkSession, d: str) -> DataFrame:
    """Parts in blocks above eight rows, for another rule."""
    return linking.name_block_pairs(_parts(spark, d), "p_partkey", "s", "p_name", ["p_brand"], most=8)[1]


@REG.add("cross_source_pairs", """
SELECT a.p_partkey AS l, b.p_partkey AS r FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.p_partkey % 3 <> b.p_partkey % 3
WHERE least(a.p_retailprice, b.p_retailprice) >= greatest(a.p_retailprice, b.p_retailprice) * 0.99 AND a.p_size = b.p_size""")
def cross_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one brand and size from different sources whose prices differ by at most 1 % of the larger."""
    apart = F.col("left.s") != F.col("right.s")
    pairs = resolution.banded_pairs(_parts(spark, d), "p_partkey", ["p_brand", "p_size"], "p_retailprice", 0.01, apart)
    return pairs.select(F.col("left.p_partkey").alias("l"), F.col("right.p_partkey").alias("r"))


@REG.add("contained_names", r"""
WITH t AS (SELECT p_partkey, ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM part), n AS (SELECT unnest(['Ring', 'red WIDGET', 'blue bolt', 'gear', '', 'ge']) AS needle)
SELECT p_partkey, needle FROM t JOIN n ON needle <> '' AND contains(t, ' ' || lower(needle) || ' ')""")
def contained_names(spark: SparkSession, d: str) -> DataFrame:
    """Part names that contain a wanted phrase as whole words."""
    needles = spark.createDataFrame([(x,) for x in ("Ring", "red WIDGET", "blue bolt", "gear", "", "ge")], "needle string").withColumn("n", F.col("needle"))
    return linking.containing(table(spark, d, "part"), "p_partkey", "p_name", needles.withColumnRenamed("n", "text"), "needle", "text")


@REG.add("fuzzy_names")
def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """Plants of the two registries whose names reach a token-set score of 85, in one state or not."""
    atlas = table(spark, d, "ethanol_atlas").withColumnRenamed("name_a", "name")
    return linking.fuzzy_names(atlas, "atlas_id", table(spark, d, "ethanol_capacity").withColumnRenamed("name_b", "name"), "capacity_id", "name", 85.0)


@REG.add("united_pairs", """
WITH a AS (SELECT l_partkey AS l, l_suppkey AS r, 'flag' AS m, max(l_quantity) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), b AS (SELECT l_partkey AS l, l_suppkey AS r, 'date' AS m, max(l_quantity) + 1 AS s FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1, 2)
SELECT l AS "left", r AS "right", string_agg(m, '+' ORDER BY m) AS methods, max(s) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def united_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs found by two methods, once each with the methods and the best score."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("right"), "l_quantity", "l_returnflag", "l_shipdate")
    of = lambda df, m, s: df.groupBy("left", "right").agg(s.alias("score")).withColumn("method", F.lit(m))
    flag = of(lines.where("l_returnflag = 'R'"), "flag", F.max("l_quantity"))
    return linking.united_pairs(flag, of(lines.where(F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")), "date", F.max("l_quantity") + 1))


@REG.add("overlaid_rates", """
WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS rate FROM events WHERE event_type = 'view' GROUP BY 1, 2), b AS (SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS rate FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, rate FROM (SELECT a.* FROM a ANTI JOIN b USING (user_id, day) UNION ALL SELECT * FROM b)""")
def overlaid_rates(spark: SparkSession, d: str) -> DataFrame:
    """A newer table of rates laid over an older one."""
    events = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    of = lambda kind, agg: events.where(F.col("event_type") == kind).groupBy("user_id", "day").agg(agg("value").alias("rate"))
    return linking.overlaid(of("view", F.max), of("click", F.min), ["user_id", "day"])


@REG.add("placed_by_tiers", """
WITH x AS (SELECT c_nationkey, c_mktsegment, CASE WHEN min(c_custkey % 40) = max(c_custkey % 40) THEN min(c_custkey % 40) END AS v FROM customer GROUP BY 1, 2), y AS (SELECT n_nationkey, n_regionkey AS v FROM nation WHERE n_nationkey % 4 <> 0)
SELECT s_suppkey, coalesce(x.v, y.v, 99) AS place, CASE WHEN x.v IS NOT NULL THEN 'exact' WHEN y.v IS NOT NULL THEN 'nation' ELSE 'all' END AS tier
FROM (SELECT s_suppkey, s_nationkey, ['BUILDING', 'MACHINERY', 'NONE'][s_suppkey % 3 + 1] AS seg FROM supplier) s LEFT JOIN x ON x.c_nationkey = s.s_nationkey AND x.c_mktsegment = s.seg LEFT JOIN y ON y.n_nationkey = s.s_nationkey""")
def placed_by_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The place of each supplier: by nation and segment if that is unambiguous, else by nation, else a default."""
    seg = F.element_at(F.array(*[F.lit(x) for x in ("BUILDING", "MACHINERY", "NONE")]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    suppliers = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), seg.alias("seg"), F.lit(1).alias("one"))
    exact = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), (F.col("c_custkey") % 40).alias("place"))
    nation = table(spark, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").cast("long").alias("place"))
    default = spark.createDataFrame([(1, 99)], "one int, place long")
    found = linking.first_found(suppliers, [("exact", exact, ["nation", "seg"]), ("nation", nation, ["nation"]), ("all", default, ["one"])], "place")
    return found.select("s_suppkey", "place", "tier")


@REG.add("names_and_aliases", r"""
WITH n AS (SELECT c_custkey, unnest([c_name, c_mktsegment || ' ' || (c_custkey % 10), CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'C-' || c_custkey END]) AS n FROM customer)
SELECT DISTINCT upper(trim(regexp_replace(n, '\s+', ' ', 'g'))) AS norm_key, c_custkey FROM n WHERE n IS NOT NULL""")
def names_and_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Every name and alias with the customers that bear it."""
    alias = F.array(F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 10).cast("string")), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("C-"), F.col("c_custkey").cast("string"))))
    rows = table(spark, d, "customer").withColumn("aliases", alias)
    return linking.by_any_name(rows, "c_custkey", "c_name", "aliases", lambda c: F.upper(tx.collapse(c)))


@REG.add("coverage_both_ways", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k""")
def coverage_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders against every second customer."""
    return linking.both_ways(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), "k")


@REG.add("tiered_names")
def tiered_names(spark: SparkSession, d: str) -> DataFrame:
    """Atlas names matched to capacity names of their state: equal, like by a margin, or refused."""
    state = F.upper(F.right(F.trim("state"), F.lit(2)))
    queries = table(spark, d, "ethanol_atlas").select(state.alias("state"), F.lower("name_a").alias("name"), F.lit(None).cast("double").alias("volts")).where("name is not null")
    nodes = table(spark, d, "ethanol_capacity").select(state.alias("state"), F.lower("name_b").alias("name"), F.col("capacity_id").alias("node"), F.lit(None).cast("double").alias("volts"))
    return linking.tiered_names(queries, nodes, "state", "name", "node", "volts", 80.0, 5.0)


@REG.add("operator_rule", r"""
WITH r AS (SELECT p_partkey, list_distinct(list_filter([CASE WHEN regexp_matches(lower(p_type), 'small|large') THEN 'grey' END, CASE WHEN regexp_matches(lower(p_type), '^(promo|econ)') THEN 'offer' END, CASE WHEN regexp_matches(lower(p_type), 'y$') THEN 'grey' END], lambda x: x IS NOT NULL)) AS l FROM part)
SELECT p_partkey, CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) > 1 THEN 'conflict' END AS label FROM r""")
def operator_rule(spark: SparkSession, d: str) -> DataFrame:
    """The label of the only rule that fits each part type."""
    return table(spark, d, "part").select("p_partkey", linking.one_rule(F.col("p_type"), [("small|large", "grey"), ("^(promo|econ)", "offer"), ("y$", "grey")]).alias("label"))


@REG.add("first_veto", """
SELECT o_orderkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'name' WHEN o_totalprice / nullif(c_acctbal, 0) > 50 THEN 'ratio' WHEN year(o_orderdate) < 1997 THEN 'years' END AS veto FROM orders JOIN customer ON c_custkey = o_custkey""")
def first_veto(spark: SparkSession, d: str) -> DataFrame:
    """Why an order is no match for its customer: the first of the ordered vetoes."""
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ratio = F.col("o_totalprice") / F.when(F.col("c_acctbal") != 0, F.col("c_acctbal"))
    vetoes = [("name", F.col("c_mktsegment") != "BUILDING"), ("ratio", ratio > 50), ("years", F.year("o_orderdate") < 1997)]
    return both.select("o_orderkey", linking.first_veto(vetoes).alias("veto"))


@REG.add("parent_facts", """
SELECT DISTINCT l_partkey, l_suppkey, a.name AS child_name, b.name AS parent_name, a.nation AS child_nation, b.nation AS parent_nation FROM (SELECT DISTINCT l_partkey % 40 + 1 AS l_partkey, l_suppkey FROM lineitem) l
JOIN (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation FROM supplier) a ON a.k = l_partkey JOIN (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation FROM supplier) b ON b.k = l_suppkey""")
def parent_facts(spark: SparkSession, d: str) -> DataFrame:
    """Relations with the facts of both ends."""
    relations = table(spark, d, "lineitem").select((F.col("l_partkey") % 40 + 1).alias("l_partkey"), "l_suppkey").distinct()
    entities = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return linking.parents_of(relations, entities, "l_partkey", "l_suppkey", "k", ["name", "nation"])


@REG.add("owner_shares", """
WITH o AS (SELECT l_orderkey AS plant, l_suppkey AS owner, l_quantity AS pct FROM lineitem), g AS (SELECT o_orderkey AS plant, o_totalprice AS mw FROM orders WHERE o_orderkey % 5 <> 0), t AS (SELECT plant, sum(pct) AS total FROM o GROUP BY 1)
SELECT o.plant, owner, sum(pct) AS pct, max(mw) * sum(pct) / max(total) AS owned FROM o JOIN t USING (plant) LEFT JOIN g USING (plant) GROUP BY 1, 2""")
def owner_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each owner holds of a plant: shares restated to their sum, and the capacity they stand for, null where none is known."""
    shares = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plant"), F.col("l_suppkey").alias("owner"), F.col("l_quantity").alias("pct"))
    held = shares.groupBy("plant", "owner").agg(F.sum("pct").alias("pct"))
    total = held.groupBy("plant").agg(F.sum("pct").alias("total"))
    capacity = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("plant"), F.col("o_totalprice").alias("mw"))
    return held.join(total, "plant").join(capacity, "plant", "left").select("plant", "owner", "pct", (F.col("mw") * F.col("pct") / F.col("total")).alias("owned"))


@REG.add("over_allocated", "SELECT l_orderkey, sum(l_quantity) AS pct FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 150.5")
def over_allocated(spark: SparkSession, d: str) -> DataFrame:
    """Units whose shares add up to more than the tolerance allows."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("pct")).where("pct > 150.5")


@REG.add("baseline_joined", """
WITH f AS (SELECT user_id, min(ts) AS first_ok FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id, c_mktsegment, strftime(first_ok, '%Y-%m-%d %H:%M:%S.%f') AS first_ok, coalesce(ts > first_ok, false) AS after_first FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN f ON f.user_id = e.user_id""")
def baseline_joined(spark: SparkSession, d: str) -> DataFrame:
    """Events with their run and its first good run, kept where either is missing."""
    events = table(spark, d, "events")
    first = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("first_ok"))
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    joined = events.join(runs, "user_id", "left").join(first, "user_id", "left")
    return joined.select("event_id", "c_mktsegment", F.date_format("first_ok", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_ok"), F.coalesce(F.col("ts") > F.col("first_ok"), F.lit(False)).alias("after_first"))


@REG.add("list_with_stats", """
SELECT c_custkey, n_name, coalesce(orders, 0) AS orders, total FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM orders GROUP BY 1) s ON o_custkey = c_custkey""")
def list_with_stats(spark: SparkSession, d: str) -> DataFrame:
    """Customers with place and figures, kept without either."""
    stats = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    places = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(places, "c_nationkey", "left").join(stats, "c_custkey", "left").select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), "total")


@REG.add("docket_years", r"""
SELECT doc_id, CAST(regexp_extract(docket_ref, '([0-9]{2,4})-', 1) AS INTEGER) AS year, regexp_extract(docket_ref, '^([A-Za-z]+)', 1) AS class FROM documents WHERE regexp_matches(docket_ref, '^[A-Za-z]+.*[0-9]{2,4}-') AND CAST(regexp_extract(docket_ref, '([0-9]{2,4})-', 1) AS INTEGER) BETWEEN 20 AND 30""")
def docket_years(spark: SparkSession, d: str) -> DataFrame:
    """Class and year of the docket each document names, within a range of years."""
    year, kind = tx.docket_year(F.col("docket_ref"))
    return table(spark, d, "documents").select("doc_id", year.alias("year"), kind.alias("class")).where("class is not null and year between 20 and 30")


@REG.add("pair_scores", """
WITH p AS (SELECT p_partkey AS id, p_partkey % 3 AS s, p_brand AS b, string_split(p_name, ' ') AS w, p_type AS sponsor, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_type || 'S' ELSE p_type END AS county, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS x, CASE WHEN p_partkey % 5 <> 0 THEN DATE '2024-01-01' + CAST(p_size * 40 AS INTEGER) END AS d FROM part),
q AS (SELECT l.id AS l, r.id AS r, 100.0 * len(list_intersect(l.w, r.w)) / len(list_distinct(list_concat(l.w, r.w))) AS name, CASE WHEN l.sponsor = r.sponsor THEN 100.0 ELSE 20.0 END AS sponsor, l.county AS lc, r.county AS rc, least(l.x, r.x) / greatest(l.x, r.x) AS ratio, abs(datediff('day', l.d, r.d)) AS days, l.x AS lx, r.x AS rx
      FROM p l JOIN p r ON l.b = r.b AND l.s <> r.s AND l.id < r.id AND len(list_intersect(l.w, r.w)) > 0),
c AS (SELECT l, r, CAST(name AS DOUBLE) AS name, CASE WHEN NOT (sponsor < 50 AND name >= 90 AND coalesce(lc = rc, false)) THEN CAST(sponsor AS DOUBLE) END AS sponsor, CASE WHEN lc = rc THEN 100.0 WHEN contains(lc, rc) OR contains(rc, lc) THEN 80.0 WHEN lc IS NOT NULL AND rc IS NOT NULL THEN 0.0 END::DOUBLE AS county,
      CASE WHEN lx IS NOT NULL AND rx IS NOT NULL THEN greatest(0.0, 100 * (ratio - (1 - 0.1::DOUBLE)) / 0.1::DOUBLE) END AS capacity, CASE WHEN days IS NOT NULL THEN greatest(0.0, 100 - days / 3.65::DOUBLE) END AS dates, coalesce(ratio < 0.93::DOUBLE, false) AS far FROM q),
e AS (SELECT *, CASE WHEN name IS NOT NULL THEN 0.4 ELSE 0 END + CASE WHEN sponsor IS NOT NULL THEN 0.25 ELSE 0 END + CASE WHEN county IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN capacity IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN dates IS NOT NULL THEN 0.05 ELSE 0 END AS ev FROM c)
SELECT l, r, round((coalesce(name * 0.4::DOUBLE, 0) + coalesce(sponsor * 0.25::DOUBLE, 0) + coalesce(county * 0.2::DOUBLE, 0) + coalesce(capacity * 0.1::DOUBLE, 0) + coalesce(dates * 0.05::DOUBLE, 0)) / CAST(ev AS DOUBLE), 4) AS score, CAST(round(ev, 2) AS DOUBLE) AS evidence, CASE WHEN far THEN 'capacity' ELSE '' END AS veto,
       ev >= 0.5 AND (coalesce(name * 0.4::DOUBLE, 0) + coalesce(sponsor * 0.25::DOUBLE, 0) + coalesce(county * 0.2::DOUBLE, 0) + coalesce(capacity * 0.1::DOUBLE, 0) + coalesce(dates * 0.05::DOUBLE, 0)) / CAST(ev AS DOUBLE) >= 75 AND NOT far AS accepted FROM e""")
def pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one brand that share a word of their names, across sources: five components, evidence gate and veto."""
    k = F.col("p_partkey")
    county = F.when(k % 4 == 1, F.concat("p_type", F.lit("S"))).when(k % 4 != 0, F.col("p_type"))
    rows = _parts(spark, d).select(
        k.alias("id"), "s", "p_brand", F.split("p_name", " ").alias("w"), F.col("p_type").alias("sponsor"), county.alias("county"), F.when(k % 9 != 0, F.col("p_retailprice")).alias("capacity"),
        F.when(k % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_size") * 40).cast("int"))).alias("date"), F.array().cast("array<int>").alias("phases"),
    )
    shared = {"shared": F.size(F.array_intersect("a.w", "b.w")), "name": 100 * tx.jaccard(F.col("a.w"), F.col("b.w"))}
    apart = (F.col("a.s") != F.col("b.s")) & (F.col("shared") > 0)
    pairs = resolution.listed_pairs(rows, "id", ["p_brand"], None, group=["w", "s"], derived=shared, keep=apart, kept=["sponsor", "county", "capacity", "date", "phases"], list_rows=2 * resolution.LIST_ROWS, written=True)
    parts = resolution.pair_components(F.col("name"), F.when(F.col("left.sponsor") == F.col("right.sponsor"), 100.0).otherwise(20.0))
    far = F.least("left.capacity", "right.capacity") / F.greatest("left.capacity", "right.capacity") < 0.93
    far = F.col("left.capacity").isNotNull() & F.col("right.capacity").isNotNull() & far
    out = resolution.accepted_pairs(pairs, parts, [("capacity", far)])
    return out.select(F.col("left.id").alias("l"), F.col("right.id").alias("r"), F.round("score", 4).alias("score"), F.round("evidence", 2).alias("evidence"), "veto", "accepted")
