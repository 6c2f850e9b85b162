"""Groups of records: evidence edges, gates before a merge, reversible merges, leads and labels, tree scopes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.graph import components
from gridloom.operators.spatial import near_pairs
from gridloom.session import forget, materialise


def star_edges(rows: DataFrame, key: str, value: Column, rule: str) -> DataFrame:
    """(left, right, rule): each row with the least row of the same ``value``; null and empty values join nothing."""
    keyed = rows.select(F.col(key).alias("right"), value.cast("string").alias("_v")).where(F.trim("_v") != "")
    least = keyed.groupBy("_v").agg(F.min("right").alias("left"))
    return keyed.join(least, "_v").where(F.col("left") != F.col("right")).select("left", "right", F.lit(rule).alias("rule")).distinct()


def distance_edges(rows: DataFrame, key: str, lat: str, lon: str, metres: float, rule: str) -> DataFrame:
    """(left, right, rule): rows at most ``metres`` apart."""
    return near_pairs(rows, key, lat, lon, metres).select(F.col("left_id").alias("left"), F.col("right_id").alias("right"), F.lit(rule).alias("rule"))


def evidence_groups(edges: DataFrame, strength: Sequence[str]) -> DataFrame:
    """(node, root, strongest, rules): components of the edges, with the strongest rule of each and all its rules, sorted.

    ``strength`` orders the rules, the strongest first.
    """
    edges = materialise(edges.select("left", "right", "rule").distinct(), "edges")
    roots = components(edges, "left", "right")
    rank = reduce(lambda c, x: c.when(F.col("rule") == x[1], x[0]), enumerate(strength), F).otherwise(len(strength))
    facts = edges.join(roots, F.col("left") == F.col("node")).groupBy("root").agg(F.min_by("rule", F.struct(rank, "rule")).alias("strongest"), F.array_join(F.array_sort(F.collect_set("rule")), "|").alias("rules"))
    return roots.join(facts, "root").select("node", "root", "strongest", "rules")


def visible_groups(edges: DataFrame, visible: DataFrame, node: str) -> DataFrame:
    """(node, root) over the edges whose ends are both visible; a visible node without such an edge is alone."""
    shown = visible.select(F.col(node).alias("node")).distinct()
    inside = edges.join(shown.select(F.col("node").alias("left")), "left", "left_semi").join(shown.select(F.col("node").alias("right")), "right", "left_semi")
    roots = components(inside, "left", "right")
    return shown.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def gated_groups(members: DataFrame, group: str, reasons: Mapping[str, Column]) -> DataFrame:
    """(group, members, refused): the first of the grouped conditions that refuses a merge, null where all agree to it."""
    first = reduce(lambda c, kv: c.when(F.col(f"_r_{kv}"), kv), reasons, F)
    g = members.groupBy(group).agg(F.count(F.lit(1)).alias("members"), *[F.coalesce(c, F.lit(False)).alias(f"_r_{n}") for n, c in reasons.items()])
    return g.select(group, "members", first.alias("refused"))


def coherence(members: DataFrame, group: str, family: str, source: str, amount: str, plant: Column) -> DataFrame:
    """(group, family, requested, built, ratio): requests against plant in each family that has both.

    Equal (family, amount) rows of one source count once; families without a counterpart are not judged.
    """
    once = members.where(F.col(amount).isNotNull()).select(group, family, source, amount, plant.alias("_p")).distinct()
    total = lambda c: F.sum(F.when(c, F.col(amount)))
    g = once.groupBy(group, family).agg(total(~F.col("_p")).alias("requested"), total(F.col("_p")).alias("built"))
    return g.where("requested is not null and built is not null and built > 0").withColumn("ratio", F.col("requested") / F.col("built"))


def canonical_member(members: DataFrame, group: str, key: str, preferred: Column, recency: Column) -> DataFrame:
    """(group, canonical): the preferred member, else the most recent, ties to the greater key."""
    return members.groupBy(group).agg(F.max_by(key, F.struct(preferred.cast("int"), recency, key)).alias("canonical"))


def current_merges(log: DataFrame, absorbed: str, canonical: str, action: str, seq: str) -> DataFrame:
    """(absorbed, canonical): what an append-only log of merges and unmerges says now.

    The last entry of an absorbed record holds; an unmerge undoes it, and since entries are never changed the state
    at any earlier entry can be read the same way.
    """
    last = log.groupBy(absorbed).agg(F.max_by(F.struct(canonical, action), seq).alias("_l"))
    return last.where(F.col(f"_l.{action}") == "merge").select(absorbed, F.col(f"_l.{canonical}").alias(canonical))


def led(members: DataFrame, group: str, order: Sequence[Column], labels: Sequence[tuple[str, Column]], key: str, facts: Sequence[str]) -> DataFrame:
    """``members`` with ``lead`` (the first of the group in the total ``order``) and ``label``: the first rule that holds
    between a member and its lead (``lead_<fact>``), ``lead`` for the lead itself."""
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("_k"), *[F.col(f).alias(f"_f_{f}") for f in facts])
    lead = members.groupBy(F.col(group).alias("_g")).agg(F.min(row).alias("_l"))
    joined = members.join(lead, F.col(group) == F.col("_g")).select(*members.columns, F.col("_l._k").alias("lead"), *[F.col(f"_l._f_{f}").alias(f"lead_{f}") for f in facts])
    label = reduce(lambda c, r: c.when(F.coalesce(r[1], F.lit(False)), r[0]), labels, F.when(F.col(key) == F.col("lead"), "lead"))
    return joined.withColumn("label", label.otherwise("other")).drop(*[f"lead_{f}" for f in facts])


def newest_of_each(rows: DataFrame, keys: Sequence[str], recency: Sequence[str]) -> DataFrame:
    """One row for each combination of ``keys`` (null being a value): the most recent. One aggregation."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*recency)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def folded(rows: DataFrame, keys: Sequence[str], start: str, end: str, key: str) -> DataFrame:
    """(keys, key, folded): of rows sharing all ``keys`` the one that lasts longest, ties to the least key, and how many it stands for.

    Rows with a null key column stay for themselves.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    g = rows.where(whole).groupBy(*keys).agg(F.min_by(key, F.struct((-F.date_diff(end, start)).alias("n"), key)).alias(key), F.count(F.lit(1)).alias("folded"))
    return g.unionByName(rows.where(~whole).select(*keys, key, F.lit(1).cast("long").alias("folded")))


def forward_filled(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``df`` with the last stated ``value`` at or before each row within its keys; null before the first.

    Windows hold one key's rows, so the keys should be those of a series.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def scopes(edges: DataFrame, parent: str, child: str, depth: int, stops: DataFrame | None = None) -> DataFrame:
    """(ancestor, node, level, cyclic): every descent up to ``depth``, each pair once at its least level.

    Nodes in ``stops`` (one column; merged or hidden) are not entered. ``cyclic`` tells that a descent from the
    ancestor comes back to it.
    """
    e = edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(F.col(parent).alias("p"), F.col(child).alias("c")).distinct()
    if stops is not None:
        e = e.join(stops.select(F.col(stops.columns[0]).alias("c")).distinct(), "c", "left_anti").select("p", "c")
    e = materialise(e, "tree")
    newest = found = materialise(e.select(F.col("p").alias("ancestor"), F.col("c").alias("node"), F.lit(1).alias("level")), "scope")
    for level in range(2, depth + 1):
        step = newest.where("ancestor <> node").join(e, F.col("node") == F.col("p")).select("ancestor", F.col("c").alias("node")).distinct()
        newest = materialise(step.join(found, ["ancestor", "node"], "left_anti").withColumn("level", F.lit(level)), "scope")
        if not newest.take(1):
            break
        found = found.unionByName(newest)
    forget(e)
    cyclic = found.where("ancestor = node").select(F.col("ancestor").alias("_a")).distinct().withColumn("_c", F.lit(True))
    return found.where("ancestor <> node").join(cyclic, F.col("ancestor") == F.col("_a"), "left").select("ancestor", "node", "level", F.coalesce("_c", F.lit(False)).alias("cyclic"))


def surplus(edges: DataFrame, amounts: DataFrame, tolerance: float) -> DataFrame:
    """(anchor, amount, neighbours, total): anchors whose neighbours' amounts add up to the anchor's, within ``tolerance``
    of it, so that they are its phases and no duplicates. Edges count in both directions; an anchor needs two neighbours."""
    both = edges.select(F.col("left").alias("anchor"), F.col("right").alias("near")).unionByName(edges.select(F.col("right").alias("anchor"), F.col("left").alias("near"))).distinct()
    near = both.join(amounts.select(F.col("node").alias("near"), F.col("amount").alias("_n")), "near")
    total = near.groupBy("anchor").agg(F.count(F.lit(1)).alias("neighbours"), F.sum("_n").alias("total")).where("neighbours >= 2")
    return total.join(amounts.select(F.col("node").alias("anchor"), "amount"), "anchor").where(F.abs(F.col("total") - F.col("amount")) <= F.col("amount") * tolerance).select("anchor", "amount", "neighbours", "total")


def kept_sample(rows: DataFrame, accepted: Column, key: str, n: int) -> DataFrame:
    """All accepted rows and ``n`` of the rest by a hash of their key, the same whenever it is drawn."""
    rest = rows.where(~F.coalesce(accepted, F.lit(False))).orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
    return rows.where(F.coalesce(accepted, F.lit(False))).unionByName(rest)
