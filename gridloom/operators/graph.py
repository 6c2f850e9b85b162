"""Components, closures and order-dependent unions in core queries."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import forget, materialise

#: Pairs of a component that one task walks, about 100 bytes each.
TASK_PAIRS = 100_000


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): each node of an edge with the least node it is joined to.

    Alternating stars: larger neighbours are linked to the least neighbour, then smaller ones, until the edges are
    stars. Each half-round is a minimum per node (combined before the shuffle) and a join on the node, which adaptive
    execution splits where one node has very many edges; every round is written out.
    """
    e = edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    e = materialise(e, "stars")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("m", F.least("_m", "u")).select("u", "m")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        following = materialise(small.where("u <> v").distinct(), "stars")
        moved = following.join(e, ["u", "v"], "left_anti").limit(1).count() + e.join(following, ["u", "v"], "left_anti").limit(1).count()
        forget(e)
        e = following
        if not moved:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def closure(edges: DataFrame, parent: str, child: str, depth: int) -> DataFrame:
    """(ancestor, node, level): every descent of up to ``depth`` steps, each pair once at its least level, cycles cut.

    Joins the newest level only, ``depth`` times at most.
    """
    e = edges.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).select(F.col(parent).alias("p"), F.col(child).alias("c")).distinct()
    found = e.where("p <> c").select(F.col("p").alias("ancestor"), F.col("c").alias("node"), F.lit(1).alias("level"))
    newest = found
    for level in range(2, depth + 1):
        step = newest.join(e, F.col("node") == F.col("p")).select("ancestor", F.col("c").alias("node")).where("ancestor <> node").distinct()
        newest = materialise(step.join(found, ["ancestor", "node"], "left_anti").withColumn("level", F.lit(level)), "closure")
        if not newest.take(1):
            break
        found = found.unionByName(newest)
    return found


def greedy_one_to_one(pairs: DataFrame, left: str, right: str, score: str, rounds: int = 4, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Pairs taken from the best score down, ties by ids, each side once.

    Equal to the sequential rule: a pair that is the best of both its ends is taken there in any order, so rounds of
    mutual best pairs give the same choice. Each round is two maxima and two anti-joins. Chains of falling scores would
    take a round a pair; so what is left after ``rounds`` is cut into its components, those up to ``task_pairs`` pairs
    are walked in a task each, and only larger ones go round further. Repeated pairs count once, at their best score.
    """
    rank = F.struct(F.col(score), (-F.col(left)).alias("_a"), (-F.col(right)).alias("_b"))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.select(left, right, score).schema}
    rest = materialise(pairs.groupBy(left, right).agg(F.max(score).alias(score)), "pairs")
    taken: list[DataFrame] = []

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        used_l, used_r, keep = set(), set(), []
        for i, (x, y) in enumerate(pdf.sort_values([score, left, right], ascending=[False, True, True], ignore_index=True)[[left, right]].itertuples(index=False)):
            if x not in used_l and y not in used_r:
                used_l.add(x)
                used_r.add(y)
                keep.append(i)
        return pdf.sort_values([score, left, right], ascending=[False, True, True], ignore_index=True).iloc[keep][[left, right, score]]

    turn = 0
    while rest.take(1):
        if turn == rounds:
            tag = lambda side, c: F.concat(F.lit(side), F.col(c).cast("string"))
            roots = components(rest.select(tag("l", left).alias("x"), tag("r", right).alias("y")), "x", "y")
            grouped = materialise(rest.join(roots, tag("l", left) == F.col("node")).select(left, right, score, "root"), "grouped")
            sized = grouped.join(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("_n")), "root")
            taken.append(materialise(sized.where(F.col("_n") <= task_pairs).groupBy("root").applyInPandas(walk, ", ".join(f"`{n}` {t}" for n, t in kinds.items())), "best"))
            following = materialise(sized.where(F.col("_n") > task_pairs).select(left, right, score), "pairs")
            forget(grouped)
        else:
            ranked = rest.withColumn("_rank", rank)
            best_l = ranked.groupBy(left).agg(F.max("_rank").alias("_l"))
            best_r = ranked.groupBy(right).agg(F.max("_rank").alias("_r"))
            best = materialise(ranked.join(best_l, left).join(best_r, right).where("_rank = _l and _rank = _r").select(left, right, score), "best")
            taken.append(best)
            following = materialise(rest.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti").select(left, right, score), "pairs")
        forget(rest)
        rest = following
        turn += 1
    out = taken[0] if taken else rest
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def greedy_neighbours(rows: DataFrame, by: Sequence[str], key: str, amount: str, tolerance: float, score: Callable[[np.ndarray], np.ndarray], least: float) -> DataFrame:
    """(l, r, score): ``greedy_one_to_one`` of the pairs within ``by``, the lesser key left, without listing them.

    ``score`` is of the ratio of the lesser to the larger amount, both positive and at most ``tolerance`` of the larger
    apart, and must not fall as it grows; pairs under ``least`` are left out. Each left keeps its best free right on a
    heap and looks again when that is taken. A group is walked in one task, in space in proportion to its rows.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        keys, v = pdf[key].to_numpy(), pdf[amount].to_numpy()
        free = np.ones(len(v), bool)

        def best(i: int) -> tuple | None:
            at = np.flatnonzero(free[i + 1 :]) + i + 1
            small, big = np.minimum(v[i], v[at]), np.maximum(v[i], v[at])
            marks = np.where(small >= big * (1 - tolerance), score(small / big), -np.inf)
            if not len(at) or (top := marks.max()) < least:
                return None
            return (-top, i, at[marks.argmax()])

        heap = [x for i in range(len(v)) if (x := best(i))]
        heapq.heapify(heap)
        taken = []
        while heap:
            mark, i, j = heapq.heappop(heap)
            if free[j]:
                free[j] = False
                taken.append((keys[i], keys[j], -mark))
            elif x := best(i):
                heapq.heappush(heap, x)
        return pd.DataFrame(taken, columns=["l", "r", "score"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(*by).applyInPandas(walk, f"l {kind}, r {kind}, score double")


def vetoed_unions(edges: DataFrame, roots: DataFrame, kinds: DataFrame) -> DataFrame:
    """(node, cluster): unions in score order, refused where the two sides hold conflicting kinds.

    ``edges`` (left, right, score and, if stated, sure: those come first), ``roots`` (node, root) of the unconstrained
    components, ``kinds`` (node, kind; null fits all). Order matters only within a component, so each is walked in its own task; nodes of one component are
    few where edges are matches above a threshold.
    """
    facts = roots.join(kinds, "node", "left").select("node", "kind", F.col("root").alias("component"))
    of = roots.select(F.col("node").alias("left"), F.col("root").alias("walk"))
    sure = F.coalesce("sure", F.lit(False)) if "sure" in edges.columns else F.lit(False)
    e = edges.join(of, "left").select("walk", "left", "right", "score", sure.alias("sure"))

    def walk(es: pd.DataFrame, ns: pd.DataFrame) -> pd.DataFrame:
        parent = {n: n for n in ns["node"]}
        kind = {n: ({k} if isinstance(k, str) else set()) for n, k in zip(ns["node"], ns["kind"], strict=True)}

        def top(n: int) -> int:
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for a, b in es.sort_values(["sure", "score", "left", "right"], ascending=[False, False, True, True])[["left", "right"]].itertuples(index=False):
            x, y = top(a), top(b)
            if x != y and not (kind[x] and kind[y] and kind[x] != kind[y]):
                x, y = min(x, y), max(x, y)
                parent[y] = x
                kind[x] |= kind[y]
        return pd.DataFrame({"node": ns["node"], "cluster": [top(n) for n in ns["node"]]})

    return e.groupBy("walk").cogroup(facts.groupBy("component")).applyInPandas(walk, "node long, cluster long")


def inherited(clusters: DataFrame, prior: DataFrame) -> DataFrame:
    """(cluster, prior_cluster, shared): rebuilt clusters keep the prior id with the largest overlap, each id once."""
    shared = clusters.join(prior, "member").groupBy("cluster", "prior_cluster").agg(F.count(F.lit(1)).alias("shared"))
    return greedy_one_to_one(shared, "cluster", "prior_cluster", "shared")


def chain_root(links: DataFrame, child: str, parent: str, steps: int) -> DataFrame:
    """(node, root): merged-into chains followed to their end, at most 2 ** ``steps`` links, by pointer doubling."""
    state = links.select(F.col(child).alias("node"), F.col(parent).alias("root"))
    for _ in range(steps):
        up = state.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        state = materialise(state.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "chains")
    return state


def row_numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``seq``: 1, 2, 3 … in ``order`` over all rows, from partition counts instead of one sorted task."""
    ordered = materialise(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ordered.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("seq", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_part", "_n", "_start")


def bounded_clusters(pairs: DataFrame, roots: DataFrame, places: DataFrame, widest_m: float) -> DataFrame:
    """(node, cluster): nearest pairs joined first, refused where the joined cluster would be wider than ``widest_m`` or
    would hold two identities.

    ``pairs`` (left, right, metres), ``roots`` (node, root) of the components of the pairs, ``places`` (node, lat, lon
    and, if stated, identity; null fits all). Order matters only within a component, so each is walked in its own
    task. Both sides are within the width already, so only distances across are measured.
    """
    identity = F.col("identity").cast("string") if "identity" in places.columns else F.lit(None).cast("string")
    facts = roots.join(places.withColumn("_who", identity), "node").select("node", "lat", "lon", F.col("_who").alias("who"), F.col("root").alias("component"))
    e = pairs.join(roots.select(F.col("node").alias("left"), F.col("root").alias("walk")), "left").select("walk", "left", "right", "metres")

    def across(a: np.ndarray, b: np.ndarray) -> float:
        h = np.sin((a[:, None, 0] - b[None, :, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[None, :, 0]) * np.sin((a[:, None, 1] - b[None, :, 1]) / 2) ** 2
        return float(2 * 6_371_008.8 * np.arcsin(np.sqrt(np.minimum(1, h))).max())

    def walk(es: pd.DataFrame, ns: pd.DataFrame) -> pd.DataFrame:
        nodes = ns["node"].tolist()
        of = {n: n for n in nodes}
        members = {n: [n] for n in nodes}
        at = {n: np.radians([[la, lo]]) for n, la, lo in ns[["node", "lat", "lon"]].itertuples(index=False)}
        who = {n: {w} if isinstance(w, str) else set() for n, w in zip(nodes, ns["who"], strict=True)}
        for a, b in es.sort_values(["metres", "left", "right"])[["left", "right"]].itertuples(index=False):
            x, y = sorted((of[a], of[b]))
            if x != y and len(who[x] | who[y]) < 2 and across(at[x], at[y]) <= widest_m:
                for n in members[y]:
                    of[n] = x
                members[x] += members.pop(y)
                at[x], who[x] = np.concatenate([at[x], at.pop(y)]), who[x] | who.pop(y)
        return pd.DataFrame({"node": nodes, "cluster": [of[n] for n in nodes]})

    return e.groupBy("walk").cogroup(facts.groupBy("component")).applyInPandas(walk, "node long, cluster long")
