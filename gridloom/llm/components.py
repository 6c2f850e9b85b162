"""Connected components of billions of pairs on a two-dimensional grid.

Vertices are hashed to ``B`` blocks. A round

1. puts each edge into the partition of its pair of blocks and runs union-find there, which leaves a forest of stars
   (vertex, local representative);
2. exchanges the representatives along rows and columns: all that a vertex has, one from each partition it lies in and
   so at most 2B - 1 however many edges it has, meet in one place. The least becomes its parent, and the others are
   linked to that parent. A vertex that represents nobody is a leaf: it leaves the graph with its parent noted;

until no edge is left. Then the parents are followed back from the last round to the first. Vertices go round under
a keyed permutation of the 64-bit numbers, so their order is random, a chain loses about a third of its vertices a
round whatever its ids, and no two vertices can clash. The first round has block pairs for all tasks that can run at
once, whatever the number of edges; later ones as many as their edges need, so once few are left a single round ends
it. A block pair that holds more edges than its share (a hot vertex) is cut into slices, since any split of the edges
is sound.

Every round is written to the shared checkpoint folder: no plan grows and a lost executor costs one re-read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import forget, materialise

#: Edges of one block pair; 16 bytes each and about ten times that while they are joined.
EDGES_PER_BLOCK = 500_000
#: Rounds of the permutation of vertices; four make a pseudo-random one.
MIXES = 4
#: A chain of 10^12 vertices takes fewer rounds; more would mean a fault.
MAX_ROUNDS = 100


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges (u, v), ascending, and the least vertex of each one's component."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    parent = np.arange(len(names))
    while len(a):
        lo, hi = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        live = lo != hi
        if not live.any():
            break
        a, b, lo, hi = a[live], b[live], lo[live], hi[live]
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return names, names[parent]


def _stars(pdf: pd.DataFrame) -> pd.DataFrame:
    """(vertex, rep, own) of one grid cell: a row for each child, and one with own = 1 for each representative."""
    names, roots = local_roots(pdf["u"].to_numpy(), pdf["v"].to_numpy())
    return pd.DataFrame({"vertex": names, "rep": roots, "own": (names == roots).astype("int32")})


def _block(c: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


def _blocks(count: int, per_block: int, slots: int = 1) -> int:
    """B such that no block pair has more than its share of edges and there are ``slots`` block pairs at least."""
    by_edges = math.ceil(math.sqrt(2 * count / per_block)) if count > per_block else 1
    return max(by_edges, math.ceil((math.sqrt(8 * slots + 1) - 1) / 2))


def _half(x: Column, key: int) -> Column:
    return F.xxhash64(x, F.lit(key)).bitwiseAND(F.lit(0xFFFFFFFF))


def mixed(v: Column) -> Column:
    """A permutation of the longs (a Feistel network over their halves) that leaves no trace of their order."""
    left, right = F.shiftrightunsigned(v, 32), v.bitwiseAND(F.lit(0xFFFFFFFF))
    for key in range(MIXES):
        left, right = right, left.bitwiseXOR(_half(right, key))
    return F.shiftleft(left, 32).bitwiseOR(right)


def unmixed(v: Column) -> Column:
    """The inverse of ``mixed``."""
    left, right = F.shiftrightunsigned(v, 32), v.bitwiseAND(F.lit(0xFFFFFFFF))
    for key in reversed(range(MIXES)):
        left, right = right.bitwiseXOR(_half(left, key)), left
    return F.shiftleft(left, 32).bitwiseOR(right)


def _round(edges: DataFrame, count: int, per_block: int, blocks: int) -> DataFrame:
    """(vertex, reps, own) after the local union-find and the exchange; reps are sorted."""
    gridded = edges.withColumns({"bu": _block(F.col("u"), blocks), "bv": _block(F.col("v"), blocks)})
    gridded = gridded.select("u", "v", F.least("bu", "bv").alias("row"), F.greatest("bu", "bv").alias("col"))
    if blocks == 1:
        gridded = gridded.withColumn("slice", F.lit(0).cast("long"))
    else:
        # One row for each pair of blocks, so about 2 * count / per_block short rows.
        loads = gridded.groupBy("row", "col").agg(F.ceil(F.count(F.lit(1)) / per_block).alias("slices"))
        gridded = gridded.join(loads, ["row", "col"]).withColumn("slice", F.pmod(F.xxhash64("u", "v"), F.col("slices")))
    stars = gridded.groupBy("row", "col", "slice").applyInPandas(_stars, "vertex long, rep long, own int")
    return stars.groupBy("vertex").agg(F.array_sort(F.collect_set(F.when(F.col("own") == 0, F.col("rep")))).alias("reps"), F.max("own").alias("own"))


def _contracted(edges: DataFrame, per_block: int, slots: int) -> DataFrame:
    """``component_roots`` of vertices whose order is random."""
    parents: list[DataFrame] = []
    written: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        count = edges.count()
        if not count:
            break
        blocks = _blocks(count, per_block, 1 if turn else slots)
        state = materialise(_round(edges, count, per_block, blocks), "components")
        leaf = (F.size("reps") > 0) & (F.col("own") == 0)
        parents.append(state.where(leaf).select("vertex", F.col("reps")[0].alias("root")))
        if blocks == 1:
            break  # one partition saw every edge, so every vertex has its root
        links = F.concat(
            F.transform(F.slice("reps", 2, F.greatest(F.size("reps") - 1, F.lit(0))), lambda r: F.struct(F.col("reps")[0].alias("u"), r.alias("v"))),
            F.when((F.col("own") == 1) & (F.size("reps") > 0), F.array(F.struct(F.col("reps")[0].alias("u"), F.col("vertex").alias("v")))).otherwise(F.array()),
        )
        following = materialise(state.select(F.inline(links)).distinct(), "edges")
        forget(*written[-1:])
        written.append(following)
        edges = following
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    forget(*written)
    if not parents:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    # A leaf's parent stays in the graph until a later round or for good, so later labels hold for earlier parents.
    labels = parents[-1]
    for earlier in reversed(parents[:-1]):
        later = labels.select(F.col("vertex").alias("_v"), F.col("root").alias("_r"))
        followed = earlier.join(later, F.col("root") == F.col("_v"), "left").select("vertex", F.coalesce("_r", "root").alias("root"))
        labels = materialise(labels.unionByName(followed), "labels") if len(parents) > 6 else labels.unionByName(followed)
    return labels


def component_roots(edges: DataFrame, per_block: int = EDGES_PER_BLOCK, slots: int | None = None) -> DataFrame:
    """(vertex, root) of every vertex that is not its component's root, from ``edges`` (u, v: long, u <> v).

    Any ids will do, in any order. The input should be written out or cheap: it is read twice, once for its count.
    ``slots``: block pairs of the first round at least, by default the tasks that can run at once.
    """
    slots = edges.sparkSession.sparkContext.defaultParallelism if slots is None else slots
    roots = _contracted(edges.select(mixed(F.col("u")).alias("u"), mixed(F.col("v")).alias("v")), per_block, slots)
    return roots.select(unmixed(F.col("vertex")).alias("vertex"), unmixed(F.col("root")).alias("root"))


def numbered(names: DataFrame, pairs: DataFrame, code: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, vertex) and edges (u, v) of distinct ``names`` (id) and ``pairs`` (a, b), ids as longs.

    The number is ``code`` of the id, a 64-bit hash, as long as no two ids share one, which is looked for; with many
    billions of ids some will, and then each id gets a number of its own and the pairs are joined to the numbers.
    """
    vertices = materialise(names.withColumn("vertex", code(F.col("id"))), "names")
    if not vertices.groupBy("vertex").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        return vertices, pairs.select(code(F.col("a")).alias("u"), code(F.col("b")).alias("v"))
    # Numbers are those of the written rows, so they hold however often they are read.
    again = materialise(vertices.select("id").withColumn("vertex", F.monotonically_increasing_id()), "names")
    forget(vertices)
    end = lambda c, n: again.select(F.col("id").alias(c), F.col("vertex").alias(n))
    return again, materialise(pairs.join(end("a", "u"), "a").join(end("b", "v"), "b").select("u", "v"), "links")


def groups(links: DataFrame, left: str, right: str, per_block: int = EDGES_PER_BLOCK, code: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, group_id): each id in a link with the least id of its group, in text order.

    Links with a null end or two equal ends count for nothing; repeats and either order make no difference. ``code``
    is the hash that numbers the ids (see ``numbered``, which stays exact where ids clash).
    """
    pairs = links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    pairs = materialise(pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct(), "links")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    names, edges = numbered(ids, pairs, code)
    roots = component_roots(edges, per_block)
    labelled = names.join(roots, "vertex", "left").select("id", F.coalesce("root", "vertex").alias("root"))
    least = labelled.groupBy("root").agg(F.min("id").alias("group_id"))
    return labelled.join(least, "root").select("id", "group_id")
