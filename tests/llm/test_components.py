"""Grid components against plain union-find."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm.components import groups, local_roots
from gridloom.llm.p1_groups import proposal_groups


def plain_groups(pairs):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return sorted((x, top(x)) for x in parent)


@pytest.mark.parametrize("per_block", [10**6, 60])
def test_groups(spark, rows, per_block):
    rng = random.Random(per_block)
    pairs = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]  # a chain in the order of its ids
    pairs += [("hub", f"leaf{i}") for i in range(400)] + [(f"r{rng.randrange(300)}", f"r{rng.randrange(300)}") for _ in range(250)]
    pairs = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in pairs]
    data = [*pairs, *pairs[:50], ("self", "self"), (None, "x"), ("y", None)]
    df = spark.createDataFrame(data, "l string, r string").selectExpr("*", "1 AS id", "2 AS root", "'v' AS vertex")
    assert rows(groups(df, "l", "r", per_block)) == plain_groups([p for p in pairs if p[0] != p[1]])


def test_proposals(spark, rows):
    nan = float("nan")
    data = [(" A ", "b", 75.0), ("B", "c ", 99.0), ("d", "e", 74.99), ("f", "g", None), ("h", "i", nan), ("", "j", 80.0), ("k", "K", 80.0), ("m", "l", 80.0), ("l", "m", 80.0)]
    df = spark.createDataFrame(data, "left_proposal_id string, right_proposal_id string, score double")
    assert rows(proposal_groups(df)) == [("a", "a"), ("b", "a"), ("c", "a"), ("l", "l"), ("m", "l")]
    assert rows(proposal_groups(df.limit(0))) == []


def test_local_roots():
    names, roots = local_roots(np.array([5, 7, 1]), np.array([6, 6, 2]))
    assert dict(zip(names.tolist(), roots.tolist(), strict=True)) == {1: 1, 2: 1, 5: 5, 6: 5, 7: 5}


def test_grid_is_used_at_every_size(spark, monkeypatch):
    from gridloom.llm import components

    assert [components._blocks(n, 500_000, 6) for n in (1, 500_000, 8_000_000)] == [3, 3, 6]
    used, plain = [], components._round
    monkeypatch.setattr(components, "_round", lambda edges, count, per_block, blocks: used.append(blocks) or plain(edges, count, per_block, blocks))
    rng = random.Random(12)
    links = [(f"x{i}", f"x{i + 1}") for i in range(400) if i % 50] + [(f"y{rng.randrange(300)}", f"y{rng.randrange(300)}") for _ in range(250)]
    links = [p for p in links if p[0] != p[1]]
    got = sorted((r["id"], r["group_id"]) for r in components.groups(spark.createDataFrame(links, "a string, b string"), "a", "b").collect())
    assert got == plain_groups(links)
    assert used[0] > 1 and used[-1] == 1


def test_chain_in_the_order_of_its_ids_settles(spark, monkeypatch):
    from gridloom.llm import components

    monkeypatch.setattr(components, "MAX_ROUNDS", 30)
    roots = components.component_roots(spark.range(400).selectExpr("id AS u", "id + 1 AS v"), per_block=5).collect()
    assert len(roots) == 400 and len({r["root"] for r in roots}) == 1


def test_clashing_ids_stay_apart(spark, rows):
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("p", "q")]
    df = spark.createDataFrame(pairs, "l string, r string")
    assert rows(groups(df, "l", "r", code=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))) == plain_groups(pairs)


def test_mixing_is_a_permutation(spark):
    from gridloom.llm.components import mixed, unmixed

    v = [0, 1, -1, 2**63 - 1, -(2**63), *range(-500, 500)]
    got = spark.createDataFrame([(x,) for x in set(v)], "v long").select("v", mixed(F.col("v")).alias("m"), unmixed(mixed(F.col("v"))).alias("back")).collect()
    assert all(r["v"] == r["back"] for r in got) and len({r["m"] for r in got}) == len(got)
