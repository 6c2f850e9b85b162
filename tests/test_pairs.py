"""Pairs within blocks: lists against brute force, scores worked out once, links instead of all pairs."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators import graph, resolution
from gridloom.plans import texts


def _parts(spark, path, n=160, many=False):
    rng = random.Random(5)
    names = ["red ring", "ring  red", "blue bolt", "Red Ring", "", None, *([" ".join(f"w{i}" for i in range(k)) for k in (61, 62)] if many else [])]
    data = [(k, rng.choice(names), rng.choice(["x", "y", None]), rng.choice(["p", "q", "q", None]), 5, rng.choice([0.0, 100.0, 100.5, 101.0, 105.0, 111.0, 140.0])) for k in range(n)]
    spark.createDataFrame(data, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")
    return data


def test_lists_of_a_block_give_every_pair_once(spark, rows, tmp_path):
    data = _parts(spark, tmp_path)
    df = spark.read.parquet(f"{tmp_path}/part.parquet")
    want = sorted((a[0], b[0], (a[1] == b[1])) for a, b in itertools.combinations(data, 2) if a[2] == b[2] and a[2] and min(a[5], b[5]) > 0 and min(a[5], b[5]) >= max(a[5], b[5]) * 0.9)
    got = resolution.listed_pairs(df, "p_partkey", ["p_brand"], "p_retailprice", 0.1, ["p_name"], {"same": F.col("a.p_name").eqNullSafe(F.col("b.p_name"))}, list_rows=3)
    assert rows(got.select("left.p_partkey", "right.p_partkey", "same")) == sorted(want, key=repr)


def test_amounts_apart_by_the_tolerance_pair(spark, rows):
    step = -math.log(1 - 0.1)
    far = [(float(x), x * (1 - 0.1)) for x in range(1, 20_000) if math.floor(math.log(x) / step) - math.floor(math.log(x * (1 - 0.1)) / step) > 1] or [(1.0, 0.9)]
    df = spark.createDataFrame([(2 * i + j, i, v) for i, two in enumerate(far) for j, v in enumerate(two)], "k long, b long, v double")
    assert resolution.banded_pairs(df, "k", ["b"], "v", 0.1).count() == len(far)


@pytest.mark.parametrize("name", ["token_set_ratio", "token_similarity"])
def test_names_are_compared_before_pairs_are_unfolded(spark, tmp_path, name):
    _parts(spark, tmp_path, 20)
    plan = getattr(texts, name)(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    mark = "ArrowEvalPython" if name == "token_set_ratio" else "array_intersect"
    assert plan.rindex("Generate explode(_xs") < plan.index(mark)


def test_unlike_names_are_not_paired(spark, tmp_path):
    _parts(spark, tmp_path, 20)
    plan = texts.pair_score_accept(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "0.9)" in plan[plan.rindex("Generate explode(_xs"):]


@pytest.mark.parametrize("many", [False, True])
def test_links_join_what_all_pairs_join(spark, rows, tmp_path, many):
    _parts(spark, tmp_path, 160, many)
    d = str(tmp_path)
    every = texts._scored_parts(spark, d, 0.99)
    roots = graph.components(every, "l", "r")
    assert rows(texts.dedupe_clusters(spark, d)) == rows(roots)
    kinds = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("kind"))
    want = graph.vetoed_unions(every.select(F.col("l").alias("left"), F.col("r").alias("right"), "score"), roots, kinds)
    assert rows(texts.kind_veto_clusters(spark, d)) == rows(want)


def test_links_are_fewer_than_parts(spark, tmp_path):
    spark.range(300).selectExpr("id p_partkey", "'red ring' p_name", "'x' p_brand", "'p' p_type", "1 p_size", "100D + id % 3 p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    assert texts._accepted_links(spark, str(tmp_path), 0.99).count() < 300
    assert texts._accepted_links(spark, str(tmp_path), 0.99, kinds=True).count() < 300
    assert tx.token_set_score("red ring", "ring red") == 100


def test_pair_scores_need_no_distinct(spark, tmp_path):
    from gridloom.plans import linkplans

    _parts(spark, tmp_path, 20)
    assert "Aggregate" not in linkplans.pair_scores(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_equal_parts_are_swept_once(spark, rows, tmp_path):
    data = [(k, ("red ring", "blue bolt")[k % 2], "x", (None, "p", "q")[k % 3], 1, 100.0 + k % 5) for k in range(40)]
    spark.createDataFrame(data, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    want = {t: [0, 0, 0, 0] for t in (0.5, 0.7, 0.9)}
    for a, b in itertools.combinations(data, 2):
        score = 0.6 * (a[1] == b[1]) + 0.4 * min(a[5], b[5]) / max(a[5], b[5])
        for t in want:
            want[t][2 * (score < t) + (a[3] is None or a[3] != b[3]) if score >= t else 2 + (a[3] is None or a[3] != b[3])] += 1
    assert rows(texts.precision_recall_sweep(spark, str(tmp_path)).select("threshold", "tp", "fp", "fn", "tn")) == sorted((t, *n) for t, n in want.items())


def test_greedy_neighbours_equal_the_listed_pairs(spark, rows):
    rng = random.Random(3)
    data = [(k, rng.choice("xy"), rng.choice([100.0, 100.0, 101.5, 103.0, 108.0, 112.0, 160.0])) for k in range(60)]
    df = spark.createDataFrame(data, "k long, b string, v double")
    mark = lambda ratio: (0.6 + ratio * 0.4) / (0.6 + 0.4)
    pairs = [(a[0], b[0], mark(min(a[2], b[2]) / max(a[2], b[2]))) for a, b in itertools.combinations(data, 2) if a[1] == b[1] and min(a[2], b[2]) >= max(a[2], b[2]) * 0.9]
    used_l, used_r, want = set(), set(), []
    for l, r, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if s >= 0.97 and l not in used_l and r not in used_r:
            used_l.add(l), used_r.add(r), want.append((l, r, s))
    assert rows(graph.greedy_neighbours(df, ["b"], "k", "v", 0.1, mark, 0.97)) == sorted(want, key=repr)


def test_alike_names_are_those_of_all_pairs(spark, rows):
    from gridloom.operators import linking

    rng = random.Random(2)
    words = ["renewable", "fuels", "ethanol", "llc", "oak", "ridge", "north", "energie", "élan", "oakridge"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 5))).title() for _ in range(120)] + ["", "zzz", "oak oak oak ridge"]
    df = spark.createDataFrame([(n,) for n in (*names, None)], "name string")
    share = lambda a, b: bool({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in a.lower()).split() if len(w) >= 4} & {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in b.lower()).split() if len(w) >= 4})
    want = {(a, b, tx.token_set_score(a, b)) for a in names for b in names if share(a, b) and tx.token_set_score(a, b) >= 85}
    assert set(rows(linking.alike_names(df.withColumnRenamed("name", "_l"), df.withColumnRenamed("name", "_r"), [], 4, 85.0))) == want
    i, *_ = linking._may_reach(names, names, 85.0)
    assert len(want) <= len(i) < len(names) ** 2 / 2
    assert all(tx.indel_to(a)(b) == tx.indel_ratio(a, b) for a in names[-9:] for b in names)


def test_fuzzy_names_need_no_shared_word(spark, rows):
    from gridloom.operators import linking

    left = ["Cargil", "Big Oak LP", "Énergié", "a b c", "Piuga Gooldantulim Bio-Enrgy", "", " ", None]
    right = ["Cargill", "Big Oak LLP", "Énergie", "a b c", "Pirga Goldantulim BioEnergy", "Cargill", "", None]
    a, b = (spark.createDataFrame(list(enumerate(n)), f"{k} int, name string") for n, k in ((left, "l"), (right, "r")))
    want = [(i, j, s) for i, x in enumerate(left) for j, y in enumerate(right) if (s := tx.token_set_score(x, y)) is not None and s >= 85]
    assert len(want) == 6
    assert rows(linking.fuzzy_names(a, "l", b, "r", "name", 85.0)) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["block_pairs", "token_similarity"])
def test_pairs_of_odd_prices_are_those_of_the_sql(spark, rows, tmp_path, name):
    import duckdb

    prices = [0.0, 0.0, -0.0, -5.0, -5.0, 100.0, 95.0, 90.0, 89.99, 111.0, math.inf, math.inf, math.nan, math.nan, None, None, 5e-324, 5e-324, 1e308, 0.0, 85.5, 94.999]
    data = [(k, ["red ring", "blue  ring", None, "Red-ring x"][k % 4], "x", "p", 1, p) for k, p in enumerate(prices)] + [(k, "red ring", b, "p", 1, p) for k, b, p in [(100, None, 5.0), (101, None, None), (102, "y", None), (103, "y", None), (None, "x", 5.0)]]
    spark.createDataFrame(data, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = duckdb.sql(texts.REG.oracles[name]).fetchall()
    assert {(0, 1), (0, 14), (5, 14), (14, 19)} <= {w[:2] for w in want}
    assert rows(getattr(texts, name)(spark, str(tmp_path))) == sorted(want, key=repr)


def test_lists_are_sent_with_what_pairs_need_alone(spark, tmp_path):
    _parts(spark, tmp_path, 20)
    plan = texts.block_pairs(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "struct(p_partkey, p_partkey" in plan and "struct(k, " not in plan


def test_groups_travel_in_one_list(spark, tmp_path):
    _parts(spark, tmp_path, 20)
    plan = texts.token_similarity(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_intersect") < plan.index("posexplode(_ls") < plan.index("RepartitionByExpression")


def test_names_are_scored_before_lists_unfold(spark, rows, tmp_path):
    data = _parts(spark, tmp_path, 90)
    got = texts.token_set_ratio(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("posexplode(_ls") < plan.index("ArrowEvalPython")
    near = lambda a, b: a[2] == b[2] and a[2] and min(a[5], b[5]) >= max(a[5], b[5]) * 0.9
    want = [(a[0], b[0], None if None in (a[1], b[1]) else round(tx.token_set_score(a[1], b[1]), 6)) for a, b in itertools.combinations(data, 2) if near(a, b)]
    assert rows(got) == sorted(want, key=repr)


def test_pair_scores_compare_names_before_rows_unfold(spark, rows, tmp_path):
    import duckdb

    from gridloom.plans import linkplans

    names = ["red ring", "ring red", "blue bolt", "blue  ring", "", None]
    data = [(k, names[k % 6], ("x", "y", None)[k % 7 % 3], ("p", "q", "pS")[k % 5 % 3], k % 9, 100.0 + k % 13) for k in range(80)]
    spark.createDataFrame(data, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = linkplans.pair_scores(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate explode(_xs") < plan.index("array_intersect")
    duckdb.sql(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert rows(got) == sorted(duckdb.sql(linkplans.REG.oracles["pair_scores"]).fetchall(), key=repr)
