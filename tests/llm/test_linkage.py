"""Linkage: comparison on the labelled pairs, windows and assignment against brute force."""

from __future__ import annotations

import itertools
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm.linkage import ACCEPT, _may_share_town, assign, best_assignment, compare, distance, town_key
from gridloom.llm.p2_plants import plant_pairs

LABELS = Path("/root/testdata/sf0.001/ethanol_match_labels.parquet")


@pytest.mark.skipif(not LABELS.exists(), reason="needs the test tables")
def test_labelled_pairs():
    rows = duckdb.sql(f"SELECT name_a, city_a, capacity_a, name_b, city_b, capacity_b, is_same FROM '{LABELS}'").fetchall()
    right = sum((compare(a, town_key(ca), xa, b, town_key(cb), xb)[0] >= ACCEPT) == same for a, ca, xa, b, cb, xb, same in rows)
    assert right / len(rows) >= 0.97


def test_distance():
    assert [distance(a, b, 9) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "abd"), ("", "ab"), ("kitten", "sitting"))] == [0, 1, 1, 2, 3]
    assert distance("aaaa", "bbbb", 2) == 3


def best_total(pairs):
    best = 0.0
    for n in range(len(pairs) + 1):
        for pick in itertools.combinations(pairs, n):
            if len({p[0] for p in pick}) == n == len({p[1] for p in pick}):
                best = max(best, sum(p[2] for p in pick))
    return best


def test_best_assignment_is_best():
    rng = random.Random(8)
    for _ in range(60):
        pairs = list({(a, b): (a, b, rng.random()) for a, b in ((rng.randrange(4), rng.randrange(4)) for _ in range(9))}.values())
        a, b, g = (np.array(x) for x in zip(*pairs, strict=True))
        keep = best_assignment(a, b, g)
        assert len(set(a[keep])) == len(keep) == len(set(b[keep]))
        assert g[keep].sum() == pytest.approx(best_total(pairs))


def test_assign(spark):
    rng = random.Random(9)
    pairs = list({(a, b): (a, b, rng.random()) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60))}.values())
    df = spark.createDataFrame(pairs, "left_id long, right_id long, confidence double").selectExpr("*", "1 AS root")
    a, b, g = (np.array(x) for x in zip(*pairs, strict=True))
    best = g[best_assignment(a, b, g)].sum()
    for limit in (20_000, 5, 0):
        got = assign(df, limit).collect()
        assert len({r["left_id"] for r in got}) == len(got) == len({r["right_id"] for r in got})
        assert {(r["left_id"], r["right_id"], r["confidence"]) for r in got} <= set(pairs)
        assert best - 0.005 * len({p[0] for p in pairs}) <= sum(r["confidence"] for r in got) <= best + 1e-9


def dense(a, b, most):
    """Edit distance with neighbour swaps by the whole table."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return min(d[-1][-1], most + 1)


def test_distance_equals_the_whole_table():
    rng = random.Random(14)
    for _ in range(4_000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        most = rng.randrange(10)
        assert distance(a, b, most) == dense(a, b, most)


def test_plants(spark, rows):
    a = [
        (1, "Limdubel Firtumar BioEnergy Inc", "Veregolgacorford", "US-CO", 40.0), (2, "Limdubel Firtumar Bio Energy", "City of Veregolgacorford", "US-CO", 40.0), (3, "Korva Duna Ethanol LLC", "Sunobelmarton", "US-IA", 55.0),
        (4, "Korva Duna Ethanol LLC", "Belnofirdale", "US-IA", 60.0), (5, None, None, None, None), (6, "", "", "US-IA", float("nan")), (7, "Wezano Pirlu Fuels", "Galoxinport", "US-NE", 100.0), (8, "x" * 5000, "y" * 5000, "US-NE", 1.0),
    ]
    b = [
        (11, "LIMMDUBEL FIRTUMAR BIOENERGY, INC.", "N. Veregolgacorford", "CO", 41.0), (12, "Duna Korva Eth.", None, "IA", 55.0), (13, "Marbel Tupir Ethanol", "Galoxinport", "NE", 100.0),
        (14, "Sister Wezano Pirlu Fuels", "Otherfarhaven", "NE", 100.0), (15, None, None, None, None), (16, "Neighbour Plant Co", "Galoxinport", "NE", 145.0),
    ]
    A = spark.createDataFrame(a, "atlas_id long, name_a string, city_a string, state string, capacity_a double").selectExpr("*", "0 AS side", "1 AS town")
    B = spark.createDataFrame(b, "capacity_id long, name_b string, city_b string, state string, capacity_b double")
    assert rows(plant_pairs(A, B).select("atlas_id", "capacity_id")) == [(1, 11), (2, 11), (3, 12), (7, 13)]
    assert rows(plant_pairs(A.limit(0), B)) == [] and rows(plant_pairs(A, B.limit(0))) == []


def test_town_filter_keeps_all_that_the_comparison_accepts(spark, rows):
    A = spark.createDataFrame([(1, "Limdubel Firtumar Inc", "Erie", "CO", 40.0)], "atlas_id long, name_a string, city_a string, state string, capacity_a double")
    B = spark.createDataFrame([(11, "Limdubel Firtumar Inc", "Eire", "CO", 40.0)], "capacity_id long, name_b string, city_b string, state string, capacity_b double")
    assert rows(plant_pairs(A, B).select("atlas_id", "capacity_id")) == [(1, 11)]
    rng = random.Random(10)
    towns = []
    for _ in range(3_000):
        a = [rng.choice("abcde") for _ in range(rng.randrange(1, 16))]
        b = list(a)
        for _ in range(rng.randrange(7)):
            i = rng.randrange(len(b))
            kind = rng.randrange(4)
            if kind == 0 and i:
                b[i - 1], b[i] = b[i], b[i - 1]
            elif kind == 1 and len(b) > 1:
                del b[i]
            else:
                b[i : i + (kind == 2)] = rng.choice("abcde")
        towns.append(("".join(a), "".join(b)))
    kept = spark.createDataFrame(towns, "a string, b string").where(_may_share_town(F.col("a"), F.col("b"))).collect()
    cut = set(towns) - {tuple(r) for r in kept}
    assert cut and all(compare("Limdubel", a, 40.0, "Limdubel", b, 40.0)[0] == 0 for a, b in cut)
