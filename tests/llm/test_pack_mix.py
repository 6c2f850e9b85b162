"""Packing and mixing."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm.mixing import mix, rates
from gridloom.llm.p8_pack import packed_documents
from gridloom.llm.packing import best_plan, pack, plan_with
from gridloom.llm.tokens import VOCABULARY, token_counts


def sequential(sizes, caps, opens):
    """Best fit decreasing one item at a time."""
    boxes = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in boxes if b[0] - b[1] >= s]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += s
        else:
            boxes.append([next((c for c in sorted(caps) if c >= s * opens), max(caps)), s])
    return sum(next(c for c in sorted(caps) if c >= used) for _, used in boxes)


def test_runs_equal_one_item_at_a_time():
    rng = random.Random(10)
    for _ in range(25):
        caps = [16, 50, 100]
        sizes = [rng.randint(1, 100) if rng.random() < 0.7 else rng.choice([7, 33]) for _ in range(rng.randrange(1, 150))]
        counts = defaultdict(int)
        for s in sizes:
            counts[s] += 1
        for opens in (1, 101):
            assert plan_with(list(counts.items()), caps, opens).total == sequential(sizes, caps, opens)
        assert best_plan(list(counts.items()), caps).total >= sum(sizes)


def test_least_cost_opening():
    # 60 leaves 4 of 64 but 36 of 96; two of 45 leave 6 of 96 but 19 of 64.
    assert plan_with([(60, 10)], [64, 96], None).containers == [(0, 10, 60, 64)]
    assert plan_with([(45, 10)], [64, 96], None).containers == [(0, 5, 90, 96)]
    assert best_plan([(60, 10), (45, 10)], [64, 96]).total == 10 * 64 + 5 * 96


def test_pack(spark, rows):
    rng = random.Random(11)
    data = [(i, rng.choice([5, 5, 5, rng.randint(1, 60)])) for i in range(500)] + [(1000, 0), (1001, None), (1002, 250), (1003, 100)]
    df = spark.createDataFrame(data, "k long, n long").selectExpr("*", "1 AS part", "2 AS size")
    got = pack(df, "k", "n", [20, 100, None, 100]).collect()
    boxes, items = defaultdict(list), defaultdict(list)
    for r in got:
        boxes[r["container"]].append(r)
        items[r["key"]].append((r["piece"], r["start"], r["size"]))
    assert {k: sum(p[2] for p in v) for k, v in items.items()} == {k: n for k, n in data if n}
    assert all(len(v) == 1 for k, v in items.items() if k != 1002)
    assert sorted(items[1002]) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    for rs in boxes.values():
        used, caps = sum(r["size"] for r in rs), {r["capacity"] for r in rs}
        assert len(caps) == 1 and used <= (cap := caps.pop()) and (cap == 20 or used > 20)
    total = sum(rs[0]["capacity"] for rs in boxes.values())
    assert sum(n or 0 for _, n in data) / total > 0.97
    assert rows(pack(df.limit(0), "k", "n", [10])) == []
    with pytest.raises(ValueError, match="no capacity"):
        pack(df, "k", "n", [])


def test_token_counts(spark, rows):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "a " * 50_000)], "d long, text string")
    got = dict(rows(token_counts(df, ["d"], "text", VOCABULARY)))
    assert (got[1], got[2], got[3]) == (2, 0, 0) and got[4] > 1 and got[5] > 50_000 - 2
    assert packed_documents(df.withColumnRenamed("d", "doc_id"), spark.createDataFrame([(1, 8), (2, 64)], "spec_id int, capacity_tokens int")).where("tokens > 64").count() == 0


def test_rates():
    plan = {r.source: r.rate for r in rates({"a": 1000, "b": 10, "c": 0}, {"a": (0.5, 2), "b": (0.4, 3), "c": (0.1, 3)}, 1010.0)}
    assert plan == {"a": pytest.approx(0.98), "b": 3.0, "c": 0.0}
    assert rates({}, {}, 0.0) == []


def test_mix(spark, rows):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(3000)] + [(10_000 + i, "b", 10) for i in range(100)] + [(20_000, None, 10), (20_001, "z", 10), (20_002, "a", None), (20_003, "a", 0)], "k long, s string, n long").selectExpr("*", "1 AS rate", "5 AS copies")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 4), ("b", 0.9, 9), ("c", 0.1, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got, plan = mix(docs, "k", "s", "n", targets, seed=3, total=5_000.0)
    per = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert per["b"] == pytest.approx(2000, abs=300) and per["a"] == pytest.approx(3000, abs=300) and set(per) == {"a", "b"}
    assert got.groupBy("key").count().agg(F.max("count")).first()[0] <= 4
    assert rows(got) == rows(mix(docs.repartition(7), "k", "s", "n", targets, seed=3, total=5_000.0)[0])
    assert mix(docs.limit(0), "k", "s", "n", targets)[0].count() == 0 and mix(docs, "k", "s", "n", targets.limit(0))[0].count() == 0
