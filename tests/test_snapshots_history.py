"""Snapshot changes and attribute history against plain Python."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from gridloom.operators.history import stitch, versions
from gridloom.operators.snapshots import snapshot_changes

DAY = date(2024, 1, 1)


def test_snapshot_changes(spark, rows):
    rng = random.Random(6)
    days = [DAY + timedelta(days=d) for d in (0, 7, 9, 30, 31)]
    data, state, n = [], {}, 0
    for day in days:
        for delivery in range(rng.choice([1, 2])):
            at = datetime.combine(day, datetime.min.time()) + timedelta(hours=delivery)
            current = {}
            for k in [*"abcdefghij", None]:
                if rng.random() < 0.7:
                    v = rng.choice(["x", "y", None])
                    for _ in range(rng.choice([1, 1, 2])):
                        n += 1
                        data.append((k, day, at, n, v, "extra"))
                    if k:
                        current[k] = v
            state[day] = current
    data.append(("z", None, None, 0, "x", "extra"))
    want = []
    for a, b in zip(days, days[1:], strict=False):
        for k in {*state[a], *state[b]}:
            kind = "added" if k not in state[a] else "removed" if k not in state[b] else "changed" if state[a][k] != state[b][k] else None
            if kind:
                want.append((b, k, kind))
    df = spark.createDataFrame(data, "k string, day date, at timestamp, n long, v string, _seq string")
    assert rows(snapshot_changes(df, ["k"], "day", "at", [F.col("v")], ["n"])) == sorted(want, key=repr)
    assert rows(snapshot_changes(df.limit(0), ["k"], "day", "at", [F.col("v")], ["n"])) == []
    # The last row by n holds where a key is repeated with another content.
    twice = spark.createDataFrame([("k", DAY, None, 1, "a"), ("k", days[1], None, 3, "a"), ("k", days[1], None, 2, "b")], "k string, day date, at timestamp, n long, v string")
    assert rows(snapshot_changes(twice, ["k"], "day", "at", [F.col("v")], ["n"])) == []


def plain_versions(data):
    best = {}
    for k, at, got, n, v in data:
        if k is not None and at is not None:
            rank = (got is not None, got or datetime.min, n)
            if (k, at) not in best or rank > best[k, at][0]:
                best[k, at] = (rank, v)
    out = []
    for k in {k for k, _ in best}:
        runs = []
        for at, v in sorted((at, v[1]) for (kk, at), v in best.items() if kk == k):
            if not runs or runs[-1][1] != v:
                runs.append((at, v))
        us = [int((at - datetime(1970, 1, 1)) / timedelta(microseconds=1)) for at, _ in runs]
        out += [(k, a, b) for a, b in zip(us, [*us[1:], -1], strict=True)]
    return sorted(out, key=repr)


def test_versions(spark, rows):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    data = []
    for i in range(1500):
        k = "hot" if rng.random() < 0.4 else rng.choice([*"abcdef", None])
        at = None if rng.random() < 0.01 else start + timedelta(minutes=rng.randrange(900))
        data.append((k, at, None if rng.random() < 0.05 else start + timedelta(days=rng.randrange(9)), i, rng.choice([None, "x", "y"])))
    df = spark.createDataFrame(data, "k string, at timestamp_ntz, got timestamp_ntz, n long, v string").withColumn("payload", F.lit(1))
    want = plain_versions(data)
    for partitions in (1, 4, 13):  # the hot entity spreads over several
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert rows(versions(df, "k", "at", "got", [F.col("v")], ["n"])) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows(versions(df.limit(0), "k", "at", "got", [F.col("v")], ["n"])) == []


def test_stitch_over_whole_partitions():
    # Three partitions hold one version each of the same entity, the middle one in the same state as the first.
    edges = [("a", "s", 1, -1, 3), ("a", "s", 5, -1, 3), ("a", "t", 9, 12, 1), ("b", "s", 2, -1, 2)]
    assert stitch(edges) == [("a", 1, 9), ("a", 9, 12), ("b", 2, -1)]
