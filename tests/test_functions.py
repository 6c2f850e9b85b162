"""Scalar functions, graph rounds, stores and streams on small frames."""

from __future__ import annotations

import json
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.functions import text as tx
from gridloom.operators import change_data, filters, graph, ranking, resolution, rollup, series
from gridloom.sources import store
from gridloom.streaming import events as st


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column).first()[0]


def test_normalisers(spark):
    c = F.col("c0")
    assert one(spark, tx.slugify(c), "  Ärger & Co. — No. 5 ") == "rger-co-no-5"
    assert one(spark, tx.parse_amount(c), "about £ 1,250.5 million") == 1250.5e6
    assert one(spark, tx.parse_amount(c), "none") is None
    assert one(spark, tx.currency_code(c), "10 eur") == "EUR"
    assert one(spark, tx.voltages(c), "400kV / 132 KV, 400 kv") == [132.0, 400.0]
    assert one(spark, tx.references(c, "[A-Z]{2}[0-9]{2}-[0-9]+"), "er24-10 and ER24-2, ER24-10") == "ER24-10|ER24-2"
    for f in (tx.slugify, tx.parse_amount, tx.legal_form):
        assert one(spark, f(c), None) is None


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_indel_ratio():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(90))) for _ in "ab")
        assert tx.indel_ratio(a, b) == pytest.approx(100 if not a + b else 200 * plain_lcs(a, b) / len(a + b))
    assert tx.token_set_score("b a", "a b") == 100 and tx.token_set_score(None, "x") is None


def test_falling_chain_is_taken_like_one_by_one(spark, rows):
    # Each pair is beaten by the one before it, so mutual best pairs alone would take a round for every second pair.
    chain = [(i // 2, (i + 1) // 2, 100.0 - i) for i in range(60)]
    df = spark.createDataFrame(chain, "l long, r long, s double")
    for limit in (100_000, 10):
        assert rows(graph.greedy_one_to_one(df, "l", "r", "s", rounds=2, task_pairs=limit)) == sorted([p for p in chain if p[0] == p[1]], key=repr)


def test_components_closure_and_unions(spark, rows):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = dict(rows(graph.components(spark.createDataFrame(pairs + pairs[:5], "a long, b long"), "a", "b")))
    assert got == {x: top(x) for x in parent}
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 5), (4, 4)], "p long, c long")
    assert rows(graph.closure(tree, "p", "c", 3)) == sorted([(1, 2, 1), (2, 3, 1), (3, 1, 1), (3, 4, 1), (1, 3, 2), (2, 1, 2), (2, 4, 2), (3, 2, 2), (1, 4, 3)], key=repr)
    cand = [(rng.randrange(12), 100 + rng.randrange(12), rng.randrange(5) / 4) for _ in range(60)]
    cand = list({(a, b): (a, b, s) for a, b, s in cand}.values())
    used, want = set(), []
    for a, b, s in sorted(cand, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, s))
    assert rows(graph.greedy_one_to_one(spark.createDataFrame(cand, "l long, r long, s double"), "l", "r", "s")) == sorted(want, key=repr)
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.95)], "left long, right long, score double")
    kinds = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "b")], "node long, kind string")
    assert rows(graph.vetoed_unions(edges, graph.components(edges, "left", "right"), kinds)) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    chain = spark.createDataFrame([(5, 4), (4, 3), (3, 1)], "c long, p long")
    assert rows(graph.chain_root(chain, "c", "p", 3)) == [(3, 1), (4, 1), (5, 1)]
    numbered = graph.row_numbered(spark.range(500).select((F.col("id") * 7 % 500).alias("x")), "x")
    assert rows(numbered.where("seq <> x + 1")) == [] and numbered.count() == 500


def test_changes_and_pages(spark, rows):
    before = spark.createDataFrame([(1, "filed", "Filed", 10.0), (2, "built", "b", None), (3, None, None, None)], "k long, s string, r string, x double").withColumn("d", F.lit(None).cast("date"))
    after = spark.createDataFrame([(1, "filed", " FILED ", 10.4), (2, "withdrawn", "w", 5.0), (4, "filed", "", 1.0)], "k long, s string, r string, x double").withColumn("d", F.lit(None).cast("date"))
    kinds = sorted((r["event_type"], r["k"]) for r in change_data.diff_events(before, after, "k", "s", "r", "x", "d").collect())
    assert kinds == [("capacity_change", 2), ("new", 4), ("removed", 3), ("withdrawn", 2)]
    page = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0), (4, 5.0), (5, None)], "k long, v double")
    first = [tuple(r) for r in filters.keyset_page(page, "v", "k", 2, ascending=False).collect()]
    assert first == [(3, 7.0), (4, 5.0), (1, 5.0)]
    rest = filters.keyset_page(page, "v", "k", 9, ascending=False, cursor=filters.encode_cursor(5.0, 4))
    assert [tuple(r) for r in rest.collect()] == [(1, 5.0), (5, None), (2, None)]
    tail = filters.keyset_page(page, "v", "k", 9, ascending=False, cursor=filters.encode_cursor(None, 5))
    assert [tuple(r) for r in tail.collect()] == [(2, None)]
    same = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", None)], "k string, v string")
    keys = [r["unique_key"] for r in change_data.disambiguated(same, "k", ["v"]).collect()]
    assert len(set(keys)) == 4 and "b" in keys
    churned = change_data.churn(before, after, "k", "s").first()
    assert tuple(churned) == (3, 2, 1, 1, "not judged")


def test_series_and_bands(spark, rows):
    rng = random.Random(3)
    vals = [(i, rng.choice(["x", "y"]), rng.choice([None, 0.0, -1.0, rng.uniform(1, 9)])) for i in range(150)]
    df = spark.createDataFrame(vals, "k long, b string, v double")
    got = {(r["left"]["k"], r["right"]["k"]) for r in resolution.banded_pairs(df, "k", ["b"], "v", 0.1).collect()}
    want = {(p[0], q[0]) for p in vals for q in vals if p[0] < q[0] and p[1] == q[1] and p[2] and q[2] and p[2] > 0 < q[2] and min(p[2], q[2]) >= max(p[2], q[2]) * 0.9}
    assert got == want
    rates = spark.createDataFrame([(datetime(2024, 1, 5).date(), 1.0), (datetime(2024, 1, 9).date(), 2.0)], "d date, rate double")
    asked = spark.createDataFrame([(i, datetime(2024, 1, i).date()) for i in (1, 5, 8, 9, 20)] + [(99, None)], "i long, at date")
    assert rows(series.as_of(asked, rates, "at", "d", ["rate"]).select("i", "rate")) == sorted([(1, 1.0), (5, 1.0), (8, 1.0), (9, 2.0), (20, 2.0), (99, None)], key=repr)
    hours = spark.createDataFrame([(f"2024-03-10 {h:02d}:00:00", float(h)) for h in range(5, 24)] + [(f"2024-03-11 {h:02d}:00:00", 0.0) for h in range(4)], "t string, v double").withColumn("t", F.to_timestamp("t"))
    day = series.daily_summary(hours.withColumn("k", F.lit(1)), ["k"], "t", "v", "America/New_York").first()
    assert (day["hours"], day["expected_hours"], day["top_mean"]) == (23, 23, 21.5)
    tally = rollup.tallies(spark.createDataFrame([("a", None), ("a", None), ("b", 0.1), ("b", 0.2)], "d string, x double"), ["d"], "x")
    assert [(r["records"], r["stated"], None if r["total"] is None else float(r["total"])) for r in tally.where("d = 'a'").collect()] == [(2, 0, None)]
    score, evidence = resolution.weighted_score({"a": (0.6, F.col("c0").cast("double")), "b": (0.4, F.col("c1").cast("double"))})
    assert one(spark, score, "0.5", None) == pytest.approx(0.5) and one(spark, evidence, "0.5", None) == pytest.approx(0.6)
    assert one(spark, score, None, None) is None
    placed = [(rng.choice(["a", "a", "a", None]), rng.choice([None, *range(60)]), i) for i in range(300)]
    cut = {(r["k"], r["p"], r["i"]): r["run"] for r in ranking.runs(spark.createDataFrame(placed, "k string, p long, i long"), ["k"], F.col("p"), 1, 7, "run", ["i"]).collect()}
    for k in ("a", None):
        number, before = 0, None
        for p, i in sorted((p, i) for kk, p, i in placed if kk == k and p is not None):
            number += before is None or p - before > 1
            before = p
            assert cut[k, p, i] == number
    assert len(cut) == 300 and all(v is None for (k, p, i), v in cut.items() if p is None)
    win = ranking.winners(spark.createDataFrame([(1, "a", 1), (1, None, 9), (1, "b", 2)], "g long, f string, r long"), ["g"], {"f": F.col("r")})
    assert rows(win) == [(1, "b")]


def test_geometry(spark):
    line = [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0), (1.0, 2.0)]
    assert geo.simplify(line, 0.01) == [(0.0, 0.0), (0.0, 2.0), (1.0, 2.0)]
    assert geo.point_to_line_m(0.5, 0.0, [(0.0, -1.0), (0.0, 1.0)]) == pytest.approx(math.radians(0.5) * geo.EARTH_RADIUS_M)
    assert geo.segment_in_box((-1.0, 0.5), (3.0, 0.5), (0, 0, 1, 1)) == ((0.0, 0.5), (1.0, 0.5)) and geo.segment_in_box((-1, 2), (3, 2), (0, 0, 1, 1)) is None
    square, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 0), (4, 0), (4, 4), (2, 4)]
    assert geo.polygon_centroid([square]) == pytest.approx((2, 2)) and geo.polygon_centroid([square, hole]) == pytest.approx((1, 2)) and geo.polygon_centroid([]) is None
    rings = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]
    assert geo.read_wkb(geo.write_wkb(rings)) == {"type": "Polygon", "coordinates": [[list(p) for p in rings[0]]]}
    assert geo.read_wkb(None) is None and geo.read_wkb(b"\x01\x03") is None and geo.read_wkb(b"\x01\x63\x00\x00\x00\x00\x00\x00\x00") is None
    assert geo.chained([[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(5, 5), (6, 6)]]) == [[(0, 0), (1, 0), (2, 0)], [(5, 5), (6, 6)]]
    df = spark.createDataFrame([([{"lon": x, "lat": y} for x, y in line],), (None,)], f"line {geo.LINE}")
    lengths = [r[0] for r in df.select(geo.line_length_m(F.col("line"))).collect()]
    assert lengths[0] == pytest.approx(333_487, rel=2e-3)
    assert [len(r[0]) if r[0] else None for r in df.select(geo.simplified(0.01)("line")).collect()] == [3, None]


def test_matching(spark, rows):
    from gridloom.functions import dates
    from gridloom.operators import matching

    left, right = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string"), spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None)], "k string, v long")
    assert rows(matching.unique_match(left, right, ["k"], "v")) == sorted([("a", 1), ("b", None), ("c", None), (None, None)], key=repr)
    a = spark.createDataFrame([(1, 50.0, 0.0, "x"), (2, 50.0, 1.0, "y"), (3, None, 1.0, "y")], "a long, lat double, lon double, n string")
    b = spark.createDataFrame([(1, 50.0005, 0.0, "x"), (2, 50.001, 0.0, "x"), (9, 50.0, 1.0001, "z")], "b long, lat double, lon double, n string")
    same = F.when(F.col("a.n") == F.col("b.n"), 1.0).otherwise(0.0)
    assert [r[:2] for r in rows(matching.matched_places(a, b, "a", "b", "lat", "lon", same, 500.0, 0.5))] == [(1, 1), (2, 9)]
    assert [r[:2] for r in rows(matching.nearest_site(a, b, "a", "b", "lat", "lon", 500.0))] == [(1, 1), (2, 9)]
    pairs = spark.createDataFrame([(1, 2, 10.0), (2, 3, 20.0)], "left long, right long, metres double")
    places = spark.createDataFrame([(1, 0.0, 0.0001), (2, 0.0, 0.0002), (3, 0.0, 0.0004)], "node long, lat double, lon double")
    of = lambda w: [c for _, c in rows(graph.bounded_clusters(pairs, graph.components(pairs, "left", "right"), places, w))]
    assert (of(1_000.0), of(20.0), of(1.0)) == ([1, 1, 1], [1, 1, 3], [1, 2, 3])
    texts = spark.createDataFrame([("2024",), ("2024-Q3",), ("2024-12",), ("2024-02-29",), ("x",), (None,)], "p string")
    assert [str(r[0]) for r in texts.select(dates.period_end(F.col("p"))).collect()] == ["2025-01-01", "2024-10-01", "2025-01-01", "2024-03-01", "None", "None"]
    old = spark.createDataFrame([("b1", "h", "k1"), ("b1", "h", "k2"), ("b2", "z", "k3")], "base string, h string, k string")
    new = spark.createDataFrame([("b1", "h", "n1"), ("b3", "z", "n3")], "base string, h string, k string")
    assert sorted(r["k"] for r in change_data.aligned_keys(old, new, "base", "h", "k").collect()) == ["k2", "k3", "n1"]


def test_store_and_files(spark, tmp_path, rows):
    s = store.Store(spark, str(tmp_path / "store"))
    frame = spark.createDataFrame([(" 7 ", None), ("8", "x")], "id string, v string")
    stamped = store.stamped(frame, "src", "id", "url", "open", F.lit("2024-01-01"))
    assert sorted(r["record_id"] for r in stamped.collect()) == ["src:7", "src:8"]
    with pytest.raises(Exception, match="has no id"):
        store.stamped(spark.createDataFrame([(" ",)], "id string"), "src", "id", "u", "l", F.lit("t")).collect()
    s.write("src", "20240101", stamped)
    s.write("src", "20240201", stamped.limit(1), status="held")
    assert s.last_promoted("src") == "20240101" and s.previous("src", "20240101") is None and s.previous("src", "20240201").count() == 2
    s.release("src", "20240201")
    assert s.last_promoted("src") == "20240201"
    (tmp_path / "rates.csv").write_text("Date,USD,JPY,\n2024-01-02,1.1,N/A,\n2024-01-01,-1,150,\n")
    assert [(str(a), b, c) for a, b, c in rows(store.read_rates(spark, str(tmp_path / "rates.csv")))] == [("2024-01-01", "JPY", 150.0), ("2024-01-02", "USD", 1.1)]
    store.write_ndjson(frame, str(tmp_path / "nd"))
    assert sorted(json.loads(r[0])["id"] for r in spark.read.text(str(tmp_path / "nd")).collect()) == [" 7 ", "8"]
    store.write_csv(frame, str(tmp_path / "csv"), ["id"], ["id"], 1)
    assert store.read_csv(spark, str(tmp_path / "csv"), "id string").count() == 1
    got = [json.loads(r[0]) for r in store.features(spark.createDataFrame([(1.0, 2.0, "a"), (None, 2.0, "b")], "x double, y double, n string"), "x", "y", ["n"]).collect()]
    assert got[0]["geometry"]["coordinates"] == [1.0, 2.0] and got[1]["geometry"] is None
    monthly = spark.createDataFrame([("s", datetime(2024, 1, 5), 1), ("s", datetime(2024, 2, 5), 2)], "source_id string, at timestamp, v long")
    store.write_by_month(monthly, str(tmp_path / "m"), "at")
    store.write_by_month(monthly.where("v = 2").withColumn("v", F.lit(3)), str(tmp_path / "m"), "at")
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [1, 3]
    store.write_clustered(spark.createDataFrame([(1.0, 2.0), (200.0, 3.0)], "lon double, lat double"), str(tmp_path / "z"), "lon", "lat")
    assert spark.read.parquet(str(tmp_path / "z")).count() == 2


def test_stream_state_over_batches(spark, tmp_path, rows):
    folder = tmp_path / "in" / "t.parquet"
    for i, batch in enumerate([[(1, 10, "a"), (1, 20, "b"), (2, 5, None)], [(1, 15, "late"), (1, 30, "b"), (1, 40, "c")]]):
        df = spark.createDataFrame([(k, datetime.fromtimestamp(s), v) for k, s, v in batch], "k long, at timestamp, v string").coalesce(1)
        df.write.parquet(str(tmp_path / f"b{i}"))
        folder.mkdir(parents=True, exist_ok=True)
        next((tmp_path / f"b{i}").glob("*.parquet")).rename(folder / f"{i}.parquet")
    stream = st.read_table_stream(spark, str(tmp_path / "in"), "t", files_per_batch=1)
    got = st.drain(st.state_changes(stream, "k", "at", "v"), "update", "t").select("key", "before", "after")
    assert rows(got) == sorted([(1, None, "a"), (1, "a", "b"), (1, "b", "c")], key=repr)
    events = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (9, "a")], "seq long, kind string")
    searches = spark.createDataFrame([("s1", "a", 1), ("s2", "z", 0)], "name string, wants string, mark long")
    fresh, moved = st.alerts(events, searches, F.col("kind") == F.col("wants"), "seq", "mark", 5)
    assert rows(fresh.select("name", "seq")) == [("s1", 3)] and rows(moved.select("name", "mark")) == [("s1", 3), ("s2", 3)]
