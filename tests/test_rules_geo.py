"""Rule documents, small functions of names and gates, and geometry columns."""

from __future__ import annotations

import struct
from datetime import date

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo, rules
from gridloom.functions import names as nm
from gridloom.functions import text as tx
from gridloom.operators import gates, linking


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column).first()[0]


def test_rule_documents():
    for bad, message in (('{"rules": [{"name": "a", "all": [["x", "near", 1]]}]}', "unknown test"), ('{"rules": [{"name": "a", "all": []}, {"name": "a", "all": []}]}', "repeated"), ('{"rules": [{"name": "a", "weight": 0, "all": []}]}', "positive")):
        with pytest.raises(ValueError, match=message):
            rules.parse_rules(bad)


def test_bounds():
    assert gates.number_bound("x", " 2.5 ") == 2.5 and gates.number_bound("x", "") is None and gates.value_bounds("1", None) == (1.0, None)
    assert gates.sort_spec("-mw", ["mw"], "mw") == ("mw", False) and gates.sort_spec(None, ["mw"], "mw") == ("mw", True)
    for call in (lambda: gates.number_bound("x", "nan"), lambda: gates.number_bound("x", "a"), lambda: gates.instant_bound("x", "2024-01-01"), lambda: gates.value_bounds("2", "1"), lambda: gates.sort_spec("b", ["a"], "a")):
        with pytest.raises(ValueError, match="."):
            call()


def test_names(spark):
    c = F.col("c0")
    assert one(spark, nm.norm_organisation(c), "The Siouxland Energy & Livestock Co-Op, L.L.C.") == "SIOUXLAND ENERGY AND LIVESTOCK COOPERATIVE"
    assert one(spark, nm.norm_organisation(c), "Shell Renewables Co., L.P. Holdings") == "SHELL RENEWABLE HOLDING"
    assert one(spark, nm.norm_organisation(c), "LLC, Inc.") is None and one(spark, nm.organisation_key(c), " LLC ") == "LLC"
    assert one(spark, nm.norm_project(c), "Sunny Ridge (PJM-1) Solar Project III") == "SUNNY RIDGE"
    assert one(spark, nm.norm_state(c), "new mexico") == "NM" and one(spark, nm.norm_state(c), "N/A") is None
    assert one(spark, nm.phase_numbers(c), "Lazy U Solar 2 Phase III") == [2, 3] and one(spark, nm.phase_numbers(c), "Attentive Energy Two") == [2]
    assert one(spark, nm.tag_voltages(c), "400000; 132000,x;0") == [132.0, 400.0] and one(spark, nm.codes(c), "d4, D3;D4") == ["D3", "D4"]
    assert one(spark, nm.scheme_codes(c), '{"cpv": ["09", "31"], "naics": ["22"]}') == ["cpv:09", "cpv:31", "naics:22"]
    assert one(spark, nm.iso2(c), " Germany ") == "DE" and one(spark, nm.iso2(c), "fr") == "FR" and one(spark, nm.iso2(c), "Atlantis") is None
    assert one(spark, nm.crockford(c), "00000000-0000-0000-0000-00000000001f") == "0" * 25 + "z" and one(spark, nm.crockford(c), "x") is None
    point = one(spark, nm.connection_point(c), "Oak Hill - Big Creek 138 kV line tap")
    assert (point["kv"], point["end_a"], point["end_b"], point["key"]) == (138.0, "BIG CREEK", "OAK HILL", "BIG CREEK - OAK HILL")
    assert one(spark, nm.connection_point(c), "Rainey Substation 345kV Bus #12A")["bus"] == "12A"
    titles = F.from_json(c, "map<string,string>")
    assert one(spark, nm.title_in(titles, ["eng", "fra"]), '{"deu": "d", "fra": "f", "eng": " "}') == "f" and one(spark, nm.title_in(titles, ["eng"]), '{"spa": "s", "deu": "d"}') == "d"
    assert one(spark, nm.looks_like_person(c), "Stone, Mary K.") and not one(spark, nm.looks_like_person(c), "Stone Energy")
    assert one(spark, tx.without_coordinates(c), "at 32.58738, -104.82952 now") == "at [position withheld] now"
    for f in (nm.norm_state, nm.norm_county, nm.norm_project, nm.norm_organisation, nm.place_key, nm.iso2, nm.crockford):
        assert one(spark, f(c), None) is None and one(spark, f(c), "") is None


def test_small_rules(spark):
    c = F.col("c0")
    assert one(spark, rules.clean_json(c), '{"a": NaN, "b": [1,-Infinity]}') == '{"a":null, "b": [1,null]}' and one(spark, rules.clean_json(c), "{") is None
    assert one(spark, rules.retirement(F.lit(None).cast("date"), F.lit(date(2030, 1, 1)), F.lit(date(2024, 1, 1)))) == "set"
    waits = [one(spark, F.unix_micros(rules.next_attempt(F.lit("2024-01-01").cast("timestamp"), F.lit(n))) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) for n in (1, 3)]
    assert waits == [60_000_000, 240_000_000] and one(spark, rules.next_attempt(F.lit("2024-01-01").cast("timestamp"), F.lit(8))) is None
    assert rules.register_functions(spark) and round(spark.sql("SELECT great_circle_m(0, 0, 0, 1)").first()[0]) == 111195
    assert one(spark, F.col("c0"), "x") == "x"


def test_geometry_columns(spark, rows):
    line = [{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 0.0}, {"lon": 1.0, "lat": 1.0}]
    df = spark.createDataFrame([(1, line), (2, None), (3, line[:1])], f"k long, line {geo.LINE}")
    pieces = {r["k"]: r["p"] for r in df.select("k", geo.pieces_of(60_000)("line").alias("p")).collect()}
    assert len(pieces[1]) == 4 and pieces[2] is None and pieces[3] == []
    assert [tuple(map(round, (p[-1]["lon"] * 100, p[-1]["lat"] * 100))) for p in pieces[1]] == [(50, 0), (100, 0), (100, 50), (100, 100)]
    assert len(df.select(geo.clipped_to((0.5, -1.0, 2.0, 0.5))("line")).first()[0]) == 2
    wkt = spark.createDataFrame([("POLYGON((0 0,4 0,4 4,0 4,0 0))",), ("x",), (None,)], "w string").select(geo.centroid_of_wkt(F.col("w")).alias("c"))
    assert [(r["c"]["lon"], r["c"]["lat"]) for r in wkt.collect()] == [(2.0, 2.0), (None, None), (None, None)]
    wkb = spark.createDataFrame([(bytearray(struct.pack("<BI2d", 1, 1, 3.0, 4.0)),), (bytearray(b"x"),), (None,)], "b binary")
    assert [r[0] for r in wkb.select(geo.geojson_of(F.col("b"))).collect()] == ['{"type": "Point", "coordinates": [3.0, 4.0]}', None, None]
    parts = spark.createDataFrame([(1, line[:2]), (1, line[1:][::-1]), (2, line)], f"k long, line {geo.LINE}")
    assert rows(geo.merged_lines(parts, "k", "line").select("key", "part", F.size("line"))) == [(1, 0, 3), (2, 0, 3)]


def test_links_on_edges(spark, rows):
    df = spark.createDataFrame([(1, "a", "x", None), (2, "b", "x", "m"), (3, "b", None, "m"), (4, "a", "", "q")], "k long, s string, i string, j string")
    assert rows(linking.shared_id_links(df, "k", "s", {"i": F.col("i"), "j": F.col("j")})) == [(1, 2, "i")]
    assert rows(linking.shared_id_links(df, "k", "s", {"j": F.col("j")}, across_sources=False)) == [(2, 3, "j")]
    assert rows(linking.shared_id_links(df.limit(0), "k", "s", {"i": F.col("i")})) == []
    texts = spark.createDataFrame([(1, "The Big-Creek tap"), (2, "bigger creek"), (3, None)], "k long, t string")
    needles = spark.createDataFrame([(7, "big creek"), (8, ""), (9, "-"), (10, None)], "n long, w string")
    assert rows(linking.containing(texts, "k", "t", needles, "n", "w")) == [(1, 7)]
    q = spark.createDataFrame([("TX", "oak hill", 138.0), ("TX", "oak hil north", None), ("TX", "elm", None), ("TX", "zzz", None)], "b string, name string, v double")
    n = spark.createDataFrame([("TX", "oak hill", 1, 138.0), ("TX", "oak hill", 2, 345.0), ("TX", "oak hill north", 3, None), ("TX", "elm", 4, None), ("TX", "elm", 5, None), ("NM", "zzz", 6, None)], "b string, name string, node long, v double")
    got = {(r["name"]): (r["node"], r["tier"]) for r in linking.tiered_names(q, n, "b", "name", "node", "v", 80.0, 5.0).collect()}
    assert got == {"oak hill": (1, "exact"), "oak hil north": (3, "fuzzy"), "elm": (None, "ambiguous"), "zzz": (None, "none")}


def test_cache_by_data_version(spark):
    from gridloom.cache import VersionedCache

    now = [0.0]
    cache, built = VersionedCache(most=2, ttl_s=10, clock=lambda: now[0]), []
    get = lambda k, v: cache.get(k, v, lambda: built.append((k, v)) or spark.range(1))
    get("a", 1), get("a", 1), get("a", 2), get("b", 1), get("c", 1)
    assert built == [("a", 1), ("a", 2), ("b", 1), ("c", 1)] and len(cache) == 2
    now[0] = 11.0
    get("c", 1)
    assert built[-1] == ("c", 1) and len(built) == 5


def test_numbers_in_hashes_agree(spark):
    from gridloom.sources.store import content_hash

    df = spark.createDataFrame([("100", "a"), ("100.0", "a"), ("1e2", "a"), ("100.00001", "a"), ("100.01", "a"), ("x", "a"), (None, "a"), ("0", "a")], "n string, t string")
    got = [r[0] for r in df.select(content_hash(["n", "t"], ["n"])).collect()]
    assert len(set(got[:4])) == 1 and len(set(got[3:])) == 5


def test_identities_keep_clusters_apart(spark, rows):
    from gridloom.operators import graph

    places = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 0.0, 0.001, None), (3, 0.0, 0.002, "b")], "node long, lat double, lon double, identity string")
    pairs = spark.createDataFrame([(1, 2, 111.0), (2, 3, 112.0)], "left long, right long, metres double")
    assert rows(graph.bounded_clusters(pairs, graph.components(pairs, "left", "right"), places, 1_000.0)) == [(1, 1), (2, 1), (3, 3)]
    edges = spark.createDataFrame([(1, 2, 100.0, False), (2, 3, 90.0, True)], "left long, right long, score double, sure boolean")
    kinds = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "node long, kind string")
    assert rows(graph.vetoed_unions(edges, graph.components(edges, "left", "right"), kinds)) == [(1, 1), (2, 2), (3, 2)]
