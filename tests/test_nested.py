"""Shredding of nested records."""

from __future__ import annotations

import json

from gridloom.operators.shred import Shape, decode, decode_deep, nodes_of, shred, unreadable
from gridloom.plans.p5_nested import TABLES, WHOLE, notice_entities, notice_table

SEARCH = {"data": {"searchParams": {"agencies": "A-1||B-2"}, "oppHits": [{"id": 7, "cfdaList": "10.5"}, None, {}, {"id": None, "cfdaList": ["1", "", None, "2"]}, {"id": "x", "cfdaList": []}]}}
PACKAGE = {"releases": [{"ocid": "o-1", "buyer": "Name only", "tender": {"lots": {"id": "L1", "items": [{"id": 1, "additionalClassifications": {"id": "c"}}, {}]}, "items": [{"classification": {"id": "no"}, "additionalClassifications": None}]}}, {}]}
LONE = {"ocid": "o-2", "buyer": {"name": "B"}, "tender": {"lots": [None, {"id": "2"}]}}


def test_entities(spark, rows):
    deep = "[" * 200_000
    data = [(1, json.dumps(SEARCH)), (2, json.dumps(PACKAGE)), (3, json.dumps(json.dumps(LONE))), (4, "<html>busy</html>"), (5, ""), (6, None), (7, '{"ocid": "cut'), (8, deep), (9, "[]"), (10, "3"), (11, "{}"), (1, json.dumps(SEARCH))]
    df = spark.createDataFrame(data, "raw_id long, payload string").selectExpr("*", "'k' AS key", "0 AS doc")
    got = rows(notice_entities(df))
    search = [
        (1, "agency", "data.searchParams", "data.searchParams.agencies[0]", "A-1"),
        (1, "agency", "data.searchParams", "data.searchParams.agencies[2]", "B-2"),
        (1, "opp_hit", "data", "data.oppHits[0]", "7"),
        (1, "cfda", "data.oppHits[0]", "data.oppHits[0].cfdaList[0]", "10.5"),
        (1, "opp_hit", "data", "data.oppHits[3]", ""),
        (1, "cfda", "data.oppHits[3]", "data.oppHits[3].cfdaList[0]", "1"),
        (1, "cfda", "data.oppHits[3]", "data.oppHits[3].cfdaList[3]", "2"),
        (1, "opp_hit", "data", "data.oppHits[4]", "x"),
    ]
    want = search * 2 + [  # a delivery that is repeated has its rows twice
        (2, "release", "", "releases[0]", "o-1"),
        (2, "buyer", "releases[0]", "releases[0].buyer", ""),
        (2, "lot", "releases[0].tender", "releases[0].tender.lots[0]", "L1"),
        (2, "item", "releases[0].tender.lots[0]", "releases[0].tender.lots[0].items[0]", "1"),
        (2, "classification", "releases[0].tender.lots[0].items[0]", "releases[0].tender.lots[0].items[0].additionalClassifications[0]", "c"),
        (2, "item", "releases[0].tender", "releases[0].tender.items[0]", ""),
        (3, "release", "", "$", "o-2"),
        (3, "buyer", "$", "buyer", ""),
        (3, "lot", "tender", "tender.lots[1]", "2"),
    ]
    assert got == sorted(want, key=repr)
    assert rows(notice_entities(df.limit(0))) == []


def test_adjacency_holds_the_whole_record(spark):
    value = {"a": [1, {"b": True, "c": None}], "d": {"e": "x"}}
    nodes = list(nodes_of(decode(json.dumps(value)), Shape()))
    by = {n[0]: n for n in nodes}
    assert [n[0] for n in nodes] == list(range(len(nodes)))
    assert all(n[1] == -1 or n[1] < n[0] and by[n[1]][4] in ("object", "array") for n in nodes)
    assert {n[6]: n[5] for n in nodes if n[4] == "scalar"} == {"a[0]": "1", "a[1].b": "true", "d.e": "x"}
    assert shred(spark.createDataFrame([(1, json.dumps(value))], "k long, t string"), "k", "t", Shape()).count() == len(nodes)


def test_numbers_stay_as_written():
    assert decode('{"x": 1.50, "y": 12345678901234567890}') == {"x": "1.50", "y": "12345678901234567890"}


def test_entity_tables_hold_every_scalar_once(spark, rows):
    package = {"version": "1.1", "releases": [{"ocid": "o", "tag": ["a", "b"], "buyer": "B", "odd": {"x": [{"y": 5}]}, "tender": {"title": "T", "value": {"amount": 1.50}, "items": [{"id": 1, "classification": {"id": "c"}, "deliveryAddresses": [{"region": "R"}]}]}}]}
    hits = {"data": {"oppHits": [{"id": 7, "title": "t", "closeDate": "", "agencyCode": ["p", "q"], "cfdaList": "10.5"}], "searchParams": {"agencies": "A|B"}}}
    df = spark.createDataFrame([(1, json.dumps(package)), (2, json.dumps(hits)), (3, json.dumps(LONE)), (4, "{")], "raw_id long, payload string")
    release = notice_table(df, "release").select("raw_id", "node_path", "ocid", "tag", "tender_title", "tender_value_amount", "more")
    assert rows(release) == [(1, "releases[0]", "o", ["a", "b"], "T", "1.5", [("odd.x.y", "releases[0].odd.x[0].y", "5")]), (3, "$", "o-2", [], None, None, [])]
    assert rows(notice_table(df, "opp_hit").select("id", "title", "closeDate", "agencyCode", "more")) == [("7", "t", None, None, [("agencyCode", "data.oppHits[0].agencyCode[0]", "p"), ("agencyCode", "data.oppHits[0].agencyCode[1]", "q")])]
    assert rows(notice_table(df, "item").select("parent_path", "id", "classification_id")) == [("releases[0].tender", "1", "c")]
    assert rows(notice_table(df, "cfda").select("parent_path", "number")) == [("data.oppHits[0]", "10.5")]
    total = 0
    for name in TABLES:
        for r in notice_table(df, name).collect():
            named = [v for k, v in r.asDict().items() if k not in ("raw_id", "parent_path", "node_path", "text", "more") and v is not None and not (r["text"] and v == r["text"])]
            total += sum(len(v) if isinstance(v, list) else 1 for v in named) + len(r["more"]) + (r["text"] is not None)
    assert total == sum(n[4] == "scalar" for p in (package, hits, LONE) for n in nodes_of(decode(json.dumps(p)), WHOLE))


def test_any_depth_is_read(spark, rows):
    text = '{"a":[' * 20_000 + "1.50" + "]}" * 20_000
    value, depth = decode(text), 0
    while isinstance(value, dict):
        value, depth = value["a"][0], depth + 1
    assert (depth, value) == (20_000, "1.50")
    wrapped = json.dumps(LONE)
    for _ in range(6):
        wrapped = json.dumps(wrapped)
    df = spark.createDataFrame([(1, wrapped), (2, '{"releases":[{"ocid":"o","x":' + "[" * 3_000 + "]" * 3_000 + "}]}")], "raw_id long, payload string")
    assert [r[:2] + r[4:] for r in rows(notice_entities(df))] == [(1, "buyer", ""), (1, "lot", "2"), (1, "release", "o-2"), (2, "release", "o")]


def test_deep_decoder_equals_the_standard_one():
    good = ['{"a": [1, 2.5e3, -0, true, false, null, "x\\u00e9\\n", {}, [], {"b": {"c": []}}], "d": "e"}', " [ ] ", "3", '"t"', '{"a":1,"a":2}', "[[],[[]],{}]"]
    bad = ["", "{", "[1,]", '{"a"}', '{"a":}', "[1 2]", "tru", "1 2", '{"a":1,}', "{1:2}", "]", '"open', "[1}"]
    for text in good:
        assert decode_deep(text) == json.loads(text, parse_int=str, parse_float=str)
    for text in bad:
        try:
            decode_deep(text)
        except ValueError:
            continue
        raise AssertionError(text)


def test_unreadable(spark, rows):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "<html>"), (4, "{}"), (None, '{"a":')], "k long, t string").selectExpr("*", "'x' AS reason")
    assert rows(unreadable(df, "k", "t")) == sorted([(1, "missing"), (2, "empty"), (3, "broken"), (None, "broken")], key=repr)
    assert rows(unreadable(df.limit(0), "k", "t")) == []
