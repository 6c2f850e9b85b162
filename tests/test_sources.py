"""Formats against files made here, and runs of a connector from first delivery to release."""

from __future__ import annotations

import io
import struct
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.sources import connectors as cn
from gridloom.sources import formats as fm
from gridloom.sources import store as st


def workbook(rows, shared=True):
    texts: list[str] = []
    lines = []
    for r, row in enumerate(rows, 1):
        cells = ""
        for c, v in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            if v is None:
                continue
            if isinstance(v, str) and shared:
                texts.append(v)
                cells += f'<c r="{at}" t="s"><v>{len(texts) - 1}</v></c>'
            elif isinstance(v, str):
                cells += f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
            else:
                cells += f'<c r="{at}"><v>{v}</v></c>'
        lines.append(f'<row r="{r}">{cells}</row>')
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Notes" sheetId="1" r:id="rId9"/><sheet name="Queue" sheetId="2" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet2.xml"/><Relationship Id="rId9" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{t[:2]}</t></r><r><t>{t[2:]}</t></r></si>" for t in texts) + "</sst>")
    return out.getvalue()


@pytest.mark.parametrize("shared", [True, False])
def test_workbooks(spark, rows, tmp_path, shared):
    (tmp_path / "a.xlsx").write_bytes(workbook([["Report of today"], ["Id", " MW ", None, "Name"], ["q1", 12.5, "lost", "Sunny"], [None, None], ["q2", None, None, "Windy"]], shared))
    (tmp_path / "broken.xlsx").write_bytes(b"no workbook")
    got = [(r["row"], r["cells"]) for r in fm.read_workbooks(spark, str(tmp_path), "Queue", header=1).collect()]
    assert sorted(got) == [(2, {"Id": "q1", "MW": "12.5", "Name": "Sunny"}), (4, {"Id": "q2", "Name": "Windy"})]
    assert fm.read_workbooks(spark, str(tmp_path)).count() == 0  # the first sheet is empty


def shapefile(shapes, attributes):
    body = b""
    for i, (kind, rings) in enumerate(shapes):
        if kind == 0:
            content = struct.pack("<I", 0)
        elif kind == 1:
            content = struct.pack("<I2d", 1, *rings)
        else:
            flat = [v for r in rings for p in r for v in p]
            starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
            content = struct.pack(f"<I4d2I{len(rings)}I{len(flat)}d", kind, 0, 0, 0, 0, len(rings), len(flat) // 2, *starts, *flat)
        body += struct.pack(">2I", i + 1, len(content) // 2) + content
    width = 10
    header = struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(attributes), 32 + 32 + 1, 1 + width) + b"NAME".ljust(11, b"\0") + b"C" + struct.pack("<4xBB14x", width, 0) + b"\r"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x/a.shp", bytes(100) + body)
        z.writestr("x/a.dbf", header + b"".join(b" " + a.encode().ljust(width) for a in attributes))
    return out.getvalue()


def test_shapes(spark, tmp_path):
    outer, hole, island = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)], [(9, 9), (9, 10), (10, 10), (9, 9)]
    (tmp_path / "a.zip").write_bytes(shapefile([(5, [outer, hole, island]), (1, (3.5, -2.0)), (0, None), (3, [[(0, 0), (1, 1)]])], ["Kent", "", "Ö", "line"]))
    got = {r["row"]: (r["wkt"], r["attributes"]) for r in fm.read_shapes(spark, str(tmp_path)).collect()}
    from gridloom.operators.spatial import parse_wkt

    assert [[len(r) for r in p] for p in parse_wkt(got[0][0])] == [[5, 5], [4]] and got[0][1] == {"NAME": "Kent"}
    assert got[1] == ("POINT (3.5 -2.0)", {}) and got[2][0] == "" and got[3][0].startswith("MULTILINESTRING")


def test_pages(spark, rows):
    html = "<title>A &amp; B</title><script>x('<p>')</script><p>Call  for <b>tenders</b><br>now <a href='/t/1'>Tender\n1</a><a>no</a>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "k long, h string").selectExpr("*", "1 AS key", "'t' AS html")
    got = {r["key"]: r for r in fm.pages(df, "k", "h").collect()}
    assert (got[1]["title"], got[1]["text"], [tuple(x) for x in got[1]["links"]]) == ("A & B", "Call for tenders now Tender 1no", [("/t/1", "Tender 1")])
    assert got[2]["title"] is None and got[3]["links"] == []


def test_boxes_months_and_documents(spark, rows, tmp_path):
    df = spark.range(200).select("id", (F.col("id") - 100).cast("double").alias("x"), (F.col("id") % 40).cast("double").alias("y"))
    box = (F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1)
    fm.write_boxed(df, str(tmp_path / "boxed"), box)
    read = fm.read_boxed(spark, str(tmp_path / "boxed"), (-0.5, 0.0, 3.5, 30.0), ["id"])
    assert set(rows(read)) == set((i,) for i in range(200) if i - 99 >= -0.5 and i - 100 <= 3.5 and i % 40 <= 30)
    assert "PushedFilters: [IsNotNull(bbox" in read._jdf.queryExecution().toString()
    at = df.select(F.lit("s").alias("source_id"), "id", F.expr("timestamp'2024-01-15' + make_interval(0, int(id % 3))").alias("at"))
    st.write_by_month(at, str(tmp_path / "months"), "at")
    assert fm.read_months(spark, str(tmp_path / "months"), "s", ["2024-02", "2024-03"], ["id"]).count() == 133
    for period, status in (("2024-01", "promoted"), ("2024-02", "held")):
        fm.write_month_document(spark, str(tmp_path / "docs"), period, '{"n": 1}', status)
    assert rows(fm.month_documents(spark, str(tmp_path / "docs")).select("period")) == [("2024-01",)]
    assert fm.month_documents(spark, str(tmp_path / "docs"), held=True).count() == 2
    fm.write_daily_document(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "trend"), "2024-05-01")
    assert [r[0] for r in spark.read.text(str(tmp_path / "trend")).select("value").collect()] == ['{"a":1,"b":null}']
    item = fm.feed_items(spark.createDataFrame([("a < b & c",)], "t string"), F.col("t"), F.lit("u"), F.lit("2024-05-01 10:00:00").cast("timestamp"), F.lit("g")).first()[0]
    assert item == "<item><title>a &lt; b &amp; c</title><link>u</link><pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate><guid>g</guid></item>"


def _read(spark, path):
    return spark.read.json(path, schema="id string, state string, mw double, day date")


def _normalise(df):
    return df.select("id", F.lower("state").alias("state"), F.col("state").alias("raw_state"), "mw", "day")


SOURCE = cn.Connector("reg", "open", _read, _normalise, "id", "state", "raw_state", "mw", "day", removal="delisted")


def test_run_from_first_delivery_to_release(spark, rows, tmp_path):
    store = st.Store(spark, str(tmp_path / "store"))

    def deliver(name, data):
        spark.createDataFrame(data, "id string, state string, mw double, day date").write.json(str(tmp_path / name))
        return str(tmp_path / name)

    base = [(f"p{i}", "Filed", 10.0, None) for i in range(60)]
    assert cn.run(store, SOURCE, "t1", deliver("a", base))["status"] == "promoted"
    assert cn.run(store, SOURCE, "t2", deliver("b", base[::-1])) == {"status": "unchanged", "events": 0}
    changed = [("p0", "Built", 10.0, None), ("p1", "Filed", 20.0, None), *base[2:59], ("new", "Filed", None, None)]
    assert cn.run(store, SOURCE, "t3", deliver("c", changed))["events"] == 4
    assert rows(store.events("reg", "t3").select("event_type", "id")) == [("capacity_change", "p1"), ("delisted", "p59"), ("new", "new"), ("status_change", "p0")]
    held = cn.run(store, SOURCE, "t4", deliver("d", base[:20]))
    assert (held["status"], held["verdicts"]["rows"], held["verdicts"]["churn"]) == ("held", "hold", "hold")
    assert store.last_promoted("reg") == "t3" and store.to_load("reg", "t1") == ["t3"]
    store.release("reg", "t4")
    assert store.last_promoted("reg") == "t4"
    assert cn.run(store, SOURCE, "t5", deliver("e", [*base[:20], base[0]]))["verdicts"]["duplicates"] == "hold"


def test_restricted_incremental_and_restated(spark, rows, tmp_path):
    from dataclasses import replace

    store = st.Store(spark, str(tmp_path / "store"))
    closed = replace(SOURCE, source_id="closed", restricted=True)
    spark.createDataFrame([("a", "X", 1.0, None)], "id string, state string, mw double, day date").write.json(str(tmp_path / "a"))
    with pytest.raises(PermissionError):
        cn.run(store, closed, "t1", str(tmp_path / "a"))
    assert cn.run(store, closed, "t1", str(tmp_path / "a"), allow_restricted=True)["status"] == "promoted" and store.last_promoted("closed") is None
    window = replace(SOURCE, source_id="win", incremental=True)
    cn.run(store, window, "t1", str(tmp_path / "a"))
    spark.createDataFrame([("b", "Y", 1.0, None)], "id string, state string, mw double, day date").write.json(str(tmp_path / "b"))
    cn.run(store, window, "t2", str(tmp_path / "b"))
    assert rows(store.read("win", "t2").select("id")) == [("a",), ("b",)] and rows(store.events("win", "t2").select("event_type")) == [("new",)]
    # A new rule for the state is applied to the older frame as well, so it makes no event.
    ruled = replace(SOURCE, source_id="win", incremental=True, normalise=lambda df: _normalise(df).withColumn("state", F.lit("z")), restate=lambda df: df.withColumn("state", F.lit("z")))
    assert cn.run(store, ruled, "t3", str(tmp_path / "b"))["events"] == 0


def test_registry_windows_and_objects(spark, rows, tmp_path):
    sources = cn.Sources()
    sources.add(SOURCE, rate=1)
    with pytest.raises(ValueError, match="twice"):
        sources.add(SOURCE)
    with pytest.raises(ValueError, match="unknown source"):
        sources.with_manifest('{"other": {}}')
    assert rows(sources.with_manifest('{"reg": {"gate": "open"}}').frame(spark).select("source_id", "facts.gate", "facts.rate")) == [("reg", "open", "1")]
    now, day = datetime(2024, 5, 10), timedelta(days=1)
    assert cn.fetch_window(datetime(2024, 5, 8), now, day, 30 * day) == (datetime(2024, 5, 7), now)
    assert cn.fetch_window(datetime(2024, 1, 1), now, day, 30 * day) == (datetime(2023, 12, 31), datetime(2024, 1, 30))
    assert cn.fetch_window(None, now, day, 30 * day) == (now - 30 * day, now)
    assert cn.removal_event("withdrawn") == "withdrawn" and cn.removal_event("withdrawn", False) is None and cn.removal_event(None) is None
    objects = cn.Objects(spark, f"file://{tmp_path}/objects")
    objects.put("a/b.bin", b"\x00\xff12")
    objects.put("a/c.bin", b"")
    assert objects.get("a/b.bin") == b"\x00\xff12" and objects.names() == ["a/b.bin", "a/c.bin"] and objects.names("z") == []
    with pytest.raises(Exception, match="(?i)exist"):
        objects.put("a/b.bin", b"")
