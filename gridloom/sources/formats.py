"""Readers of workbooks, shapefiles and pages, box-pruned geometry files, monthly reads and feeds.

Binary files are read by ``binaryFile`` and parsed a file at a time in the tasks, so many files spread over the cluster.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def per_file(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]], schema: str, glob: str | None = None) -> DataFrame:
    """(file, columns of ``schema``): the rows that ``parse`` yields for the bytes of each file; a broken file has none."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = list(parse(bytes(content)))
                except (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile, ElementTree.ParseError):
                    continue
                yield pd.DataFrame([(file, *r) for r in rows], columns=["file", *names])

    return files.mapInPandas(run, f"file string, {schema}")


_CELL = re.compile(r"([A-Z]+)(\d+)")


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_rows(content: bytes, sheet: str | None = None, header: int = 0) -> Iterator[tuple[int, dict[str, str]]]:
    """(row, cells by header) of one sheet of an .xlsx workbook, the first if none is named; values as they are stored.

    ``header`` rows come before the one with the names. Cells without a name or a value are left out, as are rows
    without any.
    """
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if local(t) == "t"))
        sheets = [e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"]
        wanted = next(e for e in sheets if sheet is None or e.get("name") == sheet)
        link = next(v for k, v in wanted.attrib.items() if k.endswith("}id"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = rels[link].lstrip("/")
        grid: list[dict[int, str]] = []
        for row in (e for e in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter() if local(e) == "row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(row):
                at = _CELL.match(c.get("r") or "")
                text = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                if text:
                    cells[_column(at[1]) if at else i] = shared[int(text)] if c.get("t") == "s" else text
            grid.append(cells)
    names = {i: n.strip() for i, n in (grid[header] if header < len(grid) else {}).items() if n.strip()}
    for i, cells in enumerate(grid[header + 1 :], header + 1):
        named = {names[k]: v for k, v in cells.items() if k in names and v.strip()}
        if named:
            yield i, named


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None, header: int = 0) -> DataFrame:
    """(file, row, cells map) of the workbooks at ``path``; see ``workbook_rows``."""
    return per_file(spark, path, lambda b: workbook_rows(b, sheet, header), "row int, cells map<string,string>")


def shape_rows(content: bytes, encoding: str = "utf-8") -> Iterator[tuple[int, str, dict[str, str]]]:
    """(row, wkt, attributes) of a zipped shapefile (.shp and .dbf): points, lines and polygons in two dimensions.

    A polygon's rings turn with the clock outside and against it inside; each outer ring opens a piece, and holes go to
    the piece before them. Null shapes have an empty text.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        by = {n.rsplit(".", 1)[-1].lower(): n for n in z.namelist()}
        shp, dbf = z.read(by["shp"]), z.read(by["dbf"]) if "dbf" in by else b""
    fields, records, at = [], [], 32
    if dbf:
        count, head, size = struct.unpack_from("<IHH", dbf, 4)
        while at < head - 1 and dbf[at] != 0x0D:
            fields.append((dbf[at : at + 11].split(b"\0")[0].decode(encoding), dbf[at + 16]))
            at += 32
        for i in range(count):
            start, row = head + i * size + 1, {}
            for name, width in fields:
                value = dbf[start : start + width].decode(encoding, "replace").strip()
                start += width
                if value:
                    row[name] = value
            records.append(row)
    pair = lambda p: f"{p[0]!r} {p[1]!r}"
    at, n = 100, 0
    while at + 8 <= len(shp):
        words = struct.unpack_from(">I", shp, at + 4)[0]
        kind = struct.unpack_from("<I", shp, at + 8)[0]
        wkt = ""
        if kind in (1, 11, 21):
            wkt = f"POINT ({pair(struct.unpack_from('<2d', shp, at + 12))})"
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack_from("<2I", shp, at + 44)
            starts = [*struct.unpack_from(f"<{parts}I", shp, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", shp, at + 52 + 4 * parts)
            rings = [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
            texts = ["(" + ", ".join(map(pair, r)) + ")" for r in rings]
            if kind % 10 == 3:
                wkt = "MULTILINESTRING (" + ", ".join(texts) + ")"
            else:
                pieces: list[list[str]] = []
                for ring, text in zip(rings, texts, strict=True):
                    turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
                    if turn < 0 or not pieces:
                        pieces.append([])
                    pieces[-1].append(text)
                wkt = "MULTIPOLYGON (" + ", ".join("(" + ", ".join(p) + ")" for p in pieces) + ")"
        yield n, wkt, records[n] if n < len(records) else {}
        n += 1
        at += 8 + 2 * words


def read_shapes(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(file, row, wkt, attributes map) of the zipped shapefiles at ``path``."""
    return per_file(spark, path, lambda b: shape_rows(b, encoding), "row int, wkt string, attributes map<string,string>")


class _Page(HTMLParser):
    """Visible text, title and links of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links, self._in = "", [], [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "title", "a"):
            self._in.append(tag)
        if tag == "a":
            self.links.append([dict(attrs).get("href") or "", ""])
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "td"):
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self._in:
            self._in.remove(tag)

    def handle_data(self, data: str) -> None:
        if "script" in self._in or "style" in self._in:
            return
        if "title" in self._in:
            self.title += data
            return
        if "a" in self._in and self.links:
            self.links[-1][1] += data
        self.text.append(data)


def page_facts(html: str | None) -> tuple[str | None, str | None, list[dict[str, str]]]:
    """(title, text, links as href and label) of a page, blanks folded; nothing for a missing page."""
    if html is None:
        return None, None, []
    page = _Page()
    page.feed(html)
    page.close()
    fold = lambda t: " ".join(t.split())
    return fold(page.title) or None, fold("".join(page.text)) or None, [{"href": h, "label": fold(t)} for h, t in page.links if h]


def pages(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, text, links) of a column of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *page_facts(h if isinstance(h, str) else None)) for k, h in zip(pdf["key"], pdf["html"], strict=True)], columns=["key", "title", "text", "links"])

    return df.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {dict(df.dtypes)[key]}, title string, text string, links array<struct<href:string,label:string>>")


def write_boxed(df: DataFrame, path: str, box: tuple[Column, Column, Column, Column]) -> None:
    """Geometries in curve order of their centres with their box (xmin, ymin, xmax, ymax) in a struct ``bbox``.

    Row groups then cover small areas, and their statistics prune what a box filter does not touch.
    """
    from gridloom.operators.spatial import cell_xy, morton, wrap_longitude

    x0, y0, x1, y1 = box
    boxed = df.withColumn("bbox", F.struct(x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax")))
    x, y = cell_xy(wrap_longitude((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2), (F.col("bbox.ymin") + F.col("bbox.ymax")) / 2)
    ordered = boxed.withColumns({"_x": x, "_y": y}).withColumn("_z", morton(F.col("_x"), F.col("_y"))).drop("_x", "_y")
    ordered.repartitionByRange("_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(path)


def read_boxed(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Geometries whose box meets ``box``; the four bounds are pushed down to the row groups."""
    df = spark.read.parquet(path)
    if box is not None:
        x0, y0, x1, y1 = box
        df = df.where((F.col("bbox.xmax") >= x0) & (F.col("bbox.xmin") <= x1) & (F.col("bbox.ymax") >= y0) & (F.col("bbox.ymin") <= y1))
    return df.select(*columns) if columns else df


def read_months(spark: SparkSession, path: str, source_id: str, months: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of some months of one source as ``store.write_by_month`` keeps them: partitions and columns are pruned."""
    df = spark.read.option("basePath", path).parquet(path).where((F.col("source_id") == source_id) & F.col("month").isin(*months))
    return df.select(*columns) if columns else df


def feed_items(df: DataFrame, title: Column, link: Column, at: Column, guid: Column) -> DataFrame:
    """One RSS item a row as XML text, special characters escaped."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c.cast("string"), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), safe(c), F.lit(f"</{name}>"))
    stamp = F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return df.select(F.concat(F.lit("<item>"), tag("title", title), tag("link", link), tag("pubDate", stamp), tag("guid", guid), F.lit("</item>")).alias("value"))


def write_daily_document(df: DataFrame, path: str, day: str) -> None:
    """One JSON document a row for the day, in place of what the day had."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/as_of={day}")


def month_documents(spark: SparkSession, path: str, held: bool = False) -> DataFrame:
    """(period, status, document) of the monthly documents under ``path``/period=…/status=…; held ones only if asked for."""
    df = spark.read.option("basePath", path).option("wholetext", "true").text(path).withColumnRenamed("value", "document")
    df = df.select(F.col("period").cast("string").alias("period"), "status", "document")
    return df if held else df.where("status <> 'held'")


def write_month_document(spark: SparkSession, path: str, period: str, document: str, status: str = "promoted") -> None:
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/period={period}/status={status}")


def named_relations(df: DataFrame, kind: str, kinds: Sequence[str], start: str, end: str) -> DataFrame:
    """Relations of some kinds with both ends stated, each once; the register is read once and filtered in the scan."""
    return df.where(F.col(kind).isin(*kinds) & F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) != F.col(end))).dropDuplicates([start, end, kind])


def folded_milestones(df: DataFrame, project: str, order: Column, status: Column, done: str) -> DataFrame:
    """(project, latest, open, milestones): each project's latest finished milestone and its next open one."""
    row = F.struct(*df.columns)
    g = df.groupBy(project).agg(
        F.max_by(row, F.when(status == done, order)).alias("_done"), F.min_by(row, F.when(status != done, order)).alias("_open"), F.count(F.lit(1)).alias("milestones"), F.count_if(status == done).alias("finished")
    )
    return g.select(project, F.col("_done").alias("latest"), F.col("_open").alias("next"), "milestones", "finished")
