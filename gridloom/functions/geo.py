"""Polyline and grid kernels as column expressions and Arrow functions."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.operators.spatial import EARTH_RADIUS_M, haversine_m

LINE = "array<struct<lon:double,lat:double>>"


def line_length_m(line: Column) -> Column:
    """Great-circle length of an array of points; 0 for fewer than two."""
    legs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def grid_cell(lon: Column, lat: Column, size: float) -> Column:
    """Cell (x, y) of a square grid in degrees."""
    return F.struct(F.floor(lon / size).alias("x"), F.floor(lat / size).alias("y"))


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas–Peucker without recursion: ends stay, inner points stay where they are further than ``tolerance`` off."""
    if len(points) < 3:
        return points
    keep = {0, len(points) - 1}
    stack = [(0, len(points) - 1)]
    xy = np.array(points, dtype=float)
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q, inner = xy[a], xy[b], xy[a + 1 : b]
        d = q - p
        span = float(d @ d)
        t = np.clip(((inner - p) @ d) / span, 0, 1) if span else np.zeros(len(inner))
        off = np.hypot(*(inner - (p + t[:, None] * d)).T)
        i = int(off.argmax())
        if off[i] > tolerance:
            keep.add(a + 1 + i)
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return [points[i] for i in sorted(keep)]


def simplified(tolerance: float):  # noqa: ANN201
    """An Arrow function that simplifies a column of lines."""

    @F.pandas_udf(LINE)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: None if line is None else [{"lon": x, "lat": y} for x, y in simplify([(p["lon"], p["lat"]) for p in line], tolerance)])

    return run


def point_to_line_m(lon: float, lat: float, line: list[tuple[float, float]]) -> float:
    """Metres from a point to the nearest leg, on a plane at the point's latitude; infinite for an empty line."""
    if not line:
        return math.inf
    k = math.cos(math.radians(lat))
    xy = np.array([((x - lon) * k, y - lat) for x, y in line]) * math.radians(1) * EARTH_RADIUS_M
    if len(xy) == 1:
        return float(np.hypot(*xy[0]))
    a, d = xy[:-1], np.diff(xy, axis=0)
    span = (d * d).sum(axis=1)
    t = np.clip(np.where(span > 0, -(a * d).sum(axis=1) / np.where(span > 0, span, 1), 0), 0, 1)
    return float(np.hypot(*(a + t[:, None] * d).T).min())


def distance_to_line(lon: Column, lat: Column, line: Column) -> Column:
    """``point_to_line_m`` over columns in Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([None if ln is None or a != a or b != b else point_to_line_m(a, b, [(p["lon"], p["lat"]) for p in ln]) for a, b, ln in zip(x, y, lines, strict=True)], dtype="float64")

    return run(lon, lat, line)


def segment_in_box(a: tuple[float, float], b: tuple[float, float], box: tuple[float, float, float, float]) -> tuple[tuple[float, float], tuple[float, float]] | None:
    """The part of a segment inside a closed box (x0, y0, x1, y1), None if it misses the box."""
    enter, leave = 0.0, 1.0
    for axis in (0, 1):
        d = b[axis] - a[axis]
        lo, hi = box[axis], box[axis + 2]
        if d == 0:
            if not lo <= a[axis] <= hi:
                return None
            continue
        s, t = (lo - a[axis]) / d, (hi - a[axis]) / d
        enter, leave = max(enter, min(s, t)), min(leave, max(s, t))
    if enter > leave:
        return None
    at = lambda t: (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
    return at(enter), at(leave)


def polygon_centroid(rings: list[list[tuple[float, float]]]) -> tuple[float, float] | None:
    """Area-weighted centre of an outer ring and its holes; the mean of the corners where there is no area."""
    if not rings or not rings[0]:
        return None
    total = cx = cy = 0.0
    for i, ring in enumerate(rings):
        p = np.array(ring, dtype=float)
        if len(p) < 3:
            continue
        q = np.roll(p, -1, axis=0)
        cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
        area = cross.sum() / 2
        if not area:
            continue
        sign = (1 if i == 0 else -1) * (1 if area > 0 else -1)
        total += sign * area
        cx += sign * ((p[:, 0] + q[:, 0]) * cross).sum() / 6
        cy += sign * ((p[:, 1] + q[:, 1]) * cross).sum() / 6
    if not total:
        return tuple(float(v) for v in np.mean(rings[0], axis=0))
    return float(cx / total), float(cy / total)


def read_wkb(data: bytes | None) -> dict | None:
    """A two-dimensional WKB point, line, polygon or a multi of these as a GeoJSON mapping; None if it is broken or another type."""
    if not data:
        return None

    def geometry(at: int) -> tuple[dict, int]:
        order = "<" if data[at] == 1 else ">"
        kind = struct.unpack_from(f"{order}I", data, at + 1)[0]
        at += 5

        def points(at: int) -> tuple[list[list[float]], int]:
            n = struct.unpack_from(f"{order}I", data, at)[0]
            flat = struct.unpack_from(f"{order}{2 * n}d", data, at + 4)
            return [list(p) for p in zip(flat[::2], flat[1::2], strict=True)], at + 4 + 16 * n

        if kind == 1:
            return {"type": "Point", "coordinates": list(struct.unpack_from(f"{order}2d", data, at))}, at + 16
        if kind == 2:
            line, at = points(at)
            return {"type": "LineString", "coordinates": line}, at
        n = struct.unpack_from(f"{order}I", data, at)[0]
        at += 4
        parts = []
        for _ in range(n):
            part, at = points(at) if kind == 3 else geometry(at)
            parts.append(part if kind == 3 else part["coordinates"])
        return {"type": {3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}[kind], "coordinates": parts}, at

    try:
        return geometry(0)[0]
    except (struct.error, KeyError, IndexError):
        return None


def write_wkb(lines: list[list[tuple[float, float]]]) -> bytes:
    """Rings as a little-endian WKB polygon."""
    out = [struct.pack("<BII", 1, 3, len(lines))]
    for ring in lines:
        out.append(struct.pack(f"<I{2 * len(ring)}d", len(ring), *[v for p in ring for v in p]))
    return b"".join(out)


def chained(parts: list[list[tuple[float, float]]], digits: int = 6) -> list[list[tuple[float, float]]]:
    """Parts of a line joined where exactly two of them share an end, in either direction; forks stay apart."""
    key = lambda p: (round(p[0], digits), round(p[1], digits))
    pool = {i: list(p) for i, p in enumerate(parts) if len(p) >= 2}
    ends: dict[tuple[float, float], list[int]] = {}
    for i, p in pool.items():
        for e in (key(p[0]), key(p[-1])):
            ends.setdefault(e, []).append(i)
    for e in sorted(ends):
        if len(ends[e]) != 2 or ends[e][0] == ends[e][1]:
            continue
        i, j = sorted(ends[e])
        a, b = pool[i], pool.pop(j)
        a = a if key(a[-1]) == e else a[::-1]
        b = b if key(b[0]) == e else b[::-1]
        pool[i] = a + b[1:]
        for other in (key(b[-1]),):
            ends[other] = [i if x == j else x for x in ends[other]]
    return [pool[i] for i in sorted(pool)]


def equal_pieces(length: Column, target: float) -> tuple[Column, Column]:
    """(pieces, length of each) of a line cut into equal pieces of about ``target``; never fewer than one."""
    n = F.greatest(F.lit(1.0), F.round(length / target))
    return n.cast("long"), length / n


def split_line(points: list[tuple[float, float]], target_m: float) -> list[list[tuple[float, float]]]:
    """A polyline cut into equal pieces of about ``target_m`` along its great-circle length; corners stay where they are."""
    if len(points) < 2:
        return []
    xy = np.radians(np.array(points, dtype=float))
    d = np.diff(xy, axis=0)
    h = np.sin(d[:, 1] / 2) ** 2 + np.cos(xy[:-1, 1]) * np.cos(xy[1:, 1]) * np.sin(d[:, 0] / 2) ** 2
    along = np.concatenate([[0.0], np.cumsum(2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1))))])
    n = max(1, round(along[-1] / target_m))
    cuts = np.linspace(0, along[-1], n + 1)
    at = lambda s: tuple(float(np.interp(s, along, np.degrees(xy[:, k]))) for k in (0, 1))
    return [[at(a), *[points[i] for i in range(len(points)) if a < along[i] < b], at(b)] for a, b in zip(cuts, cuts[1:], strict=False)]


def _over_lines(kernel, result: str):  # noqa: ANN001, ANN202
    """An Arrow function that applies ``kernel`` to a column of lines; null lines stay null."""

    @F.pandas_udf(result)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: None if line is None else kernel([(p["lon"], p["lat"]) for p in line]))

    return run


def pieces_of(target_m: float):  # noqa: ANN201
    """``split_line`` over a column of lines."""
    as_points = lambda pieces: [[{"lon": x, "lat": y} for x, y in piece] for piece in pieces]
    return _over_lines(lambda line: as_points(split_line(line, target_m)), f"array<{LINE}>")


def clipped_to(box: tuple[float, float, float, float]):  # noqa: ANN201
    """The legs of a column of lines inside a box, each cut at its border."""

    def kernel(line: list[tuple[float, float]]) -> list[list[dict[str, float]]]:
        legs = [segment_in_box(a, b, box) for a, b in zip(line, line[1:], strict=False)]
        return [[{"lon": x, "lat": y} for x, y in leg] for leg in legs if leg]

    return _over_lines(kernel, f"array<{LINE}>")


def centroid_of_wkt(text: Column) -> Column:
    """Struct (lon, lat) of the area-weighted centre of a WKT polygon's largest piece, null where there is none."""
    from gridloom.operators.spatial import parse_wkt

    def centre(t: str | None) -> dict[str, float | None]:
        pieces = parse_wkt(t)
        area = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)))
        at = polygon_centroid(max(pieces, key=lambda p: area(p[0]))) if pieces else None
        return {"lon": at[0] if at else None, "lat": at[1] if at else None}

    @F.pandas_udf("lon double, lat double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([centre(t if isinstance(t, str) else None) for t in texts], columns=["lon", "lat"])

    return run(text)


def geojson_of(wkb: Column) -> Column:
    """GeoJSON text of a WKB column, null where it is broken."""
    import json

    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None or (g := read_wkb(bytes(b))) is None else json.dumps(g))

    return run(wkb)


def merged_lines(df, key: str, line: str, digits: int = 6):  # noqa: ANN001, ANN201
    """(key, part, line): the parts of each key's line joined where exactly two of them share an end.

    A key's parts are one mapped line, so they fit a task; the parts are sorted first, so their order does not matter.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = sorted([(p["lon"], p["lat"]) for p in ln] for ln in pdf["line"] if ln is not None)
        joined = chained(parts, digits)
        return pd.DataFrame([(pdf["key"].iloc[0], i, [{"lon": x, "lat": y} for x, y in ln]) for i, ln in enumerate(joined)], columns=["key", "part", "line"])

    return df.select(F.col(key).alias("key"), F.col(line).alias("line")).groupBy("key").applyInPandas(run, f"key {dict(df.dtypes)[key]}, part int, line {LINE}")
