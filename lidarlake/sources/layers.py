"""Polygon layers from literals, WKT, GeoJSON and shapefiles."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import EDGES, Ring, ring_edges
from ..functions.validity import valid_edges
from ..plans.products import SRID

_SCHEMA = f"id long, bx0 double, bx1 double, by0 double, by1 double, edges {EDGES}, srid int, attributes map<string,string>"
#: Polygons as they were read: a part is its rings, the shell first, and a ring its numbers x, y, x, y and so on.
RAW = "id long, parts array<array<array<double>>>, srid int, attributes map<string,string>"
#: Vertices of a layer that is made valid where it is built; a larger one is made valid by tasks.
LOCAL_VERTICES = 5_000

Shape = list[Ring] | list[list[Ring]]


@dataclass(frozen=True)
class Known:
    """What the clips ask of a layer first: its size, its box, if it has polygons of another coordinate system, and its
    rows if it was built from few."""

    polygons: int
    edges: int
    box: tuple[float, float, float, float] | None
    foreign: bool
    rows: list[dict] | None = None


def known(layer: DataFrame) -> Known:
    """Of a layer that was built here without a job, of any other in one."""
    if isinstance(held := getattr(layer, "known", None), Known):
        return held
    foreign = F.count_if(F.col("srid") != SRID) if "srid" in layer.columns else F.lit(0)
    r = layer.agg(F.count("*"), F.sum(F.size("edges")), F.min("bx0"), F.max("bx1"), F.min("by0"), F.max("by1"), foreign).first()
    return Known(r[0], r[1] or 0, None if r[2] is None else tuple(r[2:6]), bool(r[6]))


def parts_of(shape: Shape) -> list[list[Ring]]:
    """The parts of a polygon that is given by its rings, shell first, or by its parts."""
    return shape if shape and shape[0] and isinstance(shape[0][0][0], (tuple, list)) else [shape]


def _row(key: int, parts: list[list[Ring]], srid: int | None, attributes: dict | None) -> dict:
    points = [p for part in parts for ring in part for p in ring]
    if len(points) < 3:
        raise ValueError(f"polygon {key} has fewer than three vertices")
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    edges = [dict(zip(("x1", "y1", "x2", "y2"), e, strict=True)) for e in valid_edges(parts)]
    return {"id": key, "bx0": float(min(xs)), "bx1": float(max(xs)), "by0": float(min(ys)), "by1": float(max(ys)), "edges": edges, "srid": srid, "attributes": attributes}


def valid(raw: DataFrame) -> DataFrame:
    """A layer of polygons as they were read (RAW): each becomes valid in the task that has it. Crossing, overlapping and
    repeated rings bound the union of the polygon's parts; a valid polygon's edges stay as they are."""
    target = to_arrow_schema(raw.sparkSession.createDataFrame([], _SCHEMA).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                rings = [[list(zip(x[::2], x[1::2], strict=True)) for x in part] for part in r["parts"]]
                yield pa.RecordBatch.from_pylist([_row(r["id"], rings, r["srid"], r["attributes"])], target)

    return raw.select("id", "parts", "srid", "attributes").mapInArrow(run, _SCHEMA)


def layer(spark: SparkSession, polygons: list[tuple[int, Shape]], attributes: list[dict] | None = None, srid: int = SRID) -> DataFrame:
    """One row per polygon, given by its rings, the shell first, or by parts of such rings."""
    shapes = [(key, parts_of(shape), {k: str(v) for k, v in (attributes[i] if attributes else {}).items()}) for i, (key, shape) in enumerate(polygons)]
    if sum(len(ring) for _, parts, _ in shapes for part in parts for ring in part) > LOCAL_VERTICES:
        raw = [(key, [[[float(c) for p in ring for c in p[:2]] for ring in part] for part in parts], srid, own) for key, parts, own in shapes]
        return valid(spark.createDataFrame(raw, RAW))
    rows = [_row(key, parts, srid, own) for key, parts, own in shapes]
    out = spark.createDataFrame(rows, _SCHEMA)
    box = (min(r["bx0"] for r in rows), max(r["bx1"] for r in rows), min(r["by0"] for r in rows), max(r["by1"] for r in rows)) if rows else None
    out.known = Known(len(rows), sum(len(r["edges"]) for r in rows), box, bool(rows) and srid != SRID, rows)
    return out


def parts_of_wkt(text: str) -> list[list[Ring]]:
    """Parts of a POLYGON or MULTIPOLYGON."""
    if not re.match(r"\s*(MULTI)?POLYGON", text, re.I):
        raise ValueError("not a polygon: " + text[:40])
    many = re.match(r"\s*MULTI", text, re.I)
    parts = re.findall(r"\(\s*((?:\([^()]+\)\s*,?\s*)+)\)", text) if many else [text]
    return [[[tuple(map(float, p.split()[:2])) for p in ring.split(",")] for ring in re.findall(r"\(([^()]+)\)", part)] for part in parts]


def from_wkt(spark: SparkSession, shapes: list[tuple[int, str]]) -> DataFrame:
    return layer(spark, [(k, parts_of_wkt(w)) for k, w in shapes])


def from_geojson(spark: SparkSession, text: str, id_field: str = "id") -> DataFrame:
    """Features that are polygons; others are left out, but one must be."""
    shapes, attributes = [], []
    for n, f in enumerate(json.loads(text)["features"], 1):
        g = f.get("geometry") or {}
        parts = [g["coordinates"]] if g.get("type") == "Polygon" else g["coordinates"] if g.get("type") == "MultiPolygon" else []
        if parts:
            own = f.get("properties") or {}
            shapes.append((int(own.get(id_field, f.get("id", n))), [[[(p[0], p[1]) for p in ring] for ring in part] for part in parts]))
            attributes.append(own)
    if not shapes:
        raise ValueError("the layer has no polygon")
    return layer(spark, shapes, attributes)


def read_geojson_lines(spark: SparkSession, path: str, id_field: str = "id") -> DataFrame:
    """A layer of one GeoJSON feature a line, read and made valid by tasks; features that are no polygons are left out.
    Ids are those of the property, else of the feature; a feature without either is an error where it is read."""
    ring = "array<array<array<double>>>"
    found = spark.read.schema("id string, properties string, geometry struct<type:string,coordinates:string>").json(path)
    one, many = F.col("geometry.type") == "Polygon", F.col("geometry.type") == "MultiPolygon"
    coordinates = F.when(one, F.array(F.from_json("geometry.coordinates", ring))).otherwise(F.from_json("geometry.coordinates", f"array<{ring}>"))
    flat = F.transform(coordinates, lambda part: F.transform(part, lambda r: F.flatten(F.transform(r, lambda p: F.slice(p, 1, 2)))))
    own = F.from_json("properties", "map<string,string>")
    number = F.coalesce(F.get(F.array(own[id_field]), F.lit(0)), F.col("id"))
    key = F.coalesce(number.cast("double").cast("long"), F.raise_error(F.lit("a feature has no id")).cast("long"))
    return valid(found.filter(one | many).select(key.alias("id"), flat.alias("parts"), F.lit(SRID).alias("srid"), own.alias("attributes")))


def _area(ring: Ring) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def _holds(edges: np.ndarray, x: float, y: float) -> bool:
    """Is the point in the ring of these edges, or on it?"""
    x1, y1, x2, y2 = edges.T
    level = (x - x1) * (y2 - y1) == (y - y1) * (x2 - x1)
    on = level & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))
    crossed = (y1 > y) != (y2 > y)
    at = x1[crossed] + (y - y1[crossed]) / (y2[crossed] - y1[crossed]) * (x2[crossed] - x1[crossed])
    return bool(on.any() or (x < at).sum() % 2)


def assembled(rings: list[Ring]) -> list[list[Ring]]:
    """Parts of a shapefile's rings: clockwise ones are shells, and the others holes of the smallest shell that holds their
    first vertex, or parts of their own. Where no ring is clockwise, all are taken the other way round."""
    areas = [_area(r) for r in rings]
    sign = -1 if any(a < 0 for a in areas) else 1
    shells = sorted((k for k, a in enumerate(areas) if a * sign >= 0), key=lambda k: abs(areas[k]))
    edges = {k: np.array(ring_edges([rings[k]]), np.float64).reshape(-1, 4) for k in shells}
    parts = {k: [rings[k]] for k in shells}
    for k, a in enumerate(areas):
        if a * sign < 0:
            owner = next((s for s in shells if abs(areas[s]) >= abs(a) and _holds(edges[s], *rings[k][0][:2])), None)
            parts[owner if owner is not None else k] = [*parts.get(owner, []), rings[k]]
    return list(parts.values())


def _rings(body: bytes) -> list[Ring]:
    """The rings of a polygon record (types 5, 15 and 25); none of any other."""
    if len(body) < 44 or struct.unpack("<i", body[:4])[0] not in (5, 15, 25):
        return []
    parts, points = struct.unpack("<2i", body[36:44])
    starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
    xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
    return [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]


def _shapes(data: bytes) -> Iterator[list[Ring]]:
    """The polygons of a .shp file, in order."""
    if struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack(">i", data[at + 4 : at + 8])[0] * 2
        yield _rings(data[at + 8 : at + 8 + size])
        at += 8 + size


class _Table:
    """A .dbf table, its rows as text; any range of them can be read."""

    def __init__(self, head: bytes) -> None:
        self.rows, self.head, self.width = struct.unpack("<IHH", head[4:12])
        self.fields = [(head[i : i + 11].split(b"\0")[0].decode(), head[i + 16]) for i in range(32, self.head - 1, 32)]

    def row(self, data: bytes, at: int) -> dict[str, str]:
        at, own = at + 1, {}
        for name, size in self.fields:
            own[name] = data[at : at + size].decode("latin-1").strip()
            at += size
        return own


def _attributes(data: bytes) -> list[dict[str, str]]:
    """All rows of a .dbf table."""
    t = _Table(data)
    return [t.row(data, t.head + n * t.width) for n in range(t.rows)]


def read_shapefile(spark: SparkSession, path: str, id_field: str = "id", records: int = 2_000) -> DataFrame:
    """A layer of a shapefile that every executor can open by its path (.shp, with .shx, .dbf and .prj beside it), read and
    made valid by tasks. The driver reads the length of the index and the coordinate system; a task reads a range of the
    index, and the records and table rows of that range. Records that are no polygons are left out."""
    stem = path.removeprefix("file:").removesuffix(".shp")
    n = (os.path.getsize(f"{stem}.shx") - 100) // 8
    prj = None
    if os.path.exists(f"{stem}.prj"):
        with open(f"{stem}.prj") as f:
            prj = f.read()
    srid, has_table = srid_of_prj(prj), os.path.exists(f"{stem}.dbf")
    target = to_arrow_schema(spark.createDataFrame([], RAW).schema)

    def some(begin: int) -> list[dict]:
        count = min(records, n - begin)
        with open(f"{stem}.shx", "rb") as f:
            f.seek(100 + 8 * begin)
            index = struct.unpack(f">{2 * count}i", f.read(8 * count))
        rows = [{}] * count
        if has_table:
            with open(f"{stem}.dbf", "rb") as f:
                head = f.read(32)
                table = _Table(head + f.read(struct.unpack("<H", head[8:10])[0] - 32))
                f.seek(table.head + begin * table.width)
                data = f.read(count * table.width)
                rows = [table.row(data, k * table.width) for k in range(count)]
        out = []
        with open(f"{stem}.shp", "rb") as f:
            for k, own in enumerate(rows):
                f.seek(2 * index[2 * k] + 8)
                if rings := _rings(f.read(2 * index[2 * k + 1])):
                    key = int(float(own[id_field])) if own.get(id_field) else begin + k + 1
                    out.append({"id": key, "parts": [[[float(c) for p in ring for c in p] for ring in part] for part in assembled(rings)], "srid": srid, "attributes": own})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in b.column(0).to_pylist():
                if got := some(begin):
                    yield pa.RecordBatch.from_pylist(got, target)

    ranges = -(-n // records)
    return valid(spark.range(0, max(n, 0), records, max(1, ranges)).mapInArrow(run, RAW))


def srid_of_prj(text: str | None) -> int:
    """The EPSG code that a .prj file's text names, last and outermost; geographic WGS 84 without a code is 4326, anything
    else without one is 0. No text: 4326."""
    if not text:
        return SRID
    codes = re.findall(r'(?:AUTHORITY|ID)\s*\[\s*"EPSG"\s*,\s*"?(\d+)"?\s*\]', text, re.I)
    if codes:
        return int(codes[-1])
    plain = re.match(r'\s*(?:GEOGCS|GEOGCRS)\s*\[\s*"([^"]*)"', text, re.I)
    return SRID if plain and re.sub(r"[^a-z0-9]", "", plain[1].lower()) in ("wgs84", "gcswgs1984") else 0


def from_shapefile(spark: SparkSession, shp: bytes, dbf: bytes | None = None, id_field: str = "id", prj: str | None = None) -> DataFrame:
    """Polygons of a shapefile given by the contents of its files; ids from the table, else by position from 1; the
    coordinate system is that of the .prj file."""
    table = _attributes(dbf) if dbf else []
    kept, attributes = [], []
    for n, rings in enumerate(_shapes(shp)):
        if rings:
            own = table[n] if n < len(table) else {}
            kept.append((int(float(own[id_field])) if own.get(id_field) else n + 1, assembled(rings)))
            attributes.append(own)
    if not kept:
        raise ValueError("the layer has no polygon")
    return layer(spark, kept, attributes, srid_of_prj(prj))
