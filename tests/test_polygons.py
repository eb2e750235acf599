"""Polygon validity, coverings, and layers that are read by tasks."""

import json
import random
import struct
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarlake.functions.validity import valid_edges
from lidarlake.operators import covering, spatial
from lidarlake.plans.products import HEIGHTS
from lidarlake.sources import layers
from lidarlake.sources import shapes as shapes_module

SQUARE = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]


def parity(edges, x, y):
    odd = False
    for x1, y1, x2, y2 in edges:
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def touches(edges, x, y):
    return any((x - x1) * (y2 - y1) == (y - y1) * (x2 - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) for x1, y1, x2, y2 in edges)


def winding(ring, x, y):
    w = 0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            w += 1 if y2 > y1 else -1
    return w


def test_valid_polygons_stay():
    for parts in ([[SQUARE(0, 0, 4, 4)]], [[SQUARE(0, 0, 4, 4), SQUARE(1, 1, 2, 2)]], [[SQUARE(0, 0, 1, 1)], [SQUARE(2, 2, 3, 3)]], [[[(0, 0), (5, 0.1), (2, 3)]]]):
        edges = valid_edges(parts)
        assert edges == [(float(a), float(b), float(c), float(d)) for part in parts for r in part for (a, b), (c, d) in zip(r, r[1:] + r[:1])]


def test_invalid_polygons_are_repaired():
    overlap = valid_edges([[SQUARE(0, 0, 4, 4)], [SQUARE(2, 2, 6, 6)]])
    assert parity(overlap, 3, 3) and parity(overlap, 1, 1) and parity(overlap, 5, 5) and not parity(overlap, 5, 1)
    assert not touches(overlap, 3.5, 4) and touches(overlap, 1, 4)  # what was an edge inside is none
    bow = valid_edges([[[(0, 0), (4, 4), (4, 0), (0, 4)]]])
    assert parity(bow, 0.5, 2) and parity(bow, 3.5, 2) and not parity(bow, 2, 3.5)
    twice = valid_edges([[SQUARE(0, 0, 4, 4) + SQUARE(0, 0, 4, 4)]])
    assert parity(twice, 2, 2) and len(twice) == 4
    apart = valid_edges([[SQUARE(0, 0, 4, 4), SQUARE(6, 6, 7, 7)]])
    assert parity(apart, 6.5, 6.5)  # a hole that its shell does not meet
    assert valid_edges([[SQUARE(0, 0, 4, 4), SQUARE(0, 0, 4, 4)]]) == []
    assert valid_edges([[[(0, 0), (1, 1), (2, 2)]]]) == [] == valid_edges([[[(1, 1)]]])
    spike = valid_edges([[[(0, 0), (4, 0), (4, 4), (6, 4), (4, 4), (0, 4)]]])
    assert parity(spike, 2, 2) and not touches(spike, 5, 4)


def test_repairs_equal_windings():
    r = random.Random(4)
    for _ in range(120):
        ring = lambda k: [(r.randrange(12) * 0.5, r.randrange(12) * 0.5) for _ in range(k)]
        parts = [[ring(r.randrange(3, 9)), *(ring(r.randrange(3, 6)) for _ in range(r.randrange(3)))] for _ in range(r.randrange(1, 4))]
        grid = [(i * 0.11 + 0.03, k * 0.11 + 0.017) for i in range(55) for k in range(55)]
        if not all(any(winding(p[0], *g) and winding(h, *g) for g in grid) for p in parts for h in p[1:]):
            continue
        edges = valid_edges(parts)
        for x, y in r.sample(grid, 80):
            assert parity(edges, x, y) == any(winding(p[0], x, y) != 0 and not any(winding(h, x, y) for h in p[1:]) for p in parts)


def star(r, cx, cy, size, n):
    angles = sorted(r.random() * 6.283 for _ in range(n))
    return [(cx + size * (0.4 + r.random()) * np.cos(a), cy + size * (0.4 + r.random()) * np.sin(a)) for a in angles]


def test_cells_hold_each_point_once():
    r = random.Random(9)
    for n in (3, 8, 60):
        edges = np.array(valid_edges([[[(float(x), float(y)) for x, y in star(r, 0.3, -0.2, 1.0, n)]]]))
        box = (edges[:, [0, 2]].min(), edges[:, [0, 2]].max(), edges[:, [1, 3]].min(), edges[:, [1, 3]].max())
        frame = covering.Frame((box[0] - 0.5, box[1] + 0.25, box[2], box[3] + 0.1))
        found = list(covering.cells(edges, frame))
        assert len(found) < 60 * n and (n < 60 or any(not len(e) for *_, e in found))
        for _ in range(800):
            x, y = r.uniform(box[0], box[1]), r.uniform(box[2], box[3])
            if r.random() < 0.2:
                x, y = edges[r.randrange(len(edges)), :2]
            code = covering._interleaved(int(np.floor(x / frame.step)) - frame.ox, int(np.floor(y / frame.step)) - frame.oy)
            here = [(odd, e) for a, b, odd, e in found if a <= code <= b]
            assert len(here) <= 1
            got = bool(here) and ((here[0][0] != parity(here[0][1], x, y)) or touches(here[0][1], x, y))
            assert got == (parity(edges, x, y) or touches(edges, x, y))


@pytest.fixture
def footprints(spark):
    r = random.Random(1)
    rows = [(k, float(r.randrange(256)) / 64, float(r.randrange(256)) / 64, [1.0] * 4, "n") for k in range(3000)] + [(-1, None, 1.0, None, "n"), (-2, float("nan"), 1.0, None, "n")]
    return spark.createDataFrame(rows, "shot_number long, lon_lowestmode double, lat_lowestmode double, rxwaveform array<double>, edges string").repartition(3)


def shapes_of(r, n):
    wide = (0, [[SQUARE(0.25, 0.25, 3.75, 3.5), SQUARE(1.0, 1.0, 2.0, 2.0)]])
    return [wide, *((k, [[[(round(float(x) * 64) / 64, round(float(y) * 64) / 64) for x, y in star(r, r.uniform(0.5, 3.5), r.uniform(0.5, 3.5), 0.2, 7)]]]) for k in range(1, n))]


def plain_hits(footprints, layer):
    polygons = [(x["id"], [(e["x1"], e["y1"], e["x2"], e["y2"]) for e in x["edges"]]) for x in layer.collect()]
    out = []
    for p in footprints.filter("shot_number >= 0").collect():
        x, y = p["lon_lowestmode"], p["lat_lowestmode"]
        out += [(p["shot_number"], k) for k, e in polygons if parity(e, x, y) or touches(e, x, y)]
    return sorted(out)


@pytest.mark.parametrize("way", ["local", "tasks", "blocks"])
def test_covering_join(spark, footprints, monkeypatch, way):
    r = random.Random(3)
    layer = layers.layer(spark, shapes_of(r, 40))
    if way != "local":
        layer = layer.repartition(3)  # nothing is known here then
    if way == "blocks":
        monkeypatch.setattr(covering, "BLOCK_EDGES", 300)
    got = spatial.clip_polygons(footprints, HEIGHTS, layer, tile=1e-9)
    assert sorted((x["shot_number"], x["poly_id"]) for x in got.collect()) == plain_hits(footprints, layer)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert got.columns == [*footprints.columns, "poly_id"]
    if way == "blocks":
        assert plan.count("BroadcastHashJoin") > 3


def test_covering_join_is_the_first_plan(sf_dir, tmp_path):
    run = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[1])
from lidarlake.plans.queries import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
found = QUERIES["clip_poly_covering"](spark, sys.argv[2])
plan = found._jdf.queryExecution().optimizedPlan()
assert "!Filter" not in plan.toString(), "a filter of what is missing"
print(len(found.collect()), "rows")
"""
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", run, root, sf_dir], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert done.returncode == 0 and "5251 rows" in done.stdout, done.stderr[-2000:]


def test_covering_of_no_points_or_edges(spark, footprints):
    layer = layers.layer(spark, [(1, [SQUARE(0, 0, 1, 1)]), (2, [[(0, 0), (1, 1), (2, 2)]])])
    got = spatial.clip_polygons(footprints, HEIGHTS, layer, tile=0.5)
    assert {x["poly_id"] for x in got.collect()} == {1}
    assert spatial.clip_polygons(footprints.limit(0), HEIGHTS, layer, tile=0.5).count() == 0


def test_multipolygons_of_all_formats(spark, tmp_path):
    wkt = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((2 2, 6 2, 6 6, 2 6, 2 2)))"
    coordinates = [[[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]], [[[2, 2, 9], [6, 2, 9], [6, 6, 9], [2, 6, 9], [2, 2, 9]]]]
    feature = {"type": "Feature", "properties": {"id": 7, "name": "x"}, "geometry": {"type": "MultiPolygon", "coordinates": coordinates}}
    made = [layers.from_wkt(spark, [(7, wkt)]).first(), layers.from_geojson(spark, json.dumps({"features": [feature]})).first()]
    lines = tmp_path / "layer.jsonl"
    point = {"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    lines.write_text("\n".join(map(json.dumps, [feature, point, feature | {"properties": {"id": 8}, "geometry": {"type": "Polygon", "coordinates": coordinates[0]}}])))
    read = {x["id"]: x for x in layers.read_geojson_lines(spark, str(lines)).collect()}
    assert sorted(read) == [7, 8] and read[7]["attributes"]["name"] == "x"
    for x in [*made, read[7]]:
        edges = [(e["x1"], e["y1"], e["x2"], e["y2"]) for e in x["edges"]]
        assert parity(edges, 3, 3) and not parity(edges, 1.5, 1.5) and parity(edges, 5, 5) and x["bx1"] == 6
    assert len(read[8]["edges"]) == 8
    with pytest.raises(Exception, match="no id"):
        nameless = tmp_path / "nameless.jsonl"
        nameless.write_text(json.dumps(feature | {"properties": {}}))
        layers.read_geojson_lines(spark, str(nameless)).collect()


def test_large_layers_become_valid_in_tasks(spark, monkeypatch):
    shapes = [(k, [[SQUARE(k, 0, k + 2, 2)], [SQUARE(k + 1, 1, k + 3, 3)]]) for k in range(30)]
    here = {x["id"]: x for x in layers.layer(spark, shapes).collect()}
    monkeypatch.setattr(layers, "LOCAL_VERTICES", 10)
    far = layers.layer(spark, shapes)
    assert not hasattr(far, "known") or not isinstance(far.known, layers.Known)
    assert {x["id"]: x for x in far.collect()} == here
    known = layers.known(far)
    assert (known.polygons, known.box, known.foreign) == (30, (0.0, 32.0, 0.0, 3.0), False) and known.edges == sum(len(x["edges"]) for x in here.values())


def test_rings_of_shapefiles():
    clockwise = lambda ring: ring[::-1]
    outer, hole, island, far = SQUARE(0, 0, 9, 9), SQUARE(1, 1, 8, 8), SQUARE(2, 2, 7, 7), SQUARE(20, 20, 21, 21)
    parts = layers.assembled([clockwise(outer), hole, clockwise(island), far])
    assert sorted(map(len, parts)) == [1, 1, 2]
    edges = valid_edges(parts)
    assert parity(edges, 0.5, 0.5) and not parity(edges, 1.5, 1.5) and parity(edges, 4, 4) and parity(edges, 20.5, 20.5)
    turned = valid_edges(layers.assembled([outer, clockwise(hole)]))  # shells are told from holes by the first sign there is
    assert parity(turned, 0.5, 0.5)


# --- shapefiles


def shapefile(path, shapes, table):
    """A polygon shapefile with a .shx and a .dbf of text columns."""
    body, index = b"", b""
    for n, rings in enumerate(shapes, 1):
        if rings is None:
            record = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in r]
            starts = np.cumsum([0, *map(len, rings)])[:-1].tolist()
            record = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        index += struct.pack(">2i", (100 + len(body)) // 2, len(record) // 2)
        body += struct.pack(">2i", n, len(record) // 2) + record
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    path.with_suffix(".shp").write_bytes(head(100 + len(body)) + body)
    path.with_suffix(".shx").write_bytes(head(100 + len(index)) + index)
    path.with_suffix(".dbf").write_bytes(shapes_module.table(list(table), ["C"] * len(table), list(table.values())))


def test_a_shapefile_is_read_by_ranges(spark, tmp_path):
    r = random.Random(6)
    shapes = [None if k == 17 else [SQUARE(k, 0, k + 2, 2)[::-1], SQUARE(k + 0.5, 0.5, k + 1, 1)] if k % 3 else [[(float(x), float(y)) for x, y in star(r, k, 1, 1, 9)]] for k in range(103)]
    shapefile(tmp_path / "layer.shp", shapes, {"id": [k + 1000 for k in range(103)], "name": [f"n{k}" for k in range(103)]})
    far = layers.read_shapefile(spark, f"{tmp_path}/layer.shp", records=10)
    here = layers.from_shapefile(spark, (tmp_path / "layer.shp").read_bytes(), (tmp_path / "layer.dbf").read_bytes())
    rows = lambda t: {x["id"]: x.asDict(True) for x in t.collect()}
    assert rows(far) == rows(here) and len(rows(far)) == 102 and far.rdd.getNumPartitions() == 11
    assert rows(far)[1005]["attributes"]["name"] == "n5"
    shapefile(tmp_path / "none.shp", [], {"id": []})
    assert layers.read_shapefile(spark, f"{tmp_path}/none.shp").count() == 0


def test_points_are_written_as_shapefiles(spark, tmp_path):
    rows = [(2**53 + k, -44.0 - k / 8, -13.0 + k / 16, k, None if k == 3 else k / 3, "é" * 50 if k == 2 else f"n{k}", k) for k in range(25)] + [(1, None, 1.0, 1, 1.0, "x", 1), (2, float("nan"), 1.0, 1, float("nan"), None, 1)]
    t = spark.createDataFrame(rows, "shot_number long, lon double, lat double, small int, rh100 double, note string, shot_number_again int")
    out = tmp_path / "o"
    shapes_module.write_points(t.repartition(2), "lon", "lat", str(out), file_rows=10)
    stems = sorted(p.with_suffix("") for p in out.glob("*.shp"))
    assert len(stems) >= 3 and not list(out.glob("_temporary*")) and all(p.with_suffix(e).exists() for p in stems for e in (".shx", ".dbf", ".prj"))
    back = []
    for stem in stems:
        shp, shx, attributes = stem.with_suffix(".shp").read_bytes(), stem.with_suffix(".shx").read_bytes(), layers._attributes(stem.with_suffix(".dbf").read_bytes())
        assert struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and len(shx) == 100 + 8 * len(attributes)
        for k, own in enumerate(attributes):
            at, words = struct.unpack(">2i", shx[100 + 8 * k : 108 + 8 * k])
            assert struct.unpack(">2i", shp[2 * at : 2 * at + 8]) == (k + 1, words)
            kind = struct.unpack("<i", shp[2 * at + 8 : 2 * at + 12])[0]
            xy = struct.unpack("<2d", shp[2 * at + 12 : 2 * at + 28]) if kind == 1 else None
            back.append((int(own["shot_numbe"]), xy, own))
    assert len(back) == 27 and {k for k, xy, _ in back if xy is None} == {1, 2}
    for shot, lon, lat, small, rh, _, again in rows[:25]:
        (found,) = [b for b in back if b[0] == shot]
        assert found[1] == (lon, lat) and int(found[2]["small"]) == small and int(found[2]["shot_num_1"]) == again
        assert found[2]["rh100"] == "" if rh is None else abs(float(found[2]["rh100"]) - rh) < 1e-9
    with pytest.raises(Exception, match="nowhere"):
        shapes_module.write_points(t, "nowhere", "lat", str(tmp_path / "p"))
