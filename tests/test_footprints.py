"""Golden rows and edge cases of the footprint operators."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lidarlake.functions.missing import metric_set, nullify, shot_time
from lidarlake.operators import clip, extract, granules, grid, profiles, spatial, stats, waveform
from lidarlake.plans.products import CANOPY, CANOPY_MAP, HEIGHTS, WAVEFORM_GEO, profile_names
from lidarlake.plans.validate import check_extent
from lidarlake.sources import catalog, download, layers
from lidarlake.sources import granules as source

# Rows of a published example.
GEO = [(19640002800109382, -13.75903, -13.75901, -44.17219, -44.17219, 784.8348), (19640003000109383, -13.75862, -13.75859, -44.17188, -44.17188, 799.0491)]
POINTS = "shot_number long, lon_lowestmode double, lat_lowestmode double"
SQUARE = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]]


def ids(df):
    return sorted(r[0] for r in df.select("shot_number").collect())


def geo(spark):
    return spark.createDataFrame(GEO, "shot_number long, latitude_bin0 double, latitude_lastbin double, longitude_bin0 double, longitude_lastbin double, elevation_bin0 double")


def test_geolocation_extract_keeps_order_and_each_column_once(spark):
    out = extract.waveform_geolocation(geo(spark), ["elevation_bin0", "shot_number", "latitude_bin0"])
    assert out.columns == ["shot_number", "latitude_bin0", "latitude_lastbin", "longitude_bin0", "longitude_lastbin", "elevation_bin0"]
    assert tuple(out.first()) == GEO[0]
    with pytest.raises(ValueError, match="nothing"):
        extract.waveform_geolocation(geo(spark), ["nothing"])


def test_canopy_map_has_all_aliases():
    assert len(CANOPY_MAP) == 62
    assert CANOPY_MAP["elev_lowestmode"] == "geolocation.elev_lowestmode" and CANOPY_MAP["modis_treecover"] == "land_cover_data.modis_treecover"


def test_unknown_canopy_column_is_left_out_with_a_warning(spark):
    t = spark.createDataFrame([(1, 0.5, 7)], "shot_number long, pai double, own int")
    with pytest.warns(UserWarning, match="cover"):
        assert extract.canopy_metrics(t, ["shot_number", "cover", "pai", "own"]).columns == ["shot_number", "pai", "own"]


def test_profile_names():
    assert profile_names("pai")[0] == "pai_z0_5m" and profile_names("pavd")[-1] == "pavd_z145_150m" and len(profile_names("pai")) == 30


def test_union_skips_beams_without_shots(spark):
    a = spark.createDataFrame([(1,)], "shot_number long")
    assert ids(extract.union([a, spark.createDataFrame([("x",)], "beam string")])) == [1]
    with pytest.raises(ValueError):
        extract.union([spark.createDataFrame([("x",)], "beam string")])


def test_box_is_closed_and_drops_missing_coordinates(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 1.1, 0.5), (4, None, 0.5), (5, math.nan, 0.5), (6, 0.5, math.nan)], POINTS)
    assert ids(clip.clip_box(t, HEIGHTS, 0, 1, 0, 1)) == [1, 2]


def test_both_ends_must_lie_in_the_box(spark):
    t = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 0.5), (2, 0.5, 1.5, 0.5, 0.5)], "shot_number long, longitude_bin0 double, longitude_lastbin double, latitude_bin0 double, latitude_lastbin double")
    assert ids(clip.clip_box(t, WAVEFORM_GEO, 0, 1, 0, 1)) == [1] == ids(clip.clip_box(t, CANOPY, 0, 1, 0, 1))


def test_empty_clip_is_empty_or_an_error(spark):
    t = spark.createDataFrame([(1, 5.0, 5.0)], POINTS)
    assert clip.clip_box(t, HEIGHTS, 0, 1, 0, 1).count() == 0
    with pytest.raises(clip.NothingLeft):
        clip.clip_box(t, HEIGHTS, 0, 1, 0, 1, strict=True)
    with pytest.raises(ValueError, match="xmin"):
        check_extent(1, 0, 0, 1)


def test_clip_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 0.5, 0.5)], POINTS).write.parquet(f"{tmp_path}/t")
    plan = clip.clip_box(spark.read.parquet(f"{tmp_path}/t"), HEIGHTS, 0, 1, 0, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(" in plan.split("PushedFilters")[1]


@pytest.mark.parametrize("tile,literal", [(None, 64), (None, 0), (0.5, 64)])
def test_polygon_boundary_hole_overlap_and_missing(spark, monkeypatch, tile, literal):
    monkeypatch.setattr(spatial, "LITERAL_EDGES", literal)
    points = [(1, 0.0, 2.0), (2, 0.0, 0.0), (3, 1.5, 1.5), (4, 1.0, 1.5), (5, 3.0, 3.0), (6, 5.0, 5.0), (7, None, 1.0), (8, math.nan, 1.0), (9, 4.0, 4.0)]
    t = spark.createDataFrame(points, POINTS)
    shapes = layers.layer(spark, [(1, SQUARE), (2, [[(2.5, 2.5), (6, 2.5), (6, 6), (2.5, 6)]])])
    got = sorted(tuple(r) for r in spatial.clip_polygons(t, HEIGHTS, shapes, tile=tile).select("shot_number", "poly_id").collect())
    assert got == [(1, 1), (2, 1), (4, 1), (5, 1), (5, 2), (6, 2), (9, 1), (9, 2)]
    assert ids(spatial.clip_polygons(t, HEIGHTS, shapes, None, tile=tile)) == [1, 2, 4, 5, 5, 6, 9, 9]


def test_layer_checks(spark):
    t = spark.createDataFrame([(1, 0.5, 0.5)], POINTS)
    shapes = layers.layer(spark, [(1, SQUARE)])
    with pytest.raises(ValueError, match="stand"):
        spatial.clip_polygons(t, HEIGHTS, shapes, "stand")
    with pytest.raises(ValueError, match="EPSG"):
        spatial.clip_polygons(t, HEIGHTS, layers.layer(spark, [(1, SQUARE)], srid=32723))
    with pytest.raises(clip.NothingLeft):
        spatial.clip_polygons(spark.createDataFrame([(1, 9.0, 9.0)], POINTS), HEIGHTS, shapes, strict=True)
    assert spatial.clip_polygons(t, HEIGHTS, shapes.limit(0)).count() == 0


def test_statistics_of_missing_values(spark):
    t = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), ("b", 2.0), ("c", 5.0)], "g string, v double")
    strict = {r["g"]: (r["max"], r["sd"]) for r in stats.summarise(t, metric_set("v", ["max", "sd"]), by="g").collect()}
    assert strict["a"] == (3.0, pytest.approx(math.sqrt(2))) and strict["b"] == (None, None) and strict["c"] == (5.0, None)
    assert stats.summarise(t, metric_set("v", ["max"], na_rm=True)).first()["max"] == 5.0
    assert nullify(spark.createDataFrame([(-9999.0,), (math.nan,), (1.0,)], "v double"), ["v"]).filter("v is null").count() == 2
    with pytest.raises(ValueError):
        stats.summarise(t, {})


def test_grid_edges_and_counts(spark):
    t = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.49, 0.51), (1.0, 0.0), (None, 0.5)], "x double, y double")
    g = grid.grid_of(t, "x", "y", 0.5)
    cells = {r["cell"]: r["n"] for r in grid.grid_stats(t, "x", "y", 0.5, {"n": F.count("*")}).collect()}
    assert (g.ncol, g.nrow) == (2, 2) and cells == {1: 1, 2: 1, 3: 1, 4: 1}
    snapped = grid.Grid(0.0, 0.0, 0.5, 1, 1)
    assert [r[0] for r in t.select(snapped.cell(F.col("x"), F.col("y"))).collect()] == [1, None, None, None, None]
    dense = grid.densify(grid.grid_stats(t.limit(1), "x", "y", 0.5, {"n": F.count("*")}, grid=g), g)
    assert dense.count() == 4 and dense.filter("n is null").count() == 3
    assert [r["line"] for r in grid.to_ascii(dense, g, "n").orderBy("row").collect()] == ["-9999.0 -9999.0", "1.0 -9999.0"]
    with pytest.raises(ValueError):
        grid.grid_of(t, "x", "y", 0)


def wave(spark, values):
    return spark.createDataFrame([(1, 10.0, 10.0 - len(values), [float(v) for v in values])], "shot_number long, elevation_bin0 double, elevation_lastbin double, rxwaveform array<float>")


def test_waveform_elevations_and_unknown_shot(spark):
    got = [tuple(r) for r in waveform.waveform(wave(spark, [5, 6, 7]), 1).orderBy("bin").select("rxwaveform", "elevation").collect()]
    assert got == [(5.0, 9.0), (6.0, 8.0), (7.0, 7.0)]
    with pytest.raises(LookupError, match="shot 2 "):
        waveform.waveform(wave(spark, [1]), 2)


def test_constant_waveform_has_no_relative_amplitude(spark):
    assert {r["relative"] for r in waveform.relative(wave(spark, [3, 3])).collect()} == {None}


def test_metrics_view(spark):
    h = spark.createDataFrame([(1, 6.0, [i / 25 for i in range(101)])], "shot_number long, elev_lowestmode double, rh array<double>")
    v = waveform.metrics_view(wave(spark, [1, 4, 2, 9, 1]), h, 1)
    assert v["marks"].select("rh").distinct().count() == 5 and v["ticks"].filter("height = 0").count() == 1 and v["limits"].count() == 1
    assert v["outline"].count() == 10 and v["curve"].count() == 4


def test_csr_and_gather(spark):
    rows = spark.createDataFrame([("B", 1, 3), ("B", 2, 2), ("B", 3, 4)], "beam string, shot_number long, rx_sample_count int")
    flat = granules.flat_index(rows)
    assert [r["start_index"] for r in flat.orderBy("shot_number").collect()] == [1, 4, 6]
    back = granules.gather(spark.createDataFrame([("B", [float(i) for i in range(9)])], "beam string, values array<float>"), flat)
    assert [len(r["rxwaveform"]) for r in back.orderBy("shot_number").collect()] == [3, 2, 4]


def test_written_clip_is_partitioned(spark, tmp_path):
    rows = spark.createDataFrame([(1, "BEAM0000", 7), (2, "BEAM0001", 7)], "shot_number long, beam string, poly_id int")
    assert granules.write_clip(rows, f"{tmp_path}/o") == ["poly_id", "beam"]
    assert spark.read.parquet(f"{tmp_path}/o").filter("beam = 'BEAM0001'").count() == 1


def test_profile_clamps_and_rounds_to_even(spark):
    t = spark.createDataFrame([("B", 1, 0.5, 3.0, [-1.0] * 30), ("B", 2, 1.5, -2.0, [1.0] * 30)], "beam string, shot_number long, elev_lowestmode double, height_bin0 double, pai_z array<float>")
    got = sorted(tuple(r) for r in profiles.track_profile(t, "pai", "B").select("shot_number", "y", "value").collect())
    assert got == [(1, 2.0, 0.0), (1, 2.0, 0.0)]
    low = profiles.track_profile(t, "pai", "B", elevation=False)
    assert sorted(r["y"] for r in low.collect()) == [0.5, 1.5] and profiles.track_lines(low, False).first()["top"] == 2.0


def test_shot_time(spark):
    assert str(spark.createDataFrame([(86400.5,)], "d double").select(shot_time(F.col("d"))).first()[0]) == "2018-01-02 00:00:00.500000"


def test_catalogue_pages_until_an_empty_one(spark):
    entry = lambda n: {"links": [{"href": f"https://{catalog.OLD_HOST}/{n}"}, {"href": "other"}]}
    pages = [[entry(1), entry(2)], [entry(3)], []]
    asked = []

    def fetch(url):
        asked.append(url)
        return 200, json.dumps({"feed": {"entry": pages[len(asked) - 1]}})

    got = catalog.find_granules(spark, fetch, catalog.GRIDDED, 1, 2, 3, 4)
    assert [r["href"] for r in got.orderBy("page", "position").collect()] == [f"https://{catalog.NEW_HOST}/{n}" for n in (1, 2, 3)]
    assert asked[1].endswith("&bounding_box=2,3,4,1&pageNum=2")
    with pytest.raises(catalog.SearchFailed, match="broken"):
        catalog.find_granules(spark, lambda url: (400, '{"errors": ["broken"]}'), "GEDI02_A", 1, 2, 3, 4)
    with pytest.raises(ValueError):
        catalog.search_url("GEDI09", 1, 2, 3, 4)


def test_download_resumes_skips_and_fails(spark, tmp_path):
    import io

    begins = []

    def opener(url, begin, timeout, headers):
        begins.append(begin)
        return io.BytesIO(b"0123456789"[begin:])

    (tmp_path / f"g.h5{download.PART}").write_bytes(b"0123")
    url = "https://host/path/g.h5?x=1"
    assert download.download(url, str(tmp_path), opener=opener, buffer_kb=1) == "done"
    assert (tmp_path / "g.h5").read_bytes() == b"0123456789" and begins == [4]
    assert download.download_all([url], str(tmp_path), opener=opener) == [(url, "skipped")]

    def broken(*_):
        raise OSError("gone")

    with pytest.raises(download.DownloadFailed, match="other.h5"):
        download.download_all(["https://host/other.h5"], str(tmp_path), opener=broken)
    with pytest.raises(ValueError, match="buffer_kb"):
        download.download(url, str(tmp_path), buffer_kb=1.5)


def test_layers_from_text_and_files(spark):
    import struct

    wkt = layers.from_wkt(spark, [(4, "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0)), ((5 5, 6 5, 6 6, 5 5)))")]).first()
    assert (wkt["id"], wkt["bx1"], len(wkt["edges"])) == (4, 6.0, 6)
    text = json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [0, 0]}}, {"properties": {"id": 3}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]})
    assert layers.from_geojson(spark, text).first()["id"] == 3
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp = struct.pack(">i", 9994) + bytes(96) + struct.pack(">2i", 1, len(body) // 2) + body
    assert len(layers.from_shapefile(spark, shp).first()["edges"]) == 3
    with pytest.raises(ValueError):
        layers.from_wkt(spark, [(1, "POINT (0 0)")])


def test_granule_source_reads_beams_of_a_crafted_file(spark):
    import numpy as np

    beam = {
        "shot_number": np.array([1, 2], np.uint64), "rx_sample_start_index": np.array([11, 14]), "rx_sample_count": np.array([3, 2]), "rxwaveform": np.arange(5, dtype=np.float32),
        "geolocation": {"latitude_bin0": np.array([0.5, 0.6])}, "rh": np.arange(6, dtype=np.float32).reshape(3, 2),
    }
    batch = source.beam_batch(beam, "BEAM0000", "waveform", source.SCHEMAS["waveform"]).to_pydict()
    assert batch["rxwaveform"] == [[0, 1, 2], [3, 4]] and batch["latitude_bin0"] == [0.5, 0.6] and batch["txwaveform"] == [None, None]
    assert source.beam_batch(beam, "BEAM0000", "heights", source.SCHEMAS["heights"]).to_pydict()["rh"] == [[0, 2, 4], [1, 3, 5]]
    assert source.beam_batch({}, "BEAM0000", "heights", source.SCHEMAS["heights"]) is None
    single = {"shot_number": np.array([9]), "rh": np.array([1.0, 2.0], np.float32)}
    assert source.beam_batch(single, "BEAM0000", "heights", source.SCHEMAS["heights"]).to_pydict()["rh"] == [[1.0, 2.0]]
    with pytest.raises(ValueError):
        source.beam_batch({"shot_number": np.array([2**63], np.uint64)}, "b", "heights", source.SCHEMAS["heights"])


def test_product_tables_round_trip(spark, tmp_path):
    spark.createDataFrame([], source.SCHEMAS["heights"]).write.parquet(f"{tmp_path}/h")
    assert source.read_product(spark, f"{tmp_path}/h", "heights", ["beam", "rh"]).columns == ["beam", "rh"]


def test_dense_grid_and_union_hold_every_shot(spark, sf_dir):
    from lidarlake.plans.queries import QUERIES
    from lidarlake.sources import views

    shots = views.shots(spark, sf_dir)
    cells = [r["n"] for r in QUERIES["grid_dense"](spark, sf_dir).collect()]
    assert None in cells and sum(n or 0 for n in cells) == shots.count()
    union = QUERIES["beam_union"](spark, sf_dir)
    assert union.count() == shots.count() and union.select("beam").distinct().count() == 8


def test_product_tables_keep_their_own_columns(spark, tmp_path):
    spark.createDataFrame([("BEAM0000", 1, 0.5, 0.25, 7, [1.0])], "beam string, shot_number int, lat_lowestmode double, lon_lowestmode float, own int, rh array<double>").write.parquet(f"{tmp_path}/h")
    t = source.read_product(spark, f"{tmp_path}/h", "heights")
    assert t.columns == ["beam", "shot_number", "lat_lowestmode", "lon_lowestmode", "own", "rh"]
    assert dict(t.dtypes)["shot_number"] == "bigint" and dict(t.dtypes)["lon_lowestmode"] == "double" and dict(t.dtypes)["rh"] == "array<double>" and t.first()["own"] == 7
    spark.createDataFrame([(1,)], "shot_number long").write.parquet(f"{tmp_path}/odd")
    with pytest.raises(ValueError, match="lat_lowestmode"):
        source.read_product(spark, f"{tmp_path}/odd", "heights")


def test_granule_files_through_the_data_source(spark, tmp_path):
    import numpy as np

    def beam(first, n):
        return {"shot_number": np.arange(first, first + n, dtype=np.uint64), "rh": np.arange(101 * n, dtype=np.float32).reshape(n, 101), "lat_lowestmode": np.full(n, 0.5), "lon_lowestmode": np.full(n, 0.25), "land_cover_data/landsat_treecover": np.arange(n, dtype=np.float64), "ancillary/l2a_alg_count": np.array(6)}

    files = []
    for k in range(2):
        held = {f"{b}/{c}": v for b, first, n in (("BEAM0000", 10 * k, 3), ("BEAM9999", 100 + 10 * k, 2)) for c, v in beam(first, n).items()}
        held |= {"BEAM0001/empty": np.zeros(0), "METADATA/DatasetIdentification/creationDate": np.array("2020-01-01"), "OTHER/shot_number": np.arange(4)}
        files.append(f"{tmp_path}/g{k}.npz")
        np.savez(files[-1], **held)
    t = source.read_product(spark, ",".join(files), "heights", form="granule")
    assert {"land_cover_data_landsat_treecover", "rh", "beam"} <= set(t.columns) and t.count() == 10
    assert sorted({r["beam"] for r in t.collect()}) == ["BEAM0000", "BEAM9999"]
    assert [len(r["rh"]) for r in t.filter("shot_number = 11").collect()] == [101]
    few = source.read_product(spark, files[0], "heights", ["shot_number", "lat_lowestmode"], "granule", whole=False)
    assert few.columns == ["shot_number", "lat_lowestmode"] and few.count() == 5
    meta = source.read_metadata(spark, files)
    assert [r["value"] for r in meta.filter("name like '%creationDate'").collect()] == ["2020-01-01"] * 2
    out = f"{tmp_path}/clip"
    granules.write_clip(granules.clip_granule(t.select("beam", "shot_number", "lat_lowestmode", "lon_lowestmode"), HEIGHTS, 0, 1, 0, 1), out, metadata=meta)
    assert spark.read.parquet(out).count() == 10 and granules.read_metadata(spark, out).count() == 2


def test_arrays_of_unknown_shape_are_errors():
    import numpy as np

    schema = source.SCHEMAS["heights"]
    odd = {"shot_number": np.arange(4), "rh": np.zeros((3, 7), np.float32)}
    with pytest.raises(ValueError, match="rh"):
        source.beam_batch(odd, "BEAM0000", "heights", schema)
    square = {"shot_number": np.arange(3), "rh": np.arange(9, dtype=np.float32).reshape(3, 3)}
    assert source.beam_batch(square, "BEAM0000", "heights", schema).to_pydict()["rh"][0] == [0, 1, 2]
    with pytest.raises(ValueError, match="delta_time"):
        source.beam_batch({"shot_number": np.arange(3), "delta_time": np.zeros(2)}, "BEAM0000", "heights", schema)


def test_heights_keep_all_columns_by_algorithm(spark):
    variant = "struct<lat_highest:double,lat_lowest:double,lon_highest:double,lon_lowest:double>"
    rows = [("B", 1, 0.5, 0.5, 0.5, 0.5, [(0.5, 0.5, 0.5, 0.5), (9.0, 0.5, 0.5, 0.5)], "x"), ("B", 2, 9.0, 9.0, 9.0, 9.0, [(9.0, 9.0, 9.0, 9.0)], "y"), ("B", 3, 0.5, 0.5, 0.5, 0.5, None, "z")]
    t = spark.createDataFrame(rows, f"beam string, shot_number long, lat_lowestmode double, lon_lowestmode double, lat_highestreturn double, lon_highestreturn double, variants array<{variant}>, own string")
    got = granules.clip_heights(t, 0, 1, 0, 1)
    assert got.columns == [*t.columns, "algorithms"] and {r["shot_number"]: [v["algorithm"] for v in r["algorithms"]] for r in got.collect()} == {1: ["a1", "main"], 3: ["main"]}
    inside = granules.clip_heights_polygons(t, layers.layer(spark, [(1, [[(0, 0), (1, 0), (1, 1), (0, 1)]])]), "id")
    assert sorted((r["shot_number"], r["algorithm"], r["own"], r["poly_id"]) for r in inside.collect()) == [(1, "a1", "x", 1), (1, "main", "x", 1), (3, "main", "z", 1)]
    with pytest.raises(clip.NothingLeft):
        granules.clip_heights(t.filter("shot_number = 2"), 0, 1, 0, 1)


def test_a_cut_connection_is_no_download(tmp_path):
    import io

    class Body(io.BytesIO):
        expected = 100

    with pytest.raises(OSError, match="5 of 100"):
        download.download("https://host/cut.h5", str(tmp_path), opener=lambda *_: Body(b"01234"))
    assert not (tmp_path / "cut.h5").exists() and (tmp_path / f"cut.h5{download.PART}").read_bytes() == b"01234"
    (tmp_path / "old.h5").write_bytes(b"old")
    (tmp_path / f"old.h5{download.PART}").write_bytes(b"part of the old")
    assert download.download("https://host/old.h5", str(tmp_path), overwrite=True, opener=lambda url, begin, *_: io.BytesIO(b"new"[begin:])) == "done"
    assert (tmp_path / "old.h5").read_bytes() == b"new"
    with pytest.raises(TypeError, match="overwrite"):
        download.download("https://host/a", str(tmp_path), overwrite="yes")
    with pytest.raises(ValueError, match="folder"):
        download.download("https://host/a", str(tmp_path / "no" / "where"))


def test_downloads_from_a_server_that_closes_early(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    whole = bytes(range(256)) * 40

    class Handler(BaseHTTPRequestHandler):
        tries = 0

        def do_GET(self):
            begin = int(self.headers.get("Range", "bytes=0-")[6:-1])
            body = whole[begin:]
            self.send_response(206 if begin else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            Handler.tries += 1
            self.wfile.write(body[:3000] if Handler.tries == 1 else body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/g.h5"
    try:
        with pytest.raises(download.DownloadFailed, match="g.h5"):
            download.download_all([url], str(tmp_path))
        assert download.download_all([url], str(tmp_path)) == [(url, "done")] and (tmp_path / "g.h5").read_bytes() == whole
    finally:
        server.shutdown()


def test_coordinate_systems_of_layers():
    assert layers.srid_of_prj(None) == 4326 == layers.srid_of_prj('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137,298.257223563]]]')
    utm = 'PROJCS["WGS 84 / UTM zone 23S",GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32723"]]'
    assert layers.srid_of_prj(utm) == 32723 and layers.srid_of_prj('PROJCS["somewhere"]') == 0


def test_clip_tables_with_clashing_names(spark):
    t = spark.createDataFrame([(1, 0.5, 0.5, 9, "a", 1.0)], POINTS + ", poly_id long, edges string, bx0 double")
    shapes = layers.layer(spark, [(3, SQUARE)])
    for tile in (None, 0.5):
        both = spatial.clip_polygons(t, HEIGHTS, shapes, tile=tile)
        assert sorted(both.columns) == sorted(t.columns) and both.first()["poly_id"] == 3 and both.first()["edges"] == "a"
        assert spatial.clip_polygons(t, HEIGHTS, shapes, None, tile=tile).first()["poly_id"] == 9


def test_one_polygon_over_all_tiles(spark):
    rnd = __import__("random").Random(1)
    t = spark.createDataFrame([(i, rnd.uniform(-1, 11), rnd.uniform(-1, 11)) for i in range(2000)], POINTS)
    ring = [(5 + 5 * math.cos(2 * math.pi * k / 90), 5 + 5 * math.sin(2 * math.pi * k / 90)) for k in range(90)]
    shapes = layers.layer(spark, [(1, [ring]), (2, SQUARE)])
    assert spatial.LITERAL_EDGES < 98 <= spatial.BROADCAST_EDGES
    near = lambda tile: sorted(tuple(r) for r in spatial.clip_polygons(t, HEIGHTS, shapes, tile=tile).select("shot_number", "poly_id").collect())
    assert near(0.25) == near(None) and len(near(None)) > 1000


@pytest.mark.parametrize("most", [100, 2_000_000])
def test_running_numbers_in_any_group(spark, monkeypatch, most):
    from lidarlake.operators import ordering
    from lidarlake.operators.ordering import running

    monkeypatch.setattr(ordering, "WINDOW_ROWS", most)
    rows = [(g, i, v) for g, n in (("a", 500), ("b", 3), (None, 40)) for i, v in ((k, k % 5) for k in range(n))]
    got = {(r["g"], r["i"]): r["before"] for r in running(spark.createDataFrame(rows, "g string, i long, v int").repartition(7), ("g",), "i", "before", "v").collect()}
    assert len(got) == 543 and all(got[g, i] == sum(k % 5 for k in range(i)) for g, i, _ in rows)
    assert running(spark.createDataFrame([], "g string, i long"), ("g",), "i", "n").count() == 0


def test_samples_never_move(spark):
    product = spark.createDataFrame([(i, 10.0, 4.0, [float(k) for k in range(6)]) for i in range(50)], "shot_number long, elevation_bin0 double, elevation_lastbin double, rxwaveform array<float>")
    levels = waveform.height_levels(spark.createDataFrame([(i, 5.0, [k / 25 for k in range(101)]) for i in range(50)], "shot_number long, elev_lowestmode double, rh array<double>"))
    for out in (waveform.relative(product), waveform.outline(product), waveform.cumulative_energy(product, levels), waveform.amplitude_limits(product, levels)):
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
        explodes = next((k for k, x in enumerate(plan) if "Generate" in x and "rxwaveform" in "".join(plan[k : k + 4]) and "rh" not in x.split("Generate")[1][:40]), 0)
        assert not any("Exchange" in x for x in plan[:explodes]), "\n".join(plan)


def test_a_cluster_needs_a_shared_folder(spark):
    from lidarlake import runtime

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def test_vector_text(spark, tmp_path):
    from lidarlake.sources import vector

    t = spark.createDataFrame([(2**62, -44.125, -13.5, None), (7, None, 1.0, "q")], "shot_number long, x double, y double, note string")
    got = [json.loads(r["feature"]) for r in vector.features(t, "x", "y", 4).collect()]
    assert got[0] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-44.125, -13.5]}, "properties": {"shot_number": str(2**62), "note": None}} and got[1]["geometry"] is None
    vector.write_csv(t, "x", "y", f"{tmp_path}/c", digits=3)
    back = spark.read.option("header", "true").csv(f"{tmp_path}/c").filter("note is null").first()
    assert back["wkt"] == "POINT (-44.125 -13.500)" and back["shot_number"] == str(2**62)
    vector.write_features(t, "x", "y", f"{tmp_path}/g")
    assert spark.read.text(f"{tmp_path}/g").count() == 2


def test_arriving_files_are_clipped_once(spark, tmp_path):
    from lidarlake import streaming

    shapes = layers.layer(spark, [(1, SQUARE)])
    clips = {"box": lambda t: clip.clip_box(t, HEIGHTS, 0, 1, 0, 1), "polygons": lambda t: spatial.clip_polygons(t, HEIGHTS, shapes)}
    files = f"{tmp_path}/in"
    for n in range(2):
        spark.createDataFrame([(10 * n + 1, 0.5, 0.5), (10 * n + 2, 3.0, 3.0), (10 * n + 3, 9.0, 9.0)], POINTS).write.mode("append").parquet(files)
        for name, f in clips.items():
            rows = streaming.arrivals(spark, files, spark.read.parquet(files).schema)
            streaming.keep_clipping(rows, f, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", once=True).awaitTermination()
    assert ids(spark.read.parquet(f"{tmp_path}/box")) == [1, 11] and ids(spark.read.parquet(f"{tmp_path}/polygons")) == [1, 2, 11, 12]
