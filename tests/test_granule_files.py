"""Granule files: read by range, written by tasks; mergeable statistics; waveforms as rows of matrices."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from lidarlake.operators import clip, granules, profiles, stats, waveform
from lidarlake.plans.products import HEIGHTS
from lidarlake.sources import granule_writer
from lidarlake.sources import granules as source

COLUMNS = ["beam", "shot_number", "lat_lowestmode", "lon_lowestmode", "rh", "granule"]


def heights(n, first=0):
    """Shots along a track from (0, 0) to (1, 1)."""
    at = np.arange(n) / n
    return {"shot_number": np.arange(first, first + n, dtype=np.uint64), "lat_lowestmode": at, "lon_lowestmode": at, "rh": np.arange(101 * n, dtype=np.float32).reshape(n, 101)}


@pytest.fixture
def files(tmp_path):
    out = []
    for k in range(3):
        out.append(f"{tmp_path}/g{k}.npz")
        np.savez(out[-1], **{f"{b}/{c}": v for b, first in (("BEAM0000", 1000 * k), ("BEAM0001", 1000 * k + 500)) for c, v in heights(200, first).items()}, **{"METADATA/day": np.array(str(k))})
    return out


class Counted:
    """An array that tells which rows were read."""

    def __init__(self, values, log, name):
        self.values, self.log, self.name, self.shape, self.dtype, self.ndim = values, log, name, values.shape, values.dtype, values.ndim

    def __len__(self):
        return len(self.values)

    def __getitem__(self, key):
        self.log.append((self.name, key))
        return self.values[key]


def reader(filters, parts=1, shots=50, log=None, monkeypatch=None, paths=("a",)):
    schema = source.StructType([*source.SCHEMAS["heights"].fields, source.StructField("granule", source.StringType())])
    r = source.PushingReader(list(paths), "heights", source.StructType([schema[c] for c in COLUMNS]), False, parts, shots)
    kept = list(r.pushFilters(filters))
    assert kept == filters  # Spark asks the rows again
    if log is not None:
        monkeypatch.setattr(source, "open_granule", lambda _: {b: {c: Counted(v, log, f"{b}/{c}") for c, v in heights(200).items()} for b in ("BEAM0000", "BEAM0001")})
    return r


def test_only_the_ranges_of_a_box_are_read(monkeypatch):
    log = []
    box = [IsNotNull(("lat_lowestmode",)), GreaterThanOrEqual(("lat_lowestmode",), 0.3), LessThanOrEqual(("lat_lowestmode",), 0.4), LessThan(("lon_lowestmode",), 0.9)]
    r = reader(box, log=log, monkeypatch=monkeypatch)
    got = [x for p in r.partitions() for x in r.read(p)]
    assert [(x.column("beam")[0].as_py(), x.column("shot_number")[0].as_py(), x.num_rows) for x in got] == [("BEAM0000", 50, 50), ("BEAM0001", 50, 50)]
    assert {key for name, key in log if name.endswith("rh")} == {slice(50, 100)}  # one range of four
    assert {key for name, key in log if name.endswith("lat_lowestmode")} == {slice(a, a + 50) for a in range(0, 200, 50)}
    assert not [name for name, key in log if name.endswith("lon_lowestmode") and key != slice(50, 100)]  # the first comparison settled the others


def test_beams_files_and_lists_are_filters(monkeypatch):
    log = []
    r = reader([EqualTo(("beam",), "BEAM0001"), In(("shot_number",), (7, 180)), GreaterThan(("shot_number",), 100)], log=log, monkeypatch=monkeypatch)
    got = [x for p in r.partitions() for x in r.read(p)]
    assert [x.column("shot_number")[0].as_py() for x in got] == [150]
    assert not [n for n, _ in log if n.startswith("BEAM0000")]
    assert reader([EqualTo(("granule",), "b")], paths=("a", "b", "c"), parts=2).partitions() == [source.GranulePartition("b", 0, 2), source.GranulePartition("b", 1, 2)]


def test_values_that_are_no_numbers_are_for_spark_to_compare(monkeypatch):
    log = []
    r = reader([GreaterThan(("lat_lowestmode",), 5.0)], log=log, monkeypatch=monkeypatch)
    assert not [x for p in r.partitions() for x in r.read(p)]
    odd = heights(60) | {"lat_lowestmode": np.r_[np.zeros(55), np.full(5, np.nan)]}
    monkeypatch.setattr(source, "open_granule", lambda _: {"BEAM0000": odd})
    assert [x.num_rows for p in r.partitions() for x in r.read(p)] == [10]


def test_a_clip_over_files_equals_the_one_over_parquet(spark, files, tmp_path):
    whole = source.read_product(spark, ",".join(files), "heights", COLUMNS, "granule", whole=False)
    whole.write.parquet(f"{tmp_path}/rows")
    table = spark.read.parquet(f"{tmp_path}/rows")
    assert table.count() == 1200 and table.select("granule").distinct().count() == 3
    box = (0.25, 0.5, 0.125, 0.375)
    ranged = source.read_product(spark, ",".join(files), "heights", COLUMNS, "granule", whole=False, parts=3, shots=32, where=source.in_box(HEIGHTS, *box))
    got, want = (sorted(map(repr, clip.clip_box(t, HEIGHTS, *box).collect())) for t in (ranged, table))
    assert got == want and len(got) > 100 and ranged.count() == len(want) and ranged.rdd.getNumPartitions() == 9
    some = [("beam", "=", "BEAM0001"), ("shot_number", "in", [501, 1501, 3])]
    few = [source.read_product(spark, f"{tmp_path}/rows", "heights", ["rh"], where=some), source.read_product(spark, ",".join(files), "heights", ["rh"], "granule", whole=False, where=some)]
    assert [t.columns for t in few] == [["rh"]] * 2
    assert sorted(map(repr, few[0].collect())) == sorted(map(repr, few[1].collect())) != []


def test_filters_that_spark_pushes(spark, files):
    source.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda push: spark.read.format("footprint_granule").options(product="heights", shots="32", push=push, columns=source.json.dumps(COLUMNS)).load(",".join(files))
        assert load("true").filter("lat_lowestmode > 0.9 and lon_lowestmode <= 0.95").count() == 60
        whole = load("false")  # without it nothing that one query asks is left for the next
        assert whole.filter("lat_lowestmode > 0.9").count() == 114 and whole.count() == 1200
        assert whole.filter("lat_lowestmode > 0.9").unionByName(whole).count() == 1314
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_metadata_of_granules_that_have_rows_left(spark, files, tmp_path):
    rows = source.read_product(spark, ",".join(files), "heights", COLUMNS, "granule", whole=False)
    metadata = source.read_metadata(spark, files)
    granules.write_clip(rows.filter("shot_number between 1100 and 1200"), f"{tmp_path}/clip", metadata=metadata)
    left = granules.read_metadata(spark, f"{tmp_path}/clip").collect()
    assert {r["granule"] for r in left} == {files[1]} and [r["value"] for r in left if r["name"].endswith("day")] == ["1"]


def test_granules_are_written_and_read_back(spark, tmp_path):
    r = random.Random(0)
    rows = [(f"BEAM000{k % 3}", k, 0.5 + k, [float(r.randrange(9)) for _ in range(r.randrange(0, 6))], [1.5, 2.5, k / 4], f"g{k % 2}") for k in range(400)]
    t = spark.createDataFrame(rows, "beam string, shot_number long, latitude_bin0 double, rxwaveform array<float>, own array<double>, granule string")
    source.register(spark)
    out = f"{tmp_path}/o"
    t.repartition(4).write.format("footprint_granule").options(product="waveform", file_shots="60").mode("append").save(out)
    names = sorted(os.listdir(out))
    assert len(names) >= 7 and not [n for n in names if not n.endswith(".npz")]
    first = source.open_granule(f"{out}/{names[0]}")
    for beam in source.beams_of(first):
        start, count = (np.asarray(first[beam][c]) for c in ("rx_sample_start_index", "rx_sample_count"))
        assert start[0] == 1 and (start == np.cumsum(count) - count + 1).all() and count.sum() == len(first[beam]["rxwaveform"])
        assert (np.diff(np.asarray(first[beam]["shot_number"])) > 0).all() and "latitude_bin0" in first[beam]["geolocation"]
    assert set(np.asarray(first["METADATA"]["source_granule"])) <= {b"g0", b"g1"}
    back = source.read_product(spark, ",".join(f"{out}/{n}" for n in names), "waveform", form="granule")
    columns = ["beam", "shot_number", "latitude_bin0", "rxwaveform", "own"]
    assert sorted(map(repr, back.select(columns).collect())) == sorted(map(repr, t.select(columns).collect()))
    t.limit(10).coalesce(1).write.format("footprint_granule").options(product="waveform").mode("overwrite").save(out)
    assert len(os.listdir(out)) == 1


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    source.register(spark)
    t = spark.range(100).select(F.lit("BEAM0000").alias("beam"), F.col("id").alias("shot_number"), F.when(F.col("id") < 90, 1).alias("flag"))
    out = f"{tmp_path}/o"
    with pytest.raises(Exception, match="flag"):
        t.repartition(4).write.format("footprint_granule").options(product="waveform").mode("append").save(out)
    assert not os.path.exists(out) or os.listdir(out) == []
    for bad in (t.select("shot_number"), t.select("beam", "shot_number", F.struct("flag").alias("s"))):
        with pytest.raises(Exception, match="granule"):
            bad.write.format("footprint_granule").options(product="waveform").mode("append").save(out)


def test_missing_values_of_a_beam():
    import pyarrow as pa

    made = granule_writer.beam_datasets(pa.table({"beam": ["b", "b"], "shot_number": [1, 2], "x": pa.array([None, 2.0]), "rxwaveform": pa.array([None, [1.0]], pa.list_(pa.float32())), "name": ["é", "n"]}), "waveform")
    assert np.isnan(made["x"][0]) and made["rx_sample_count"].tolist() == [0, 1] and made["rx_sample_start_index"].tolist() == [1, 1] and made["name"][0] == "é".encode()
    with pytest.raises(ValueError, match="own"):
        granule_writer.beam_datasets(pa.table({"own": pa.array([[1.0], [1.0, 2.0]])}), "waveform")


def test_tracks_are_by_granule(spark):
    rows = [("B", g, s, 10.0, 7.0, [1.0] * 30) for g in ("x", "y") for s in (5, 9, 11)]
    t = spark.createDataFrame(rows, "beam string, granule string, shot_number long, elev_lowestmode double, height_bin0 double, pai_z array<float>")
    got = profiles.track_profile(t, "pai", "B")
    assert sorted({(r["granule"], r["shot_number"], r["rowid"]) for r in got.collect()}) == [(g, s, k) for g in ("x", "y") for k, s in enumerate((5, 9, 11), 1)]
    assert profiles.track_lines(got).count() == 6 and profiles.track_profile(t.drop("granule"), "pai", "B").select("rowid").distinct().count() == 6


# --- mergeable statistics

MEAN = stats.Statistic(lambda: (0, 0.0), lambda s, v: (s[0] + int((~np.isnan(v)).sum()), s[1] + float(np.nansum(v))), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[1] / s[0] if s[0] else None)
SEEN = stats.Statistic(set, lambda s, v: s | set(v[~np.isnan(v)].tolist()), lambda a, b: a | b, len)


@pytest.mark.parametrize("most", [50_000, 1])
def test_mergeable_statistics_of_a_hot_key(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "MOST_GROUPS", most)
    rows = [(None if k % 50 == 0 else "hot" if k % 10 else f"k{k % 7}", k % 3, float(k % 11) if k % 4 else None) for k in range(3000)]
    t = spark.createDataFrame(rows, "key string, part long, x double").repartition(16)
    got = {(r["key"], r["part"]): (r["mean"], r["seen"]) for r in stats.summarise_mergeable(t, {"mean": ("x", MEAN), "seen": ("x", SEEN)}, ["key", "part"]).collect()}
    groups = {}
    for key, part, x in rows:
        groups.setdefault((key, part), []).append(x)
    assert set(got) == set(groups)
    for k, xs in groups.items():
        own = [x for x in xs if x is not None]
        assert got[k][1] == len(set(own)) and (got[k][0] is None if not own else abs(got[k][0] - sum(own) / len(own)) < 1e-9)
    one = stats.summarise_mergeable(t, {"seen": ("x", SEEN)}).collect()
    assert [tuple(r) for r in one] == [(11.0,)]
    assert stats.summarise_mergeable(t.limit(0), {"seen": ("x", SEEN)}, "key").count() == 0


def test_a_hot_key_is_merged_in_steps(spark):
    """No task merges the states of all tasks: they meet in a few places first."""
    t = spark.range(0, 4000, 1, 64).select(F.lit("hot").alias("key"), F.col("id").cast("double").alias("x"))
    most = stats.Statistic(lambda: 0, lambda s, v: 0, lambda a, b: max(a, b) + 1, lambda s: s)
    depth = stats.summarise_mergeable(t, {"n": ("x", most)}, "key").first()["n"]
    assert depth < 64  # states that were merged one after the other


# --- waveforms


def test_curves_of_odd_waveforms(spark):
    rows = [(1, 10.0, 4.0, [1.0, 3.0, 2.0, 5.0, 2.0, 1.0]), (2, 10.0, 4.0, [2.0] * 6), (3, 10.0, 4.0, []), (4, 10.0, 4.0, None), (5, 10.0, 4.0, [7.0]), (6, 10.0, 4.0, [1.0, 2.0, 4.0]), (7, 5.0, 5.0, [1.0, 2.0])]
    product = spark.createDataFrame(rows, "shot_number long, elevation_bin0 double, elevation_lastbin double, rxwaveform array<float>")
    levels = waveform.height_levels(spark.createDataFrame([(k, 5.0, [j / 25 for j in range(101)]) for k in range(1, 9)], "shot_number long, elev_lowestmode double, rh array<double>"))
    curve = {}
    for r in waveform.cumulative_energy(product, levels).collect():
        curve.setdefault(r["shot_number"], []).append((r["bin"], r["elevation"], r["energy"]))
    assert sorted(b for b, *_ in curve[1]) == [1, 2, 3, 4, 5] and 3 not in curve and 4 not in curve
    energy = {b: e for b, _, e in curve[1]}
    total = np.cumsum([1.0, 4.0, 1.0, 2.0, 0.0])  # from bin 5 up, above the least amplitude
    want = total / ((total.max() - total.min()) / 4.0) + 1.0
    assert np.allclose([energy[b] for b in (5, 4, 3, 2, 1)], want)
    assert all(e is None for _, _, e in curve[2]) and all(e is None for _, _, e in curve.get(7, []))
    marks = waveform.energy_marks(product, levels)
    again = waveform.marks(waveform.cumulative_energy(product, levels), levels) if hasattr(waveform, "marks") else marks
    assert sorted(map(repr, marks.collect())) == sorted(map(repr, again.select(marks.columns).collect()))
    for out in (marks, waveform.cumulative_energy(product, levels)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Generate explode(rxwaveform" not in plan
    assert waveform.energy_marks(product.limit(0), levels).count() == 0


# --- rasters


@pytest.mark.parametrize("side", [4, 64])
def test_tiles_hold_the_cells(spark, side):
    from lidarlake.operators import grid, raster

    r = random.Random(side)
    g = grid.Grid(0.0, 0.0, 1.0, 21, 13)
    cells = {(a, b): (r.randrange(9), r.random()) for a in range(13) for b in range(21) if r.random() < 0.4 or a == 5}
    stats_ = spark.createDataFrame([(a, b, *v) for (a, b), v in cells.items()], "row long, col long, n long, x double")
    tiled = raster.tiles(stats_, ["n", "x"], side)
    assert tiled.count() == len({(a // side, b // side) for a, b in cells})
    for t in tiled.collect():
        places = [p for run in t["runs"] for p in range(run["start"], run["start"] + run["length"])]
        assert places == sorted(places) and len(places) == len(t["n"]) == len(t["x"])
        assert all(b["start"] > a["start"] + a["length"] for a, b in zip(t["runs"], t["runs"][1:]))
    back = {(x["row"], x["col"]): (x["n"], x["x"]) for x in raster.unpack(tiled, g, ["n", "x"], side).collect()}
    assert back == cells
    dense = raster.unpack(tiled, g, ["n", "x"], side, dense=True).collect()
    assert sorted(x["cell"] for x in dense) == list(range(1, 13 * 21 + 1))
    assert all((x["n"], x["x"]) == cells.get((x["row"], x["col"]), (None, None)) for x in dense)
    assert raster.tiles(stats_.limit(0), ["n"]).count() == 0


def test_overviews_halve(spark):
    from lidarlake.operators import raster

    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 4), (3, 3, 8), (5, 2, 16)], "row long, col long, n long")
    got = {(t["level"], t["tile_row"], t["tile_col"]): (t["n"], [tuple(x) for x in t["runs"]]) for t in raster.overviews(cells, {"n": "sum"}, 2, 2).collect()}
    assert got[1, 0, 0] == ([7, 8], [(0, 1), (3, 1)]) and got[1, 1, 0] == ([16], [(1, 1)]) and got[2, 0, 0] == ([15, 16], [(0, 1), (2, 1)])
    with pytest.raises(ValueError, match="mean"):
        raster.overviews(cells, {"n": "mean"}, 1)


# --- flat arrays in pages


def test_flat_arrays_in_pages(spark):
    r = random.Random(8)
    rows = [("A" if k % 3 else "B", k, [float(r.randrange(99)) for _ in range(r.choice([0, 1, 2, 7, 40]))]) for k in range(80)]
    t = spark.createDataFrame(rows, "beam string, shot_number long, rxwaveform array<float>").withColumn("rx_sample_count", F.size("rxwaveform"))
    placed = granules.flat_index(t)
    flat = granules.pages(t.join(placed, ["beam", "shot_number", "rx_sample_count"]), size=16)
    held = {(x["beam"], x["page"]): x["values"] for x in flat.collect()}
    for beam in "AB":
        want = [v for b, _, w in rows if b == beam for v in w]
        assert [v for p in range(-(-len(want) // 16)) for v in held[beam, p]] == want and max(len(v) for v in held.values()) == 16
    whole = spark.createDataFrame([(b, [v for c, _, w in rows if c == b for v in w]) for b in "AB"], "beam string, values array<float>")
    for buffers in (flat, whole):
        back = {x["shot_number"]: x["rxwaveform"] for x in granules.gather(buffers, placed, size=16).collect()}
        assert back == {k: w for _, k, w in rows}
    twice = granules.gather(flat, placed.unionByName(placed), size=16).collect()
    assert len(twice) == 160 and all(x["rxwaveform"] == rows[x["shot_number"]][2] for x in twice)
