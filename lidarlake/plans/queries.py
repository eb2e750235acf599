"""The queries of the footprint operators, each with the same question in SQL where SQL can put it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import metric_set, nullify
from ..operators import clip, extract, granules, grid, profiles, raster, spatial, stats, waveform
from ..runtime import scratch, ship
from ..sources import catalog, vector, views
from ..sources import granules as source
from .products import BEAMS, CANOPY, CANOPY_DEFAULT, HEIGHT_COLUMNS, HEIGHTS, N_RH, PAI, PAVD, PROFILE_COLUMNS, WAVEFORM_GEO, profile_names

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BOX = (0.25, 0.625, 0.125, 0.75)
_IN = "{0} >= 0.25 AND {0} <= 0.625 AND {1} >= 0.125 AND {1} <= 0.75"
_NEAR = "{0} >= 0.25 AND {0} <= 0.9375 AND {1} >= 0.125 AND {1} <= 0.875"
BEAM = "BEAM0101"


def query(sql: str | None = None):
    """Register a query; sql follows the common views."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = views.SQL + sql
        return run

    return add


# --- extraction ---------------------------------------------------------------------------------------------------


@query("SELECT shot_number, latitude_bin0, latitude_lastbin, longitude_bin0, longitude_lastbin, elevation_bin0, elevation_lastbin FROM geo")
def extract_geo(spark, d):
    return extract.waveform_geolocation(views.geolocation(spark, d))


@query("SELECT shot_number, latitude_bin0, latitude_lastbin, longitude_bin0, longitude_lastbin, delta_time FROM geo")
def extract_geo_select(spark, d):
    return extract.waveform_geolocation(views.geolocation(spark, d), ["delta_time", "shot_number"])


@query("SELECT * FROM samples WHERE shot_number = 7")
def extract_waveform_one(spark, d):
    return waveform.waveform(views.waveforms(spark, d), 7)


@query("SELECT * FROM samples")
def extract_waveform_all(spark, d):
    return waveform.samples(views.waveforms(spark, d))


@query(f"SELECT {', '.join(HEIGHT_COLUMNS)}, {', '.join(f'CAST({i} * k / 64 AS FLOAT) AS rh{i}' for i in range(N_RH))} FROM heights")
def extract_rh_wide(spark, d):
    return extract.height_metrics(views.heights(spark, d))


@query(f"SELECT {', '.join(CANOPY_DEFAULT)} FROM canopy")
def extract_vpm_cols(spark, d):
    return extract.canopy_metrics(views.canopy(spark, d))


@query(f"SELECT {', '.join(PROFILE_COLUMNS)}, {', '.join(f'pai_z[{k + 1}] AS {n}' for k, n in enumerate(profile_names('pai')))} FROM profile")
def extract_pai_wide(spark, d):
    return extract.profile(views.profiles(spark, d), "pai")


@query(f"SELECT {', '.join(PROFILE_COLUMNS)}, {', '.join(f'pavd_z[{k + 1}] AS {n}' for k, n in enumerate(profile_names('pavd')))} FROM profile")
def extract_pavd_wide(spark, d):
    return extract.profile(views.profiles(spark, d), "pavd")


@query("SELECT shot_number, CAST(unnest(range(0, 30)) AS INTEGER) AS bin, unnest(pai_z) AS value FROM profile")
def extract_pai_long(spark, d):
    return extract.long_profile(views.profiles(spark, d), "pai")


@query("SELECT beam, shot_number, value FROM shots")
def beam_union(spark, d):
    s = views.shots(spark, d).select("beam", "shot_number", "value")
    return extract.union([*(extract.of_beam(s, b) for b in BEAMS), s.select("beam").limit(0)])


@query("SELECT shot_number, value FROM shots WHERE beam = 'BEAM0101'")
def beam_filter(spark, d):
    return extract.of_beam(views.shots(spark, d), BEAM).select("shot_number", "value")


@query("SELECT DISTINCT beam FROM shots")
def beam_discovery(spark, d):
    return extract.beams(views.shots(spark, d))


# --- clips by a box -----------------------------------------------------------------------------------------------

_BOTH = f"{_IN.format('longitude_bin0', 'latitude_bin0')} AND {_IN.format('longitude_lastbin', 'latitude_lastbin')}"
_LOWEST = _IN.format("lon_lowestmode", "lat_lowestmode")


@query(f"SELECT shot_number, longitude_bin0, latitude_bin0 FROM geo WHERE {_BOTH}")
def clip_bbox_geo(spark, d):
    return clip.clip_box(views.geolocation(spark, d), WAVEFORM_GEO, *BOX).select("shot_number", "longitude_bin0", "latitude_bin0")


@query(f"SELECT shot_number, lon_lowestmode, lat_lowestmode FROM heights WHERE {_LOWEST}")
def clip_bbox_2am(spark, d):
    return clip.clip_box(views.heights(spark, d), HEIGHTS, *BOX).select("shot_number", "lon_lowestmode", "lat_lowestmode")


@query(f"SELECT * FROM canopy WHERE {_BOTH}")
def clip_bbox_vpm(spark, d):
    return clip.clip_box(extract.canopy_metrics(views.canopy(spark, d)), CANOPY, *BOX)


@query(f"SELECT shot_number, pai_z[1] AS pai_z0_5m FROM profile WHERE {_LOWEST}")
def clip_bbox_pai(spark, d):
    return clip.clip_box(extract.profile(views.profiles(spark, d), "pai"), PAI, *BOX).select("shot_number", "pai_z0_5m")


@query(f"SELECT shot_number, pavd_z[1] AS pavd_z0_5m FROM profile WHERE {_LOWEST}")
def clip_bbox_pavd(spark, d):
    return clip.clip_box(extract.profile(views.profiles(spark, d), "pavd"), PAVD, *BOX).select("shot_number", "pavd_z0_5m")


@query("SELECT min(lon) AS xmin, max(lon) AS xmax, min(lat) AS ymin, max(lat) AS ymax FROM shots")
def extent(spark, d):
    return clip.extent(views.shots(spark, d), "lon", "lat")


# --- clips by polygons --------------------------------------------------------------------------------------------

_NEAR_BOTH = f"{_NEAR.format('longitude_bin0', 'latitude_bin0')} AND {_NEAR.format('longitude_lastbin', 'latitude_lastbin')}"


@query(f"SELECT shot_number, longitude_bin0, longitude_lastbin, poly_id FROM geo JOIN hits USING (shot_number) WHERE {_NEAR_BOTH}")
def clip_poly_geo(spark, d):
    return spatial.clip_polygons(views.geolocation(spark, d), WAVEFORM_GEO, views.polygons(spark)).select("shot_number", "longitude_bin0", "longitude_lastbin", "poly_id")


@query("SELECT shot_number, beam, poly_id FROM heights JOIN hits USING (shot_number)")
def clip_poly_2am(spark, d):
    return spatial.clip_polygons(views.heights(spark, d), HEIGHTS, views.polygons(spark)).select("shot_number", "beam", "poly_id")


@query(f"SELECT canopy.*, poly_id FROM canopy JOIN hits USING (shot_number) WHERE {_NEAR_BOTH}")
def clip_poly_vpm(spark, d):
    return spatial.clip_polygons(extract.canopy_metrics(views.canopy(spark, d)), CANOPY, views.polygons(spark))


@query("SELECT shot_number, pai_z[2] AS pai_z5_10m, poly_id FROM profile JOIN hits2 USING (shot_number)")
def clip_poly_pai(spark, d):
    return spatial.clip_polygons(extract.profile(views.profiles(spark, d), "pai"), PAI, views.polygons(spark)).select("shot_number", "pai_z5_10m", "poly_id")


@query("SELECT shot_number, pavd_z[2] AS pavd_z5_10m, poly_id FROM profile JOIN hits2 USING (shot_number)")
def clip_poly_pavd(spark, d):
    return spatial.clip_polygons(extract.profile(views.profiles(spark, d), "pavd"), PAVD, views.polygons(spark)).select("shot_number", "pavd_z5_10m", "poly_id")


@query("SELECT shot_number, count(*) AS polygons FROM hits GROUP BY 1 HAVING count(*) > 1")
def clip_poly_overlap(spark, d):
    return spatial.clip_polygons(views.heights(spark, d), HEIGHTS, views.polygons(spark)).groupBy("shot_number").agg(F.count("*").alias("polygons")).filter("polygons > 1")


@query("SELECT count(*) AS n FROM hits JOIN shots USING (shot_number) WHERE poly_id = 1 AND lon > 0.4375 AND lon < 0.5625 AND lat > 0.4375 AND lat < 0.5625")
def clip_poly_hole(spark, d):
    s = spatial.clip_polygons(views.heights(spark, d), HEIGHTS, views.polygons(spark).filter("id = 1"))
    inner = (F.col("lon_lowestmode") > 0.4375) & (F.col("lon_lowestmode") < 0.5625) & (F.col("lat_lowestmode") > 0.4375) & (F.col("lat_lowestmode") < 0.5625)
    return s.filter(inner).agg(F.count("*").alias("n"))


@query("SELECT shot_number, lon, lat FROM hits JOIN shots USING (shot_number) WHERE poly_id = 1 AND (lon IN (0.25, 0.75) OR lat IN (0.25, 0.75))")
def clip_poly_boundary(spark, d):
    s = spatial.clip_polygons(views.heights(spark, d), HEIGHTS, views.polygons(spark).filter("id = 1"))
    rim = F.col("lon_lowestmode").isin(0.25, 0.75) | F.col("lat_lowestmode").isin(0.25, 0.75)
    return s.filter(rim).select("shot_number", F.col("lon_lowestmode").alias("lon"), F.col("lat_lowestmode").alias("lat"))


@query("SELECT shot_number, beam FROM heights JOIN hits USING (shot_number)")
def clip_poly_nosplit(spark, d):
    return spatial.clip_polygons(views.heights(spark, d), HEIGHTS, views.polygons(spark), None).select("shot_number", "beam")


@query("SELECT shot_number, poly_id FROM hits")
def clip_poly_tiles(spark, d):
    return spatial.clip_polygons(views.heights(spark, d), HEIGHTS, views.polygons(spark), tile=0.125).select("shot_number", "poly_id")


@query("SELECT poly_id, count(*) AS n FROM hits GROUP BY 1 UNION ALL SELECT CAST(3 AS BIGINT), CAST(0 AS BIGINT)")
def clip_poly_counts(spark, d):
    shapes = views.layer(spark, [*views.POLYGONS, (3, [[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]])])
    return spatial.polygon_counts(spatial.clip_polygons(views.heights(spark, d), HEIGHTS, shapes), shapes)


@query(f"SELECT shot_number, poly_id FROM shots, ({views.sql_edges(views.REPAIRED)}) AS e(poly_id, x1, y1, x2, y2) GROUP BY shot_number, poly_id, lon, lat HAVING {views.SQL_INSIDE}")
def clip_poly_invalid(spark, d):
    return spatial.clip_polygons(views.heights(spark, d), HEIGHTS, views.layer(spark, views.INVALID)).select("shot_number", "poly_id")


_LINES = "SELECT shot_number, (shot_number * 37) % 4093 / 4096e0 AS lon, (shot_number * 53) % 4091 / 4096e0 AS lat FROM (SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS shot_number FROM lineitem)"


@query(f"""SELECT shot_number, 8 AS samples, poly_id FROM (
  SELECT shot_number, CAST(0 AS BIGINT) AS poly_id, row_number() OVER () AS r FROM (SELECT row_number() OVER () AS n, * FROM ({_LINES})), ({views.sql_edges([(0, [views.WIDE])])}) AS e(k, x1, y1, x2, y2) GROUP BY n, shot_number, lon, lat HAVING {views.SQL_INSIDE}
  UNION ALL SELECT shot_number, CAST(1 + j * {views.PER_ROW} + i AS BIGINT), 0 FROM ({_LINES}) JOIN (SELECT unnest(range({views.PER_ROW})) AS i) a ON lon BETWEEN i / {views.PER_ROW}e0 AND i / {views.PER_ROW}e0 + {views.SIDE}e0
    JOIN (SELECT unnest(range({views.SMALL // views.PER_ROW})) AS j) b ON lat BETWEEN j / {views.PER_ROW}e0 AND j / {views.PER_ROW}e0 + {views.SIDE}e0)""")
def clip_poly_covering(spark, d):
    rows = spatial.clip_polygons(views.line_footprints(spark, d), HEIGHTS, views.many_polygons(spark))
    return rows.select("shot_number", F.size("rxwaveform").alias("samples"), "poly_id")


# --- whole products -----------------------------------------------------------------------------------------------


@query(f"SELECT geo.* FROM geo WHERE {_BOTH}")
def clip_product_1b(spark, d):
    return granules.clip_granule(views.geolocation(spark, d), WAVEFORM_GEO, *BOX)


_VARIANTS = ", ".join(f"SELECT beam, shot_number, '{a}' AS algorithm, lat_lowestmode + {o} AS lat_highest, lat_lowestmode AS lat_lowest, lon_highestreturn + {o} AS lon_highest, lon_lowestmode AS lon_lowest FROM heights" for a, o in (("a1", "0e0"), ("a2", "0.125e0"), ("main", "0e0"))).replace(", SELECT", " UNION ALL SELECT")


@query(f"SELECT * FROM ({_VARIANTS}) WHERE {_IN.format('lon_lowest', 'lat_lowest')} AND {_IN.format('lon_highest', 'lat_highest')}")
def clip_product_2a_algorithms(spark, d):
    return granules.clip_variants(views.heights(spark, d), *BOX)


@query(f"SELECT algorithm, poly_id, count(*) AS n FROM ({_VARIANTS}) JOIN hits USING (shot_number) WHERE {_NEAR.format('lon_highest', 'lat_highest')} GROUP BY 1, 2")
def clip_product_2a_polygons(spark, d):
    return granules.clip_variants_polygons(views.heights(spark, d), views.polygons(spark), "id").groupBy("algorithm", "poly_id").agg(F.count("*").alias("n"))


@query(f"SELECT shot_number, pai FROM canopy WHERE {_BOTH}")
def clip_product_2b(spark, d):
    return granules.clip_granule(extract.canopy_metrics(views.canopy(spark, d)), CANOPY, *BOX).select("shot_number", "pai")


@query(f"SELECT beam, CAST(poly_id AS INTEGER) AS poly_id, shot_number, rx_sample_count FROM geo JOIN hits USING (shot_number) WHERE {_NEAR_BOTH}")
def clip_product_split(spark, d):
    rows = granules.clip_granule_polygons(views.geolocation(spark, d), WAVEFORM_GEO, views.polygons(spark), "id")
    path = scratch(spark)
    granules.write_clip(rows, path)
    return spark.read.parquet(path).select("beam", "poly_id", "shot_number", "rx_sample_count")


@query(f"SELECT 'g' || n_nationkey AS granule, n_name AS name, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_nationkey IN (SELECT shot_number % 1009 FROM geo WHERE {_BOTH})")
def clip_metadata(spark, d):
    granule = lambda c: F.concat(F.lit("g"), c.cast("string")).alias("granule")
    rows = views.geolocation(spark, d).select("*", granule(F.col("shot_number") % 1009))
    metadata = spark.read.parquet(f"{d}/nation.parquet").select(granule(F.col("n_nationkey")), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("value"))
    path = scratch(spark)
    granules.write_clip(granules.clip_granule(rows, WAVEFORM_GEO, *BOX), path, metadata=metadata)
    return granules.read_metadata(spark, path)


@query("SELECT beam, shot_number, rx_sample_count, CAST(1 + coalesce(sum(rx_sample_count) OVER (PARTITION BY beam ORDER BY shot_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_index FROM geo")
def csr_rebase(spark, d):
    return granules.flat_index(views.geolocation(spark, d))


@query("SELECT beam, shot_number, CAST(shot_number - min(shot_number) OVER (PARTITION BY beam) + 1 AS BIGINT) AS start_index FROM geo")
def csr_normalise(spark, d):
    return granules.normalised_start(views.geolocation(spark, d), "shot_number").select("beam", "shot_number", "start_index")


@query("SELECT beam, CAST(sum(rx_sample_count) AS BIGINT) AS rx, CAST(sum(tx_sample_count) AS BIGINT) AS tx FROM geo GROUP BY 1")
def total_samples(spark, d):
    return granules.total_samples(views.geolocation(spark, d))


def _stored(spark, table: DataFrame) -> str:
    path = scratch(spark)
    table.write.parquet(path)
    return path


def _with_arrays(spark, d) -> DataFrame:
    """Waveform rows with their samples, 1 k, 2 k and so on, and a column that no product knows."""
    wave = F.transform(F.sequence(F.lit(1), F.col("rx_sample_count")), lambda i: (i * (F.col("elevation_bin0") - 200)).cast("float"))
    return views.geolocation(spark, d).withColumns({"rxwaveform": wave, "own_flag": F.col("shot_number") % 7})


_WAVE = "list_transform(range(1, rx_sample_count + 1), lambda i: CAST(i * (elevation_bin0 - 200) AS FLOAT))"


@query(f"SELECT shot_number, latitude_bin0, own_flag, len(w) AS n, CAST(list_sum(w) AS DOUBLE) AS total FROM (SELECT *, shot_number % 7 AS own_flag, {_WAVE} AS w FROM geo)")
def read_l1b(spark, d):
    rows = source.read_product(spark, _stored(spark, _with_arrays(spark, d)), "waveform")
    total = F.aggregate("rxwaveform", F.lit(0.0), lambda a, v: a + v)
    return rows.select("shot_number", "latitude_bin0", "own_flag", F.size("rxwaveform").cast("long").alias("n"), total.alias("total"))


@query("SELECT shot_number, lat_highestreturn, lon_highestreturn, value, CAST(k / 2 AS FLOAT) AS rh32, CAST(2 AS BIGINT) AS algorithms FROM heights")
def read_l2a(spark, d):
    rows = source.read_product(spark, _stored(spark, views.heights(spark, d)), "heights")
    return rows.select("shot_number", "lat_highestreturn", "lon_highestreturn", "value", F.get("rh", F.lit(32)).alias("rh32"), F.size("variants").cast("long").alias("algorithms"))


@query(f"SELECT {', '.join(CANOPY_DEFAULT)} FROM canopy")
def read_l2b(spark, d):
    return extract.canopy_metrics(source.read_product(spark, _stored(spark, views.canopy(spark, d)), "canopy"))


@query(f"SELECT shot_number, beam, rx_sample_count, own_flag, len(w) AS n, CAST(list_sum(w) AS DOUBLE) AS total FROM (SELECT *, shot_number % 7 AS own_flag, {_WAVE} AS w FROM geo WHERE {_BOTH})")
def clip_1b_arrays(spark, d):
    rows = granules.clip_granule(_with_arrays(spark, d), WAVEFORM_GEO, *BOX)
    total = F.aggregate("rxwaveform", F.lit(0.0), lambda a, v: a + v)
    return rows.select("shot_number", "beam", "rx_sample_count", "own_flag", F.size("rxwaveform").cast("long").alias("n"), total.alias("total"))


@query(f"""SELECT shot_number, sensitivity, value, CAST(k / 2 AS FLOAT) AS rh32, string_agg(algorithm, ',' ORDER BY algorithm) AS algorithms FROM (
  SELECT v.*, h.sensitivity, h.value, h.k FROM ({_VARIANTS}) v JOIN heights h USING (shot_number)) WHERE {_IN.format('lon_lowest', 'lat_lowest')} AND {_IN.format('lon_highest', 'lat_highest')} GROUP BY shot_number, sensitivity, value, k""")
def clip_2a_full(spark, d):
    rows = granules.clip_heights(views.heights(spark, d), *BOX)
    return rows.select("shot_number", "sensitivity", "value", F.get("rh", F.lit(32)).alias("rh32"), F.array_join(F.array_sort(F.col("algorithms.algorithm")), ",").alias("algorithms"))


@query(f"SELECT algorithm, poly_id, shot_number, sensitivity, lat_highest FROM (SELECT v.*, sensitivity FROM ({_VARIANTS}) v JOIN heights h USING (shot_number)) JOIN hits USING (shot_number) WHERE {_NEAR.format('lon_highest', 'lat_highest')}")
def clip_2a_full_polygons(spark, d):
    return granules.clip_heights_polygons(views.heights(spark, d), views.polygons(spark), "id").select("algorithm", "poly_id", "shot_number", "sensitivity", "lat_highest")


@query(f"SELECT shot_number, poly_id, pai, cover FROM canopy JOIN hits USING (shot_number) WHERE {_NEAR_BOTH}")
def clip_2b_polygons(spark, d):
    return granules.clip_granule_polygons(extract.canopy_metrics(views.canopy(spark, d)), CANOPY, views.polygons(spark), "id").select("shot_number", "poly_id", "pai", "cover")


@query("SELECT beam, count(*) AS shots, CAST(0 AS BIGINT) AS gaps FROM geo GROUP BY 1")
def csr_gather(spark, d):
    # pages of each beam's flat array hold the shots' samples one after the other, and give each shot its own again
    rows = _with_arrays(spark, d).drop("own_flag")
    placed = granules.flat_index(rows)
    flat = granules.pages(rows.select("beam", "shot_number", "rxwaveform").join(placed, ["beam", "shot_number"]), size=1024)
    back = granules.gather(flat, placed, size=1024).withColumnRenamed("rxwaveform", "again")
    same = rows.join(back.select("beam", "shot_number", "again"), ["beam", "shot_number"])
    return same.groupBy("beam").agg(F.count("*").alias("shots"), F.sum(F.when(F.col("again") == F.col("rxwaveform"), 0).otherwise(1)).alias("gaps"))


_NUMBER = "CAST(CAST({0} AS DECIMAL(20,10)) AS VARCHAR)"


@query(f"SELECT CAST(shot_number AS VARCHAR) AS shot_number, 'POINT (' || {_NUMBER.format('lon')} || ' ' || {_NUMBER.format('lat')} || ')' AS wkt FROM shots")
def export_wkt(spark, d):
    return vector.with_wkt(views.shots(spark, d).select("shot_number", "lon", "lat"), "lon", "lat").select("shot_number", "wkt")


@query(f"""SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || {_NUMBER.format('lon')} || ',' || {_NUMBER.format('lat')} || ']}},"properties":{{"shot_number":"' || shot_number || '","beam":"' || beam || '"}}}}' AS feature FROM shots""")
def export_geojson(spark, d):
    return vector.features(views.shots(spark, d).select("shot_number", "beam", "lon", "lat"), "lon", "lat")


# --- statistics ---------------------------------------------------------------------------------------------------


def _clean(spark, d):
    return nullify(views.heights(spark, d), ["value"])


def _in_polygons(spark, d):
    return spatial.clip_polygons(_clean(spark, d), HEIGHTS, views.polygons(spark))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in df.columns if c in ("mean", "sd")})


_CLEAN = "nullif(value, -9999e0)"
_FOUR = f"min({_CLEAN}) AS min, max({_CLEAN}) AS max, round(avg({_CLEAN}), 9) AS mean, round(stddev_samp({_CLEAN}), 9) AS sd"


@query("SELECT max(k / 4) AS max FROM shots")
def stats_global(spark, d):
    return stats.summarise(extract.canopy_metrics(views.canopy(spark, d)), {"max": F.max("rh100")})


@query(f"SELECT poly_id, {_FOUR} FROM shots JOIN hits USING (shot_number) GROUP BY 1")
def stats_by_poly(spark, d):
    return _rounded(stats.summarise(_in_polygons(spark, d), column="value", by="poly_id", na_rm=True))


@query("SELECT poly_id, min(k) AS min, max(k) AS max, round(avg(k), 9) AS mean, round(stddev_samp(k), 9) AS sd FROM shots JOIN hits USING (shot_number) GROUP BY 1")
def stats_metric_set(spark, d):
    table = _in_polygons(spark, d).withColumn("k", (F.col("solar_elevation") + 20).cast("double"))
    return _rounded(stats.summarise(table, lambda c: metric_set(c), column="k", by="poly_id"))


@query(f"SELECT poly_id, beam, count(*) AS n, max({_CLEAN}) AS max FROM shots JOIN hits USING (shot_number) GROUP BY 1, 2")
def stats_multi_key(spark, d):
    return stats.summarise(_in_polygons(spark, d), {"n": F.count("*"), "max": F.max("value")}, by=["poly_id", "beam"])


@query(f"SELECT beam, CASE WHEN count({_CLEAN}) = count(*) THEN max({_CLEAN}) END AS max FROM shots GROUP BY 1")
def stats_na_strict(spark, d):
    return stats.summarise(_clean(spark, d), metric_set("value", ["max"]), by="beam")


@query(f"SELECT beam, max({_CLEAN}) AS max FROM shots GROUP BY 1")
def stats_na_rm(spark, d):
    return stats.summarise(_clean(spark, d), metric_set("value", ["max"], na_rm=True), by="beam")


@query("SELECT beam, CAST(max(k) - min(k) AS DOUBLE) AS spread FROM shots GROUP BY 1")
def stats_custom_udaf(spark, d):
    return stats.summarise_custom(views.shots(spark, d), "k", lambda s: s.max() - s.min(), "spread", "beam")


#: The root mean square and the range, in parts.
_RMS = stats.Statistic(lambda: (0, 0.0), lambda s, v: (s[0] + len(v), s[1] + float((v * v).sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: (s[1] / s[0]) ** 0.5 if s[0] else None)
_SPREAD = stats.Statistic(lambda: (float("inf"), float("-inf")), lambda s, v: (min(s[0], float(v.min())), max(s[1], float(v.max()))), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: s[1] - s[0])


@query("SELECT CASE WHEN shot_number % 10 = 0 THEN beam END AS key, round(sqrt(avg(k * k)), 9) AS rms, CAST(max(k) - min(k) AS DOUBLE) AS spread FROM shots GROUP BY 1")
def stats_mergeable(spark, d):
    rows = views.shots(spark, d).withColumn("key", F.when(F.col("shot_number") % 10 == 0, F.col("beam")))
    return stats.summarise_mergeable(rows, {"rms": ("k", _RMS), "spread": ("k", _SPREAD)}, "key").withColumn("rms", F.round("rms", 9))


_RES = 0.125
_CELLS = """, g AS (SELECT min({x}) AS x0, min({y}) AS y0, CAST(greatest(1, floor((max({x}) - min({x})) / 0.125e0 + 0.5e0)) AS BIGINT) AS nc, CAST(greatest(1, floor((max({y}) - min({y})) / 0.125e0 + 0.5e0)) AS BIGINT) AS nr FROM shots),
placed AS (SELECT *, CASE WHEN {y} = y0 THEN nr - 1 ELSE CAST(floor((y0 + nr * 0.125e0 - {y}) / 0.125e0) AS BIGINT) END AS r0, CASE WHEN {x} = x0 + nc * 0.125e0 THEN nc - 1 ELSE CAST(floor(({x} - x0) / 0.125e0) AS BIGINT) END AS c0
  FROM shots, g WHERE {x} BETWEEN x0 AND x0 + nc * 0.125e0 AND {y} BETWEEN y0 AND y0 + nr * 0.125e0),
cells AS (SELECT r0 * nc + c0 + 1 AS cell, r0 AS row, c0 AS col, x0 + (c0 + 0.5e0) * 0.125e0 AS x_center, y0 + nr * 0.125e0 - (r0 + 0.5e0) * 0.125e0 AS y_center, value, k FROM placed) """.replace("{x}", "lon").replace("{y}", "lat")


@query(_CELLS + f"SELECT cell, row, col, x_center, y_center, round(avg({_CLEAN}), 9) AS mean FROM cells GROUP BY ALL")
def grid_mean(spark, d):
    return _rounded(grid.grid_stats(_clean(spark, d), "lon_lowestmode", "lat_lowestmode", _RES, {"mean": F.avg("value")}))


@query(_CELLS + f"SELECT cell, row, col, x_center, y_center, {_FOUR} FROM cells GROUP BY ALL")
def grid_metric_set(spark, d):
    return _rounded(grid.grid_stats(_clean(spark, d), "lon_lowestmode", "lat_lowestmode", _RES, column="value", na_rm=True))


@query(_CELLS + "SELECT cell, row, col, x_center, y_center, max(k / 256) AS max FROM cells GROUP BY ALL")
def grid_vpm(spark, d):
    return grid.grid_stats(extract.canopy_metrics(views.canopy(spark, d)), "longitude_bin0", "latitude_bin0", _RES, {"max": F.max("cover")})


_FINE = 1 / 512


@query(_CELLS.replace("0.125e0", f"{_FINE}e0") + "SELECT CAST(i AS BIGINT) AS cell, n FROM (SELECT unnest(range(1, nc * nr + 1)) AS i FROM g) LEFT JOIN (SELECT cell, count(*) AS n FROM cells GROUP BY 1) ON cell = i")
def grid_dense(spark, d):
    s = views.shots(spark, d)
    g = grid.grid_of(s, "lon", "lat", _FINE)
    return grid.densify(grid.grid_stats(s, "lon", "lat", _FINE, {"n": F.count("*")}, grid=g), g).select("cell", "n")


@query(_CELLS.replace("0.125e0", f"{_FINE}e0") + "SELECT CAST(i AS BIGINT) AS cell, CAST((i - 1) // nc AS BIGINT) AS row, CAST((i - 1) % nc AS BIGINT) AS col, n FROM (SELECT unnest(range(1, nc * nr + 1)) AS i, nc FROM g) LEFT JOIN (SELECT cell, count(*) AS n FROM cells GROUP BY 1) ON cell = i")
def grid_tiles(spark, d):
    s = views.shots(spark, d)
    g = grid.grid_of(s, "lon", "lat", _FINE)
    return raster.unpack(raster.tiles(grid.grid_stats(s, "lon", "lat", _FINE, {"n": F.count("*")}, grid=g), ["n"]), g, ["n"], dense=True)


@query(_CELLS.replace("0.125e0", f"{_FINE}e0") + """, c AS (SELECT row, col, count(*) AS n, max(k) AS top FROM cells GROUP BY 1, 2),
v AS (SELECT l, row >> l AS row, col >> l AS col, sum(n) AS n, max(top) AS top FROM c, (SELECT unnest(range(4)) AS l) GROUP BY 1, 2, 3)
SELECT CAST(l AS INTEGER) AS level, CAST(row // 64 AS BIGINT) AS tile_row, CAST(col // 64 AS BIGINT) AS tile_col, count(*) AS cells, CAST(sum(n) AS BIGINT) AS n, max(top) AS top FROM v GROUP BY ALL""")
def grid_overviews(spark, d):
    s = views.shots(spark, d)
    t = raster.overviews(grid.grid_stats(s, "lon", "lat", _FINE, {"n": F.count("*"), "top": F.max("k")}), {"n": "sum", "top": "max"}, 3)
    cells = F.aggregate("runs", F.lit(0), lambda a, r: a + r["length"]).cast("long")
    return t.select("level", "tile_row", "tile_col", cells.alias("cells"), F.aggregate("n", F.lit(0).cast("long"), lambda a, v: a + v).alias("n"), F.array_max("top").alias("top"))


_BULK = ", bulk AS (SELECT CAST((l_partkey * 37) % 1009 AS DOUBLE) / 1024e0 AS lon, CAST((l_suppkey * 53) % 997 AS DOUBLE) / 1024e0 AS lat, l_quantity AS value, 0 AS k FROM lineitem)"


@query(_BULK + _CELLS.replace("FROM shots", "FROM bulk") + "SELECT cell, row, col, x_center, y_center, min(value) AS min, max(value) AS max, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd FROM cells GROUP BY ALL")
def grid_bulk(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    lon, lat = ((F.col(c) * k % m).cast("double") / 1024.0 for c, k, m in (("l_partkey", 37, 1009), ("l_suppkey", 53, 997)))
    return _rounded(grid.grid_stats(lines.select(lon.alias("lon"), lat.alias("lat"), F.col("l_quantity").alias("value")), "lon", "lat", _RES, column="value"))


# --- waveforms ----------------------------------------------------------------------------------------------------


def _waves(spark, d):
    return views.waveforms(spark, d), waveform.height_levels(views.waveform_heights(spark, d))


_BAND = """, band AS (SELECT shot_number, min(z) AS zmin, max(z) AS zmax FROM levels GROUP BY 1),
kept AS (SELECT s.*, zmin, zmax FROM (SELECT *, CAST(min(rxwaveform) OVER (PARTITION BY shot_number) AS DOUBLE) AS low, CAST(max(rxwaveform) OVER (PARTITION BY shot_number) AS DOUBLE) - CAST(min(rxwaveform) OVER (PARTITION BY shot_number) AS DOUBLE) AS span FROM samples) s JOIN band USING (shot_number) WHERE elevation BETWEEN zmin AND zmax),
total AS (SELECT *, sum(CAST(rxwaveform AS DOUBLE) - low) OVER (PARTITION BY shot_number ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM kept),
curve AS (SELECT shot_number, bin, elevation, t / nullif((max(t) OVER (PARTITION BY shot_number) - min(t) OVER (PARTITION BY shot_number)) / nullif(span, 0), 0) + low AS energy FROM total) """


@query("SELECT *, CAST(rxwaveform - min(rxwaveform) OVER w AS DOUBLE) / nullif(CAST(max(rxwaveform) OVER w - min(rxwaveform) OVER w AS DOUBLE), 0) * 100 AS relative FROM samples WINDOW w AS (PARTITION BY shot_number)")
def wf_relative(spark, d):
    return waveform.relative(views.waveforms(spark, d))


@query("""SELECT shot_number, CAST(CASE c WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN n + 4 ELSE n + 5 END AS BIGINT) AS vertex,
  CAST(CASE c WHEN 3 THEN first WHEN 4 THEN last ELSE low END AS DOUBLE) AS x, CASE WHEN c IN (2, 3) THEN bottom ELSE top END AS y
  FROM (SELECT shot_number, min(rxwaveform) AS low, min(elevation) AS bottom, max(elevation) AS top, arg_max(rxwaveform, bin) AS first, arg_min(rxwaveform, bin) AS last, count(*) AS n FROM samples GROUP BY 1), range(1, 6) AS r(c)
  UNION ALL SELECT shot_number, row_number() OVER (PARTITION BY shot_number ORDER BY bin DESC) + 3, CAST(rxwaveform AS DOUBLE), elevation FROM samples""")
def wf_outline(spark, d):
    return waveform.outline(views.waveforms(spark, d))


@query(_BAND + "SELECT shot_number, bin, elevation, round(energy, 9) AS energy FROM curve")
def wf_cum_energy(spark, d):
    waves, levels = _waves(spark, d)
    return waveform.cumulative_energy(waves, levels).withColumn("energy", F.round("energy", 9))


@query(_BAND + """SELECT shot_number, rh, z, bin, elevation, round(energy, 9) AS energy, z - (z - zmin) / 2 AS label_z FROM (
  SELECT c.*, rh, z, zmin, rank() OVER (PARTITION BY shot_number, rh ORDER BY abs(elevation - z)) AS near FROM curve c JOIN levels USING (shot_number) JOIN band USING (shot_number)) WHERE near = 1""")
def wf_rh_marks(spark, d):
    waves, levels = _waves(spark, d)
    return waveform.energy_marks(waves, levels).withColumn("energy", F.round("energy", 9))


@query("""SELECT shot_number, ymin, ymax, quantile_disc(CAST(rxwaveform AS DOUBLE), 0.05) AS q05, quantile_disc(CAST(rxwaveform AS DOUBLE), 1.0) AS q100
  FROM samples JOIN (SELECT shot_number, min(z) - (max(z) - min(z)) * 0.2e0 AS ymin, max(z) + (max(z) - min(z)) * 0.2e0 AS ymax FROM levels GROUP BY 1) USING (shot_number) WHERE elevation BETWEEN ymin AND ymax GROUP BY 1, 2, 3""")
def wf_quantiles(spark, d):
    return waveform.amplitude_limits(*_waves(spark, d))


@query("""SELECT shot_number, CAST(tick AS INTEGER) AS tick, CASE WHEN near = 1 THEN ground ELSE even END AS z, CASE WHEN near = 1 THEN ground ELSE even END - ground AS height FROM (
  SELECT *, row_number() OVER (PARTITION BY shot_number ORDER BY abs(even - ground), tick) AS near FROM (
    SELECT shot_number, ground, tick, zmin + (tick - 1) * ((zmax - zmin) / 3) AS even FROM (SELECT shot_number, min(z) AS zmin, max(z) AS zmax, min(ground_z) AS ground FROM levels GROUP BY 1), range(1, 5) AS r(tick)))""")
def wf_ticks(spark, d):
    return waveform.ticks(_waves(spark, d)[1])


# --- profiles -----------------------------------------------------------------------------------------------------


def _track(bins: str, elevation: bool) -> str:
    y = "round_even(elev_lowestmode + m, 0)" if elevation else "m - 0.5e0"
    gap = "elev_lowestmode + h - (m + elev_lowestmode)" if elevation else "h - m"
    return f""", track AS (SELECT shot_number, CAST(rowid AS INTEGER) AS rowid, (rowid * 60 - 60) / 1000e0 AS x, CAST({y} AS DOUBLE) AS y, greatest({bins}[CAST(floor((m - 1) / 5) AS BIGINT) + 1], CAST(0 AS FLOAT)) AS value FROM (
  SELECT *, row_number() OVER (ORDER BY shot_number) AS rowid, greatest(height_bin0, 0) AS h FROM profile WHERE beam = '{BEAM}'), range(1, 151) AS r(m) WHERE {gap} > 0) """


def _profile_query(name: str, prefix: str, elevation: bool) -> None:
    def f(spark, d):
        return profiles.track_profile(views.profiles(spark, d), prefix, BEAM, elevation).withColumn("y", F.col("y").cast("double"))

    f.__name__ = name
    query(_track(f"{prefix}_z", elevation) + "SELECT * FROM track")(f)


for _name, _prefix, _elevation in (("pai_profile_elev", "pai", True), ("pai_profile_height", "pai", False), ("pavd_profile_elev", "pavd", True), ("pavd_profile_height", "pavd", False)):
    _profile_query(_name, _prefix, _elevation)


@query(_track("pai_z", True) + "SELECT rowid, x, max(y) + 0.5e0 AS top, min(y) - 0.5e0 AS ground FROM track GROUP BY 1, 2")
def profile_lines(spark, d):
    return profiles.track_lines(profiles.track_profile(views.profiles(spark, d), "pai", BEAM).withColumn("y", F.col("y").cast("double")))


@query(_track("pai_z", True).replace("OVER (ORDER BY", "OVER (PARTITION BY shot_number % 3 ORDER BY").replace("SELECT shot_number, CAST(rowid", "SELECT 'g' || shot_number % 3 AS granule, shot_number, CAST(rowid") + "SELECT * FROM track")
def pai_profile_granules(spark, d):
    rows = views.profiles(spark, d).withColumn("granule", F.concat(F.lit("g"), (F.col("shot_number") % 3).cast("string")))
    return profiles.track_profile(rows, "pai", BEAM).withColumn("y", F.col("y").cast("double"))


# --- catalogue ----------------------------------------------------------------------------------------------------


@query(f"""SELECT c_custkey, '{catalog.SEARCH}&concept_id=' || id || '&bounding_box=' || (c_custkey % 359 - 180) || ',' || (c_custkey % 100 - 52) || ',' || (c_custkey % 359 - 179) || ',' || (c_custkey % 100 - 51) || '&temporal=2019-07-01,2020-05-22&pageNum=1' AS url
  FROM customer, (VALUES {', '.join(f'({v!r})' for k, v in catalog.COLLECTIONS.items() if k.endswith('.002'))}) AS t(id)""")
def catalog_urls(spark, d):
    west, south = F.col("c_custkey") % 359 - 180, F.col("c_custkey") % 100 - 52
    boxes = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", west.alias("west"), south.alias("south"), (west + 1).alias("east"), (south + 1).alias("north"))
    return reduce(DataFrame.unionByName, (catalog.search_urls(boxes, k[:-4], daterange=("2019-07-01", "2020-05-22")).select("c_custkey", "url") for k in catalog.COLLECTIONS if k.endswith(".002")))


@query("SELECT CAST(floor(nation.n_nationkey / 10) AS INTEGER) + 1 AS page, CAST(n_nationkey % 10 AS INTEGER) AS position, 'https://daac.ornl.gov/daacdata/g' || n_nationkey || '.h5' AS href FROM nation")
def catalog_hrefs(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").withColumn("page", (F.floor(F.col("n_nationkey") / 10) + 1).cast("int"))
    links = F.array(F.struct(F.concat(F.lit("https://data.ornldaac.earthdata.nasa.gov/protected/g"), F.col("n_nationkey").cast("string"), F.lit(".h5")).alias("href")))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", links.alias("links")))), lambda e: F.struct(e["links"].alias("links")))
    bodies = n.groupBy("page").agg(F.to_json(F.struct(F.struct(entries.alias("entry")).alias("feed"))).alias("body"))
    return catalog.first_links(bodies, catalog.GRIDDED)
