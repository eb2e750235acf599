"""Footprint products derived from the driver's tables, as DataFrames and as SQL of the same columns.

Coordinates are dyadic fractions, so that both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.products import BEAMS, SENTINEL
from .layers import layer

#: A square with a square hole, and a triangle that overlaps it; vertices lie on the points' lattice.
SQUARE = [[(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)], [(0.4375, 0.4375), (0.5625, 0.4375), (0.5625, 0.5625), (0.4375, 0.5625)]]
TRIANGLE = [[(0.5, 0.125), (0.9375, 0.5), (0.5, 0.875)]]
POLYGONS = [(1, SQUARE), (2, TRIANGLE)]


def polygons(spark: SparkSession) -> DataFrame:
    return layer(spark, POLYGONS)


def _dyadic(id_: str, factor: int, modulus: int, scale: int) -> Column:
    return (F.col(id_) * factor % modulus).cast("double") / float(scale)


def _beam(id_: str) -> Column:
    return F.get(F.array(*map(F.lit, BEAMS)), (F.col(id_) % 8).cast("int"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shot_number, beam, lon, lat, lon_last, value (with the sentinel for errors), k (a small whole number)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lon = _dyadic("event_id", 37, 1009, 1024)
    return e.select(
        F.col("event_id").alias("shot_number"), _beam("event_id").alias("beam"), lon.alias("lon"), _dyadic("event_id", 53, 997, 1024).alias("lat"),
        (lon + _dyadic("event_id", 1, 3, 4096)).alias("lon_last"), F.when(F.col("event_type") == "error", SENTINEL).otherwise(F.col("value")).alias("value"), (F.col("event_id") % 40).cast("double").alias("k"),
    )


def geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    return s.select("beam", "shot_number", F.col("lat").alias("latitude_bin0"), F.col("lat").alias("latitude_lastbin"), F.col("lon").alias("longitude_bin0"), F.col("lon_last").alias("longitude_lastbin"), (F.col("k") + 200).alias("elevation_bin0"), (F.col("k") + 168).alias("elevation_lastbin"), F.col("value").alias("delta_time"), (F.col("k") % 5 + 1).cast("int").alias("rx_sample_count"), (F.col("k") % 3 + 1).cast("int").alias("tx_sample_count"))


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    variant = lambda d: F.struct((F.col("lat") + d).alias("lat_highest"), F.col("lat").alias("lat_lowest"), (F.col("lon_last") + d).alias("lon_highest"), F.col("lon").alias("lon_lowest"))
    return s.select(
        "beam", "shot_number", (F.col("shot_number") % 2).cast("short").alias("degrade_flag"), (F.col("shot_number") % 3).cast("short").alias("quality_flag"), F.col("value").alias("delta_time"),
        F.lit(0.5).cast("float").alias("sensitivity"), (F.col("k") - 20).cast("float").alias("solar_elevation"), F.col("lat").alias("lat_lowestmode"), F.col("lon").alias("lon_lowestmode"),
        F.col("lat").alias("lat_highestreturn"), F.col("lon_last").alias("lon_highestreturn"), (F.col("k") + 200).cast("float").alias("elev_highestreturn"), (F.col("k") / 2 + 100).cast("float").alias("elev_lowestmode"),
        F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: (i * F.col("k") / 64).cast("float")).alias("rh"), F.array(variant(0.0), variant(0.125)).alias("variants"), F.col("value"),
    )


def line_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints from the largest table: shot_number, lon_lowestmode, lat_lowestmode, and a waveform beside them."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shot = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    return t.select(shot.alias("shot_number"), ((shot * 37) % 4093 / F.lit(4096.0)).alias("lon_lowestmode"), ((shot * 53) % 4091 / F.lit(4096.0)).alias("lat_lowestmode"), F.array_repeat(F.col("l_quantity").cast("float"), 8).alias("rxwaveform"))


#: What is not valid: parts that overlap, a ring that crosses itself, a hole that leaves its shell, and holes that overlap.
INVALID = [
    (1, [[[(0.125, 0.125), (0.5, 0.125), (0.5, 0.5), (0.125, 0.5)]], [[(0.375, 0.375), (0.75, 0.375), (0.75, 0.75), (0.375, 0.75)]]]),
    (2, [[(0.25, 0.25), (0.75, 0.75), (0.75, 0.25), (0.25, 0.75)]]),
    (3, [[(0.0, 0.5), (0.5, 0.5), (0.5, 0.875), (0.0, 0.875)], [(0.375, 0.625), (0.625, 0.625), (0.625, 0.75), (0.375, 0.75)], [(0.125, 0.5625), (0.25, 0.5625), (0.25, 0.75), (0.125, 0.75)], [(0.1875, 0.625), (0.3125, 0.625), (0.3125, 0.8125), (0.1875, 0.8125)]]),
]
#: The same as rings that are.
REPAIRED = [
    (1, [[(0.125, 0.125), (0.5, 0.125), (0.5, 0.375), (0.75, 0.375), (0.75, 0.75), (0.375, 0.75), (0.375, 0.5), (0.125, 0.5)]]),
    (2, [[(0.25, 0.25), (0.5, 0.5), (0.25, 0.75)], [(0.75, 0.75), (0.75, 0.25), (0.5, 0.5)]]),
    (3, [[(0.0, 0.5), (0.5, 0.5), (0.5, 0.625), (0.375, 0.625), (0.375, 0.75), (0.5, 0.75), (0.5, 0.875), (0.0, 0.875)], [(0.125, 0.5625), (0.25, 0.5625), (0.25, 0.625), (0.3125, 0.625), (0.3125, 0.8125), (0.1875, 0.8125), (0.1875, 0.75), (0.125, 0.75)]]),
]
#: One wide polygon with a notch, and many small squares in rows of 32.
WIDE = [(0.0625, 0.03125), (0.9375, 0.03125), (0.9375, 0.96875), (0.5, 0.5), (0.0625, 0.96875)]
SMALL, PER_ROW, SIDE = 1024, 32, 1 / 64


def many_polygons(spark: SparkSession) -> DataFrame:
    square = lambda x, y: [(x, y), (x + SIDE, y), (x + SIDE, y + SIDE), (x, y + SIDE)]
    small = [(k + 1, [square(k % PER_ROW / PER_ROW, k // PER_ROW / PER_ROW)]) for k in range(SMALL)]
    return layer(spark, [(0, [WIDE]), *small])


def canopy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    geo = F.struct(F.col("lat").alias("latitude_bin0"), F.col("lat").alias("latitude_lastbin"), F.col("lon").alias("longitude_bin0"), F.col("lon_last").alias("longitude_lastbin"), (F.col("k") + 200).alias("elev_highestreturn"), (F.col("k") / 2 + 100).alias("elev_lowestmode"), (F.col("k") - 20).alias("solar_elevation"))
    return s.select("beam", "shot_number", F.lit(1).cast("short").alias("algorithmrun_flag"), (F.col("shot_number") % 2).cast("short").alias("l2b_quality_flag"), F.col("value").alias("delta_time"), (F.col("k") / 64).alias("sensitivity"), geo.alias("geolocation"), (F.col("k") / 4).alias("rh100"), F.col("value").alias("pai"), (F.col("k") / 8).alias("fhd_normal"), F.lit(1.0).alias("omega"), (F.col("k") / 128).alias("pgap_theta"), (F.col("k") / 256).alias("cover"))


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    top = (F.col("label") + 200).cast("double")
    return e.select(F.col("vec_id").alias("shot_number"), _beam("vec_id").alias("beam"), F.col("embedding").alias("rxwaveform"), top.alias("elevation_bin0"), (top - 32).alias("elevation_lastbin"))


def waveform_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height metrics of the same shots as `waveforms`."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    step = (F.col("vec_id") % 7 + 1) / F.lit(32.0)
    return e.select(F.col("vec_id").alias("shot_number"), (F.col("label") + 170).cast("double").alias("elev_lowestmode"), F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: i * step).alias("rh"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    lon = _dyadic("vec_id", 37, 1009, 1024)
    return e.select(
        _beam("vec_id").alias("beam"), F.col("vec_id").alias("shot_number"), F.lit(1).cast("short").alias("algorithmrun_flag"), (F.col("vec_id") % 2).cast("short").alias("l2b_quality_flag"),
        F.col("label").cast("double").alias("delta_time"), _dyadic("vec_id", 53, 997, 1024).alias("lat_lowestmode"), lon.alias("lon_lowestmode"), (F.col("label") + 130).cast("double").alias("elev_highestreturn"),
        (F.col("label") + 100 + F.col("vec_id") % 2 / F.lit(2.0)).cast("double").alias("elev_lowestmode"), F.lit(0.0).alias("height_lastbin"), (F.col("vec_id") % 40 - 2).cast("double").alias("height_bin0"),
        F.slice("embedding", 1, 30).alias("pai_z"), F.slice("embedding", 31, 30).alias("pavd_z"),
    )


def _sql_beam(id_: str) -> str:
    return f"list_extract([{', '.join(repr(b) for b in BEAMS)}], CAST({id_} % 8 AS INTEGER) + 1)"


def _sql_dyadic(id_: str, factor: int, modulus: int, scale: int) -> str:
    return f"CAST(({id_} * {factor}) % {modulus} AS DOUBLE) / {scale}e0"


def sql_edges(polygons: list) -> str:
    """Rows (poly_id, x1, y1, x2, y2) of valid polygons that are given by their rings."""
    edges = [(k, *e) for k, rings in polygons for r in rings for e in [(*a, *b) for a, b in zip(r, [*r[1:], r[0]], strict=True)]]
    return "VALUES " + ", ".join(f"(CAST({k} AS BIGINT), {a}e0, {b}e0, {c}e0, {d}e0)" for k, a, b, c, d in edges)


#: Is a point (lon, lat) that is grouped with a polygon's edges in it?
SQL_INSIDE = """sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1
    OR bool_or((lon - x1) * (y2 - y1) = (lat - y1) * (x2 - x1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2))"""


SQL = f"""WITH RECURSIVE shots AS (
  SELECT event_id AS shot_number, {_sql_beam("event_id")} AS beam, {_sql_dyadic("event_id", 37, 1009, 1024)} AS lon, {_sql_dyadic("event_id", 53, 997, 1024)} AS lat,
    {_sql_dyadic("event_id", 37, 1009, 1024)} + {_sql_dyadic("event_id", 1, 3, 4096)} AS lon_last, CASE WHEN event_type = 'error' THEN -9999e0 ELSE value END AS value, CAST(event_id % 40 AS DOUBLE) AS k FROM events),
geo AS (SELECT beam, shot_number, lat AS latitude_bin0, lat AS latitude_lastbin, lon AS longitude_bin0, lon_last AS longitude_lastbin, k + 200 AS elevation_bin0, k + 168 AS elevation_lastbin, value AS delta_time,
    CAST(CAST(k AS BIGINT) % 5 + 1 AS INTEGER) AS rx_sample_count, CAST(CAST(k AS BIGINT) % 3 + 1 AS INTEGER) AS tx_sample_count FROM shots),
heights AS (SELECT beam, shot_number, CAST(shot_number % 2 AS SMALLINT) AS degrade_flag, CAST(shot_number % 3 AS SMALLINT) AS quality_flag, value AS delta_time, CAST(0.5 AS FLOAT) AS sensitivity, CAST(k - 20 AS FLOAT) AS solar_elevation,
    lat AS lat_lowestmode, lon AS lon_lowestmode, lat AS lat_highestreturn, lon_last AS lon_highestreturn, CAST(k + 200 AS FLOAT) AS elev_highestreturn, CAST(k / 2 + 100 AS FLOAT) AS elev_lowestmode, value, k FROM shots),
canopy AS (SELECT beam, shot_number, CAST(1 AS SMALLINT) AS algorithmrun_flag, CAST(shot_number % 2 AS SMALLINT) AS l2b_quality_flag, value AS delta_time, k / 64 AS sensitivity, k - 20 AS solar_elevation, lat AS latitude_lastbin, lat AS latitude_bin0,
    lon AS longitude_bin0, lon_last AS longitude_lastbin, k + 200 AS elev_highestreturn, k / 2 + 100 AS elev_lowestmode, k / 4 AS rh100, value AS pai, k / 8 AS fhd_normal, 1e0 AS omega, k / 128 AS pgap_theta, k / 256 AS cover FROM shots),
waves AS (SELECT vec_id AS shot_number, {_sql_beam("vec_id")} AS beam, embedding AS rxwaveform, CAST(label + 200 AS DOUBLE) AS elevation_bin0, CAST(label + 168 AS DOUBLE) AS elevation_lastbin FROM embeddings),
samples AS (SELECT shot_number, i AS bin, rxwaveform[i] AS rxwaveform, elevation_bin0 - i * ((elevation_bin0 - elevation_lastbin) / len(rxwaveform)) AS elevation FROM (SELECT *, CAST(unnest(range(1, len(rxwaveform) + 1)) AS INTEGER) AS i FROM waves)),
levels AS (SELECT vec_id AS shot_number, CAST(label + 170 AS DOUBLE) AS ground_z, rh, rh * ((vec_id % 7 + 1) / 32e0) + (label + 170) AS z FROM embeddings, (VALUES (0), (25), (50), (75), (100)) AS t(rh)),
profile AS (SELECT {_sql_beam("vec_id")} AS beam, vec_id AS shot_number, CAST(1 AS SMALLINT) AS algorithmrun_flag, CAST(vec_id % 2 AS SMALLINT) AS l2b_quality_flag, CAST(label AS DOUBLE) AS delta_time, {_sql_dyadic("vec_id", 53, 997, 1024)} AS lat_lowestmode,
    {_sql_dyadic("vec_id", 37, 1009, 1024)} AS lon_lowestmode, CAST(label + 130 AS DOUBLE) AS elev_highestreturn, label + 100 + (vec_id % 2) / 2e0 AS elev_lowestmode, 0e0 AS height_lastbin, CAST(vec_id % 40 - 2 AS DOUBLE) AS height_bin0,
    embedding[1:30] AS pai_z, embedding[31:60] AS pavd_z FROM embeddings),
edges(poly_id, x1, y1, x2, y2) AS ({sql_edges(POLYGONS)}),
hits AS (SELECT shot_number, poly_id FROM shots, edges GROUP BY shot_number, poly_id, lon, lat HAVING {SQL_INSIDE}),
hits2 AS (SELECT vec_id AS shot_number, poly_id FROM (SELECT vec_id, {_sql_dyadic("vec_id", 37, 1009, 1024)} AS lon, {_sql_dyadic("vec_id", 53, 997, 1024)} AS lat FROM embeddings), edges GROUP BY vec_id, poly_id, lon, lat HAVING {SQL_INSIDE})
"""
