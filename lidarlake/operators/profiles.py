"""Vertical profiles of a beam in one-metre bins along the track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.products import BIN_METRES, N_BINS
from .ordering import running


def along_track_km(position: Column) -> Column:
    """Distance of the n-th footprint of a track; footprints lie 60 m apart."""
    return (position * 60 - 60) / F.lit(1000.0)


def _track(table: DataFrame) -> list[str]:
    """What a track is of, beside its beam."""
    return [c for c in ("granule",) if c in table.columns]


def track_profile(product: DataFrame, prefix: str, beam: str, elevation: bool = True) -> DataFrame:
    """(granule, shot_number, rowid, x, y, value): one row for each metre below the canopy top of each footprint.

    Negative heights and values count as 0. With elevation y is the rounded elevation (half to even), else the middle
    of the metre above ground. Footprints are numbered by shot_number within the beam of their granule; a table that does
    not tell granules is one, and has no such column.
    """
    mine = product.filter(F.col("beam") == beam)
    track = _track(mine)
    height = F.greatest(F.col("height_bin0"), F.lit(0)).cast("double")
    placed = running(mine.select(*track, "beam", "shot_number", "elev_lowestmode", "height_bin0", f"{prefix}_z"), (*track, "beam"), "shot_number", "before")
    numbered = placed.select(*track, "shot_number", (F.col("before") + 1).cast("int").alias("rowid"), F.col("elev_lowestmode").cast("double").alias("ground"), height.alias("height"), F.slice(f"{prefix}_z", 1, N_BINS).alias("bins"))
    values = numbered.select("*", F.posexplode("bins").alias("k", "raw"))
    first = F.col("k") * BIN_METRES + 1
    metres = values.select(*track, "shot_number", "rowid", "ground", "height", F.greatest("raw", F.lit(0).cast("float")).alias("value"), F.explode(F.sequence(first, first + BIN_METRES - 1)).alias("metre"))
    if elevation:
        kept = metres.filter(F.col("ground") + F.col("height") - (F.col("metre") + F.col("ground")) > 0)
        y = F.bround(F.col("ground") + F.col("metre"))
    else:
        kept = metres.filter(F.col("height") - F.col("metre") > 0)
        y = F.col("metre") - F.lit(0.5)
    return kept.select(*track, "shot_number", "rowid", along_track_km(F.col("rowid")).alias("x"), y.alias("y"), "value")


def track_lines(profile: DataFrame, elevation: bool = True) -> DataFrame:
    """(granule, rowid, x, top, ground): the canopy's top and the ground along the track; heights have no ground line."""
    track = _track(profile)
    grouped = profile.groupBy(*track, "rowid", "x").agg(F.max("y").alias("top"), F.min("y").alias("ground"))
    if elevation:
        return grouped.select(*track, "rowid", "x", (F.col("top") + 0.5).alias("top"), (F.col("ground") - 0.5).alias("ground"))
    return grouped.select(*track, "rowid", "x", (F.col("top") + 0.5).alias("top"), F.lit(None).cast("double").alias("ground"))
