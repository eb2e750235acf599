"""Rasters as tiles: fixed blocks of cells with a run-length mask, and overviews by halving.

A tile holds what its cells hold and no more: runs of neighbouring cells that have a value, in the order of rows, and these
cells' values. Tiles without a cell are no rows, so a sparse raster takes the room of its cells, whatever its extent. An
overview has half as many rows and columns; its cells are aggregates of the four below them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid

#: Cells on each side of a tile.
SIDE = 64
#: How an overview's cell is made of the ones below it.
HALVINGS = {"sum": F.sum, "min": F.min, "max": F.max}


def _runs(at: Column) -> Column:
    """Runs (start, length) of ascending places."""
    begins = F.filter(at, lambda p, i: (i == 0) | (p != F.get(at, i - 1) + 1))
    ends = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (p != F.get(at, i + 1) - 1))
    return F.transform(begins, lambda p, i: F.struct(p.alias("start"), (F.get(ends, i) - p + 1).alias("length")))


def tiles(stats: DataFrame, metrics: Sequence[str], side: int = SIDE, level: int = 0) -> DataFrame:
    """(level, tile_row, tile_col, runs, one array for each metric) of cells (row, col, metrics): a group of at most
    side * side cells makes a tile."""
    place = ((F.pmod("row", F.lit(side)) * side) + F.pmod("col", F.lit(side))).cast("int")
    cells = stats.select(F.floor(F.col("row") / side).cast("long").alias("tile_row"), F.floor(F.col("col") / side).cast("long").alias("tile_col"), F.struct(place.alias("at"), *metrics).alias("cell"))
    held = cells.groupBy("tile_row", "tile_col").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    # bound once, since the runs ask for it at every place
    runs = F.get(F.transform(F.array(F.col("cells").getField("at")), lambda at: _runs(at)), F.lit(0))
    return held.select(F.lit(level).alias("level"), "tile_row", "tile_col", runs.alias("runs"), *(F.col("cells").getField(m).alias(m) for m in metrics))


def unpack(tiled: DataFrame, g: Grid, metrics: Sequence[str], side: int = SIDE, dense: bool = False) -> DataFrame:
    """(cell, row, col, metrics) of level 0: cells that have values, or with `dense` every cell of the grid."""
    at = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    if dense:
        every = tiled.sparkSession.range(-(-g.nrow // side) * -(-g.ncol // side)).select(F.floor(F.col("id") / -(-g.ncol // side)).alias("tile_row"), F.pmod("id", F.lit(-(-g.ncol // side))).alias("tile_col"))
        held = every.join(tiled.withColumn("held", F.map_from_arrays(at, F.arrays_zip(*metrics))), ["tile_row", "tile_col"], "left")
        places = held.select("tile_row", "tile_col", "held", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("at"))
        cells = places.select("tile_row", "tile_col", "at", *(F.col("held")[F.col("at")][m].alias(m) for m in metrics))
    else:
        cells = tiled.select("tile_row", "tile_col", F.inline(F.arrays_zip(at.alias("at"), *metrics)))
    row, col = F.col("tile_row") * side + F.floor(F.col("at") / side), F.col("tile_col") * side + F.pmod("at", F.lit(side))
    placed = cells.select(row.cast("long").alias("row"), col.cast("long").alias("col"), *metrics).filter((F.col("row") < g.nrow) & (F.col("col") < g.ncol))
    return placed.select((F.col("row") * g.ncol + F.col("col") + 1).alias("cell"), "row", "col", *metrics)


def overviews(stats: DataFrame, metrics: dict[str, str], levels: int, side: int = SIDE) -> DataFrame:
    """Tiles of cells (row, col, metrics) and of `levels` overviews. metrics: by name how four cells make one (sum, min or
    max), each overview from the one below it."""
    if unknown := set(metrics.values()) - HALVINGS.keys():
        raise ValueError(f"an overview is made by {', '.join(HALVINGS)}, not by {', '.join(sorted(unknown))}")
    cells = stats.select("row", "col", *metrics)
    out = tiles(cells, list(metrics), side)
    half = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    for level in range(1, levels + 1):
        cells = cells.groupBy(half("row"), half("col")).agg(*(HALVINGS[how](m).alias(m) for m, how in metrics.items()))
        out = out.unionByName(tiles(cells, list(metrics), side, level))
    return out
