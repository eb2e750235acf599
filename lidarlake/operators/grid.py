"""Statistics on a regular grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import usable
from .clip import extent
from .stats import Metrics, resolve


@dataclass(frozen=True)
class Grid:
    """Cells are numbered from 1 along rows, the first row at the top. The origin is the data's lower left corner; the
    far sides lie whole cells away from it. Points on the right side belong to the last column, those on the lower side to
    the last row; points beyond the sides belong to no cell."""

    xmin: float
    ymin: float
    res: float
    ncol: int
    nrow: int

    @property
    def xmax(self) -> float:
        return self.xmin + self.ncol * self.res

    @property
    def ymax(self) -> float:
        return self.ymin + self.nrow * self.res

    def column(self, x: Column) -> Column:
        return F.when(x == self.xmax, self.ncol - 1).otherwise(F.floor((x - self.xmin) / self.res)).cast("long")

    def row(self, y: Column) -> Column:
        return F.when(y == self.ymin, self.nrow - 1).otherwise(F.floor((self.ymax - y) / self.res)).cast("long")

    def cell(self, x: Column, y: Column) -> Column:
        held = x.between(self.xmin, self.xmax) & y.between(self.ymin, self.ymax) & usable(x) & usable(y)
        return F.when(held, self.row(y) * self.ncol + self.column(x) + 1)


def grid_of(table: DataFrame, x: str, y: str, res: float) -> Grid | None:
    """The grid that the table's points span; None for a table without points."""
    if not res > 0:
        raise ValueError("res must be above 0")
    e = extent(table, x, y).first()
    if e["xmin"] is None:
        return None
    cells = lambda a, b: max(1, int((b - a) / res + 0.5))
    return Grid(e["xmin"], e["ymin"], res, cells(e["xmin"], e["xmax"]), cells(e["ymin"], e["ymax"]))


def _places(cells: DataFrame, g: Grid) -> DataFrame:
    row, col = F.floor((F.col("cell") - 1) / g.ncol), F.pmod(F.col("cell") - 1, F.lit(g.ncol))
    return cells.withColumns({"row": row, "col": col, "x_center": F.lit(g.xmin) + (col + 0.5) * g.res, "y_center": F.lit(g.ymax) - (row + 0.5) * g.res})


def grid_stats(table: DataFrame, x: str, y: str, res: float, metrics: Metrics | None = None, column: str | None = None, na_rm: bool = False, grid: Grid | None = None) -> DataFrame:
    """(cell, row, col, x_center, y_center, metrics...): cells that hold points. The table is not changed."""
    aggregates = resolve(metrics, column, na_rm)
    g = grid or grid_of(table, x, y, res) or Grid(0.0, 0.0, res, 1, 1)
    used = table.withColumn("cell", g.cell(F.col(x), F.col(y))).filter("cell is not null")
    stats = used.groupBy("cell").agg(*aggregates)
    names = [c for c in stats.columns if c != "cell"]
    return _places(stats, g).select("cell", "row", "col", "x_center", "y_center", *names)


def densify(stats: DataFrame, g: Grid) -> DataFrame:
    """The whole raster: cells without points have null metrics."""
    names = [c for c in stats.columns if c not in ("cell", "row", "col", "x_center", "y_center")]
    every = stats.sparkSession.range(1, g.ncol * g.nrow + 1).withColumnRenamed("id", "cell")
    return _places(every.join(stats.select("cell", *names), "cell", "left"), g).select("cell", "row", "col", "x_center", "y_center", *names)


def to_ascii(dense: DataFrame, g: Grid, metric: str, nodata: float = -9999.0) -> DataFrame:
    """(row, line): the raster's rows as text of an ASCII grid, to be written in order below `ascii_header`."""
    value = F.coalesce(F.col(metric).cast("double"), F.lit(nodata)).cast("string")
    lines = dense.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", value.alias("v")))).alias("vs"))
    return lines.select("row", F.array_join(F.transform("vs", lambda v: v["v"]), " ").alias("line"))


def ascii_header(g: Grid, nodata: float = -9999.0) -> str:
    return f"ncols {g.ncol}\nnrows {g.nrow}\nxllcorner {g.xmin}\nyllcorner {g.ymin}\ncellsize {g.res}\nNODATA_value {nodata}\n"
