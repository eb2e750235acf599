"""Bounding-box clips, one operator for every product."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import usable
from ..plans.products import Product
from ..plans.validate import check_columns, check_extent


class NothingLeft(ValueError):
    """A strict clip found no footprint."""


def in_box(product: Product, xmin: float, xmax: float, ymin: float, ymax: float) -> Column:
    """All points of a footprint inside the closed box. Plain comparisons come first, so that they reach the scan;
    a null or NaN coordinate is outside."""
    sides = [c for x, y in product.points for c in (F.col(x) >= xmin, F.col(x) <= xmax, F.col(y) >= ymin, F.col(y) <= ymax)]
    return reduce(and_, sides + [usable(F.col(c)) for p in product.points for c in p])


def clip_box(table: DataFrame, product: Product, xmin: float, xmax: float, ymin: float, ymax: float, strict: bool = False) -> DataFrame:
    """Rows whose points all lie in the box, borders included. strict: an empty result is an error."""
    check_extent(xmin, xmax, ymin, ymax)
    check_columns(table, [c for p in product.points for c in p], product.name)
    out = table.filter(in_box(product, xmin, xmax, ymin, ymax))
    if strict and out.isEmpty():
        raise NothingLeft("no footprint lies inside the extent")
    return out


def extent(table: DataFrame, x: str, y: str) -> DataFrame:
    """(xmin, xmax, ymin, ymax) in one row."""
    ok = table.filter(usable(F.col(x)) & usable(F.col(y)))
    return ok.agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))
