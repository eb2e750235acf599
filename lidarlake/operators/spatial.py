"""Point-in-polygon joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import inside, inside_literal
from ..plans.products import SRID, Product
from ..plans.validate import check_columns
from ..sources.layers import Known, known
from . import covering
from .clip import NothingLeft, clip_box

#: A layer up to this many polygons and edges is broadcast for a nested-loop join (about 3 MB); a larger one is joined
#: by cells that cover it.
BROADCAST_POLYGONS, BROADCAST_EDGES = 1_000, 100_000
#: A layer of so many edges in all becomes part of the plan.
LITERAL_EDGES = 64


def check_layer(layer: DataFrame, split_by: str | None) -> Known:
    check_columns(layer, ["bx0", "bx1", "by0", "by1", "edges"], "polygon layer")
    if split_by is not None and split_by not in layer.columns:
        raise ValueError(f"the polygon layer has no column {split_by}")
    found = known(layer)
    if found.foreign:
        raise ValueError(f"polygons must be in EPSG:{SRID}")
    return found


def clip_polygons(table: DataFrame, product: Product, layer: DataFrame, split_by: str | None = "id", tile: float | None = None, strict: bool = False) -> DataFrame:
    """One row per footprint and polygon that holds it (boundary included), with the polygon's `split_by` as poly_id.

    The layer's own bounding box clips first, on all points of the product; then the product's first point is tested.
    Overlapping polygons multiply rows, also without split_by. tile: force the join by cells, none smaller than this; by
    default the layer's size decides.
    """
    found = check_layer(layer, split_by)
    if not found.polygons or found.box is None:
        out = table.limit(0)
        return out.withColumn("poly_id", F.lit(None).cast("long")) if split_by else out
    # the table's rows travel whole in one column, so that its names meet none of the polygons'
    x, y = (F.col(f"row.{c}") for c in product.points[0])
    points = clip_box(table, product, *found.box).select(F.struct(*table.columns).alias("row"))
    shapes = layer.select(F.col(split_by).alias("poly_id") if split_by else F.lit(0).alias("poly_id"), "bx0", "bx1", "by0", "by1", "edges")
    rows = None if found.rows is None else [r | {"poly_id": r[split_by] if split_by else 0} for r in found.rows]
    if tile is None and found.edges <= LITERAL_EDGES and found.polygons <= LITERAL_EDGES:
        rows = [r.asDict(True) for r in shapes.collect()] if rows is None else rows
        joined = points.select("row", F.inline(_held_by(x, y, rows, shapes.schema["poly_id"].dataType)))
    elif tile is None and found.polygons <= BROADCAST_POLYGONS and found.edges <= BROADCAST_EDGES:
        near = x.between(F.col("bx0"), F.col("bx1")) & y.between(F.col("by0"), F.col("by1"))
        joined = points.join(F.broadcast(shapes), near & inside(x, y, F.col("edges")))
    else:
        joined = covering.join(points, x, y, shapes, covering.Frame(found.box, tile or 0.0), rows)
    names = [c for c in table.columns if not split_by or c != "poly_id"]
    out = joined.select(*(F.col(f"row.{c}") for c in names), *(["poly_id"] if split_by else []))
    if strict and out.isEmpty():
        raise NothingLeft("no footprint lies inside a polygon")
    return out


def _held_by(x: Column, y: Column, shapes: list[dict], kind) -> Column:
    """An array with (poly_id) of each polygon that holds the point."""
    hits = []
    for s in shapes:
        near = x.between(s["bx0"], s["bx1"]) & y.between(s["by0"], s["by1"])
        held = near & inside_literal(x, y, [(e["x1"], e["y1"], e["x2"], e["y2"]) for e in s["edges"]])
        hits.append(F.when(held, F.struct(F.lit(s["poly_id"]).cast(kind).alias("poly_id"))))
    return F.array_compact(F.array(*hits))


def polygon_counts(clipped: DataFrame, layer: DataFrame, split_by: str = "id") -> DataFrame:
    """(poly_id, n): every polygon of the layer, those without a footprint too."""
    ids = layer.select(F.col(split_by).alias("poly_id")).distinct()
    return ids.join(clipped.groupBy("poly_id").agg(F.count("*").alias("n")), "poly_id", "left").select("poly_id", F.coalesce("n", F.lit(0)).alias("n"))
