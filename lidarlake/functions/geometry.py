"""Polygons as arrays of edges, and the test of a point against them in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"

Ring = list[tuple[float, float]]


def ring_edges(rings: list[Ring]) -> list[tuple[float, float, float, float]]:
    """Edges of all rings, each closed if it is not; edges without length are left out."""
    out = []
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (x1, y1) != (x2, y2):
                out.append((float(x1), float(y1), float(x2), float(y2)))
    return out


def inside(x: Column, y: Column, edges: Column, odd: Column | None = None) -> Column:
    """Is the point in the polygon, its boundary included? Even-odd parity over all rings, so holes are outside. One fold
    tells both: its lowest bit is the parity, the next one that an edge holds the point. odd: edges that are not in the
    array lie beyond the point, an odd number of them."""

    def crosses(e: Column) -> Column:
        at = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & F.coalesce(x < at, F.lit(False))

    def touches(e: Column) -> Column:
        on_line = (x - e["x1"]) * (e["y2"] - e["y1"]) == (y - e["y1"]) * (e["x2"] - e["x1"])
        return y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & on_line

    bit = lambda c, n: F.when(c, n).otherwise(0)
    return F.aggregate(edges, F.lit(0) if odd is None else bit(odd, 1), lambda acc, e: acc.bitwiseXOR(bit(crosses(e), 1)).bitwiseOR(bit(touches(e), 2))) > 0


def inside_literal(x: Column, y: Column, edges: list[tuple[float, float, float, float]]) -> Column:
    """The same for edges that are known when the plan is made: plain comparisons, which are compiled with the scan."""
    crossings, touches = F.lit(0), F.lit(False)
    for x1, y1, x2, y2 in edges:
        if y1 != y2:
            at = F.lit(x2 - x1) * (y - y1) / F.lit(y2 - y1) + x1
            crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at), 1).otherwise(0)
        on_line = (x - x1) * F.lit(y2 - y1) == (y - y1) * F.lit(x2 - x1)
        touches = touches | (y.between(min(y1, y2), max(y1, y2)) & x.between(min(x1, x2), max(x1, x2)) & on_line)
    return (crossings % 2 == 1) | touches
