"""Cells of a quadtree that cover polygons, and the join of points to them.

A cell's side is a power of two and its corner a multiple of it, so that the cell of a point is found without rounding. A
polygon's cells are split while many of its edges meet them. Cells that no edge meets lie inside as a whole, and their
points need no test, or are left out; a cell that edges meet keeps the few that decide there: those that reach it, those
beyond it that begin or end at its heights, and whether those that pass beyond it from side to side are odd.

Points meet cells by their Morton codes: by equal buckets (codes of a coarse level), then by the range of codes of the
cell. Cells are dealt to blocks of BLOCK_EDGES edges in the order of buckets; each block is broadcast to the points of its
buckets. Points, and the rows they are of, are never shuffled, whatever the size of the layer: a larger layer takes more
blocks, whose boxes are filters of the points' scans.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, floor, frexp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import EDGES, inside
from ..runtime import cut

#: Halvings of the layer's square.
LEVELS = 16
#: A cell is split while more edges than this meet it.
FEW = 6
#: Edges of a broadcast block (32 bytes each), a cell counting as one at least.
BLOCK_EDGES = 500_000


class Frame:
    """The layer's square: 2**LEVELS cells of side `step` on each side, from cell (ox, oy)."""

    def __init__(self, box: tuple[float, float, float, float], least: float = 0.0) -> None:
        x0, x1, y0, y1 = box
        span = max(x1 - x0, y1 - y0, least, abs(x0) * 2.0**-40, abs(y0) * 2.0**-40, 1e-300)
        self.step = 2.0 ** (frexp(span)[1] + 1 - LEVELS)
        self.ox, self.oy = floor(x0 / self.step), floor(y0 / self.step)
        #: the finest level whose cells are not smaller than `least`
        self.levels = LEVELS if least <= self.step else max(1, LEVELS - ceil(log(least / self.step, 2)))

    def code(self, x: Column, y: Column) -> Column:
        """The Morton code of the points' cells; points are in the layer's box."""

        def spread(v: Column) -> Column:
            for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
                v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
            return v

        cell = lambda c, o: (F.floor(c / F.lit(self.step)) - o).cast("long")
        return spread(cell(x, self.ox)).bitwiseOR(F.shiftleft(spread(cell(y, self.oy)), 1))


def _interleaved(x: int, y: int) -> int:
    return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(LEVELS))


def _meets(e: np.ndarray, x0: float, x1: float, y0: float, y1: float) -> np.ndarray:
    """Which edges may meet the closed box: none that does is left out."""
    cx, cy, hx, hy = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2, (y1 - y0) / 2
    mx, my, dx, dy = (e[:, 0] + e[:, 2]) / 2 - cx, (e[:, 1] + e[:, 3]) / 2 - cy, np.abs(e[:, 2] - e[:, 0]) / 2, np.abs(e[:, 3] - e[:, 1]) / 2
    apart = np.abs((e[:, 2] - e[:, 0]) * my - (e[:, 3] - e[:, 1]) * mx) / 2
    slack = 1 + 1e-9
    return (np.abs(mx) <= (hx + dx) * slack) & (np.abs(my) <= (hy + dy) * slack) & (apart <= (hx * dy + hy * dx) * slack + 1e-300)


def cells(edges: np.ndarray, frame: Frame) -> Iterator[tuple[int, int, bool, np.ndarray]]:
    """(first code, last code, odd, edges) of the cells that cover a polygon; no edges and odd: inside as a whole."""
    left, right, low, high = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2]), np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    ix0, ix1 = (int(floor(v / frame.step)) - frame.ox for v in (left.min(), right.max()))
    iy0, iy1 = (int(floor(v / frame.step)) - frame.oy for v in (low.min(), high.max()))
    level = LEVELS - max((ix1 - ix0).bit_length(), (iy1 - iy0).bit_length())
    level = max(0, min(level, frame.levels))
    shift = LEVELS - level
    every = np.arange(len(edges))
    left_over = [(level, x, y, every) for x in range(ix0 >> shift, (ix1 >> shift) + 1) for y in range(iy0 >> shift, (iy1 >> shift) + 1)]
    coarse = min(frame.levels, level + 3)
    while left_over:
        level, cx, cy, near = left_over.pop()
        shift = LEVELS - level
        x0, x1 = (((cx + k << shift) + frame.ox) * frame.step for k in (0, 1))
        y0, y1 = (((cy + k << shift) + frame.oy) * frame.step for k in (0, 1))
        # of the edges at the cell's heights those beyond its left side
        near = near[(low[near] <= y1) & (high[near] >= y0) & (right[near] >= x0)]
        met = _meets(edges[near], x0, x1, y0, y1)
        first = _interleaved(cx << shift, cy << shift)
        last = first + (1 << 2 * shift) - 1
        if not met.any():
            y = (y0 + y1) / 2
            e = edges[near]
            crossed = (e[:, 1] > y) != (e[:, 3] > y)
            e = e[crossed]
            if ((x0 + x1) / 2 < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]).sum() % 2:
                yield first, last, True, edges[:0]
        elif level < frame.levels and (int(met.sum()) > FEW or level < coarse):
            left_over += [(level + 1, 2 * cx + i, 2 * cy + k, near) for i in (0, 1) for k in (0, 1)]
        else:
            beyond = left[near] >= x1
            through = beyond & (low[near] <= y0) & (high[near] >= y1) & (low[near] < high[near])
            level_ = beyond & (low[near] == high[near])
            yield first, last, bool(through.sum() % 2), edges[near[~through & ~level_]]


def cover(shapes: DataFrame, frame: Frame) -> DataFrame:
    """(poly_id, first, last, odd, edges): the cells of polygons (poly_id, edges), made where the polygons are."""
    kind = shapes.schema["poly_id"].dataType.simpleString()
    sql = f"poly_id {kind}, first long, last long, odd boolean, edges {EDGES}"
    schema = to_arrow_schema(shapes.sparkSession.createDataFrame([], sql).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                flat = b.column("edges")[k].values
                if flat is None or not len(flat):
                    continue
                e = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")], 1)
                held: list[tuple] = []
                for cell in cells(e, frame):
                    held.append(cell)
                    if len(held) == 1024:
                        yield batch(b, k, held)
                        held = []
                if held:
                    yield batch(b, k, held)

    def batch(b: pa.RecordBatch, k: int, held: list[tuple]) -> pa.RecordBatch:
        e = np.concatenate([x[3] for x in held])
        offsets = np.concatenate(([0], np.cumsum([len(x[3]) for x in held]))).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(e[:, i], pa.float64()) for i in range(4)], fields=list(schema.field("edges").type.value_type))
        ids = b.column("poly_id").take(pa.array([k] * len(held)))
        columns = [ids.cast(schema.field("poly_id").type), *(pa.array(c, t) for c, t in zip(list(zip(*held, strict=True))[:3], (pa.int64(), pa.int64(), pa.bool_()), strict=True))]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), structs, type=schema.field("edges").type)], schema=schema)

    return shapes.select("poly_id", "edges").mapInArrow(run, sql)


def _bucket_level(n: int) -> int:
    """About four cells a bucket."""
    return max(1, min(10, ceil(log(max(4, n) / 4, 4))))


def blocks(covering: DataFrame) -> tuple[DataFrame, int, list[tuple[int, int, int]]]:
    """The cells by bucket and block; the shift from a code to its bucket; and each block's number and buckets."""
    shift = 2 * (LEVELS - _bucket_level(covering.count()))
    low, high = F.shiftright("first", shift), F.shiftright("last", shift)
    rows = covering.withColumn("bucket", F.explode(F.sequence(low, high))).withColumn("weight", F.size("edges") + 1)
    # sums by bucket, a million at most, tell where blocks begin; a bucket of more than a block is dealt to several
    per = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("bucket").agg(F.sum("weight").alias("weight")).withColumn("before", F.coalesce(F.sum("weight").over(per), F.lit(0)))
    begin, end = F.floor(F.col("before") / BLOCK_EDGES), F.floor((F.col("before") + F.col("weight") - 1) / BLOCK_EDGES)
    placed = sums.select("bucket", begin.cast("int").alias("begin"), (end - begin + 1).cast("int").alias("several"))
    dealt = rows.join(placed, "bucket").withColumn("block", F.col("begin") + F.pmod(F.xxhash64("first", "poly_id"), F.col("several")).cast("int"))
    held = cut(dealt.select("block", "bucket", "poly_id", "first", "last", "odd", "edges").repartition("block", F.pmod(F.xxhash64("first"), F.lit(8))))
    found = held.groupBy("block").agg(F.min("bucket"), F.max("bucket")).collect()
    return held, shift, sorted(tuple(r) for r in found)


def local_blocks(spark: SparkSession, rows: list[dict], kind: str, frame: Frame) -> tuple[DataFrame, int, list[tuple[int, int, int]]] | None:
    """The same of a layer that was built here from few vertices, without a job; None if it takes several blocks."""
    found = []
    for r in rows:
        e = np.array([[x["x1"], x["y1"], x["x2"], x["y2"]] for x in r["edges"]], np.float64).reshape(-1, 4)
        if len(e):
            found += [(r["poly_id"], first, last, odd, [tuple(x) for x in own.tolist()]) for first, last, odd, own in cells(e, frame)]
    level = _bucket_level(len(found))
    shift = 2 * (LEVELS - level)
    if sum((len(x[4]) + 1) * ((x[2] >> shift) - (x[1] >> shift) + 1) for x in found) > BLOCK_EDGES:
        return None
    held = spark.createDataFrame(found, f"poly_id {kind}, first long, last long, odd boolean, edges {EDGES}")
    return held.withColumns({"block": F.lit(0), "bucket": F.explode(F.sequence(F.shiftright("first", shift), F.shiftright("last", shift)))}), shift, [(0, 0, 1 << 2 * level)]


def join(points: DataFrame, x: Column, y: Column, shapes: DataFrame, frame: Frame, rows: list[dict] | None = None) -> DataFrame:
    """(row, poly_id): rows of points (row) with each polygon (poly_id, edges) that holds their point. rows: the polygons,
    where they are few and known here."""
    local = None if rows is None else local_blocks(points.sparkSession, rows, shapes.schema["poly_id"].dataType.simpleString(), frame)
    held, shift, parts = local or blocks(cut(cover(shapes, frame)))
    placed = points.withColumn("code", frame.code(x, y))
    out = []
    for block, low, high in parts:
        near = placed.filter(F.shiftright("code", shift).between(low, high)) if len(parts) > 1 else placed
        own = F.broadcast(held.filter(F.col("block") == block).drop("block"))
        here = (F.shiftright(F.col("code"), shift) == F.col("bucket")) & F.col("code").between(F.col("first"), F.col("last"))
        whole = F.col("odd") & (F.size("edges") == 0)
        held_by = F.when(whole | inside(x, y, F.col("edges"), F.col("odd")), F.array("poly_id"))
        # after the join: of a fold in its condition Spark 4.1.2 infers, in the first plan of a session, a filter of the
        # cells, where the point is missing
        out.append(near.join(own, here).select("row", F.explode(held_by).alias("poly_id")))
    empty = points.limit(0).select("row", F.lit(None).cast(shapes.schema["poly_id"].dataType).alias("poly_id"))
    return reduce(DataFrame.unionByName, out) if out else empty
