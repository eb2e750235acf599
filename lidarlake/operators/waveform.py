"""Full waveforms: reconstruction, cumulative energy, and relative-height marks.

A shot's samples stay an array as long as what is asked of them can be told from the array; they are exploded last.
Running sums and nearest samples are found in Arrow batches, where waveforms are rows of a matrix: samples never move and
are never sorted.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _elevation(i: Column) -> Column:
    """Sample i of n, from 1, lies i steps of (bin0 - lastbin) / n below the first bin's elevation."""
    return F.col("elevation_bin0") - i * ((F.col("elevation_bin0") - F.col("elevation_lastbin")) / F.size("rxwaveform"))


def _elevations() -> Column:
    return F.transform("rxwaveform", lambda _, i: _elevation(i + 1))


def samples(product: DataFrame) -> DataFrame:
    """(shot_number, bin, rxwaveform, elevation) of every sample."""
    n = F.size("rxwaveform")
    w = product.select("shot_number", "elevation_bin0", "elevation_lastbin", n.alias("n"), F.posexplode("rxwaveform").alias("at", "rxwaveform"))
    i = F.col("at") + 1
    return w.select("shot_number", i.alias("bin"), "rxwaveform", (F.col("elevation_bin0") - i * ((F.col("elevation_bin0") - F.col("elevation_lastbin")) / F.col("n"))).alias("elevation"))


def of_shot(product: DataFrame, shot_number: int) -> DataFrame:
    """The row of one shot; an unknown shot is an error."""
    one = product.filter(F.col("shot_number") == shot_number)
    if one.isEmpty():
        raise LookupError(f"shot {shot_number} is not in the product")
    return one


def waveform(product: DataFrame, shot_number: int) -> DataFrame:
    """The samples of one shot."""
    return samples(of_shot(product, shot_number))


def relative(product: DataFrame) -> DataFrame:
    """The samples with `relative`: the amplitude within its shot's range, in percent; null for a constant waveform."""
    low, high = F.array_min("rxwaveform"), F.array_max("rxwaveform")
    w = product.select("shot_number", low.alias("low"), high.alias("high"), F.posexplode(F.arrays_zip("rxwaveform", _elevations().alias("elevation"))).alias("at", "s"))
    share = F.try_divide((F.col("s.rxwaveform") - F.col("low")).cast("double"), (F.col("high") - F.col("low")).cast("double")) * 100
    return w.select("shot_number", (F.col("at") + 1).alias("bin"), "s.rxwaveform", "s.elevation", share.alias("relative"))


def outline(product: DataFrame) -> DataFrame:
    """(shot_number, vertex, x, y): the closed polygon below each waveform, corners first and last.

    At equal elevations of the lowest or highest sample, the largest bin is taken.
    """
    held = product.select("shot_number", "rxwaveform", _elevations().alias("elevations"), F.size("rxwaveform").alias("n")).filter("n > 0")
    ends = held.select("*", F.array_min("rxwaveform").alias("low"), F.array_min("elevations").alias("bottom"), F.array_max("elevations").alias("top"))
    at_last = lambda y: F.get("rxwaveform", (F.col("n") - F.array_position(F.reverse("elevations"), F.col(y))).cast("int"))
    vertex = lambda at, x, y: F.struct(at.cast("long").alias("vertex"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    n, low, bottom, top = (F.col(c) for c in ("n", "low", "bottom", "top"))
    corners = F.array(vertex(F.lit(1), low, top), vertex(F.lit(2), low, bottom), vertex(F.lit(3), at_last("bottom"), bottom), vertex(n + 4, at_last("top"), top), vertex(n + 5, low, top))
    body = F.transform(F.arrays_zip(F.col("rxwaveform").alias("x"), F.col("elevations").alias("y")), lambda s, i: vertex(n - i + 3, s["x"], s["y"]))
    return ends.select("shot_number", F.inline(F.concat(corners, body)))


def height_levels(heights: DataFrame, rh: Sequence[int] = (25, 50, 75)) -> DataFrame:
    """(shot_number, rh, z, ground_z): elevations of rh0, the chosen relative heights and rh100."""
    levels = list(dict.fromkeys((0, *rh, 100)))
    pairs = F.array(*(F.struct(F.lit(k).alias("rh"), (F.get("rh", F.lit(k)) + F.col("elev_lowestmode")).cast("double").alias("z")) for k in levels))
    return heights.select("shot_number", F.col("elev_lowestmode").cast("double").alias("ground_z"), F.inline(pairs))


def _band(levels: DataFrame) -> DataFrame:
    return levels.groupBy("shot_number").agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"))


#: Waveforms that are worked on together, as rows of a matrix.
_TOGETHER = 512
_CURVE = pa.schema([("shot_number", pa.int64()), ("bin", pa.int32()), ("elevation", pa.float64()), ("energy", pa.float64())])
_MARK = pa.schema([("shot_number", pa.int64()), ("rh", pa.int32()), ("z", pa.float64()), ("bin", pa.int32()), ("elevation", pa.float64()), ("energy", pa.float64()), ("label_z", pa.float64())])


class Curves:
    """Energy curves of some waveforms, in rows, from the last bin upward: what lies outside of a shot's band, or beyond
    its last sample, is not held."""

    def __init__(self, b: pa.RecordBatch) -> None:
        lists = b.column("rxwaveform")
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        top, bottom, zmin, zmax = (b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("elevation_bin0", "elevation_lastbin", "zmin", "zmax"))
        shape = (b.num_rows, int(n.max(initial=0)))
        there = np.arange(shape[1]) < n[:, None]
        amp = np.full(shape, np.nan)
        amp[there] = lists.flatten().to_numpy(zero_copy_only=False)
        # upward: column 0 is each waveform's last bin
        self.bin = np.where(there, n[:, None] - np.arange(shape[1]), 0)
        at = np.maximum(self.bin - 1, 0)
        amp = np.take_along_axis(amp, at, 1) if shape[1] else amp
        with np.errstate(divide="ignore", invalid="ignore"):
            step = (top - bottom) / n
            self.elevation = top[:, None] - self.bin * step[:, None]
            low, high = (np.array(f(np.where(there, amp, other), axis=1, initial=other)) for f, other in ((np.nanmin, np.inf), (np.nanmax, -np.inf)))
            self.held = there & (self.elevation >= zmin[:, None]) & (self.elevation <= zmax[:, None])
            total = np.cumsum(np.where(self.held, amp - low[:, None], 0.0), axis=1)
            spread = np.max(np.where(self.held, total, -np.inf), axis=1, initial=-np.inf) - np.min(np.where(self.held, total, np.inf), axis=1, initial=np.inf)
            factor = spread / (high - low)
            self.energy = np.where((high > low)[:, None] & (factor != 0)[:, None], total / factor[:, None] + low[:, None], np.nan)


def _with_levels(product: DataFrame, levels: DataFrame) -> DataFrame:
    per = levels.groupBy("shot_number").agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.collect_list(F.struct(F.col("rh").cast("int").alias("rh"), "z")).alias("levels"))
    wave = F.transform("rxwaveform", lambda v: v.cast("double")).alias("rxwaveform")
    return product.select("shot_number", "elevation_bin0", "elevation_lastbin", wave).join(per, "shot_number").select("shot_number", "elevation_bin0", "elevation_lastbin", "rxwaveform", "zmin", "zmax", "levels")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _TOGETHER):
            yield b.slice(at, _TOGETHER)


def _numbers(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), from_pandas=True)


def cumulative_energy(product: DataFrame, levels: DataFrame) -> DataFrame:
    """(shot_number, bin, elevation, energy): energy added up from the ground within [rh0, rh100], scaled to the range
    of the whole waveform. Shots whose band holds fewer than two different sums have null energy. A waveform's samples
    stay together: sums run along rows of a matrix, in the task that has the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            c = Curves(b)
            row, at = np.nonzero(c.held)
            if len(row):
                yield pa.RecordBatch.from_arrays([b.column("shot_number").take(pa.array(row)), pa.array(c.bin[row, at], pa.int32()), pa.array(c.elevation[row, at]), _numbers(c.energy[row, at])], schema=_CURVE)

    return _with_levels(product, levels).drop("levels").mapInArrow(run, "shot_number long, bin int, elevation double, energy double")


def energy_marks(product: DataFrame, levels: DataFrame) -> DataFrame:
    """(shot_number, rh, z, bin, elevation, energy, label_z): per height the nearest samples of the energy curve, ties
    kept, and the middle between the height and the lowest level, where its label stands. Found where the waveform is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            c = Curves(b)
            lists = b.column("levels")
            shot = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            rh, z = flat.field("rh"), flat.field("z").to_numpy(zero_copy_only=False)
            low = b.column("zmin").to_numpy(zero_copy_only=False)
            if not c.held.size:
                continue
            gap = np.where(c.held[shot], np.abs(c.elevation[shot] - z[:, None]), np.nan)
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")  # a level of a shot without a curve
                nearest = np.nanmin(gap, axis=1)
            level, at = np.nonzero(gap == nearest[:, None])
            if len(level):
                row, own = shot[level], z[level]
                yield pa.RecordBatch.from_arrays([b.column("shot_number").take(pa.array(row)), rh.take(pa.array(level)), _numbers(own), pa.array(c.bin[row, at], pa.int32()), pa.array(c.elevation[row, at]), _numbers(c.energy[row, at]), _numbers(own - (own - low[row]) / 2)], schema=_MARK)

    return _with_levels(product, levels).mapInArrow(run, "shot_number long, rh int, z double, bin int, elevation double, energy double, label_z double")


def amplitude_limits(product: DataFrame, levels: DataFrame, share: float = 0.2) -> DataFrame:
    """(shot_number, ymin, ymax, q05, q100): plot limits; order statistics of the amplitudes inside them (the least one
    that a share of p of them does not exceed). Shots without a sample inside are left out."""
    off = (F.col("zmax") - F.col("zmin")) * share
    rows = product.join(_band(levels), "shot_number").select("*", (F.col("zmin") - off).alias("ymin"), (F.col("zmax") + off).alias("ymax"))
    inside = F.filter(F.arrays_zip(F.col("rxwaveform").alias("x"), _elevations().alias("y")), lambda s: s["x"].isNotNull() & s["y"].between(F.col("ymin"), F.col("ymax")))
    held = rows.select("shot_number", "ymin", "ymax", F.array_sort(F.transform(inside, lambda s: s["x"].cast("double"))).alias("sorted")).filter(F.size("sorted") > 0)
    at = lambda hundredths: F.get("sorted", F.ceil(F.size("sorted") * hundredths / 100).cast("int") - 1)
    return held.select("shot_number", "ymin", "ymax", at(5).alias("q05"), at(100).alias("q100"))


def ticks(levels: DataFrame, n: int = 4) -> DataFrame:
    """(shot_number, tick, z, height): n even elevations over the band, the one nearest to the ground moved onto it."""
    band = levels.groupBy("shot_number").agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.first("ground_z").alias("ground"))
    at = band.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("tick")).withColumn("even", F.col("zmin") + (F.col("tick") - 1) * ((F.col("zmax") - F.col("zmin")) / (n - 1)))
    nearest = F.row_number().over(Window.partitionBy("shot_number").orderBy(F.abs(F.col("even") - F.col("ground")), "tick"))
    z = F.when(F.col("nearest") == 1, F.col("ground")).otherwise(F.col("even"))
    return at.withColumn("nearest", nearest).select("shot_number", "tick", z.alias("z"), (z - F.col("ground")).alias("height"))


def metrics_view(waveform_product: DataFrame, height_product: DataFrame, shot_number: int, rh: Sequence[int] = (25, 50, 75)) -> dict[str, DataFrame]:
    """Everything that a picture of one shot's waveform with its relative heights shows."""
    one = of_shot(waveform_product, shot_number)
    levels = height_levels(height_product.filter(F.col("shot_number") == shot_number), rh)
    return {"outline": outline(one), "curve": cumulative_energy(one, levels), "marks": energy_marks(one, levels), "limits": amplitude_limits(one, levels), "ticks": ticks(levels)}
