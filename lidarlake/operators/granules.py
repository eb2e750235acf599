"""Clips of whole products, all columns and arrays kept, and their partitioned output."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import usable
from ..plans.products import HEIGHT_VARIANTS, Product
from ..plans.validate import check_extent
from .clip import NothingLeft, clip_box
from .ordering import running
from .spatial import clip_polygons


def clip_granule(product_rows: DataFrame, product: Product, xmin: float, xmax: float, ymin: float, ymax: float, strict: bool = True) -> DataFrame:
    """Rows carry their arrays, so that a clip is a filter; an empty clip is an error unless strict is False."""
    return clip_box(product_rows, product, xmin, xmax, ymin, ymax, strict)


def clip_granule_polygons(product_rows: DataFrame, product: Product, layer: DataFrame, split_by: str | None = None, strict: bool = True) -> DataFrame:
    """The same by polygons; without split_by all polygons make one output."""
    return clip_polygons(product_rows, product, layer, split_by, strict=strict)


_VARIANT = ("lat_highest", "lat_lowest", "lon_highest", "lon_lowest")


def height_variants(heights: DataFrame) -> DataFrame:
    """(beam, shot_number, algorithm, lat_highest, lat_lowest, lon_highest, lon_lowest) of a product whose `variants`
    array holds the algorithms' coordinates: a1..aN by position, then the main ones."""
    return heights.select("beam", "shot_number", F.inline(_all_variants(heights)))


def _all_variants(heights: DataFrame) -> Column:
    """The algorithms of a row, the main one last, each with its name and coordinates."""
    fields = lambda v: [v[f].cast("double").alias(f) for f in _VARIANT]
    main = F.struct(F.lit("main").alias("algorithm"), *(F.col(c).cast("double").alias(f) for f, c in zip(_VARIANT, ("lat_highestreturn", "lat_lowestmode", "lon_highestreturn", "lon_lowestmode"), strict=True)))
    if "variants" not in heights.columns:
        return F.array(main)
    named = F.transform("variants", lambda v, k: F.struct(F.concat(F.lit("a"), (k + 1).cast("string")).alias("algorithm"), *fields(v)))
    return F.concat(F.coalesce(named, F.array().cast(heights.select(named.alias("n")).schema["n"].dataType)), F.array(main))


def clip_variants(heights: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float, strict: bool = True) -> DataFrame:
    """Every algorithm is clipped by its own coordinates; one row for each that is left."""
    return clip_box(height_variants(heights), HEIGHT_VARIANTS, xmin, xmax, ymin, ymax, strict)


def clip_heights(heights: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float, strict: bool = True, name: str = "algorithms") -> DataFrame:
    """The product's rows with all their columns and `algorithms`, an array of what is left of (algorithm, coordinates):
    every algorithm is clipped by its own ones. A row goes if none is left."""
    check_extent(xmin, xmax, ymin, ymax)
    inside = lambda v: reduce(and_, [v[c].between(*s) & usable(v[c]) for p in HEIGHT_VARIANTS.points for c, s in zip(p, ((xmin, xmax), (ymin, ymax)), strict=True)])
    out = heights.withColumn(name, F.filter(_all_variants(heights), inside)).filter(F.size(name) > 0)
    if strict and out.isEmpty():
        raise NothingLeft("no algorithm's footprint lies inside the extent")
    return out


def clip_variants_polygons(heights: DataFrame, layer: DataFrame, split_by: str | None = None, strict: bool = True) -> DataFrame:
    return clip_polygons(height_variants(heights), HEIGHT_VARIANTS, layer, split_by, strict=strict)


def clip_heights_polygons(heights: DataFrame, layer: DataFrame, split_by: str | None = None, strict: bool = True) -> DataFrame:
    """clip_heights by polygons: a row for each algorithm and polygon, with all columns of the product beside the
    algorithm's name and coordinates."""
    wide = heights.select("*", F.inline(_all_variants(heights)))
    return clip_polygons(wide, HEIGHT_VARIANTS, layer, split_by, strict=strict)


#: Where a clip keeps the metadata of the granules that it came from. Readers of the rows pass over it.
METADATA = "_granule_metadata"


def write_clip(rows: DataFrame, output: str, by: tuple[str, ...] = ("poly_id", "beam"), mode: str = "error", metadata: DataFrame | None = None) -> list[str]:
    """Parquet partitioned by polygon and beam, as far as the rows have them; empty ones are not written. Each
    partition's rows are dealt by key and a salt, so that a hot polygon has several writers. The granules' metadata, if
    given, goes with the clip; where the rows tell their granule, that of granules which have rows left."""
    keys = [c for c in by if c in rows.columns]
    spread = rows.repartition(*keys, F.pmod(F.xxhash64("shot_number"), F.lit(16))) if keys else rows
    (spread.write.partitionBy(*keys) if keys else spread.write).mode(mode).parquet(output)
    if metadata is not None:
        if "granule" in rows.columns:
            metadata = of_granules(metadata, rows.sparkSession.read.schema(rows.select("granule").schema).parquet(output))
        metadata.write.mode(mode).parquet(f"{output.rstrip('/')}/{METADATA}")
    return keys


def of_granules(metadata: DataFrame, rows: DataFrame) -> DataFrame:
    """The metadata (granule, name, value) of the granules that rows are from."""
    return metadata.join(rows.select("granule").distinct(), "granule", "left_semi")


def read_metadata(spark: SparkSession, output: str) -> DataFrame:
    """The metadata that write_clip kept."""
    return spark.read.parquet(f"{output.rstrip('/')}/{METADATA}")


def _keys(by: str | tuple[str, ...]) -> tuple[str, ...]:
    return (by,) if isinstance(by, str) else tuple(by)


def flat_index(rows: DataFrame, count: str = "rx_sample_count", by: str | tuple[str, ...] = "beam") -> DataFrame:
    """(beam, shot_number, count, start_index): 1-based starts of each shot's samples in one flat array per beam; by may
    name several columns, such as granule and beam."""
    keys = _keys(by)
    placed = running(rows.select(*keys, "shot_number", count), keys, "shot_number", "start_index", count)
    return placed.withColumn("start_index", F.col("start_index") + 1)


def normalised_start(rows: DataFrame, start: str = "rx_sample_start_index", by: str | tuple[str, ...] = "beam") -> DataFrame:
    """Starts counted from 1 within each beam."""
    keys = _keys(by)
    least = rows.groupBy(*keys).agg(F.min(start).alias("_least"))
    same = reduce(and_, (F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in keys))
    joined = rows.alias("r").join(least.alias("l"), same)
    return joined.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col(f"r.{start}") - F.col("_least") + 1).alias("start_index"))


#: Samples of a page of a flat array.
PAGE = 1 << 16


def pages(rows: DataFrame, by: str | tuple[str, ...] = "beam", start: str = "start_index", wave: str = "rxwaveform", size: int = PAGE) -> DataFrame:
    """(by, page, values): shots' samples laid out as one flat array for each beam (of a granule), in pages: every shot
    gives each page that it reaches its part. No row holds more than a page."""
    keys = _keys(by)
    end = F.col(start) - 1 + F.size(wave)
    reached = rows.filter(F.size(wave) > 0).select(*keys, start, wave, F.explode(F.sequence(F.floor((F.col(start) - 1) / size), F.floor((end - 1) / size))).alias("page"))
    low, high = F.greatest(F.col(start) - 1, F.col("page") * size), F.least(end, (F.col("page") + 1) * size)
    part = F.slice(wave, (low - F.col(start) + 2).cast("int"), (high - low).cast("int"))
    held = reached.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(F.struct(low.alias("at"), part.alias("part")))).alias("parts"))
    return held.select(*keys, "page", F.flatten(F.col("parts").getField("part")).alias("values"))


def gather(flat: DataFrame, rows: DataFrame, by: str | tuple[str, ...] = "beam", start: str = "start_index", count: str = "rx_sample_count", size: int = PAGE) -> DataFrame:
    """Ragged arrays from flat buffers: flat has rows (by, page, values) of `size` samples each, or one row (by, values)
    for each beam (of a granule), which is cut into pages first. A shot takes its samples from the pages that it reaches;
    one without samples has an empty array, one that reaches beyond the buffer is cut there."""
    keys = _keys(by)
    if "page" not in flat.columns:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("values") - 1) / size).cast("int")), lambda p: F.slice("values", p * size + 1, F.lit(size)))
        flat = flat.filter(F.size("values") > 0).select(*keys, F.posexplode(parts).alias("page", "values"))
    numbered = rows.withColumn("_first", (F.col(start) - 1).cast("long")).withColumn("_end", F.col("_first") + F.greatest(F.col(count), F.lit(0)))
    reached = numbered.select(*keys, "shot_number", "_first", "_end", F.explode(F.sequence(F.floor(F.col("_first") / size), F.floor((F.col("_end") - 1) / size))).alias("page"))
    reached = reached.filter(F.col("_end") > F.col("_first"))
    low, high = F.greatest(F.col("_first"), F.col("page") * size) - F.col("page") * size, F.least(F.col("_end"), (F.col("page") + 1) * size) - F.col("page") * size
    met = reached.join(flat.select(*keys, F.col("page").cast("long").alias("page"), "values"), [*keys, "page"])
    some = met.select(*keys, "shot_number", "_first", "_end", "page", F.slice("values", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    # a set, since rows may be repeated
    waves = some.groupBy(*keys, "shot_number", "_first", "_end").agg(F.array_sort(F.collect_set(F.struct("page", "part"))).alias("parts"))
    joined = numbered.join(waves, [*keys, "shot_number", "_first", "_end"], "left")
    none = F.array().cast(flat.schema["values"].dataType)
    return joined.select(*rows.columns, F.coalesce(F.flatten(F.col("parts").getField("part")), none).alias("rxwaveform"))


def total_samples(rows: DataFrame, by: str = "beam") -> DataFrame:
    return rows.groupBy(by).agg(F.sum("rx_sample_count").alias("rx"), F.sum("tx_sample_count").alias("tx"))


__all__ = ["NothingLeft", "clip_granule", "clip_granule_polygons", "clip_heights", "clip_heights_polygons", "clip_variants", "clip_variants_polygons", "flat_index", "gather", "height_variants", "normalised_start", "of_granules", "pages", "read_metadata", "total_samples", "write_clip"]
