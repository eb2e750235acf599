"""Extracts as vector data: WKT, GeoJSON features and CSV, as text that any other tool reads.

Coordinates have a fixed number of decimals; shot numbers are text, since many readers keep numbers as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 10


def _fixed(c: Column, digits: int) -> Column:
    return c.cast(f"decimal(20,{digits})").cast("string")


def point_wkt(x: str, y: str, digits: int = DIGITS) -> Column:
    """POINT (x y); null if a coordinate is missing."""
    return F.concat(F.lit("POINT ("), _fixed(F.col(x), digits), F.lit(" "), _fixed(F.col(y), digits), F.lit(")"))


def with_wkt(table: DataFrame, x: str, y: str, digits: int = DIGITS, shot: str = "shot_number") -> DataFrame:
    """The table with shot numbers as text and the point as `wkt`."""
    return table.withColumn("wkt", point_wkt(x, y, digits)).withColumn(shot, F.col(shot).cast("string"))


def features(table: DataFrame, x: str, y: str, digits: int = DIGITS, shot: str = "shot_number") -> DataFrame:
    """(feature): a GeoJSON feature for each row, the other columns as properties."""
    own = [F.col(c).cast("string").alias(c) if c == shot else F.col(c) for c in table.columns if c not in (x, y)]
    place = F.concat(F.lit('{"type":"Point","coordinates":['), _fixed(F.col(x), digits), F.lit(","), _fixed(F.col(y), digits), F.lit("]}"))
    return table.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(place, F.lit("null")), F.lit(',"properties":'), F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), F.lit("}")).alias("feature"))


def write_features(table: DataFrame, x: str, y: str, path: str, mode: str = "error", **options) -> None:
    """A folder of text files, one feature a line."""
    features(table, x, y, **options).write.mode(mode).text(path)


def write_csv(table: DataFrame, x: str, y: str, path: str, mode: str = "error", **options) -> None:
    """A folder of CSV files with a header and the point as WKT."""
    with_wkt(table, x, y, **options).write.mode(mode).option("header", "true").csv(path)
