"""Extraction: scalar and array columns of product tables as flat tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.products import BEAM_PATTERN, CANOPY_DEFAULT, CANOPY_MAP, GEO_COLUMNS, GEO_DEFAULT, HEIGHT_COLUMNS, N_BINS, N_RH, PROFILE_COLUMNS, profile_names
from ..plans.validate import check_columns


def waveform_geolocation(product: DataFrame, select: Sequence[str] = GEO_DEFAULT) -> DataFrame:
    """shot_number, the coordinates of both ends, and the selected columns, each once."""
    names = list(dict.fromkeys(("shot_number", *GEO_COLUMNS, *select)))
    check_columns(product, names, "waveform product")
    return product.select(*names)


def height_metrics(product: DataFrame) -> DataFrame:
    """Scalars and rh0..rh100. A one-element projection per height, made last, keeps the array until then."""
    return product.select(*HEIGHT_COLUMNS, *(F.get("rh", F.lit(i)).alias(f"rh{i}") for i in range(N_RH)))


def _present(product: DataFrame, path: str) -> bool:
    kind = product.schema
    for part in path.split("."):
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            return False
        kind = kind[part].dataType
    return True


def canopy_metrics(product: DataFrame, columns: Sequence[str] = CANOPY_DEFAULT) -> DataFrame:
    """Logical columns by the product's map; a name that the map does not know is taken as it is. A column that the
    product lacks is left out with a warning."""
    chosen = []
    for c in dict.fromkeys(columns):
        path = CANOPY_MAP.get(c, c)
        path = path if _present(product, path) else c
        if _present(product, path):
            chosen.append(F.col(path).alias(c))
        else:
            warnings.warn(f"the canopy product has no column {c}", stacklevel=2)
    return product.select(*chosen)


def profile(product: DataFrame, prefix: str) -> DataFrame:
    """Scalars and the 30 vertical bins of pai_z or pavd_z."""
    return product.select(*PROFILE_COLUMNS, *(F.get(f"{prefix}_z", F.lit(k)).alias(n) for k, n in enumerate(profile_names(prefix))))


def beams(product: DataFrame) -> DataFrame:
    """The beam groups that have shots."""
    return product.filter(F.col("beam").rlike(BEAM_PATTERN) & F.col("shot_number").isNotNull()).select("beam").distinct()


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """Beams or granules below each other, columns by name; those without shot_number are skipped."""
    some = [p for p in parts if "shot_number" in p.columns]
    if not some:
        raise ValueError("no part has a shot_number")
    out = some[0]
    for p in some[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def of_beam(table: DataFrame, beam: str) -> DataFrame:
    return table.filter(F.col("beam") == beam)


def long_profile(product: DataFrame, prefix: str) -> DataFrame:
    """(shot_number, bin, value): one row per vertical bin."""
    return product.select("shot_number", F.posexplode(F.slice(f"{prefix}_z", 1, N_BINS)).alias("bin", "value"))
