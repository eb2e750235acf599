"""Checks of arguments, in the words of this package."""

from __future__ import annotations

import math
from collections.abc import Iterable
from numbers import Real

from pyspark.sql import DataFrame


def check_extent(xmin: float, xmax: float, ymin: float, ymax: float) -> None:
    sides = {"xmin": xmin, "xmax": xmax, "ymin": ymin, "ymax": ymax}
    odd = [k for k, v in sides.items() if isinstance(v, bool) or not isinstance(v, Real) or math.isnan(v)]
    if odd:
        raise ValueError(f"an extent needs numbers for its sides, not for {', '.join(odd)} as given")
    for low, high in (("xmin", "xmax"), ("ymin", "ymax")):
        if sides[low] > sides[high]:
            raise ValueError(f"empty extent: {low} {sides[low]} lies beyond {high} {sides[high]}")


def check_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: no column {', '.join(missing)}")
