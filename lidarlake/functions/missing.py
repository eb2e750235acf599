"""Missing values and aggregates over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.products import SENTINEL


def nullify(df: DataFrame, columns: Sequence[str], value: float = SENTINEL) -> DataFrame:
    """The sentinel, and NaN, become null in these columns."""
    kinds = dict(df.dtypes)
    clean = lambda c: F.when((F.col(c) == value) | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)), None).otherwise(F.col(c))
    return df.withColumns({c: clean(c) for c in columns})


def strict(aggregate: Column, of: Column) -> Column:
    """The aggregate, or null if any row of the group has a null."""
    return F.when(F.count(of) == F.count(F.lit(1)), aggregate)


#: Aggregates by the name that their result takes.
STATISTICS: dict[str, Callable[[Column], Column]] = {"min": F.min, "max": F.max, "mean": F.avg, "sd": F.stddev_samp, "sum": F.sum, "median": F.median, "count": F.count}
_DEFAULT = ("min", "max", "mean", "sd")


def metric_set(column: str | Column, names: Sequence[str] = _DEFAULT, na_rm: bool = False) -> dict[str, Column]:
    """Named aggregates of a column. Without na_rm a missing value makes the group's result missing."""
    c = F.col(column) if isinstance(column, str) else column
    made = {n: STATISTICS[n](c) for n in names}
    return made if na_rm else {n: strict(a, c) for n, a in made.items()}


def shot_time(delta_time: Column) -> Column:
    """Seconds since 2018-01-01 as a timestamp."""
    return F.timestamp_micros((F.lit(1_514_764_800_000_000) + F.round(delta_time * 1_000_000)).cast(T.LongType()))


def usable(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)
