"""Running numbers and sums inside groups, whatever a group's size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, partitions


#: Rows of the largest group up to which a group is sorted in one task, about 100 MB.
WINDOW_ROWS = 2_000_000


def running(rows: DataFrame, by: tuple[str, ...], order: str, name: str, value: str | None = None) -> DataFrame:
    """rows with `name`: the sum of `value` over the group's earlier rows, or without a value how many they are.

    Where the largest group, which is counted first, has more than WINDOW_ROWS rows, rows are dealt to ranges of (group,
    order); each range sums its own, and the sums of a group's earlier ranges are added: no task has more than a range.
    Rows that share their group and order are numbered in any order.
    """
    own = F.lit(1).cast("long") if value is None else F.coalesce(F.col(value), F.lit(0)).cast("long")
    largest = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= WINDOW_ROWS:
        before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(own).over(before), F.lit(0)).cast("long"))
    dealt = cut(rows.repartitionByRange(partitions(rows.sparkSession), *by, order).withColumns({"_range": F.spark_partition_id(), "_own": own}))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_own").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    within = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_within", F.coalesce(F.sum("_own").over(within), F.lit(0))).alias("r")
    same = reduce(and_, (F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "_range")))
    joined = placed.join(sums.alias("s"), same)
    return joined.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("_before") + F.col("_within")).cast("long").alias(name))
