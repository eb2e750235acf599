"""Statistics over all footprints, or by polygon or any other key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.missing import metric_set
from ..runtime import partitions

Metrics = dict[str, Column] | Callable[..., dict[str, Column]]


def resolve(metrics: Metrics, column: str | None = None, na_rm: bool = False) -> list[Column]:
    """Named aggregates: given as they are, by a function of a column, or the default set of a column."""
    made = metric_set(column, na_rm=na_rm) if metrics is None else metrics if isinstance(metrics, dict) else metrics(F.col(column))
    if not made:
        raise ValueError("no metric is named")
    return [c.alias(n) for n, c in made.items()]


def summarise(table: DataFrame, metrics: Metrics | None = None, column: str | None = None, by: str | Sequence[str] | None = None, na_rm: bool = False) -> DataFrame:
    """One row, or one per key."""
    aggregates = resolve(metrics, column, na_rm)
    keys = [by] if isinstance(by, str) else list(by or ())
    return table.groupBy(*keys).agg(*aggregates) if keys else table.agg(*aggregates)


def summarise_custom(table: DataFrame, column: str, func: Callable[[pd.Series], float], name: str, by: str) -> DataFrame:
    """Any Python statistic of a column by group, as a grouped pandas aggregate."""

    def f(values):
        return float(func(values))

    f.__annotations__ = {"values": pd.Series, "return": float}
    return table.groupBy(by).agg(F.pandas_udf(f, "double")(F.col(column).cast("double")).alias(name))


@dataclass(frozen=True)
class Statistic:
    """A statistic of Python functions that can be made in parts: a state, what a part's values (numbers, missing ones as
    NaN) make of it, what two states make, and the number that a state stands for."""

    init: Callable[[], Any]
    update: Callable[[Any, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


#: Groups whose states a task holds; beyond, they are passed on and begun anew.
MOST_GROUPS = 50_000


def summarise_mergeable(table: DataFrame, metrics: dict[str, tuple[str, Statistic]], by: str | Sequence[str] | None = None) -> DataFrame:
    """Named statistics (column, statistic), in one row or one per key. Each task makes a state for each of its groups
    before anything is shuffled; states are merged in two steps, first in as many places for a key as the root of the
    number of tasks, so that of a key that all rows share no task merges more than that. Null keys are a group. States
    travel pickled."""
    keys = [by] if isinstance(by, str) else list(by or ())
    if not metrics:
        raise ValueError("no metric is named")
    given = list(dict.fromkeys(c for c, _ in metrics.values()))
    names = [f"key_{i}" for i in range(len(keys))]  # no name of the table meets one of the states
    rows = table.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), *(F.col(c).cast("double").alias(f"value_{i}") for i, c in enumerate(given)))
    fields = [f"{n} {table.schema[k].dataType.simpleString()}" for k, n in zip(keys, names, strict=True)]
    head = table.select(*keys).schema if keys else None
    kinds = [*(to_arrow_schema(head).types if keys else ()), pa.int32(), pa.binary()]
    sql = ", ".join([*fields, "part int", "state binary"])
    stats = [(given.index(c), s) for c, s in metrics.values()]
    fan = max(1, round(max(partitions(table.sparkSession), 1) ** 0.5))

    def out(held: dict[tuple, list], part: int) -> pa.RecordBatch:
        columns = [*zip(*held, strict=True)] if keys else []
        values = [*columns, [part] * len(held), [pickle.dumps(v) for v in held.values()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=[*names, "part", "state"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        for b in batches:
            if not b.num_rows:
                continue
            values = [b.column(len(keys) + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(given))]
            if keys:
                number: dict[tuple, int] = {}
                group = np.fromiter((number.setdefault(k, len(number)) for k in zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True)), np.int64, b.num_rows)
            else:
                number, group = {(): 0}, np.zeros(b.num_rows, np.int64)
            order = np.argsort(group, kind="stable")
            ends = np.cumsum(np.bincount(group, minlength=len(number)))
            for key, places in zip(number, np.split(order, ends[:-1]), strict=True):
                state = held.setdefault(key, [s.init() for _, s in stats])
                held[key] = [s.update(x, values[c][places]) for x, (c, s) in zip(state, stats, strict=True)]
            if len(held) > MOST_GROUPS:
                yield out(held, part)
                held = {}
        if held:
            yield out(held, part)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done: dict[tuple, list] = {}
            for *key, state_ in zip(*(b.column(i).to_pylist() for i in (*range(len(keys)), len(keys) + 1)), strict=True):
                key, more = tuple(key), pickle.loads(state_)
                if state is None or key != now:
                    if state is not None:
                        done[now] = state
                    now, state = key, more
                else:
                    state = [s.merge(x, y) for x, y, (_, s) in zip(state, more, stats, strict=True)]
            if done:
                yield out(done, 0)
        if state is not None:
            yield out({now: state}, 0)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states = [pickle.loads(x) for x in b.column(len(keys) + 1).to_pylist()]
            numbers = [[None if (v := s.finish(x[i])) is None else float(v) for x in states] for i, (_, s) in enumerate(stats)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), *(pa.array(v, pa.float64()) for v in numbers)], names=[*names, *(f"value_{i}" for i in range(len(stats)))])

    some = rows.mapInArrow(partial, sql)
    n = partitions(table.sparkSession)
    for place in (F.pmod("part", F.lit(fan)), F.lit(0)):
        some = some.withColumn("_place", place).repartition(n, *names, "_place").sortWithinPartitions(*names, "_place").drop("_place").mapInArrow(merged, sql)
    done = some.mapInArrow(finished, ", ".join([*fields, *(f"value_{i} double" for i in range(len(stats)))]))
    return done.toDF(*keys, *metrics)
