"""Shared parts of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes that a Python stage holds unpacked at a time; one longer text makes a piece of its own.
PIECE_BYTES = 2 << 20


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def narrow(docs: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Only the named columns, cast and renamed; extra columns never meet those of an operator."""
    return docs.select(*(col(name).cast(kind).alias(alias) for alias, (name, kind) in columns.items()))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", budget: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `budget` bytes of text each."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > budget:
                yield b.slice(begin, i - begin)
                begin, held = i, 0
            held += n + 64
        yield b.slice(begin)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


Stage = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Stage) -> Stage:
    """The same stage; when its rows end, the worker, which lives on, gives freed memory back to the system."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return stage
