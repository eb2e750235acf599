"""Rows written back as granule files: a group for each beam, ragged arrays laid out flat again, starts counted anew.

A task writes files of its own below a temporary folder; a commit moves those of the tasks that ended well, and an abort
deletes them, so that a failed or repeated task leaves nothing. A file closes at `file_shots` rows, which bounds what a task
holds. The folder must be one that all executors share, by a path of the file system.

A file lists the granules that its rows came from, if they have a `granule` column, below METADATA. Numbers that are
missing are NaN; a missing whole number, a missing array of a fixed width and nested columns have no place in a granule and
are errors.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, MapType, StructType

from .granules import _RAGGED, PATHS

SOURCES = "METADATA/source_granule"


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    shots: int = 0


def _plain(name: str, column: pa.ChunkedArray) -> np.ndarray:
    """A number or text for each shot."""
    kind = column.type
    if pa.types.is_floating(kind):
        return np.asarray(pc.fill_null(column, float("nan")).to_numpy())
    if column.null_count:
        raise ValueError(f"{name}: a missing value that is no floating-point number has no place in a granule")
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return np.array([v.encode() for v in column.to_pylist()])
    return np.asarray(column.to_numpy())


def _of_lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lists' values, one list after the other, and their lengths; a missing list is empty."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).astype(np.int64)


def beam_datasets(rows: pa.Table, product: str, places: dict[str, str] | None = None) -> dict[str, np.ndarray]:
    """A beam's rows as datasets by their paths."""
    out: dict[str, np.ndarray] = {}
    for name in rows.column_names:
        column, path = rows.column(name), (places or {}).get(name) or PATHS[product].get(name, name)
        if name in ("beam", "granule") or any(name in pair for k, pair in _RAGGED.items() if k in rows.column_names):
            continue
        if not pa.types.is_list(column.type):
            out[path] = _plain(name, column)
            continue
        values, n = _of_lists(column)
        if name in _RAGGED:
            start, count = _RAGGED[name]
            out |= {path: values, start: np.cumsum(n) - n + 1, count: n}
        elif column.null_count or len(set(n.tolist())) > 1:
            raise ValueError(f"{name}: arrays of several lengths, or missing ones, have no place in a granule")
        else:
            out[path] = values.reshape(len(n), -1)
    return out


def _save(path: str, datasets: dict[str, np.ndarray], form: str) -> None:
    if form == "npz":
        with open(path, "wb") as f:
            np.savez(f, **datasets)
        return
    import h5py

    with h5py.File(path, "w") as f:
        for name, values in datasets.items():
            f.create_dataset(name, data=values)


class GranuleWriter(DataSourceArrowWriter):
    def __init__(self, path: str, product: str, schema: StructType, overwrite: bool, form: str, file_shots: int) -> None:
        if form not in ("npz", "h5"):
            raise ValueError("granule files are npz or h5")
        missing = {"beam", "shot_number"} - set(schema.names)
        if missing:
            raise ValueError(f"a granule needs the columns {', '.join(sorted(missing))}")
        nested = [f.name for f in schema.fields if isinstance(f.dataType, (StructType, MapType)) or isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, (StructType, MapType, ArrayType))]
        if nested:
            raise ValueError(f"nested columns have no place in a granule: {', '.join(nested)}")
        self.path, self.product, self.form, self.file_shots, self.overwrite = path.removeprefix("file:"), product, form, file_shots, overwrite
        self.temporary = f"{self.path.rstrip('/')}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.temporary, exist_ok=True)
        task, out, held, size = TaskContext.get().partitionId(), Written(), [], 0
        for b in iterator:
            for at in range(0, b.num_rows, self.file_shots):
                part = b.slice(at, self.file_shots)
                if size and size + part.num_rows > self.file_shots:
                    self._close(out, task, held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            self._close(out, task, held)
        return out

    def _close(self, out: Written, task: int, held: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(held)
        datasets: dict[str, np.ndarray] = {}
        for beam in sorted(pc.unique(rows.column("beam")).to_pylist()):
            own = rows.filter(pc.equal(rows.column("beam"), beam)).sort_by("shot_number")
            datasets |= {f"{beam}/{path}": values for path, values in beam_datasets(own, self.product).items()}
        if "granule" in rows.column_names:
            datasets[SOURCES] = np.array([g.encode() for g in sorted(pc.unique(rows.column("granule").drop_null()).to_pylist())])
        # the name holds the attempt, so that two attempts at one task never meet
        out.files.append(f"{self.temporary}/part-{task:05d}-{uuid.uuid4().hex}.{self.form}")
        _save(out.files[-1], datasets, self.form)
        out.shots += rows.num_rows

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for name in os.listdir(self.path):
                if name.startswith("part-"):
                    os.remove(f"{self.path}/{name}")
        for m in messages:
            for f in m.files if m else ():
                os.rename(f, f"{self.path}/{os.path.basename(f)}")
        shutil.rmtree(self.temporary, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.temporary, ignore_errors=True)
