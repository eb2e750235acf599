"""Extracts as point shapefiles, written by tasks: each has a set of .shp, .shx, .dbf and .prj files of its own.

A point's record has a fixed size, so the offsets in the index follow from the number of records. Shot numbers and other
whole numbers above 2**31 are text, since readers keep the table's numbers as doubles. Names of the table have ten
characters at most; longer ones are cut, and made different by a number. A row without a coordinate, or with one that is
not finite, is a null shape. Null values are blank. Files close at `file_rows` rows, since the format ends at 2 GB. They
appear in the folder when all tasks have ended well, and a failed write leaves none. The folder must be one that all
executors share, by a path of the file system.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import DoubleType, FloatType, IntegerType, ShortType, StructType

#: Widths of the table's columns: text, whole numbers, and numbers with decimals. Fixed values of the format.
TEXT, WHOLE, REAL, DECIMALS = 64, 11, 24, 10
# Fixed value: the coordinate system of the files.
PRJ = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
_POINT = np.dtype([("number", ">i4"), ("words", ">i4"), ("kind", "<i4"), ("x", "<f8"), ("y", "<f8")])


def field_names(columns: list[str]) -> list[str]:
    """Names of ten characters at most, all different."""
    out: list[str] = []
    for c in columns:
        name, k = c[:10], 0
        while name.lower() in (n.lower() for n in out):
            k += 1
            name = f"{c[: 9 - len(str(k))]}_{k}"
        out.append(name)
    return out


def _head(bytes_: int, kind: int, box: tuple[float, float, float, float]) -> bytes:
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, bytes_ // 2) + struct.pack("<2i8d", 1000, kind, *box, 0.0, 0.0, 0.0, 0.0)


def points(x: np.ndarray, y: np.ndarray) -> tuple[bytes, bytes]:
    """The contents of a .shp and of its .shx file. A null shape is a record of its kind alone."""
    there = np.isfinite(x) & np.isfinite(y)
    size = np.where(there, 20, 4)
    records = np.zeros(len(x), _POINT)
    records["number"], records["words"], records["kind"] = np.arange(1, len(x) + 1), size // 2, there
    records["x"], records["y"] = np.where(there, x, 0.0), np.where(there, y, 0.0)
    raw = records.view(np.uint8).reshape(len(x), -1)
    body = raw[np.arange(raw.shape[1]) < (size + 8)[:, None]].tobytes()
    offsets = 100 + np.cumsum(size + 8) - (size + 8)
    index = np.stack((offsets // 2, size // 2), 1).astype(">i4").tobytes()
    box = (float(x[there].min()), float(y[there].min()), float(x[there].max()), float(y[there].max())) if there.any() else (0.0, 0.0, 0.0, 0.0)
    return _head(100 + len(body), 1, box) + body, _head(100 + len(index), 1, box) + index


def _cell(value, kind: str) -> bytes:
    if value is None:
        text = ""
    elif kind == "F":
        text = f"{value:.{DECIMALS}f}" if np.isfinite(value) else ""
        text = text if len(text) <= REAL else f"{value:.{DECIMALS}e}"
    else:
        text = str(value)
    raw = text.encode("utf-8")
    width = {"C": TEXT, "N": WHOLE, "F": REAL}[kind]
    raw = raw[:width].decode("utf-8", "ignore").encode("utf-8")  # no half character
    return raw.ljust(width) if kind == "C" else raw.rjust(width)


def table(names: list[str], kinds: list[str], columns: list[list]) -> bytes:
    """The contents of a .dbf file."""
    widths = [{"C": TEXT, "N": WHOLE, "F": REAL}[k] for k in kinds]
    n = len(columns[0]) if columns else 0
    head = struct.pack("<B3BIHH20x", 3, 126, 1, 1, n, 33 + 32 * len(names), 1 + sum(widths))
    fields = b"".join(struct.pack("<11sc4xBB14x", name.encode("ascii", "replace")[:10], b"N" if k != "C" else b"C", w, DECIMALS if k == "F" else 0) for name, k, w in zip(names, kinds, widths, strict=True))
    rows = b"".join(b" " + b"".join(_cell(v, k) for v, k in zip(row, kinds, strict=True)) for row in zip(*columns, strict=True))
    return head + fields + b"\r" + rows + b"\x1a"


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class ShapeWriter(DataSourceArrowWriter):
    def __init__(self, path: str, x: str, y: str, schema: StructType, overwrite: bool, file_rows: int) -> None:
        if missing := {x, y} - set(schema.names):
            raise ValueError(f"no column {', '.join(sorted(missing))} for the points")
        self.path, self.x, self.y, self.overwrite, self.file_rows = path.removeprefix("file:"), x, y, overwrite, file_rows
        self.columns = [f.name for f in schema.fields if f.name not in (x, y)]
        kinds = {ShortType: "N", IntegerType: "N", FloatType: "F", DoubleType: "F"}
        self.kinds = [kinds.get(type(schema[c].dataType), "C") for c in self.columns]
        self.temporary = f"{self.path.rstrip('/')}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.temporary, exist_ok=True)
        task, out, held, size = TaskContext.get().partitionId(), Written(), [], 0
        for b in iterator:
            for at in range(0, b.num_rows, self.file_rows):
                part = b.slice(at, self.file_rows)
                if size and size + part.num_rows > self.file_rows:
                    self._close(out, task, held)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            self._close(out, task, held)
        return out

    def _close(self, out: Written, task: int, held: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(held)
        x, y = (rows.column(c).cast(pa.float64()).to_numpy() for c in (self.x, self.y))
        shp, shx = points(np.asarray(x, np.float64), np.asarray(y, np.float64))
        dbf = table(field_names(self.columns), self.kinds, [rows.column(c).to_pylist() for c in self.columns])
        name = f"{self.temporary}/part-{task:05d}-{uuid.uuid4().hex}"
        for ending, data in (("shp", shp), ("shx", shx), ("dbf", dbf), ("prj", PRJ.encode()), ("cpg", b"UTF-8")):
            with open(f"{name}.{ending}", "wb") as f:
                f.write(data)
            out.files.append(f"{name}.{ending}")

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


class ShapeSink(DataSource):
    """format("footprint_shapes"): options x and y, the columns of the points, and file_rows."""

    @classmethod
    def name(cls) -> str:
        return "footprint_shapes"

    def writer(self, schema: StructType, overwrite: bool) -> ShapeWriter:
        return ShapeWriter(self.options["path"], self.options["x"], self.options["y"], schema, overwrite, int(self.options.get("file_rows", "200000")))


def write_points(rows: DataFrame, x: str, y: str, path: str, mode: str = "append", **options) -> None:
    """A folder of point shapefiles of the rows."""
    rows.sparkSession.dataSource.register(ShapeSink)
    rows.write.format("footprint_shapes").options(x=x, y=y, **options).mode(mode).save(path)
