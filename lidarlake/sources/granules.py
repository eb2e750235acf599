"""Product tables: Parquet, and granule files through a Python data source."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from ..plans.products import BEAM_PATTERN, CANOPY_GEOLOCATION, CANOPY_LAND_COVER, MANDATORY, SCHEMAS, Product
from ..plans.validate import check_columns

#: Where a file keeps a column, if not at the beam's root under its own name. Fixed values.
PATHS = {
    "waveform": {c: f"geolocation/{c}" for c in ("latitude_bin0", "latitude_lastbin", "longitude_bin0", "longitude_lastbin", "elevation_bin0", "elevation_lastbin", "delta_time")},
    "heights": {},
    "canopy": {c: f"geolocation/{c}" for c in CANOPY_GEOLOCATION if c not in ("delta_time",)} | {c: f"land_cover_data/{c}" for c in CANOPY_LAND_COVER},
    "profiles": {c: f"geolocation/{c}" for c in ("delta_time", "lat_lowestmode", "lon_lowestmode", "elev_highestreturn", "elev_lowestmode", "height_lastbin", "height_bin0")},
}
_RAGGED = {"rxwaveform": ("rx_sample_start_index", "rx_sample_count"), "txwaveform": ("tx_sample_start_index", "tx_sample_count")}


def read_product(spark: SparkSession, path: str, product: str, columns: list[str] | None = None, form: str = "parquet", whole: bool = True, parts: int = 1, shots: int = 65_536, where: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
    """A product table; `columns` reach the scan.

    A Parquet table has its own columns, all of them, as they are; the mandatory ones are cast where they have another
    type. Of granule files `whole` reads every dataset of the beams, else the product's usual columns only; a file has
    `parts` partitions of ranges of `shots`. where: comparisons (column, one of =, >, >=, <, <=, in, value) that all rows
    pass; a range of a granule file is read only if they leave one of its shots.
    """
    if form == "parquet":
        table = spark.read.parquet(path)
        check_columns(table, [c for c in MANDATORY[product] if not columns or c in columns], f"{product} table")
        wanted = columns or table.columns
        kinds = {f.name: f.dataType for f in SCHEMAS[product].fields if f.name in MANDATORY[product]}
        own = {f.name: f.dataType for f in table.schema.fields}
        typed = table.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds and own.get(c) != kinds[c] else F.col(c) for c in dict.fromkeys([*wanted, *(c for c, *_ in where)])))
        return _passing(typed, where, columns)
    register(spark)
    asked = list(dict.fromkeys([*columns, *(c for c, *_ in where)])) if columns else []
    options = {"product": product, "columns": json.dumps(asked), "whole": str(whole).lower(), "parts": str(parts), "shots": str(shots), "where": json.dumps(list(where))}
    return _passing(spark.read.format("footprint_granule").options(**options).load(path), where, columns)


def _passing(rows: DataFrame, where: Sequence[tuple[str, str, object]], columns: list[str] | None) -> DataFrame:
    for name, how, value in where:
        c = F.col(name)
        rows = rows.filter({"=": c == value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[how] if how != "in" else c.isin(list(value)))
    return rows.select(*columns) if columns else rows


def in_box(product: Product, xmin: float, xmax: float, ymin: float, ymax: float) -> list[tuple[str, str, float]]:
    """What `where` needs to read the ranges that a clip by this box needs."""
    return [w for x, y in product.points for w in ((x, ">=", xmin), (x, "<=", xmax), (y, ">=", ymin), (y, "<=", ymax))]


def read_metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(granule, name, value): attributes of granule files and of their METADATA groups, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                granule = open_granule(path)
                try:
                    found = [(path, name, str(value)) for at, group in _groups(granule) if not at or at.startswith("METADATA") for name, value in (*((f"{at}@{k}", v) for k, v in dict(getattr(group, "attrs", {})).items()), *((f"{at}/{k}" if at else k, _plain(v)) for k, v in group.items() if at and not _is_group(v)))]
                finally:
                    getattr(granule, "close", lambda: None)()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else ([], [], []))], names=["granule", "name", "value"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, "granule string, name string, value string")


def _plain(dataset) -> str:
    value = np.asarray(dataset[()] if hasattr(dataset, "shape") and dataset.shape == () else dataset)
    return str(value.item() if value.ndim == 0 or value.size == 1 else value.tolist())


def _is_group(x) -> bool:
    return hasattr(x, "items") and hasattr(x, "__contains__") and not hasattr(x, "dtype")


def _groups(group, at: str = "") -> Iterator[tuple[str, object]]:
    yield at, group
    for k, v in group.items():
        if _is_group(v):
            yield from _groups(v, f"{at}/{k}" if at else k)


def _datasets(group, at: str = "") -> dict[str, object]:
    """Every dataset below a group, by its path."""
    return {f"{own}/{k}" if own else k: v for own, g in _groups(group, at) for k, v in g.items() if not _is_group(v)}


class _Stored:
    """A dataset of a NumPy archive: its shape from the head, its values when they are asked for."""

    def __init__(self, path: str, name: str) -> None:
        self.path, self.name = path, name
        with zipfile.ZipFile(path) as z, z.open(f"{name}.npy") as f:
            version = np.lib.format.read_magic(f)
            head = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            self.shape, _, self.dtype = head(f)
        self.ndim = len(self.shape)

    def __len__(self) -> int:
        return self.shape[0]

    def __array__(self, dtype=None, copy=None):
        with np.load(self.path) as held:
            return np.asarray(held[self.name], dtype)

    def __getitem__(self, key):
        return np.asarray(self)[key]


def open_npz(path: str) -> dict:
    """A granule that was stored as a NumPy archive, its datasets by their paths."""
    out: dict = {}
    with zipfile.ZipFile(path) as held:
        names = [n.removesuffix(".npy") for n in held.namelist()]
    for name in names:
        *groups, leaf = name.split("/")
        at = out
        for g in groups:
            at = at.setdefault(g, {})
        at[leaf] = _Stored(path, name)
    return out


def _open_h5(path: str):
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("granule files need the h5py package on the executors; Parquet product tables do not") from e
    return h5py.File(path, "r")


def open_granule(path: str):
    """A mapping of groups, each a mapping of array-likes."""
    return open_npz(path) if path.endswith(".npz") else _open_h5(path)


def _exists(group, path: str) -> bool:
    for part in path.split("/"):
        if part not in group:
            return False
        group = group[part]
    return True


def _at(group, path: str):
    for part in path.split("/"):
        group = group[part]
    return group


def _name(path: str, product: str) -> str:
    """The column of a dataset: the product's name for it, else its path with underscores."""
    known = {PATHS[product].get(f.name, f.name): f.name for f in SCHEMAS[product].fields}
    return known.get(path, path.replace("/", "_"))


def _kind(dataset, name: str, shots: int, product: str) -> DataType:
    known = {f.name: f.dataType for f in SCHEMAS[product].fields}
    if name in known:
        return known[name]
    x = np.asarray(dataset[:1] if getattr(dataset, "ndim", 1) else dataset)
    one = {"f": FloatType() if x.dtype.itemsize <= 4 else DoubleType(), "i": IntegerType() if x.dtype.itemsize <= 4 else LongType(), "u": IntegerType() if x.dtype.itemsize < 4 else LongType(), "b": BooleanType()}.get(x.dtype.kind, StringType())
    return one if dataset.shape[:1] == (shots,) and len(dataset.shape) == 1 else ArrayType(one)


def whole_schema(granule, product: str) -> tuple[StructType, dict[str, str]]:
    """All datasets of a granule's first beam with shots as columns, and where each column lies."""
    for beam in beams_of(granule):
        if "shot_number" in granule[beam]:
            shots = len(granule[beam]["shot_number"])
            found = {_name(path, product): (path, d) for path, d in _datasets(granule[beam]).items() if getattr(d, "shape", ()) != ()}
            fields = [StructField("beam", StringType()), *(StructField(n, _kind(d, n, shots, product)) for n, (_, d) in found.items() if n != "beam")]
            return StructType(fields), {n: path for n, (path, _) in found.items()}
    return SCHEMAS[product], {}


def beams_of(granule) -> list[str]:
    """The groups whose names are those of beams."""
    return sorted(k for k in granule if re.search(BEAM_PATTERN, k))


def _part(dataset, begin: int, end: int):
    """Rows of a dataset, read from there on."""
    return np.asarray(dataset[begin:end])


def beam_batch(group, beam: str, product: str, schema: StructType, paths: dict[str, str] | None = None, granule: str | None = None, rows: tuple[int, int] | None = None) -> pa.RecordBatch | None:
    """One beam's rows, or those of a range of its shots; a beam without shot_number has none. Ragged arrays are cut by
    their 1-based starts, wide ones are read shot by shot, whichever way round they are stored; an array of any other shape
    is an error. Of every dataset only the range is read."""
    if "shot_number" not in group:
        return None
    every = len(group["shot_number"])
    begin, end = rows or (0, every)
    shots = _part(group["shot_number"], begin, end)
    if shots.dtype.kind == "u" and len(shots) and int(shots.max()) > 2**63 - 1:
        raise ValueError("a shot number does not fit a signed 64-bit number")
    columns = []
    target = to_arrow_schema(schema)

    def ragged(flat, of: str, kind: pa.DataType) -> pa.Array:
        start, count = (np.asarray(group[c][0:every]).astype(np.int64) for c in _RAGGED[of])
        start = start - (start.min() if len(start) else 0)
        if len(start) and int((start + count).max()) > len(flat):
            raise ValueError(f"{of}: samples end beyond the {len(flat)} that the beam has")
        start, count = start[begin:end], count[begin:end]
        first = int(start.min()) if len(start) else 0
        held = _part(flat, first, int((start + count).max()) if len(start) else 0)
        return pa.array([held[a - first : a - first + n] for a, n in zip(start, count, strict=True)], kind)

    def wide(dataset, name: str) -> list:
        """A row for each shot. Where both sides are as long as there are shots, rows are as the file has them."""
        shape = dataset.shape
        if len(shape) == 1 and shape[0] and every == 1:
            return [np.asarray(dataset[0 : shape[0]])]
        if len(shape) >= 2 and shape[0] == every:
            return list(_part(dataset, begin, end).reshape(end - begin, -1))
        if len(shape) == 2 and shape[1] == every:
            return list(np.asarray(dataset[:, begin:end]).T)
        raise ValueError(f"{name}: an array of shape {shape} does not go with {every} shots")

    for f in schema.fields:
        kind = target.field(f.name).type
        path = (paths or {}).get(f.name) or PATHS[product].get(f.name, f.name)
        if f.name in ("beam", "granule"):
            columns.append(pa.array([beam if f.name == "beam" else granule] * len(shots), kind))
        elif not _exists(group, path):
            columns.append(pa.nulls(len(shots), kind))
        elif f.name in _RAGGED:
            columns.append(ragged(_at(group, path), f.name, kind))
        elif isinstance(f.dataType, ArrayType):
            values = _at(group, path)
            of = next((k for k, (_, n) in _RAGGED.items() if n in group and len(values.shape) == 1 and every > 1 and len(values) == int(np.asarray(group[n][0:every]).sum())), None)
            columns.append(ragged(values, of, kind) if of else pa.array(wide(values, f.name), kind))
        else:
            values = _at(group, path)
            if tuple(values.shape) != (every,):
                raise ValueError(f"{f.name}: {tuple(values.shape)} values for {every} shots")
            columns.append(pa.array([v.decode() if isinstance(v, bytes) else v for v in _part(values, begin, end).tolist()], kind))
    return pa.RecordBatch.from_arrays(columns, schema=target)


@dataclass
class GranulePartition(InputPartition):
    """One of several equal parts of a file."""

    path: str
    part: int
    parts: int


#: Comparisons by their signs.
_SIGNS = {"=": EqualTo, ">": GreaterThan, ">=": GreaterThanOrEqual, "<": LessThan, "<=": LessThanOrEqual, "in": In}
#: Those that a range of shots can be passed over by, with what they ask of a value.
_COMPARED = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class GranuleReader(DataSourceReader):
    def __init__(self, paths: list[str], product: str, schema: StructType, whole: bool, parts: int = 1, shots: int = 65_536, where: list | None = None) -> None:
        self.paths, self.product, self.schema, self.whole, self.parts, self.shots = paths, product, schema, whole, parts, shots
        self.given = self.pushed = self._plain([_SIGNS[how]((name,), tuple(value) if how == "in" else value) for name, how, value in where or ()])

    def _plain(self, filters: list) -> list:
        """Comparisons of plain columns with a value."""
        own = {f.name for f in self.schema.fields}
        return [f for f in filters if isinstance(f, (*_COMPARED, In)) and len(f.attribute) == 1 and f.attribute[0] in own and not isinstance(self.schema[f.attribute[0]].dataType, ArrayType)]

    def partitions(self) -> list[InputPartition]:
        return [GranulePartition(p, k, self.parts) for p in self.paths if self._may("granule", p) for k in range(self.parts)]

    def _may(self, column: str, value: str) -> bool:
        return all(value in f.value if isinstance(f, In) else bool(_COMPARED[type(f)](value, f.value)) for f in self.pushed if f.attribute == (column,))

    def _needed(self, group, begin: int, end: int, paths: dict[str, str]) -> bool:
        """May a shot of the range pass all comparisons? Only the columns that are compared are read. A value that is not a
        number passes: how it compares is for Spark to say."""
        left = np.ones(end - begin, bool)
        for f in self.pushed:
            name = f.attribute[0]
            path = paths.get(name) or PATHS[self.product].get(name, name)
            if name in ("beam", "granule") or not _exists(group, path) or len(_at(group, path).shape) != 1:
                continue
            x = _part(_at(group, path), begin, end)
            if x.dtype.kind not in "iuf" or len(x) != len(left):
                continue
            passed = np.isin(x, [v for v in f.value if v is not None]) if isinstance(f, In) else _COMPARED[type(f)](x, f.value)
            left &= passed | np.isnan(x) if x.dtype.kind == "f" else passed
            if not left.any():
                return False
        return True

    def read(self, partition: GranulePartition) -> Iterator[pa.RecordBatch]:
        granule = open_granule(partition.path)
        try:
            places = whole_schema(granule, self.product)[1] if self.whole else {}
            beams = [b for b in beams_of(granule) if "shot_number" in granule[b]]
            ranges = [(b, at, min(at + self.shots, n)) for b in beams for n in (len(granule[b]["shot_number"]),) for at in range(0, n, self.shots)]
            first, last = (len(ranges) * k // partition.parts for k in (partition.part, partition.part + 1))
            for beam, begin, end in ranges[first:last]:
                if self._may("beam", beam) and self._needed(granule[beam], begin, end, places):
                    yield beam_batch(granule[beam], beam, self.product, self.schema, places, partition.path, (begin, end))
        finally:
            getattr(granule, "close", lambda: None)()


class PushingReader(GranuleReader):
    """Asks ranges of shots what Spark pushes too; Spark asks all of their rows again."""

    def pushFilters(self, filters: list) -> Iterator:
        self.pushed = [*self.given, *self._plain(filters)]
        yield from filters


class GranuleSource(DataSource):
    """format("footprint_granule"): options product (waveform, heights, canopy, profiles), columns (a JSON list), whole
    (every dataset of the first file's beams), parts (partitions of a file), shots (of a range); a path or several,
    comma-separated. A file's beams are the groups with a beam's name. A range of shots is read in whole only if its
    columns that are compared leave a shot; rows tell their file as `granule`. Written with the same name, rows become
    granule files (see granule_writer).

    where (a JSON list) holds the comparisons. With push=true those that Spark pushes count too, if the session has
    spark.sql.python.filterPushdown.enabled. Spark 4.1 keeps what was pushed with the source: another scan of the same
    DataFrame, in the same plan or a later one, may miss rows then. So push is for a DataFrame that is scanned once."""

    @classmethod
    def name(cls) -> str:
        return "footprint_granule"

    def _paths(self) -> list[str]:
        return [p for p in self.options["path"].split(",") if p]

    def _whole(self) -> bool:
        return self.options.get("whole", "false") == "true"

    def schema(self) -> StructType:
        full = whole_schema(open_granule(self._paths()[0]), self.options["product"])[0] if self._whole() else SCHEMAS[self.options["product"]]
        full = full if "granule" in full.names else StructType([*full.fields, StructField("granule", StringType())])
        wanted = json.loads(self.options.get("columns", "[]"))
        return StructType([full[c] for c in wanted]) if wanted else full

    def reader(self, schema: StructType) -> GranuleReader:
        made = PushingReader if self.options.get("push", "false") == "true" else GranuleReader
        return made(self._paths(), self.options["product"], schema, self._whole(), int(self.options.get("parts", "1")), int(self.options.get("shots", "65536")), json.loads(self.options.get("where", "[]")))

    def writer(self, schema: StructType, overwrite: bool):
        from .granule_writer import GranuleWriter

        return GranuleWriter(self.options["path"], self.options.get("product", "waveform"), schema, overwrite, self.options.get("form", "npz"), int(self.options.get("file_shots", "200000")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GranuleSource)
