"""The data source `arrays`: daily grids in array files, read by blocks of days and bands of latitude.

    register(spark)
    spark.read.format("arrays").option("path", ...).option("variable", "precipitation").option("product", "test").load()

The format is told by a file's first bytes: the classic format (its 32-bit and 64-bit offset forms) is decoded here, HDF5
files go to netCDF4 where it is installed. Conditions on time, lat and lon are taken at planning: only the days and rows of
the grid that they leave become partitions, of which each task reads its own bytes and returns record batches. Files are
opened through pyarrow's file systems, so they may be on any that it knows; a path may be a list, separated by commas.

Missing values, by `_FillValue` or `missing_value` or as NaN, are NULL; `scale_factor` and `add_offset` are applied.
Cells are numbered from the south and the west.
"""

from __future__ import annotations

import datetime
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import SparkSession

SCHEMA = "product string, time date, lat_i int, lon_i int, lat double, lon double, value double"
#: Cells that a partition has at most, but for a single row of the grid.
CELLS = 4_000_000
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
UNITS = {"days": 86400, "day": 86400, "hours": 3600, "hour": 3600, "minutes": 60, "seconds": 1}


def _open(path: str):
    if re.match("file:/|/", path):
        return LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    if "://" not in path:
        return LocalFileSystem().open_input_file(path)
    files, where = FileSystem.from_uri(path)
    return files.open_input_file(where)


@dataclass
class Variable:
    dims: list[str]
    attributes: dict
    kind: str
    begin: int
    record: bool


@dataclass
class Classic:
    """The header of a classic file."""

    dims: dict[str, int]
    variables: dict[str, Variable]
    records: int
    stride: int = 0
    attributes: dict = field(default_factory=dict)


def header(stream) -> Classic:
    """Read the header, in growing pieces, until it is whole."""
    size, n = stream.size(), 1 << 16
    while True:
        data = stream.read_at(min(n, size), 0)
        try:
            return _parse(data)
        except (struct.error, IndexError):
            if n >= size:
                raise ValueError("the header of an array file is cut off") from None
            n *= 4


def _parse(data: bytes) -> Classic:
    at = 4
    wide = data[3] == 2

    def number(form: str = ">i") -> int:
        nonlocal at
        (out,) = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return out

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise IndexError
        out = data[at : at + n]
        at += n + -n % 4
        return out

    def name() -> str:
        return take(number()).decode()

    def attributes() -> dict:
        number()
        out = {}
        for _ in range(number()):
            key, kind = name(), number()
            count = number()
            raw = take(count * np.dtype(TYPES[kind]).itemsize)
            out[key] = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, TYPES[kind])[:count].astype(float)
        return out

    records = number()
    number()
    dims = [(name(), number()) for _ in range(number())]
    whole = attributes()
    number()
    variables, stride = {}, 0
    for _ in range(number()):
        key = name()
        ids = [number() for _ in range(number())]
        own, kind = attributes(), TYPES[number()]
        length, begin = number(">I"), number(">q" if wide else ">i")
        record = bool(ids) and dims[ids[0]][1] == 0
        stride += length * record
        variables[key] = Variable([dims[k][0] for k in ids], own, kind, begin, record)
    only = [v for v in variables.values() if v.record]
    if len(only) == 1:  # a single record variable isn't padded
        stride = math.prod(dict(dims)[d] for d in only[0].dims[1:]) * np.dtype(only[0].kind).itemsize
    sizes = {k: n or records for k, n in dims}
    return Classic(sizes, variables, records, stride, whole)


def _values(stream, head: Classic, name: str, first: int = 0, last: int | None = None, rows: tuple[int, int] | None = None) -> np.ndarray:
    """Steps [first, last) of a variable along its first dimension, of them only some rows of the second; missing as NaN."""
    v = head.variables[name]
    shape = [head.dims[d] for d in v.dims]
    last = shape[0] if last is None else last
    item, inner = np.dtype(v.kind).itemsize, shape[1:]
    step = math.prod(inner) * item
    a, z = rows or (0, inner[0] if inner else 1)
    row = step // inner[0] if inner else item
    stride = head.stride if v.record else step
    parts = []
    if rows is None and stride == step:
        parts.append(stream.read_at((last - first) * step, v.begin + first * step))
    else:
        for k in range(first, last):
            parts.append(stream.read_at((z - a) * row, v.begin + k * stride + a * row))
    out = np.frombuffer(b"".join(parts), v.kind).astype(float).reshape([last - first, *([z - a, *inner[1:]] if inner else [])])
    return _clean(out, v.attributes)


def _clean(values: np.ndarray, attributes: dict) -> np.ndarray:
    for key in ("_FillValue", "missing_value"):
        if key in attributes:
            values = np.where(values == np.float64(attributes[key][0]), np.nan, values)
    return values * float(np.ravel(attributes.get("scale_factor", 1.0))[0]) + float(np.ravel(attributes.get("add_offset", 0.0))[0])


def _days(values: np.ndarray, units: str) -> list[datetime.date]:
    unit, since = re.match(r"(\w+) since (\d+-\d+-\d+)", units).groups()
    start = datetime.datetime(*map(int, since.split("-")))
    return [(start + datetime.timedelta(seconds=float(v) * UNITS[unit])).date() for v in values]


class ClassicFile:
    def __init__(self, path: str):
        self.stream = _open(path)
        self.head = header(self.stream)

    def axes(self) -> tuple[list[datetime.date], np.ndarray, np.ndarray]:
        clock = _values(self.stream, self.head, "time")
        return _days(clock, self.head.variables["time"].attributes["units"]), _values(self.stream, self.head, "lat"), _values(self.stream, self.head, "lon")

    def block(self, variable: str, first: int, last: int, a: int, z: int) -> np.ndarray:
        return _values(self.stream, self.head, variable, first, last, (a, z))


class Hdf5File:
    def __init__(self, path: str):
        import netCDF4

        self.file = netCDF4.Dataset(re.sub("^file:/+", "/", path))
        self.file.set_auto_maskandscale(True)

    def axes(self):
        v = self.file.variables
        return _days(np.asarray(v["time"][:], float), v["time"].units), np.asarray(v["lat"][:], float), np.asarray(v["lon"][:], float)

    def block(self, variable: str, first: int, last: int, a: int, z: int) -> np.ndarray:
        return np.ma.filled(self.file.variables[variable][first:last, a:z].astype(float), np.nan)


def opened(path: str) -> ClassicFile | Hdf5File:
    """The reader for a file, by its first bytes."""
    with _open(path) as f:
        start = f.read_at(min(8, f.size()), 0)
    if start[:3] == b"CDF" and start[3] in (1, 2):
        return ClassicFile(path)
    if start == b"\x89HDF\r\n\x1a\n":
        return Hdf5File(path)
    raise ValueError(f"{path} is neither a classic nor an HDF5 array file")


def _runs(keep: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(keep.astype(int), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def register(spark: SparkSession) -> None:
    from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

    tests = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.paths = [x.strip() for x in options["path"].split(",")]
            self.variable, self.product, self.cells = options.get("variable", "precipitation"), options.get("product"), int(options.get("cells", CELLS))
            self.filters = []

        def pushFilters(self, filters):
            for f in filters:
                if type(f) in tests and len(f.attribute) == 1 and f.attribute[0] in ("time", "lat", "lon"):
                    self.filters.append((f.attribute[0], type(f), f.value))
                else:
                    yield f

        def kept(self, name, values):
            keep = np.ones(len(values), bool)
            for attribute, kind, value in self.filters:
                if attribute == name:
                    keep &= tests[kind](np.asarray(values), value)
            return keep

        def partitions(self):
            out = []
            for path in self.paths:
                days, lat, lon = opened(path).axes()
                for a, z in _runs(self.kept("lat", lat)):
                    step = max(1, min(z - a, self.cells // max(1, len(lon))))
                    for b in range(a, z, step):
                        rows = (b, min(z, b + step))
                        for first, last in _runs(self.kept("time", np.array(days, dtype=object))):
                            size = max(1, self.cells // ((rows[1] - rows[0]) * max(1, len(lon))))
                            out += [InputPartition((path, k, min(last, k + size), *rows)) for k in range(first, last, size)]
            return out or [InputPartition(None)]

        def read(self, partition) -> Iterator[pa.RecordBatch]:
            if partition.value is None:
                return
            path, first, last, a, z = partition.value
            file = opened(path)
            days, lat, lon = file.axes()
            up, right = np.argsort(np.argsort(lat))[a:z], np.argsort(np.argsort(lon))
            across = self.kept("lon", lon)
            for k in range(first, last):
                values = file.block(self.variable, k, k + 1, a, z)[0][:, across]
                n, m = values.shape
                flat = values.ravel()
                columns = [
                    pa.array([self.product] * (n * m), pa.string()), pa.array([days[k]] * (n * m), pa.date32()), pa.array(np.repeat(up, m), pa.int32()), pa.array(np.tile(right[across], n), pa.int32()),
                    pa.array(np.repeat(lat[a:z], m)), pa.array(np.tile(lon[across], n)), pa.array(flat, pa.float64(), mask=np.isnan(flat)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    class Arrays(DataSource):
        @classmethod
        def name(cls):
            return "arrays"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Arrays)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
