"""The array source: a classic file written here, read whole and in parts."""

import datetime
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyetos.sources import arrays

LAT, LON = np.array([1.5, 0.5, -0.5, -1.5]), np.array([100.0, 100.5, 101.0, 101.5, 102.0])
START = datetime.date(2001, 1, 1)


def classic(path, values, version=1, record=True, scaled=False, extra=False):
    """A file of the classic format with time, lat, lon and precipitation; days are hours since its start."""
    days = len(values)
    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    attr = lambda name, kind, data, n: text(name) + struct.pack(">ii", kind, n) + data + b"\0" * (-len(data) % 4)
    units = "hours since 2001-01-01 00:00:00"
    fill = struct.pack(">h", -999) if scaled else struct.pack(">f", -9999.0)
    own = [attr("_FillValue", 3 if scaled else 5, fill, 1)]
    if scaled:
        own += [attr("scale_factor", 6, struct.pack(">d", 0.1), 1), attr("add_offset", 6, struct.pack(">d", 5.0), 1)]
    pack = lambda a: np.where(np.isnan(a), -999, np.round((a - 5) / 0.1)).astype(">i2").tobytes() if scaled else np.where(np.isnan(a), -9999.0, a).astype(">f4").tobytes()
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    variables = [("lat", [1], [], 6, LAT.astype(">f8").tobytes(), False), ("lon", [2], [], 6, LON.astype(">f8").tobytes(), False)]
    clock = [struct.pack(">d", 24.0 * k) for k in range(days)]
    field = [pad(pack(values[k])) for k in range(days)]
    variables.append(("time", [0], [attr("units", 2, units.encode(), len(units))], 6, clock, record))
    variables.append(("precipitation", [0, 1, 2], own, 3 if scaled else 5, field, record))
    if extra:
        variables.append(("note", [0], [], 3, [pad(struct.pack(">h", k)) for k in range(days)], record))
    offset = ">q" if version == 2 else ">i"

    def head(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", days if record else 0)
        out += struct.pack(">ii", 10, 3) + text("time") + struct.pack(">i", 0 if record else days) + text("lat") + struct.pack(">i", len(LAT)) + text("lon") + struct.pack(">i", len(LON))
        out += struct.pack(">ii", 12, 1) + attr("title", 2, b"rain", 4) + struct.pack(">ii", 11, len(variables))
        for (name, dims, attributes, kind, data, _), begin in zip(variables, begins, strict=True):
            size = len(data[0]) if isinstance(data, list) and record else sum(map(len, data)) if isinstance(data, list) else len(data)
            out += text(name) + struct.pack(">i", len(dims)) + b"".join(struct.pack(">i", d) for d in dims)
            out += (struct.pack(">ii", 12, len(attributes)) if attributes else struct.pack(">ii", 0, 0)) + b"".join(attributes) + struct.pack(">i", kind) + struct.pack(">I", size) + struct.pack(offset, begin)
        return out

    at, begins, body = len(head([0] * len(variables))), [], b""
    for *_, data, is_record in variables:
        begins.append(at + len(body))
        if not is_record:
            body += data if isinstance(data, bytes) else b"".join(data)
        else:
            begins[-1] = None
    start = at + len(body)
    for k, (*_, data, is_record) in enumerate(variables):
        if is_record:
            begins[k] = start
            start += len(data[0])
    records = b"".join(b"".join(data[k] for *_, data, is_record in variables if is_record) for k in range(days))
    with open(path, "wb") as f:
        f.write(head(begins) + body + records)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(2)
    out = np.round(rng.gamma(0.7, 9, (6, 4, 5)), 1)
    out[rng.random(out.shape) < 0.2] = np.nan
    return out


def want(values, product="p"):
    return [
        (product, START + datetime.timedelta(days=k), 3 - i, j, LAT[i], LON[j], None if np.isnan(values[k, i, j]) else pytest.approx(values[k, i, j], abs=1e-5))
        for k in range(values.shape[0]) for i in range(4) for j in range(5)
    ]


def same(rows, wanted):
    key = lambda r: (r[1], r[2], r[3])
    assert [tuple(r) for r in sorted(rows, key=key)] == sorted(wanted, key=key)


@pytest.mark.parametrize(("version", "record", "scaled", "extra"), [(1, True, False, False), (2, True, True, True), (1, False, False, True)])
def test_whole_files(spark, tmp_path, values, version, record, scaled, extra):
    arrays.register(spark)
    path = f"{tmp_path}/x.nc"
    classic(path, values, version, record, scaled, extra)
    for cells in ("4000000", "7"):
        same(spark.read.format("arrays").option("path", path).option("product", "p").option("cells", cells).load().collect(), want(values))


def test_filters_read_only_their_part(spark, tmp_path, values):
    arrays.register(spark)
    path = f"{tmp_path}/y.nc"
    classic(path, values)
    table = spark.read.format("arrays").option("path", f"file://{path}").option("product", "p").option("cells", "5").load()
    assert table.rdd.getNumPartitions() == 24  # six days, four rows
    some = table.filter((F.col("time") >= datetime.date(2001, 1, 3)) & (F.col("time") < datetime.date(2001, 1, 5)) & (F.col("lat") > 0) & (F.col("lon") <= 101.0) & (F.col("value") > 1))
    assert some.rdd.getNumPartitions() == 4
    same(some.collect(), [r for r in want(values) if START + datetime.timedelta(days=2) <= r[1] < START + datetime.timedelta(days=4) and r[4] > 0 and r[5] <= 101 and r[6] is not None and r[6].expected > 1])
    # Days that no condition leaves aren't touched: of this file the last four are cut off.
    classic(path, values, record=False)
    data = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(data[: len(data) - 4 * 4 * 5 * 4])
    same(table.filter(F.col("time") <= datetime.date(2001, 1, 2)).collect(), [r for r in want(values) if r[1] <= datetime.date(2001, 1, 2)])
    assert table.filter(F.col("time") > datetime.date(2020, 1, 1)).count() == 0


def test_equal_to_the_parquet_table(spark, tmp_path, values):
    arrays.register(spark)
    paths = [f"{tmp_path}/{k}.nc" for k in range(2)]
    for p in paths:
        classic(p, values)
    table = spark.read.format("arrays").option("path", ",".join(paths)).option("product", "p").load()
    table.write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert stored.count() == 240 and stored.exceptAll(table).count() == 0 and table.exceptAll(stored).count() == 0


def test_other_files(spark, tmp_path):
    (tmp_path / "z.nc").write_bytes(b"not an array file")
    with pytest.raises(ValueError, match="neither"):
        arrays.opened(str(tmp_path / "z.nc"))
    (tmp_path / "w.nc").write_bytes(b"CDF\x01" + b"\0" * 3)
    with pytest.raises(ValueError, match="cut off"):
        arrays.opened(str(tmp_path / "w.nc"))
