"""Station files, gridded tables, boundaries and their sinks."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyetos import __version__
from hyetos.functions.scalar import no_nan
from hyetos.params import Params

GRID = T.StructType([
    T.StructField("product", T.StringType()), T.StructField("time", T.DateType()), T.StructField("lat_i", T.IntegerType()), T.StructField("lon_i", T.IntegerType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("value", T.DoubleType()),
])


def _separator(spark: SparkSession, path: str) -> str:
    line = spark.read.text(path).filter("value <> ''").first()
    if line is None:
        raise ValueError(f"{path} is empty")
    return max(";,\t|", key=line[0].count)


def station_locations(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with any usual separator; Lon and Lat are required, rows without either are dropped."""
    rows = spark.read.csv(path, sep=_separator(spark, path), header=True)
    rows = rows.withColumnsRenamed({c: c.strip().lstrip("﻿") for c in rows.columns})
    lacking = {"Lon", "Lat"} - set(rows.columns)
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(sorted(lacking))}")
    number = {c: F.expr(f"try_cast(`{c}` as {t})") for c, t in (("Lon", "double"), ("Lat", "double"), ("Elevation", "double"), ("ID", "int"), ("ID_WMO", "long")) if c in rows.columns}
    return rows.withColumns(number).na.drop(subset=["Lon", "Lat"])


def station_observations(spark: SparkSession, path: str, locations: DataFrame | None = None, missing: float = 8888.0) -> DataFrame:
    """A wide CSV file (Date as DD-MM-YYYY, a column for each station) as (station_id, date, value).

    ID and day-of-year columns are dropped, whatever the case of their names; `missing` and anything that is no number
    become NULL; with `locations` only their stations stay.
    """
    rows = spark.read.csv(path, sep=_separator(spark, path), header=True)
    rows = rows.withColumnsRenamed({c: c.strip().lstrip("﻿") for c in rows.columns})
    date = next((c for c in rows.columns if c.lower() == "date"), rows.columns[0])
    stations = [c for c in rows.columns if c != date and c.lower() not in ("id", "jd", "julian_day", "doy")]
    out = rows.select(F.expr(f"try_to_date(`{date}`, 'dd-MM-yyyy')").alias("date"), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in stations])
    out = out.unpivot("date", stations, "station_id", "value").select(F.expr("try_cast(station_id as long)").alias("station_id"), "date", F.nullif(no_nan("value"), F.lit(missing)).alias("value"))
    return out if locations is None else out.join(locations.select(F.col("ID_WMO").alias("station_id")), "station_id", "left_semi")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A cell table as Parquet; NaN becomes NULL."""
    rows = spark.read.parquet(path)
    lacking = {f.name for f in GRID} - {"product"} - set(rows.columns)
    if lacking:
        raise ValueError(f"{path} lacks {', '.join(sorted(lacking))}; it has {', '.join(rows.columns)}")
    return rows.withColumn("value", no_nan("value"))


def write_corrected(rows: DataFrame, path: str, mask: DataFrame | None = None, policy: str = "overwrite", **attributes: str) -> None:
    """A corrected field by method, month and dekad, in single precision, with provenance beside it.

    `policy`: overwrite (only the partitions written), skip (nothing if the path exists) or abort.
    """
    if mask is not None:
        from hyetos.operators.align import mask_keep

        rows = mask_keep(rows, mask)
    mode = {"overwrite": "overwrite", "skip": "ignore", "abort": "errorifexists"}[policy]
    rows.withColumn("value", F.col("value").cast("float")).repartition("method", "month", "dekad").sortWithinPartitions("lat_i", "lon_i", "time").write.mode(mode).option(
        "partitionOverwriteMode", "dynamic").partitionBy("method", "month", "dekad").parquet(f"{path}/cells")
    provenance(rows.sparkSession, **attributes).write.mode("append").parquet(f"{path}/provenance")


def read_corrected(spark: SparkSession, path: str, method: str, month: int | None = None, dekad: int | None = None) -> DataFrame:
    """Only the partitions asked for are read; none is an empty table."""
    rows = spark.read.parquet(f"{path}/cells").filter(F.col("method") == method)
    for name, value in (("month", month), ("dekad", dekad)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def provenance(spark: SparkSession, **attributes: str) -> DataFrame:
    row = {"written_at": datetime.datetime.now(datetime.UTC).isoformat(), "spark_version": spark.version} | {k: str(v) for k, v in attributes.items()}
    return spark.createDataFrame([(k, v) for k, v in row.items()], "name string, value string")


def described(params: Params, reference: str, test: str) -> dict[str, str]:
    """What a corrected field was made of: names of both sides, every parameter, and the version of this package."""
    return {"reference": reference, "test": test, "package_version": __version__} | {k: str(v) for k, v in asdict(params).items()}


def write_metrics(rows: DataFrame, path: str, keys: Sequence[str], units: dict[str, str] | None = None) -> None:
    """Metrics or quality as single precision, with a comment on each column; partitioned by `keys`."""
    out = rows.select(*[F.col(c).cast("float").alias(c, metadata={"comment": (units or {}).get(c, "")}) if t == "double" else F.col(c) for c, t in rows.dtypes])
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_station_csv(rows: DataFrame, path: str, first: Sequence[str] = ()) -> None:
    """Six decimals; the `first` columns before the others."""
    order = [*first, *[c for c in rows.columns if c not in first]]
    out = rows.select(*[F.format_string("%.6f", c).alias(c) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c) for c in order])
    out.write.mode("overwrite").csv(path, header=True)


def to_json_rows(rows: DataFrame, digits: int = 4) -> DataFrame:
    """One JSON document a row, numbers rounded, missing ones as null."""
    cells = [F.round(no_nan(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))


FEATURES = "struct<features:array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"


def features(texts: DataFrame, column: str = "value") -> DataFrame:
    """GeoJSON documents as (properties, kind, rings): a row for each polygon, multipolygons taken apart."""
    one = texts.select(F.explode(F.from_json(column, FEATURES)["features"]).alias("f")).select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    rings = "array<array<array<double>>>"
    many = one.filter("kind = 'MultiPolygon'").select("properties", "kind", F.explode(F.from_json("c", f"array<{rings}>")).alias("rings"))
    return one.filter("kind = 'Polygon'").select("properties", "kind", F.from_json("c", rings).alias("rings")).unionByName(many)
