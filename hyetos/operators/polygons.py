"""Polygons on a regular grid: simplification, and all cells that they touch.

Cells come from edges, row by row of the grid: where an edge runs in a row gives the cells that it touches, where it
crosses the middle of a row gives the ends of the runs inside. All of it is arithmetic on columns; a row of a polygon is a
group, so a country of millions of cells is the work of many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<array<double>>>"


def _cells(low: Column, high: Column, resolution: float) -> Column:
    """Numbers of cells around [low, high], one more on either side, to be held against the exact ends."""
    return F.sequence((F.floor(low / resolution) - 1).cast("int"), (F.floor(high / resolution) + 1).cast("int"))


def rasterize(polygons: DataFrame, resolution: float = 0.1) -> DataFrame:
    """(lat_i, lon_i) of all cells that a polygon touches, its border and corners of cells included, or whose centre it holds.

    `polygons` has rings of closed lines of (x, y); a second ring within the first is a hole. Cell k spans [k, k + 1] times
    the resolution.
    """
    r = resolution
    pairs = F.transform(F.filter("rings", lambda ring: F.size(ring) >= 2), lambda ring: F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(
        a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))))
    numbered = polygons.select("rings").withColumn("id", F.monotonically_increasing_id())
    edges = numbered.select("id", F.explode(F.flatten(pairs)).alias("e")).select("id", "e.*")
    x1, y1, x2, y2, i = (F.col(c) for c in ("x1", "y1", "x2", "y2", "lat_i"))
    rows = edges.withColumn("lat_i", F.explode(_cells(F.least(y1, y2), F.greatest(y1, y2), r))).filter((F.greatest(y1, y2) >= i * r) & (F.least(y1, y2) <= (i + 1) * r))
    # The part of an edge within its row.
    at = lambda y: F.when(y2 != y1, (y - y1) / (y2 - y1))
    a, b = at(i * r), at((i + 1) * r)
    low, high = F.coalesce(F.greatest(F.lit(0.0), F.least(a, b)), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), F.greatest(a, b)), F.lit(1.0))
    ends = rows.select("lat_i", (x1 + low * (x2 - x1)).alias("p"), (x1 + high * (x2 - x1)).alias("q")).select("lat_i", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    j = F.col("lon_i")
    touched = ends.withColumn("lon_i", F.explode(_cells(F.col("p"), F.col("q"), r))).filter((F.col("q") >= j * r) & (F.col("p") <= (j + 1) * r)).select("lat_i", "lon_i")
    # Runs between crossings of the middle of a row, the first of each pair included.
    middle = i * r + r / 2
    crossings = rows.filter((y1 > middle) != (y2 > middle)).select("id", "lat_i", ((x2 - x1) * (middle - y1) / (y2 - y1) + x1).alias("x"))
    sorted_ = crossings.groupBy("id", "lat_i").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    runs = sorted_.select("lat_i", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.get("xs", 2 * k).alias("p"), F.get("xs", 2 * k + 1).alias("q")))).alias("run")).select("lat_i", "run.*")
    centre = j * r + r / 2
    inside = runs.withColumn("lon_i", F.explode(_cells(F.col("p"), F.col("q"), r))).filter((centre >= F.col("p")) & (centre < F.col("q"))).select("lat_i", "lon_i")
    return touched.unionByName(inside).distinct()


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """The line without points that lie within the tolerance: it is split at its farthest point again and again."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    parts = [(0, len(line) - 1)]
    while parts:
        a, b = parts.pop()
        if b - a < 2:
            continue
        way, off = line[b] - line[a], line[a + 1 : b] - line[a]
        length = way @ way
        along = np.clip(off @ way / length, 0, 1) if length > 0 else np.zeros(len(off))
        far = np.hypot(*(off - along[:, None] * way).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            parts += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def simplify(polygons: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """`polygons` with simplified rings; holes that collapse go, and a polygon whose outer ring would collapse stays as it was."""

    @F.pandas_udf(RINGS)
    def made(rings: pd.Series) -> pd.Series:
        out = []
        for shape in rings:
            lines = [simplified(np.array([list(p) for p in ring], float), tolerance) for ring in shape]
            large = [len(x) >= 4 and abs(np.sum(x[:-1, 0] * x[1:, 1] - x[1:, 0] * x[:-1, 1])) > 0 for x in lines]
            out.append([x.tolist() for x, ok in zip(lines, large, strict=True) if ok] if large and large[0] else [[list(p) for p in ring] for ring in shape])
        return pd.Series(out)

    return polygons.withColumn("rings", made("rings"))
