"""Cells of polygons against a test of each cell, and simplification."""

import numpy as np
import pytest

from hyetos.operators import polygons

SHAPE = "rings array<array<array<double>>>"


def touches(ring, box):
    """Whether an edge of a closed ring meets a box, by clipping each edge (west, south, east, north)."""
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
        low, high = 0.0, 1.0
        for a, d, lo, hi in ((x1, x2 - x1, box[0], box[2]), (y1, y2 - y1, box[1], box[3])):
            if d == 0:
                if not lo <= a <= hi:
                    high = -1.0
            else:
                t = sorted(((lo - a) / d, (hi - a) / d))
                low, high = max(low, t[0]), min(high, t[1])
        if low <= high:
            return True
    return False


def within(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def cells(shapes, r):
    out = set()
    for rings in shapes:
        xs, ys = zip(*[p for ring in rings for p in ring], strict=True)
        for i in range(int(min(ys) // r) - 1, int(max(ys) // r) + 2):
            for j in range(int(min(xs) // r) - 1, int(max(xs) // r) + 2):
                if any(touches(ring, (j * r, i * r, (j + 1) * r, (i + 1) * r)) for ring in rings) or within(rings, j * r + r / 2, i * r + r / 2):
                    out.add((i, j))
    return out


def star(rng, x, y, size, n):
    at = np.sort(rng.random(n)) * 2 * np.pi
    far = size * (0.3 + rng.random(n))
    points = np.stack([x + far * np.cos(at), y + far * np.sin(at)], axis=1).tolist()
    return [*points, points[0]]


@pytest.mark.parametrize("r", [0.5, 0.1])
def test_cells_are_those_of_a_test_of_each(spark, r):
    rng = np.random.default_rng(3)
    shapes = [[star(rng, *rng.normal(0, 3, 2), 1.5, 9)] for _ in range(12)]
    shapes.append([[[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0], [0.0, 0.0]], [[1.2, 1.2], [2.9, 1.2], [2.9, 2.1], [1.2, 2.1], [1.2, 1.2]]])  # a hole
    shapes.append([[[9.03, 9.03], [9.04, 9.03], [9.04, 9.04], [9.03, 9.03]]])  # within one cell
    shapes.append([[[-5.2, 6.0], [-4.1, 6.3], [-5.2, 6.0]]])  # a line there and back
    table = spark.createDataFrame([(s,) for s in shapes], SHAPE)
    got = {(c.lat_i, c.lon_i) for c in polygons.rasterize(table, r).collect()}
    assert got == cells(shapes, r)
    plan = polygons.rasterize(table, r)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_country_is_many_rows(spark):
    big = [[[0.0, 0.0], [100.0, 0.0], [100.0, 100.0], [0.0, 100.0], [0.0, 0.0]]]
    assert polygons.rasterize(spark.createDataFrame([(big,), (big,)], SHAPE), 0.125).count() == 802 * 802
    assert polygons.rasterize(spark.createDataFrame([([[]],), ([],)], SHAPE), 0.1).count() == 0


def test_simplification_keeps_to_the_tolerance_and_rescues_islands(spark):
    rng = np.random.default_rng(8)
    at = np.linspace(0, 2 * np.pi, 400)
    coast = (np.stack([10 * np.cos(at), 10 * np.sin(at)], axis=1) + rng.normal(0, 0.004, (400, 2))).tolist()
    coast[-1] = coast[0]
    island = [[20.0, 0.0], [20.005, 0.0], [20.005, 0.004], [20.0, 0.0]]
    hole = [[1.0, 1.0], [1.004, 1.0], [1.004, 1.004], [1.0, 1.0]]
    lake = [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [3.0, 4.001], [2.0, 4.0], [2.0, 2.0]]
    got = [r.rings for r in polygons.simplify(spark.createDataFrame([([coast, hole, lake],), ([island],)], SHAPE), 0.02).collect()]
    outer = np.array(got[0][0])
    assert len(got[0]) == 2 and 20 < len(outer) < 200 and got[1] == [island]
    assert got[0][1] == [p for p in lake if p[1] != 4.001]
    for p in np.array(coast):  # no point is farther from the new line than the tolerance
        a, d = outer[:-1], np.diff(outer, axis=0)
        t = np.clip(((p - a) * d).sum(1) / (d * d).sum(1), 0, 1)
        assert np.hypot(*(a + t[:, None] * d - p).T).min() <= 0.02 + 1e-12
