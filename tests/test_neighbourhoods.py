"""The 3 x 3 cells around each cell: a row is shuffled once."""

import random

import pytest

from hyetos.operators import correction


@pytest.mark.parametrize("side", [2, 3, 512])
def test_neighbourhoods_against_plain(spark, side):
    rng = random.Random(1)
    cells = [(d, i, j, rng.choice([None, float(rng.randrange(9)), float(rng.randrange(9))]), f"{d}{i}{j}") for d in ("x", "y") for i in range(-2, 7) for j in range(5) if rng.random() < 0.6]
    cells.append(("z", 100, 100, None, "alone"))
    rows = spark.createDataFrame(cells, "time string, lat_i int, lon_i int, value double, tag string")
    made = correction.neighbourhoods(rows, side)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    at = {(d, i, j): v for d, i, j, v, _ in cells}
    got = {r.tag: [r[f"_x{k}"] for k in range(9)] for r in made.collect()}
    assert len(got) == len(cells)
    for d, i, j, _, tag in cells:
        near = [at.get((d, i + a, j + b)) for a, b in correction.STEPS]
        assert got[tag] == ([None] * 9 if all(v is None for v in near) else [v or 0.0 for v in near])
