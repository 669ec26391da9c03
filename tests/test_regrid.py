"""Bilinear regridding shuffles values by target row, not by target cell."""

import re

from hyetos.operators import align


def test_values_are_shuffled_before_longitudes_are_spread(spark):
    cells = spark.createDataFrame([(t, float(i), float(j), t + 10.0 * i + j) for t in range(2) for i in range(3) for j in range(4)], "time int, lat double, lon double, value double")
    targets = [(k, k / 4) for k in range(16)]
    maps = [align.brackets(align.axis(cells, x), spark.createDataFrame(targets, "i int, x double")) for x in ("lat", "lon")]
    made = align.regrid_bilinear(cells, *maps, ["value"], ["time"])
    assert not re.search(r"hashpartitioning\([^)]*_lon", made._jdf.queryExecution().executedPlan().toString())
    got = {(r.time, r.lat, r.lon): r.value for r in made.collect()}
    inside = lambda x, top: x <= top
    for t in range(2):
        for _, y in targets:
            for _, x in targets:
                if inside(y, 2) and inside(x, 3) and y % 1 and x % 1:
                    assert abs(got[t, y, x] - (t + 10 * y + x)) < 1e-9
