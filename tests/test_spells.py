"""Dry spells with one sort for both sides."""

import itertools
import random

from hyetos.operators import metrics


def test_dry_spells_against_plain_with_one_sort(spark):
    rng = random.Random(4)
    rows = [(k, t, rng.choice([None, 0.0, 0.5, 2.0]), rng.choice([0.0, 0.0, 3.0])) for k in range(6) for t in rng.sample(range(100), 5 * k + 1)] + [(9, t, 5.0, 0.0) for t in range(4)]
    made = metrics.dry_spells(spark.createDataFrame(rows, "k int, time int, ref double, test double"), ["k"], 1.0)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1
    longest = lambda xs: float(max((len(list(g)) for dry, g in itertools.groupby(xs, lambda x: x < 1) if dry), default=0))
    for r in made.collect():
        both = sorted((t, a, b) for k, t, a, b in rows if k == r.k and a is not None)
        want = (None, None) if len(both) < 2 else (longest([a for _, a, _ in both]), longest([b for _, _, b in both]))
        assert (r.dsl_ref, r.dsl_test) == want
