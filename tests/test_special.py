"""Special functions and fits against closed forms and simulated data."""

import numpy as np
import pytest

from hyetos.functions import special as S
from hyetos.operators import correction as C


def test_gamma_cdf_closed_forms():
    x = np.array([0.0, 0.1, 1.0, 5.0, 40.0])
    np.testing.assert_allclose(S.gamma_cdf(x, 1.0), 1 - np.exp(-x), atol=1e-14)
    np.testing.assert_allclose(S.gamma_cdf(x, 2.0), 1 - (1 + x) * np.exp(-x), atol=1e-13)


@pytest.mark.parametrize("shape", [0.2, 0.6, 1.0, 3.5, 40.0])
def test_gamma_quantile_inverts(shape):
    p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.999, 1 - 1e-9])
    np.testing.assert_allclose(S.gamma_cdf(S.gamma_quantile(p, shape, 3.0), shape, 3.0), p, rtol=1e-8, atol=1e-11)


def test_polygamma():
    assert S.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-11)
    assert S.trigamma(np.array([0.5]))[0] == pytest.approx(np.pi**2 / 2, abs=1e-10)


def test_kolmogorov_tail():
    assert S.kolmogorov_tail(0.274, 10) == pytest.approx(1 - 0.6284796154565, abs=1e-9)
    assert S.kolmogorov_tail(0.05, 1999) == pytest.approx(S.kolmogorov_tail(0.05, 2001), rel=0.05)
    assert S.kolmogorov_tail(0.0, 10) == 1 and S.kolmogorov_tail(1.0, 10) == 0


def test_gamma_fit_recovers():
    x = np.random.default_rng(42).gamma(0.6, 4.0, 10_000)
    k, s = C.solve_gamma(np.array([x.mean()]), np.array([np.log(x).mean()]), np.array([len(x)]))
    assert k[0] == pytest.approx(0.6, rel=0.1) and s[0] == pytest.approx(4.0, rel=0.1)
    assert C.solve_gamma(np.array([2.0]), np.array([0.1]), np.array([4])) == (1.0, 1.0)


@pytest.mark.parametrize("shape", [-0.2, 0.0, 0.3])
def test_gpd_fit_recovers(shape):
    p = np.random.default_rng(3).random(20_000)
    x = 2 * -np.log(1 - p) if shape == 0 else 2 / shape * ((1 - p) ** -shape - 1)
    k, s = C.fit_gpd(x)
    assert k == pytest.approx(shape, abs=0.05) and s == pytest.approx(2.0, rel=0.06)
    k, s = C.fit_gpd_folds(x[:500])
    assert abs(k - shape) < 0.25


def test_mapped_values_are_monotone_bounded_and_keep_dry():
    n = 400
    x = np.linspace(1.01, 80, n)
    sat = {"p_dry": np.full(n, 0.5), "shape": np.full(n, 0.8), "scale": np.full(n, 9.0), "limit": np.full(n, 1e9)}
    ref = {k: np.full(n, v) for k, v in {"gamma_shape": 0.7, "gamma_scale": 12.0, "gpd_threshold": 20.0, "gpd_shape": 0.1, "gpd_loc": 0.0, "gpd_scale": 5.0, "upper_cap": 90.0, "p_threshold": 0.8, "p_dry": 0.55}.items()}
    y = C.map_values(x, sat, ref, 1.0, np.full(n, True))
    assert (np.diff(y) >= -1e-9).all() and y.min() >= 0 and y.max() <= 90.0
