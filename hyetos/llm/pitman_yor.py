"""Numeric parts of the hierarchical Pitman-Yor model: seating in Chinese restaurants."""

from __future__ import annotations

import math

import numpy as np

#: Up to so many customers of a dish the number of tables is drawn from a table of its distribution; above, by Metropolis-Hastings.
EXACT = 64
#: When so few customers didn't open a table, a power series gives the Stirling number, else an integral.
NEAR = 24


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(customers, tables), by their recursion."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, t - 1], out[c, t] + np.log(np.maximum(c - discount * t, 1e-300)))
    return out


#: Stirling's series from 9 up; below, products.
def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    up = np.where(x < 9, x + 9, x)
    series = (up - 0.5) * np.log(up) - up + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * up * up)) / (up * up)) / (up * up)) / up
    less = sum(np.log(x + k) for k in range(9))
    return np.where(x < 9, series - less, series)


def _near(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log of the coefficient of z^(c-t) in (f(z) / z / discount)^t, f = 1 - (1-z)^discount, for few c - t."""
    k = int((c - t).max(initial=0))
    a = np.ones(k + 1)
    for j in range(1, k + 1):
        a[j] = a[j - 1] * (j - discount) / (j + 1)
    b = np.zeros((k + 1, len(c)))
    b[0] = 1.0
    for m in range(1, k + 1):
        b[m] = sum((t * j - (m - j)) * a[j] * b[m - j] for j in range(1, m + 1)) / m
    return np.log(b[c - t, np.arange(len(c))])


def _far(c: np.ndarray, t: np.ndarray, discount: float, points: int = 41) -> np.ndarray:
    """The same where c - t is large: Cauchy's integral over a parabola through the saddle point of v = -log(1-z)."""
    low, high = np.full(len(c), -30.0), np.full(len(c), math.log(60 / (1 - discount)))
    for _ in range(60):
        v = np.exp((low + high) / 2)
        past = t * discount / np.expm1(np.minimum(discount * v, 700)) > c / np.expm1(np.minimum(v, 700))
        low, high = np.where(past, low, (low + high) / 2), np.where(past, (low + high) / 2, high)
    v = np.minimum(np.exp((low + high) / 2), np.log(c))
    e, ed = np.expm1(v), np.expm1(discount * v)
    bend = c * (1 + 1 / e) / e - t * discount**2 * (1 + 1 / ed) / ed
    width = np.minimum(3.5, 14 / np.sqrt(np.maximum(bend, 1e-300)))
    y = np.linspace(0, 1, points)[:, None] * width
    s = v - 0.4 * y * y + 1j * y
    phi = t * np.log1p(-np.exp(-discount * s)) - c * np.log1p(-np.exp(-s))
    top = phi[0].real
    part = (np.exp(phi - top) * (1 + 0.8j * y) / np.expm1(s)).real
    total = (part.sum(axis=0) - 0.5 * (part[0] + part[-1])) * width / (points - 1) / math.pi
    return top + np.log(np.maximum(total, 1e-300)) - t * math.log(discount)


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) for any numbers of customers and tables, from the generating function of S."""
    out = np.zeros(len(c))
    for few, form in ((True, _near), (False, _far)):
        at = np.flatnonzero((c - t < NEAR) == few)
        if len(at):
            out[at] = form(c[at], t[at], discount)
    return out + log_gamma(c + 1.0) - log_gamma(t + 1.0)


def _weight(c: np.ndarray, t: np.ndarray, share: np.ndarray, others: np.ndarray, strength: float, discount: float) -> np.ndarray:
    """log of what the probability of t tables is proportional to."""
    more = strength / discount + others
    return log_stirling(c, t, discount) + t * np.log(share * discount) + log_gamma(more + t) - log_gamma(more)


def _proposal(c: np.ndarray, share: np.ndarray, others: np.ndarray, strength: float, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scale of a logistic distribution near that of the tables, by the saddle point."""
    more = strength + discount * others

    def tables(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At the saddle point q: the tables, and the log of how much likelier one table more is."""
        r, f = -np.expm1(-q), -np.expm1(-discount * q)
        t = c * f / (r * discount * np.exp((1 - discount) * q))
        return t, np.log(f * share * (more + discount * t) / (discount * (t + 0.5)))

    low, high = np.full(len(c), -9.0), np.full(len(c), math.log(60.0))
    for _ in range(40):
        q = np.exp((low + high) / 2)
        less = tables(q)[1] < 0  # too many tables yet; they fall with q
        low, high = np.where(less, (low + high) / 2, low), np.where(less, high, (low + high) / 2)
    (t, g), (t2, g2) = tables(q), tables(q * 1.001)
    spread = np.sqrt(np.clip(-(t2 - t) / np.where(g2 == g, -1, g2 - g), 0, c * c))
    return np.clip(t, 1, c), np.maximum(0.4, 0.65 * spread)


def _metropolis(now: np.ndarray, c: np.ndarray, share: np.ndarray, others: np.ndarray, strength: float, discount: float, rng: np.random.Generator, steps: int) -> np.ndarray:
    centre, scale = _proposal(c, share, others, strength, discount)
    sigmoid = lambda x: 1 / (1 + np.exp(np.minimum(x, 700)))

    def log_q(t: np.ndarray) -> np.ndarray:
        off = np.abs(t - centre)
        return np.log(np.maximum(sigmoid((off - 0.5) / scale) - sigmoid((off + 0.5) / scale), 1e-300))

    weigh = lambda t: _weight(c, t, share, others, strength, discount) - log_q(t)
    old = weigh(now)
    for _ in range(steps):
        u = np.clip(rng.random(len(c)), 1e-12, 1 - 1e-12)
        new = np.clip(np.rint(centre + scale * np.log(u / (1 - u))), 0, c + 1).astype(np.int64)
        inside = (new >= 1) & (new <= c)
        new = np.where(inside, new, now)
        value = weigh(new)
        take = inside & (np.log(rng.random(len(c))) < value - old)
        now, old = np.where(take, new, now), np.where(take, value, old)
    return now


def draw_tables(
    customers: np.ndarray, share: np.ndarray, others: np.ndarray, strength: float, discount: float, rng: np.random.Generator, table: np.ndarray, now: np.ndarray | None = None,
) -> np.ndarray:
    """A Gibbs draw of every dish's tables, given its customers, its parent's probability and the other tables of its restaurant.

    The probability of t tables is proportional to S(c, t) share^t prod_{i<t} (strength + discount (others + i)). Up to
    EXACT customers it is tabulated. Above, a Metropolis-Hastings step from `now` (without it, from the mode, four
    steps) leaves exactly this distribution unchanged: the logistic proposal is only near it, and is corrected for.
    """
    tables = np.ones(len(customers), np.int64)
    order = np.argsort(customers, kind="stable")
    edge = lambda c: np.searchsorted(customers, c, sorter=order)
    at = order[edge(2) : edge(3)]  # the commonest by far
    odds = (strength + discount * (others[at] + 1)) * share[at] / (1 - discount)
    tables[at] = 1 + (rng.random(len(at)) * (1 + odds) < odds)
    # How much likelier t tables are than t - 1, but for what depends on the parent and the other tables.
    steps = np.zeros_like(table)
    with np.errstate(invalid="ignore"):
        steps[:, 2:] = np.exp(np.nan_to_num(table[:, 2:] - table[:, 1:-1], nan=-np.inf))
    low = 3
    while low <= EXACT:
        high = min(EXACT, 1 << (low - 1).bit_length())
        mine, t = order[edge(low) : edge(high + 1)], np.arange(1, high + 1)
        for at in np.array_split(mine, len(mine) * high // 1_000_000 + 1):
            w = steps[customers[at], 1 : high + 1]
            w[:, 0] = 1.0
            w[:, 1:] *= share[at][:, None] * (strength + discount * (others[at][:, None] + t[1:] - 1))
            with np.errstate(over="ignore", invalid="ignore"):
                p = np.cumsum(np.cumprod(w, axis=1), axis=1)
            tables[at] = 1 + (p < (rng.random(len(at)) * p[:, -1])[:, None]).sum(axis=1)
            bad = np.flatnonzero(~np.isfinite(p[:, -1]))
            if len(bad):  # too large as products: the same from logarithms
                z = np.cumsum(np.log(np.maximum(w[bad], 1e-300)), axis=1)
                p = np.cumsum(np.exp(z - z.max(axis=1, keepdims=True)), axis=1)
                tables[at[bad]] = 1 + (p < (rng.random(len(bad)) * p[:, -1])[:, None]).sum(axis=1)
        low = high + 1
    mine = order[edge(EXACT + 1) :]
    for at in np.array_split(mine, len(mine) // 20_000 + 1):
        if len(at):
            given = customers[at], share[at], others[at], strength, discount
            start = np.rint(_proposal(*given)[0]).astype(np.int64) if now is None else now[at]
            tables[at] = _metropolis(start, *given, rng, 4 if now is None else 1)
    return tables


def discount_of(once: float, twice: float) -> float:
    """The discount that fits how many dishes have one customer and two."""
    return float(np.clip(once / max(1.0, once + 2 * twice), 0.05, 0.95))
