"""Scalar expressions that keep missing values missing. NaN never enters a table: it is turned to NULL on reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def div(a, b) -> Column:
    """a / b; NULL if b is 0."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def div0(a, b) -> Column:
    """a / b; 0 if b is 0."""
    return F.when(c(b) == 0, 0.0).otherwise(div(a, b))


def lower(a, b) -> Column:
    """The smaller of two; NULL if one is."""
    return F.when(c(a).isNotNull() & c(b).isNotNull(), F.least(c(a), c(b)))


def upper(a, b) -> Column:
    return F.when(c(a).isNotNull() & c(b).isNotNull(), F.greatest(c(a), c(b)))


def clip(x, a: float, b: float) -> Column:
    return lower(upper(x, F.lit(float(a))), F.lit(float(b)))


def no_nan(x) -> Column:
    return F.when(~F.isnan(c(x)), c(x))


def r6(x) -> Column:
    """Rounded to six decimals, without a negative zero. Millionths are rounded as they are in binary, as DuckDB does: half up of the
    shortest decimals would take 1.2704374999999999, whose millionths are 1270437.5, down."""
    return F.round(c(x) * 1e6, 0) / 1e6 + F.lit(0.0)


def dekad(day) -> Column:
    """1 for days 1-10, 2 for 11-20, 3 for the rest of the month."""
    return F.least(F.ceil(F.dayofmonth(c(day)) / 10), F.lit(3)).cast("int")


def dekad_columns(day: str = "time") -> dict[str, Column]:
    return {"year": F.year(day), "month": F.month(day), "dekad": dekad(day)}


def dekad_start(number) -> Column:
    """01, 11 or 21."""
    return F.lpad(((c(number) - 1) * 10 + 1).cast("string"), 2, "0")


def dekad_range(month: int, number: int) -> tuple[int, int]:
    """First and last day; the last is 31 for the third, which no month exceeds."""
    if not 1 <= month <= 12 or number not in (1, 2, 3):
        raise ValueError(f"no dekad {number} in month {month}")
    return (number - 1) * 10 + 1, (10, 20, 31)[number - 1]


def wrap_longitude(x) -> Column:
    """To [-180, 180)."""
    shifted = c(x) + 180.0
    return shifted - F.floor(shifted / 360.0) * 360.0 - 180.0


def year_bounds(year, start, end) -> tuple[Column, Column]:
    """First and last day of the year within [start, end]."""
    return F.greatest(F.make_date(c(year), F.lit(1), F.lit(1)), c(start)), F.least(F.make_date(c(year), F.lit(12), F.lit(31)), c(end))


def gpd_quantile(p, shape, scale, loc=0.0) -> Column:
    """The generalised Pareto distribution's quantile."""
    p, shape, scale, loc = c(p), c(shape), c(scale), c(loc)
    return loc + F.when(shape == 0, -scale * F.log(1 - p)).otherwise(div(scale, shape) * (F.pow(1 - p, -shape) - 1))


def effective_alpha(confidence, alpha) -> Column:
    """1 where there is no confidence, alpha where it is full."""
    return 1 - c(confidence) * (1 - c(alpha))


def closeness(test, ref) -> Column:
    """1 for equal values, 0 when they differ by as much as the reference or more."""
    return 1 - lower(div(F.abs(c(test) - c(ref)), c(ref) + 0.1), F.lit(1.0))


def correlation(n, s_a, s_b, s_aa, s_bb, s_ab) -> Column:
    """r from six sums; NULL without variance, clipped to [-1, 1]."""
    va, vb = c(s_aa) - div(c(s_a) * c(s_a), n), c(s_bb) - div(c(s_b) * c(s_b), n)
    return F.when((va > 0) & (vb > 0), clip(div(c(s_ab) - div(c(s_a) * c(s_b), n), F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))), -1, 1))
