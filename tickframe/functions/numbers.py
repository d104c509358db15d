"""Rounding and means that give the same answer on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, half-even; null when ``whole`` is 0."""
    return F.bround(F.try_divide(F.lit(100.0) * part, whole), digits)


def ratio_pct_or_zero(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.coalesce(ratio_pct(part, whole, digits), F.lit(0.0))


def fixed_sum(c, scale: int = 10_000) -> Column:
    """Sum in whole units of 1/scale.

    Sums of doubles depend on the order in which shuffled partials arrive, which
    is enough to flip a rounded figure between two runs. Whole units add exactly.
    """
    return F.sum(F.round(as_col(c) * F.lit(float(scale))).cast("long"))


def mean_of(total: Column, n: Column, scale: int = 10_000) -> Column:
    return F.try_divide(total.cast("double"), n.cast("double") * F.lit(float(scale)))


def fixed_avg(c, scale: int = 10_000) -> Column:
    """Order-independent mean; null over no rows."""
    return mean_of(fixed_sum(c, scale), F.count(as_col(c)), scale)


# Durations are whole seconds, so hours add exactly in units of 1/3600.
HOURS = 3600


def hours_avg(c="mttr_hours", where: Column | None = None) -> Column:
    c = as_col(c)
    return fixed_avg(F.when(where, c) if where is not None else c, HOURS)


def clean_nan(c) -> Column:
    """NaN and the infinities become null, as on every output of the dashboards."""
    c = as_col(c)
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~bad, c)


def clean_nan_zero(c, digits: int = 1) -> Column:
    """The SLA views' variant: bad values become 0, good ones are rounded."""
    return F.coalesce(F.bround(clean_nan(c), digits), F.lit(0.0))
