"""Forecast error metrics as aggregates of Columns.

``r`` is actual - prediction, ``y`` the actual and ``p`` the prediction. Rows with a null or NaN ratio
are left out; a metric that is infinite or not a number is null. A zero actual makes a ratio infinite,
unless the residual is zero too (left out).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _real(x: Column) -> Column:
    """NaN as null, in DOUBLE."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def _ratio(top: Column, bottom: Column) -> Column:
    top, bottom = F.abs(top), F.abs(bottom)
    over_zero = F.when(top > 0, F.lit(float("inf")))
    return F.when(bottom == 0, over_zero).otherwise(F.try_divide(top, bottom))


def mae(r: Column, y: Column, p: Column) -> Column:
    return _finite(F.avg(F.abs(_real(r))))


def mape(r: Column, y: Column, p: Column) -> Column:
    return _finite(F.avg(_real(_ratio(_real(r), _real(y)))) * 100)


def mdape(r: Column, y: Column, p: Column) -> Column:
    return _finite(F.median(_real(_ratio(_real(r), _real(y)))) * 100)


def smape(r: Column, y: Column, p: Column) -> Column:
    return _finite(F.avg(_real(_ratio(2 * _real(r), F.abs(_real(y)) + F.abs(_real(p))))) * 100)


def rmse(r: Column, y: Column, p: Column) -> Column:
    return _finite(F.sqrt(F.avg(_real(r) * _real(r))))


def rmsse(r: Column, scale: Column) -> Column:
    """Root of the mean squared error over ``scale``, the mean squared step of the training actuals; null where that is 0."""
    x = _real(r)
    return _finite(F.sqrt(F.try_divide(F.avg(x * x), F.max(F.when(scale > 0, scale)))))


METRICS: dict[str, Callable[[Column, Column, Column], Column]] = {"mae": mae, "mape": mape, "mdape": mdape, "smape": smape, "rmse": rmse}
ALL = (*METRICS, "rmsse")
