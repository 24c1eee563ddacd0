"""Residuals of predictions on training frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .models import Results


def residual(results: Results) -> Column:
    """Actual minus prediction; for predicted classes 1 where they are wrong, else 0."""
    y, p = F.col(results.spec.outcome), F.col(results.pred)
    if results.spec.outcome_levels is None:
        return y - p
    return (y.cast("string") != p.cast("string")).cast("int")


def residuals(results: Results) -> DataFrame:
    """model, groups, the model's horizon, index and residuals.

    With class probabilities there is a column ``<class>_residuals`` for each class, 1 - probability.
    """
    if results.kind != "training":
        raise ValueError("residuals are of predictions on training frames")
    spec = results.spec
    if spec.outcome_levels and results.pred not in results.df.columns:
        values = [(1 - F.col(x)).alias(f"{x}_residuals") for x in spec.outcome_levels]
    else:
        values = [residual(results).alias("residuals")]
    return results.df.select("model", *spec.groups, results.horizon, F.col(results.index).alias("index"), *values)
