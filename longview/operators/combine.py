"""Combining the forecasts of models with different horizons."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from .errors import ErrorTables
from .models import Results
from .relational import null_safe_join, union_all


def median_of_all(p: Column) -> Column:
    """The median, null if any value is."""
    return F.when(F.count(p) == F.count(F.lit(1)), F.median(p))


def combine(*forecasts: Results, by: str = "horizon", aggregate: Callable[[Column], Column] = median_of_all, errors: Sequence[ErrorTables] | ErrorTables | None = None, metric: str | None = None) -> Results:
    """One forecast for each horizon (and group).

    by="horizon": of the trained horizons the shortest that reaches a step forecasts it; several models
    become one "Ensemble" by ``aggregate``. Classes are selected but not aggregated. Which horizons are
    trained is known beforehand, so the selection is a filter ahead of the aggregation.
    by="error": for each horizon and group the forecast whose model and model horizon has the least
    ``metric`` in the errors by horizon; nulls come last and ties go to the first forecast given, then to
    the shorter model horizon, then to the model's name. Error columns are kept.
    """
    if not forecasts or any(f.kind != "forecast" for f in forecasts):
        raise ValueError("only forecasts can be combined")
    if any(f.window_length != 0 for f in forecasts):
        raise ValueError("final forecasts come from models trained with window_length=0")
    if by not in ("horizon", "error"):
        raise ValueError("by is 'horizon' or 'error'")
    first = forecasts[0]
    spec, groups = first.spec, list(first.spec.groups)
    if by == "error":
        return _by_error(forecasts, errors, metric)
    if first.method == "multi_output":
        raise ValueError("multi_output models have no horizons of their own to combine by")
    trained = sorted({h for f in forecasts for h in f.horizons})
    names = tuple(dict.fromkeys(n for f in forecasts for n in f.models))
    df = union_all([f.df for f in forecasts])
    use = F.lit(False)
    for low, high in zip([0, *trained], trained):
        use = use | ((F.col("model_forecast_horizon") == high) & (F.col("horizon") > low) & (F.col("horizon") <= high))
    df = df.filter(use)
    if spec.outcome_levels is None:
        if len(names) > 1:
            df, names = df.withColumn("model", F.lit("Ensemble")), ("Ensemble",)
        preds = [c for c in (first.pred, f"{first.pred}_lower", f"{first.pred}_upper") if c in df.columns]
        df = df.groupBy("model", "model_forecast_horizon", "horizon", *groups, "forecast_period").agg(*[aggregate(F.col(c)).alias(c) for c in preds])
    return replace(first, df=df, kind="combined", models=names, horizons=tuple(trained), combined_by="horizon")


def _by_error(forecasts: Sequence[Results], errors, metric: str | None) -> Results:
    first = forecasts[0]
    groups, h = list(first.spec.groups), first.horizon
    errors = [errors] if isinstance(errors, ErrorTables) else list(errors or ())
    if not errors:
        raise ValueError("combining by error needs the errors of the models")
    if not metric or any(metric not in e.by_horizon.columns for e in errors):
        raise ValueError("name one metric that the errors have")
    table = union_all([e.by_horizon for e in errors])
    table = table.drop("window_start", "window_stop")
    df = union_all([f.df.withColumn("__given", F.lit(i)) for i, f in enumerate(forecasts)])
    df = null_safe_join(df, table, ["model", h, *groups])
    w = Window.partitionBy("horizon", *groups).orderBy(F.col(metric).asc_nulls_last(), "__given", F.col(h), "model")
    best = df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1")
    out: DataFrame = best.drop("__rank", "__given", "window_length", "window_number")
    names = tuple(dict.fromkeys(n for f in forecasts for n in f.models))
    return replace(first, df=out, kind="combined", models=names, combined_by="error")
