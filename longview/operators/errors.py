"""Forecast errors by window, by horizon and overall."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, NumericType

from ..functions.metrics import ALL, METRICS, rmsse
from ..plans.spec import ROW
from ..session import settle
from .models import Results
from .relational import in_series, null_safe_join
from .residuals import residual


class ErrorTables(NamedTuple):
    by_window: DataFrame
    by_horizon: DataFrame
    overall: DataFrame


def errors(
    results: Results,
    actuals: DataFrame | None = None,
    metrics: Sequence[str] = ALL[:5],
    aggregate: Callable[[Column], Column] = F.median,
    models: Sequence[str] | None = None,
    horizons: Sequence[int] | None = None,
    windows: Sequence[int] | None = None,
    where: str | None = None,
) -> ErrorTables:
    """Error metrics of predictions, at three levels.

    Metrics are taken over the rows of a window (and group); horizons and the whole aggregate the
    metrics of their windows, ignoring nulls. Window bounds are those of all groups together. Forecasts
    are compared with ``actuals`` (index or forecast_period, groups, outcome) by an inner join; combined
    forecasts have errors by horizon and overall only, straight from the rows. "rmsse" needs the
    training actuals. ``where`` is a SQL condition on the rows.
    """
    metrics = list(dict.fromkeys(metrics))
    if unknown := [m for m in metrics if m not in ALL] or (["no metric"] if not metrics else []):
        raise ValueError(f"unknown metrics: {', '.join(unknown)}; there are {', '.join(ALL)}")
    spec = results.spec
    if spec.outcome_levels is not None:
        if metrics != ["mae"]:
            raise ValueError("classes have only the metric mae")
        if results.pred not in results.df.columns:
            raise ValueError("class probabilities have no error metrics")
    if actuals is None and (results.kind != "training" or "rmsse" in metrics):
        raise ValueError("forecasts, and rmsse, need the table of actuals")
    groups, h = list(spec.groups), results.horizon
    df = results.df
    if results.kind != "training":
        truth = _actuals(results, actuals, "forecast_period")
        df = null_safe_join(df, truth, ["forecast_period", *groups], "inner")
    if "rmsse" in metrics:
        scale = _scale(results, _actuals(results, actuals, "__index"))
        on = [*(["window_number"] if "window_number" in scale.columns else []), *groups]
        df = null_safe_join(df, scale, on) if on else df.crossJoin(F.broadcast(scale))
    df = df.withColumn("__r", residual(results))
    if results.kind != "combined":
        for column, wanted in (("model", models), (h, horizons), ("window_number", windows)):
            df = df if wanted is None else df.filter(F.col(column).isin(list(wanted)))
        df = df if where is None else df.filter(where)
    aggs = [_metric(m, spec.outcome, results.pred).alias(m) for m in metrics]
    rolled = [aggregate(F.col(m)).alias(m) for m in metrics]
    if results.kind == "combined":
        return ErrorTables(df.select("model").limit(0), df.groupBy("model", "horizon", *groups).agg(*aggs), df.groupBy("model", *groups).agg(*aggs))
    keys = ["model", h, "window_number", *groups]
    if results.kind == "forecast":
        one = settle(df.groupBy(*keys).agg(*aggs), "errors")
        return ErrorTables(one, one.groupBy("model", h, *groups).agg(*rolled), one.groupBy("model", *groups).agg(*rolled))
    i = results.index
    number = _number(df, i)
    one = df.groupBy(*keys).agg(F.min(i).alias("__a"), F.max(i).alias("__b"), F.sum(number).alias("__s"), F.count(i).alias("__n"), *aggs)
    one = settle(one, "errors")  # a row for each window and group, which three tables read
    # Bounds come from the small table of metrics, and have a row for each window.
    bounds = one.groupBy("model", h, "window_number").agg(F.min("__a").alias("window_start"), F.max("__b").alias("window_stop"), _middle(df, i).alias("window_midpoint"))
    one = null_safe_join(one, bounds, ["model", h, "window_number"], "inner", broadcast=True)
    by_window = one.select(*keys, "window_start", "window_stop", "window_midpoint", *metrics)
    ends = [F.min("window_start").alias("window_start"), F.max("window_stop").alias("window_stop")]
    out = []
    for by in (["model", h], ["model"]):
        span = bounds.groupBy(*by).agg(*ends)
        level = one.groupBy(*by, *groups).agg(*rolled)
        out.append(null_safe_join(level, span, by, "inner", broadcast=True).select(*by, *groups, "window_start", "window_stop", *metrics))
    return ErrorTables(by_window, *out)


def _metric(name: str, outcome: str, pred: str) -> Column:
    r = F.col("__r")
    return rmsse(r, F.col("__scale")) if name == "rmsse" else METRICS[name](r, F.col(outcome) if name != "mae" else r, F.col(pred) if name != "mae" else r)


def _number(df: DataFrame, index: str) -> Column:
    kind = df.schema[index].dataType
    return F.col(index) if isinstance(kind, NumericType) else F.unix_date(index) if isinstance(kind, DateType) else F.unix_micros(F.col(index).cast("timestamp"))


def _middle(df: DataFrame, index: str) -> Column:
    """The mean index, for dates rounded down to a day."""
    kind = df.schema[index].dataType
    mean = F.sum("__s") / F.sum("__n")
    return mean if isinstance(kind, NumericType) else F.date_from_unix_date(F.floor(mean).cast("int")) if isinstance(kind, DateType) else F.timestamp_micros(F.floor(mean)).cast(kind)


def _actuals(results: Results, actuals: DataFrame, name: str) -> DataFrame:
    """(index, groups, outcome) under the name that the join needs."""
    spec = results.spec
    named = [c for c in ("forecast_period", "index", spec.date, ROW) if c and c in actuals.columns]
    if not named:
        raise ValueError("the actuals have no index: name it as the date column, index, forecast_period or row_index")
    return actuals.select(F.col(named[0]).alias(name), *spec.groups, spec.outcome)


def _scale(results: Results, actuals: DataFrame) -> DataFrame:
    """The mean squared step of the actuals, by group (and window, with those rows left out that it holds out).

    A step counts for a window if neither of its two rows is held out. Steps are taken once and not for
    each window; the windows that hold a row out are a small array.
    """
    spec, groups = results.spec, list(results.spec.groups)
    rows = actuals.dropDuplicates(["__index", *groups])
    y = F.col(spec.outcome).cast("double")
    training = results.kind == "training"
    if training:
        held = results.df.select(F.col(results.index).alias("__index"), *groups, "window_number")
        if results.window_length == 0:
            rows = null_safe_join(rows, held.select("__index", *groups).distinct(), ["__index", *groups], "left_semi")
        else:
            out = held.groupBy("__index", *groups).agg(F.collect_set("window_number").alias("__held"))
            rows = null_safe_join(rows, out, ["__index", *groups])
    if not training or results.window_length == 0:
        step = in_series(rows, "__index", groups, lambda w: {"__d": y - F.lag(y).over(w)}, ahead=0)
        return step.groupBy(*groups).agg(F.avg(F.col("__d") * F.col("__d")).alias("__scale"))
    none = F.array().cast("array<int>")
    own = F.coalesce("__held", none)
    step = in_series(rows, "__index", groups, lambda w: {"__d": y - F.lag(y).over(w), "__out": F.array_union(own, F.coalesce(F.lag("__held").over(w), none))}, ahead=0).filter("__d IS NOT NULL")
    numbers = results.df.agg(F.collect_set("window_number").alias("__all"))
    each = step.crossJoin(F.broadcast(numbers)).select(*groups, "__d", F.explode(F.array_except("__all", "__out")).alias("window_number"))
    return each.groupBy("window_number", *groups).agg(F.avg(F.col("__d") * F.col("__d")).alias("__scale"))
