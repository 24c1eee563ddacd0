"""The tables behind the plots: what is drawn, not how."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from ..functions.metrics import ALL
from ..plans.spec import LaggedFrame
from .errors import ErrorTables
from .models import Results
from .relational import in_series, null_safe_join, union_all
from .residuals import residual
from .windows import Windows


def facets(names: str | Sequence[str], groups: Sequence[str] = ()) -> list[str]:
    """Facet columns: horizon, model and group, which stands for the group columns."""
    names = [names] if isinstance(names, str) else list(names)
    if bad := [n for n in names if n not in ("horizon", "model", "group", ".")]:
        raise ValueError(f"facets are horizon, model or group, not {', '.join(bad)}")
    return [x for n in names if n != "." for x in (groups if n == "group" else [n])]


def _label(columns: Sequence[str]) -> Column:
    return F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def _rows(df: DataFrame, models, horizons, windows, where, h: str) -> DataFrame:
    for column, wanted in (("model", models), (h, horizons), ("window_number", windows)):
        df = df if wanted is None or column not in df.columns else df.filter(F.col(column).isin(list(wanted)))
    return df if where is None else df.filter(where)


def lag_map(lagged: LaggedFrame, per_predictor: bool = False) -> DataFrame:
    """horizon, time and feature: "Feature" where a lag is used, "No feature" where not, "Forecast" ahead; predictor where asked for.

    The map comes from the plan, not from data.
    """
    spark = next(iter(lagged.frames.values())).sparkSession
    rows = []
    reach = max((k for per in lagged.lags.by_horizon.values() for ks in per.values() for k in ks), default=0)
    for key, per in lagged.lags.by_horizon.items():
        top = max(key) if isinstance(key, tuple) else key
        columns = list(per) if per_predictor else [None]
        for c in columns:
            used = set(per[c]) if c else {k for ks in per.values() for k in ks}
            rows += [(top, -k, c, "Feature" if k in used else "No feature") for k in range(reach, 0, -1)]
            rows += [(top, t, c, "Forecast") for t in range(1, top + 1)]
    out = spark.createDataFrame(rows, "horizon int, time int, predictor string, feature string")
    return out if per_predictor else out.drop("predictor")


def windows_grid(lagged: LaggedFrame, windows: Windows, where: str | None = None) -> DataFrame:
    """The outcome of each series on the full grid of dates: index, series, groups, outcome, window_number, window_midpoint and is_point (no neighbour with an outcome).

    Series without dates have no gaps to show.
    """
    spec, f = lagged.spec, next(iter(lagged.frames.values()))
    y = lagged.targets[0]
    rows = f.select(F.col(lagged.index).alias("index"), *spec.groups, F.col(y).alias(spec.outcome))
    rows = rows if where is None else rows.filter(where)
    if spec.date:
        ends = rows.agg(F.min("index").alias("a"), F.max("index").alias("b"))
        grid = rows.select(*spec.groups).distinct().crossJoin(F.broadcast(ends)) if spec.groups else ends
        grid = grid.select(*spec.groups, F.explode(spec.step.grid(F.col("a"), F.col("b"))).alias("index"))
        rows = null_safe_join(grid, rows, ["index", *spec.groups])
    kind = rows.schema["index"].dataType
    alone = lambda w: F.lag(spec.outcome).over(w).isNull() & F.lead(spec.outcome).over(w).isNull() & F.col(spec.outcome).isNotNull()
    rows = in_series(rows, "index", spec.groups, lambda w: {"is_point": alone(w)})
    number, middle = F.lit(None).cast("int"), F.lit(None).cast(kind)
    for i in reversed(range(len(windows))):
        a, b = windows.rows[i]
        inside = F.col("index").between(F.lit(a).cast(kind), F.lit(b).cast(kind))
        mid = a + (b - a) / 2 if not isinstance(kind, NumericType) else (a + b) / 2
        number, middle = F.when(inside, F.lit(i + 1)).otherwise(number), F.when(inside, F.lit(mid).cast(kind)).otherwise(middle)
    series = _label(spec.groups) if spec.groups else F.lit("All")
    return rows.select("index", series.alias("series"), *spec.groups, spec.outcome, number.alias("window_number"), middle.alias("window_midpoint"), "is_point")


def training_lines(results: Results, keep_missing: bool = False, models=None, horizons=None, windows=None, where: str | None = None) -> DataFrame:
    """Actuals, predictions and residuals in long form: model, horizon, window_number, index, groups, outcome (the column's name) and value."""
    spec, h = results.spec, results.horizon
    df = _rows(results.df, models, horizons, windows, where, h)
    y, p = spec.outcome, results.pred
    classes = spec.outcome_levels is not None
    if classes and p not in df.columns:
        names = list(spec.outcome_levels)
        df = df if keep_missing else df.filter(F.col(y).isNotNull())
        values = [F.struct(F.lit(n).alias("outcome"), F.col(n).cast("string").alias("value")) for n in (y, *names)]
    else:
        if not keep_missing:
            df = df.filter(F.col(y).isNotNull()) if classes else df.withColumn(p, F.when(F.col(y).isNotNull(), F.col(p)))
        df = df.withColumn("__r", residual(results))
        kind = "string" if classes else "double"
        values = [F.struct(F.lit(n).alias("outcome"), F.col(c).cast(kind).alias("value")) for n, c in ((y, y), (p, p), ("residual", "__r"))]
    return df.select("model", F.col(h).alias("horizon"), "window_number", F.col(results.index).alias("index"), *spec.groups, F.inline(F.array(*values)))


def forecast_stability(results: Results, models=None, horizons=None, windows=None, where: str | None = None) -> DataFrame:
    """The forecasts of each validation row by where they were made: forecast_origin is horizon rows before it."""
    spec, h = results.spec, results.horizon
    df = _rows(results.df, models, horizons, windows, where, h)
    return df.select("model", F.col(h).alias("horizon"), "window_number", "valid_indices", (F.col("valid_indices") - F.col(h)).alias("forecast_origin"), *spec.groups, spec.outcome, results.pred)


def forecast_lines(forecasts: Results, actuals: DataFrame | None = None, models=None, horizons=None, windows=None, where: str | None = None) -> DataFrame:
    """Forecasts, and actuals as historical (up to the training data's end) or test: series, type, model, model_forecast_horizon, index, groups, outcome, lower, upper."""
    spec, h = forecasts.spec, forecasts.horizon
    df = _rows(forecasts.df, models, horizons, windows, where, h)
    p, index = forecasts.pred, "forecast_period"
    null = F.lit(None).cast("double")
    bound = lambda c: F.col(c) if c in df.columns else null
    made = df.select(F.lit("forecast").alias("series"), F.lit("model_forecast").alias("type"), "model", F.col(h).alias("model_forecast_horizon"), F.col(index).alias("index"), *spec.groups, F.col(p).cast("double").alias("outcome"), bound(f"{p}_lower").alias("lower"), bound(f"{p}_upper").alias("upper"))
    if actuals is None:
        return made
    named = next(c for c in ("forecast_period", "index", spec.date, spec.order) if c and c in actuals.columns)
    kind = df.schema[index].dataType
    old = F.col(named).cast(kind) <= F.lit(forecasts.data_stop).cast(kind)
    real = actuals if where is None else actuals.filter(where)
    real = real.select(F.lit("actual").alias("series"), F.when(old, "historical").otherwise("test").alias("type"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("int").alias("model_forecast_horizon"), F.col(named).cast(kind).alias("index"), *spec.groups, F.col(spec.outcome).cast("double").alias("outcome"), null.alias("lower"), null.alias("upper"))
    return union_all([made, real])


def error_lines(tables: ErrorTables, level: str = "window", models=None, horizons=None, windows=None, where: str | None = None) -> DataFrame:
    """One level of an error table in long form: its keys, error_metric and value. Levels are window, horizon and global."""
    found = {"window": tables.by_window, "horizon": tables.by_horizon, "global": tables.overall}
    if level not in found:
        raise ValueError("level is window, horizon or global")
    df = found[level]
    h = "model_forecast_horizon" if "model_forecast_horizon" in df.columns else "horizon"
    df = _rows(df, models, horizons if h in df.columns else None, windows, where, h)
    metrics = [m for m in ALL if m in df.columns]
    keys = [c for c in df.columns if c not in metrics]
    return df.unpivot(keys, metrics, "error_metric", "value")


def hyper_lines(table: DataFrame, errors: ErrorTables | None = None, horizons=None, windows=None) -> DataFrame:
    """Hyperparameters in long form (hyper, value; value_text for those that are not numbers), joined to the window errors (error_metric, error) where given."""
    fixed = ["model", "model_forecast_horizon", "horizon", "window_length", "window_number", "valid_window_start", "valid_window_stop", "valid_window_midpoint"]
    h = "model_forecast_horizon" if "model_forecast_horizon" in table.columns else "horizon"
    df = _rows(table, None, horizons, windows, None, h)
    names = [c for c in df.columns if c not in fixed]
    number = {c: isinstance(df.schema[c].dataType, NumericType) for c in names}
    each = [F.struct(F.lit(c).alias("hyper"), (F.col(c) if number[c] else F.lit(None)).cast("double").alias("value"), (F.lit(None) if number[c] else F.col(c)).cast("string").alias("value_text")) for c in names]
    keys = ["model", h, "window_length", "window_number"]
    long = df.select(*keys, F.inline(F.array(*each)))
    if errors is None:
        return long
    lines = error_lines(errors, "window").select("model", h, "window_number", "error_metric", F.col("value").alias("error"))
    return null_safe_join(long, lines, ["model", h, "window_number"], "inner")


def interval_ribbons(combined: Results) -> DataFrame:
    """Interval bounds in long form: a row for each forecast and level, with lower and upper.

    The first step of each model horizon is repeated under the horizon before it, so that ribbons of
    neighbouring horizons touch.
    """
    spec, p = combined.spec, combined.pred
    lower = [c for c in combined.df.columns if c.startswith(f"{p}_lower")]
    pairs = [(c, c.replace("_lower", "_upper", 1)) for c in lower]
    if not pairs:
        raise ValueError("the forecasts have no intervals")
    keys = ["model", *spec.groups]
    df = combined.df.withColumn("__filler", F.lit(False))
    w = Window.partitionBy(*keys).orderBy("horizon")
    fill = combined.df.withColumn("model_forecast_horizon", F.lag("model_forecast_horizon").over(w)).filter("model_forecast_horizon IS NOT NULL").withColumn("__filler", F.lit(True))
    each = [F.struct(F.lit(a.rsplit("_", 1)[-1]).alias("level"), F.col(a).alias("lower"), F.col(b).alias("upper")) for a, b in pairs]
    return df.unionByName(fill).select(*keys, "model_forecast_horizon", "horizon", F.col("forecast_period").alias("index"), F.col("__filler").alias("is_filler"), F.inline(F.array(*each)))
