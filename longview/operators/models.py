"""Models: SQL aggregates, pandas functions, and Spark ML estimators behind one protocol."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, DoubleType


@dataclass(frozen=True)
class AggregateModel:
    """A model whose fit is aggregates and whose prediction is an expression of them and the features.

    ``fit`` maps parameter names to SQL aggregates over the training frame, ``predict`` is a SQL
    expression (or, for intervals, a list of three) over features and parameters. Both see the columns
    of the frame; ``{h}`` in either is the model's horizon. ``by`` names group columns to fit apart; the
    default is one pooled model. All windows are fitted in one pass: an aggregate is filtered to the rows
    outside its window, so rows are not multiplied.
    """

    fit: Mapping[str, str]
    predict: str | tuple[str, ...]
    by: tuple[str, ...] = ()


@dataclass(frozen=True)
class PandasModel:
    """Any model in Python: ``fit(frame, horizon, **args)`` gives an object, ``predict(object, frame)`` a frame.

    Both get pandas frames, the outcome first. A prediction has one column (points, or class levels),
    three (bounds and point, put in the order of their means), one for each class, or one for each
    horizon (multi_output); one row stands for all. Training rows come in the order of groups and dates. With
    ``held_out`` a fit is also told its window, as held_out=(start, stop), None where all rows train.
    Predictions are made in chunks and have to be made row by row.

    A fit sees all its training rows in one frame, so they have to fit in one worker. Two forms hold no more than
    some thousands of rows at once. With ``stream`` the first argument is an iterator of frames, in order.
    With ``merge`` each task fits the rows that it has, in any order and in frames of some thousands, ``merge(a, b)``
    makes one of two fits, and ``finish(fit)``, if given, makes the object of the last one.
    """

    fit: Callable[..., Any]
    predict: Callable[[Any, Any], Any]
    args: Mapping[str, Any] = field(default_factory=dict)
    held_out: bool = False
    stream: bool = False
    merge: Callable[[Any, Any], Any] | None = None
    finish: Callable[[Any], Any] | None = None


@dataclass(frozen=True)
class EstimatorModel:
    """A ``pyspark.ml`` estimator (or pipeline): every fit is distributed.

    ``estimator(features, target, horizon)`` returns it; its predictions are read from ``prediction``.
    Rows with a null in a feature or the target are left out of the fit.
    """

    estimator: Callable[[list[str], str, int], Any]
    prediction: str = "prediction"


@dataclass(frozen=True)
class ForecastModel:
    """Trained models. ``table`` has a row for each (horizon, window): model, model_forecast_horizon,
    horizons, window_number, start, stop, window_length, error, and the model: its parameters, or its
    pickle. ``fitted`` holds Spark ML models by (horizon, window number)."""

    name: str
    model: Any
    windows: Any
    table: DataFrame
    horizons: tuple[int, ...]
    method: str
    spec: Any
    params: Mapping[Any, DataFrame] = field(default_factory=dict)
    fitted: Mapping[tuple[Any, int], Any] = field(default_factory=dict)
    outputs: str = "points"


@dataclass(frozen=True)
class Results:
    """A table of predictions with what the following steps need to know about it.

    ``kind`` is "training", "forecast" or "combined"; ``window_length`` is 0 for models of all rows."""

    df: DataFrame
    spec: Any
    kind: str
    method: str
    models: tuple[str, ...] = ()
    horizons: tuple[int, ...] = ()
    window_length: int | None = None
    data_stop: Any = None
    combined_by: str | None = None

    @property
    def pred(self) -> str:
        return f"{self.spec.outcome}_pred"

    @property
    def index(self) -> str:
        return "forecast_period" if self.kind != "training" else "date_indices" if "date_indices" in self.df.columns else "valid_indices"

    @property
    def horizon(self) -> str:
        return "model_forecast_horizon" if "model_forecast_horizon" in self.df.columns else "horizon"


def prediction_columns(spec: Any, outputs: str) -> list[tuple[str, DataType]]:
    """Names and types of the predictions: points, interval (with bounds), levels or classes."""
    from pyspark.sql.types import StringType

    p = f"{spec.outcome}_pred"
    if outputs == "points":
        return [(p, DoubleType())]
    if outputs == "interval":
        return [(p, DoubleType()), (f"{p}_lower", DoubleType()), (f"{p}_upper", DoubleType())]
    if outputs == "levels":
        return [(p, StringType())]
    if outputs == "classes":
        return [(x, DoubleType()) for x in spec.outcome_levels]
    raise ValueError(f"outputs is points, interval, levels or classes, not {outputs!r}")
