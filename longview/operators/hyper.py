"""Hyperparameters of trained models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DateType, NumericType

from ..session import ship
from .models import AggregateModel, ForecastModel, PandasModel
from .training import load


def hyper(models: ForecastModel, function: Callable[[Any], Mapping[str, Any]] | None = None, schema: str | None = None) -> DataFrame:
    """A row for each model: model, its horizon, window_length, window_number, valid_window_start, -stop, -midpoint, hyperparameters.

    ``function`` maps a fitted object to a mapping with the columns of ``schema`` (DDL); an aggregate
    model's are its parameters, and it needs neither. Bounds are indices of the windows' index column. A
    model that failed has nulls.
    """
    table = models.table
    if isinstance(models.model, AggregateModel):
        names = list(models.model.fit)
    else:
        if not callable(function) or not schema:
            raise ValueError("give a function of a fitted model, and the schema of what it returns")
        if isinstance(models.model, PandasModel):
            table, names = _from_pickles(table, function, schema)
        else:
            table, names = _from_driver(models, function, schema)
    kind = table.schema["start"].dataType
    a, b = F.col("start"), F.col("stop")
    if isinstance(kind, NumericType):
        middle = (a + b) / 2
    elif isinstance(kind, DateType):
        middle = F.date_add(a, F.floor(F.datediff(b, a) / 2).cast("int"))
    else:
        middle = F.timestamp_micros(F.floor((F.unix_micros(a.cast("timestamp")) + F.unix_micros(b.cast("timestamp"))) / 2)).cast(kind)
    horizon = F.col("model_forecast_horizon") if models.method == "direct" else F.col("horizons").alias("horizon")
    by = list(models.model.by) if isinstance(models.model, AggregateModel) else []
    return table.select("model", horizon, "window_length", "window_number", *by, a.alias("valid_window_start"), b.alias("valid_window_stop"), middle.alias("valid_window_midpoint"), *names)


def _from_pickles(table: DataFrame, function, schema: str) -> tuple[DataFrame, list[str]]:
    ship(table.sparkSession)
    names = table.sparkSession.createDataFrame([], schema).columns
    kept = [c for c in table.columns if c != "model_blob"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [dict.fromkeys(names) if x is None else {**dict.fromkeys(names), **dict(function(load(x)))} for x in b["model_blob"]]
            yield pd.concat([b[kept].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields if f.name in kept]
    return table.mapInPandas(run, ", ".join([*fields, schema])), names


def _from_driver(models: ForecastModel, function, schema: str) -> tuple[DataFrame, list[str]]:
    spark = models.table.sparkSession
    names = spark.createDataFrame([], schema).columns
    rows = [(h, w, *[dict(function(m)).get(n) for n in names]) for (h, w), m in models.fitted.items()]
    found = spark.createDataFrame(rows, f"model_forecast_horizon int, window_number int, {schema}")
    return models.table.join(F.broadcast(found), ["model_forecast_horizon", "window_number"], "left"), names
