"""Fitting a model for each horizon and validation window."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..plans.spec import ROW, LaggedFrame
from ..session import settle, ship
from .models import AggregateModel, EstimatorModel, ForecastModel, PandasModel, prediction_columns
from .relational import union_all
from .windows import LITERAL_WINDOWS, Windows, expand


def train(lagged: LaggedFrame, windows: Windows, name: str, model: Any, outputs: str = "points", on_error: str = "record") -> ForecastModel:
    """Train ``model`` on the rows outside each window, for each horizon (one model for multi_output).

    Rows on both sides of a window train; a window of length 0 over all of the data trains on all rows.
    A failing fit is kept as ``error`` in the model's row and predicts nulls; with ``on_error="raise"``
    it fails the job. Pandas models are fitted once and written to the shared folder.
    """
    if lagged.kind != "train":
        raise ValueError("models are trained on training frames")
    if not isinstance(name, str) or not name:
        raise ValueError("a model needs a name")
    if on_error not in ("record", "raise"):
        raise ValueError("on_error is 'record' or 'raise'")
    if not isinstance(model, (AggregateModel, PandasModel, EstimatorModel)):
        raise ValueError("the model has to be an AggregateModel, PandasModel or EstimatorModel")
    if lagged.method == "direct":
        prediction_columns(lagged.spec, outputs)
    how = {AggregateModel: _aggregates, PandasModel: _pandas, EstimatorModel: _estimators}[type(model)]
    return how(lagged, windows, name, model, outputs, on_error)


def _rows(lagged: LaggedFrame, windows: Windows, name: str, key: Any, df: DataFrame) -> DataFrame:
    """``df`` (window_number, ...) with the columns that every model's row has."""
    spark = df.sparkSession
    kind = next(iter(lagged.frames.values())).schema[windows.index].dataType
    horizon = F.lit(key if lagged.method == "direct" else None).cast("int").alias("model_forecast_horizon")
    text = F.lit(", ".join(map(str, key)) if isinstance(key, tuple) else str(key)).alias("horizons")
    found = F.broadcast(windows.table(spark, kind).drop("is_custom"))  # one row a window
    out = df.join(found, "window_number")
    return out.select(F.lit(name).alias("model"), horizon, text, *out.columns)


def _sql(text: str, key: Any) -> str:
    return text.replace("{h}", str(max(key) if isinstance(key, tuple) else key))


def _aggregates(lagged, windows, name, model, outputs, on_error) -> ForecastModel:
    params = {}
    for key, frame in lagged.frames.items():
        if len(windows) > LITERAL_WINDOWS:
            rows = expand(frame, windows, validation=False)
            params[key] = rows.groupBy(*model.by, "window_number").agg(*[F.expr(_sql(x, key)).alias(p) for p, x in model.fit.items()])
            continue
        kind = frame.schema[windows.index].dataType
        flags = {f"__w{i}": F.lit(True) if windows.trains_on_all(i) else ~windows.inside(i, kind) for i in range(len(windows))}
        cols = [F.expr(f"{_sql(x, key)} FILTER (WHERE __w{i})").alias(f"__{p}_{i}") for i in range(len(windows)) for p, x in model.fit.items()]
        fitted = frame.withColumns(flags).groupBy(*model.by).agg(*cols) if cols else frame.select(*model.by).limit(0)
        each = [F.struct(F.lit(i + 1).alias("window_number"), *[F.col(f"__{p}_{i}").alias(p) for p in model.fit]) for i in range(len(windows))]
        params[key] = fitted.select(*model.by, F.explode(F.array(*each)).alias("__m")).select(*model.by, "__m.*")
    table = union_all([_rows(lagged, windows, name, k, p).withColumn("error", F.lit(None).cast("string")) for k, p in params.items()])
    return ForecastModel(name, model, windows, table, lagged.horizons, lagged.method, lagged.spec, params, outputs=outputs)


def _pandas(lagged, windows, name, model, outputs, on_error) -> ForecastModel:
    if model.merge and model.stream or model.finish and not model.merge:
        raise ValueError("a model has either stream or merge, and finish only with merge")
    rows = []
    for key, frame in lagged.frames.items():
        ship(frame.sparkSession)
        columns = [*lagged.targets, *lagged.features(key)]
        found = expand(frame, windows, validation=False)
        if model.merge:
            order, data = ["__part"], ["model_blob", "error"]
            found = found.select("window_number", *columns).mapInPandas(_in_parts(model, key, columns, on_error, windows), f"{_FITTED}, __part int")
            run = _merger(model, on_error)
        else:
            order, data = [c for c in (*lagged.spec.groups, lagged.spec.date, ROW) if c in frame.columns], columns
            run = _fitter(model, key, columns, on_error, windows)
        # Spark sorts, which needs no memory of Python workers; rows reach a fit in batches and without the columns that only order them.
        found = found.repartition("window_number").sortWithinPartitions("window_number", *[F.col(c).asc_nulls_last() for c in order]).select("window_number", *data)
        rows.append(_rows(lagged, windows, name, key, found.groupBy("window_number").applyInPandas(run, _FITTED)))
    table = settle(union_all(rows), "models")
    return ForecastModel(name, model, windows, table, lagged.horizons, lagged.method, lagged.spec, outputs=outputs)


_FITTED = "window_number int, model_blob binary, error string"


def _attempt(on_error: str, call: Callable[[], Any]) -> tuple[Any, str | None]:
    """What ``call`` gives, and its error as text."""
    try:
        return call(), None
    except Exception as e:
        if on_error == "raise":
            raise
        return None, f"{type(e).__name__}: {e}"


def _fit(model: PandasModel, horizon: Any, windows: Windows) -> Callable[[Any, int], Any]:
    """The model's fit as a function of rows and their window's number."""
    fit, args, told = model.fit, dict(model.args), model.held_out
    held = [None if windows.trains_on_all(i) else w for i, w in enumerate(windows.rows)]
    return lambda data, number: fit(data, horizon, **args, **({"held_out": held[number - 1]} if told else {}))


def _fitter(model: PandasModel, horizon: Any, columns: list[str], on_error: str, windows: Windows):
    fit, stream = _fit(model, horizon, windows), model.stream

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(batches)
        number = int(first["window_number"].iloc[0])
        frames = (b[columns] for b in chain([first], batches))
        del first
        data = frames if stream else _whole(frames, columns)
        blob, error = _attempt(on_error, lambda: cloudpickle.dumps(fit(data, number)))
        for _ in frames:  # the rows that a fit left
            pass
        yield pd.DataFrame({"window_number": [number], "model_blob": [blob], "error": [error]})

    return run


def _whole(frames: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """One frame of all, put together a column at a time, so that only one column is held twice."""
    parts: dict[str, list[pd.Series]] = {c: [] for c in columns}
    for b in frames:
        for c in columns:
            parts[c].append(b[c])
    return pd.DataFrame({c: pd.concat(parts.pop(c), ignore_index=True) for c in columns}, copy=False)


def _in_parts(model: PandasModel, horizon: Any, columns: list[str], on_error: str, windows: Windows):
    """One fit of each window by a task, of the rows that it has."""
    fit, merge = _fit(model, horizon, windows), model.merge

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[Any, str | None]] = {}
        for b in batches:
            for number, part in b.groupby("window_number", sort=False):
                before = found.get(int(number))
                if before is None or before[1] is None:
                    data = part[columns].reset_index(drop=True)
                    found[int(number)] = _attempt(on_error, lambda: fit(data, int(number)) if before is None else merge(before[0], fit(data, int(number))))
        task = TaskContext.get().partitionId()
        for number, (got, error) in found.items():
            blob, error = (None, error) if error else _attempt(on_error, lambda: cloudpickle.dumps(got))
            yield pd.DataFrame({"window_number": [number], "model_blob": [blob], "error": [error], "__part": [task]})

    return run


def _merger(model: PandasModel, on_error: str):
    """One model of a window's fits, a row each."""
    merge, finish = model.merge, model.finish

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, error, first = None, None, True
        for b in batches:
            number = int(b["window_number"].iloc[0])
            for blob, failed in zip(b["model_blob"], b["error"]):
                if error is None and blob is None:
                    error = failed
                elif error is None:
                    got, error = _attempt(on_error, lambda: load(blob) if first else merge(got, load(blob)))
                first = False
        blob, error = (None, error) if error else _attempt(on_error, lambda: cloudpickle.dumps(finish(got) if finish else got))
        yield pd.DataFrame({"window_number": [number], "model_blob": [blob], "error": [error]})

    return run


def _estimators(lagged, windows, name, model, outputs, on_error) -> ForecastModel:
    fitted, notes = {}, []
    if lagged.method != "direct" or outputs != "points":
        raise ValueError("an EstimatorModel predicts points of the direct method")
    for key, frame in lagged.frames.items():
        kind, features = frame.schema[windows.index].dataType, lagged.features(key)
        for i in range(len(windows)):
            part = frame if windows.trains_on_all(i) else frame.filter(~windows.inside(i, kind))
            error = None
            try:
                fitted[key, i + 1] = model.estimator(features, lagged.spec.outcome, key).fit(part.dropna(subset=[lagged.spec.outcome, *features]))
            except Exception as e:
                if on_error == "raise":
                    raise
                error = f"{type(e).__name__}: {e}"
            notes.append((key, i + 1, error))
    spark = next(iter(lagged.frames.values())).sparkSession
    table = union_all([_rows(lagged, windows, name, key, spark.createDataFrame([n[1:] for n in notes if n[0] == key], "window_number int, error string")) for key in lagged.frames])
    return ForecastModel(name, model, windows, table, lagged.horizons, lagged.method, lagged.spec, fitted=fitted, outputs=outputs)


def load(blob: bytes) -> Any:
    """The object that a pandas model's fit returned."""
    return pickle.loads(blob)
