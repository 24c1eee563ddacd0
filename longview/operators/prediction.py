"""Predictions on validation rows and on forecast frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.spec import ROW, LaggedFrame
from ..session import ship
from .models import AggregateModel, ForecastModel, PandasModel, Results, prediction_columns
from .relational import null_safe_join, union_all
from .training import _sql, load
from .windows import expand

#: Bytes of a horizon's pickled models up to which they are broadcast.
MODEL_BYTES = 32 << 20
#: Tasks that the rows of one window are predicted in by a pandas model beyond that.
CHUNKS = 32


def predict(models: ForecastModel | Sequence[ForecastModel], lagged: LaggedFrame, chunks: int = CHUNKS) -> Results:
    """Predict each window's validation rows (training frames) or all rows of a forecast frame.

    Training results: model, model_forecast_horizon (multi_output: horizon), window_length,
    window_number, valid_indices, date_indices where there are dates, groups, the actual outcome and
    predictions; multi_output has a row for each horizon, with forecast_indices and
    forecast_date_indices. Forecast results: model, model_forecast_horizon, horizon, window_length,
    window_number, forecast_period, groups and predictions.
    """
    models = [models] if isinstance(models, ForecastModel) else list(models)
    if not models:
        raise ValueError("no models were given")
    if any(m.method != lagged.method or m.horizons != lagged.horizons for m in models):
        raise ValueError("the models were trained with other horizons or another method than the data's")
    out = union_all([_one(m, lagged, key, chunks) for m in models for key in lagged.frames])
    stop = None if lagged.kind == "train" else models[0].windows.full[1]
    lengths = {m.windows.length for m in models}
    names = tuple(dict.fromkeys(m.name for m in models))
    return Results(out, lagged.spec, "training" if lagged.kind == "train" else "forecast", lagged.method, names, lagged.horizons, lengths.pop() if len(lengths) == 1 else None, stop)


def _one(m: ForecastModel, lagged: LaggedFrame, key: Any, chunks: int) -> DataFrame:
    spec, frame, train = lagged.spec, lagged.frames[key], lagged.kind == "train"
    names = [n for n, _ in prediction_columns(spec, m.outputs)] if lagged.method == "direct" else [f"__p{h}" for h in lagged.horizons]
    rows = expand(frame, m.windows, validation=True) if train else frame.crossJoin(F.broadcast(m.table.sparkSession.range(1, len(m.windows) + 1).select(F.col("id").cast("int").alias("window_number"))))
    if isinstance(m.model, AggregateModel):
        df = _by_expression(m, rows, key, names)
    elif isinstance(m.model, PandasModel):
        df = _by_pandas(m, lagged, rows, key, names, chunks)
    else:
        df = _by_estimator(m, rows, key, names)
    df = df.withColumns({"model": F.lit(m.name), "window_length": F.lit(m.windows.length).cast("int")})
    if lagged.method == "multi_output":
        return _multi(df, lagged, key, names)
    mfh = F.lit(key).cast("int").alias("model_forecast_horizon")
    if train:
        at = [F.col(ROW).alias("valid_indices"), *([F.col(spec.date).alias("date_indices")] if spec.date else [])]
        return df.select("model", mfh, "window_length", "window_number", *at, *spec.groups, spec.outcome, *names)
    return df.select("model", mfh, "horizon", "window_length", "window_number", F.col("index").alias("forecast_period"), *spec.groups, *names)


def _by_expression(m: ForecastModel, rows: DataFrame, key: Any, names: list[str]) -> DataFrame:
    said = [m.model.predict] if isinstance(m.model.predict, str) else list(m.model.predict)
    if len(said) != len(names):
        raise ValueError(f"the model has {len(said)} predictions where {len(names)} are needed")
    on = ["window_number", *m.model.by]
    # Pooled models have a row for each window; models by group are as many as groups, and shuffled if large.
    df = null_safe_join(rows, m.params[key], on, "left", broadcast=not m.model.by)
    kinds = {} if m.method != "direct" else dict(prediction_columns(m.spec, m.outputs))
    return df.withColumns({n: F.expr(_sql(x, key)).cast(kinds.get(n, DoubleType())) for n, x in zip(names, said)})


def _by_estimator(m: ForecastModel, rows: DataFrame, key: Any, names: list[str]) -> DataFrame:
    parts = []
    for i in range(len(m.windows)):
        part = rows.filter(F.col("window_number") == i + 1)
        fitted = m.fitted.get((key, i + 1))
        if fitted is None:
            parts.append(part.withColumn(names[0], F.lit(None).cast("double")))
            continue
        done = fitted.transform(part)
        parts.append(done.select(*part.columns, F.col(m.model.prediction).cast("double").alias(names[0])))
    return union_all(parts)


def _by_pandas(m: ForecastModel, lagged: LaggedFrame, rows: DataFrame, key: Any, names: list[str], chunks: int) -> DataFrame:
    """Rows stay where they are and get their window's model, where all models together are small; else both are shuffled."""
    spec = lagged.spec
    ship(rows.sparkSession)
    columns, predict_rows = lagged.features(key), m.model.predict
    kinds = [k for _, k in prediction_columns(spec, m.outputs)] if lagged.method == "direct" else [DoubleType()] * len(names)
    schema = StructType([*rows.schema.fields, *[StructField(n, k) for n, k in zip(names, kinds)]])
    order, outputs = rows.columns, m.outputs if lagged.method == "direct" else "multi"
    blobs = m.table.filter(F.col("horizons") == (", ".join(map(str, key)) if isinstance(key, tuple) else str(key)))
    blobs = blobs.select("window_number", "model_blob")

    def predicted(out: pd.DataFrame, model: tuple) -> pd.DataFrame:
        """The rows of one window with their predictions; ``model`` is empty if its fit failed."""
        out = out.reset_index(drop=True)
        for n in names:
            out[n] = None
        if not len(out) or not model:
            return out
        got = pd.DataFrame(predict_rows(*model, out[columns])).reset_index(drop=True)
        if outputs == "interval" and got.shape[1] == 3:
            low, mid, high = got.mean().sort_values(kind="stable").index
            got = got[[mid, low, high]]
        if got.shape[1] != len(names):
            raise ValueError(f"the prediction has {got.shape[1]} columns where {len(names)} are needed")
        if len(got) == 1:
            got = got.loc[got.index.repeat(len(out))].reset_index(drop=True)
        if len(got) != len(out):
            raise ValueError(f"the prediction has {len(got)} rows where {len(out)} are needed")
        for n, c in zip(names, got.columns):
            out[n] = got[c].to_numpy()
        return out

    size = blobs.agg(F.sum(F.octet_length("model_blob"))).first()[0] or 0
    if size <= MODEL_BYTES:
        shared = rows.sparkSession.sparkContext.broadcast({r["window_number"]: r["model_blob"] for r in blobs.collect()})  # MODEL_BYTES at most

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loaded: dict[int, tuple] = {}
            for b in batches:
                for number, part in b.groupby("window_number", sort=False):
                    if number not in loaded:
                        blob = shared.value.get(int(number))
                        loaded[number] = () if blob is None else (load(blob),)
                    yield predicted(part[order], loaded[number])

        return rows.mapInPandas(run, schema)
    rows = rows.withColumn("__chunk", F.pmod(F.xxhash64(*[c for c in (ROW, spec.date, "index", "horizon", *spec.groups) if c in rows.columns]), F.lit(chunks)))
    blobs = blobs.crossJoin(F.broadcast(rows.sparkSession.range(chunks).withColumnRenamed("id", "__chunk")))

    def together(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        blob = right["model_blob"].iloc[0] if len(right) else None
        return predicted(left[order], () if blob is None else (load(blob),))

    keys = ["window_number", "__chunk"]
    return rows.groupBy(*keys).cogroup(blobs.groupBy(*keys)).applyInPandas(together, schema)


def _multi(df: DataFrame, lagged: LaggedFrame, key: Any, names: list[str]) -> DataFrame:
    """A row for each horizon of multi_output predictions."""
    spec = lagged.spec
    p = f"{spec.outcome}_pred"
    if lagged.kind == "train":
        each = []
        for h, n in zip(lagged.horizons, names):
            at = [F.lit(h).alias("horizon"), (F.col(ROW) + h).alias("forecast_indices")]
            if spec.date:
                at.append(spec.step.after(F.col(spec.date), h, df.schema[spec.date].dataType).alias("forecast_date_indices"))
            each.append(F.struct(*at, F.col(f"{spec.outcome}_{h}").alias(spec.outcome), F.col(n).alias(p)))
        index = [F.col(ROW).alias("valid_indices"), *([F.col(spec.date).alias("date_indices")] if spec.date else [])]
        out = df.select("model", "window_length", "window_number", *index, *spec.groups, F.inline(F.array(*each)))
        return out.select("model", "horizon", "window_length", "window_number", "valid_indices", *(["date_indices"] if spec.date else []), "forecast_indices", *(["forecast_date_indices"] if spec.date else []), *spec.groups, spec.outcome, p)
    kind = "timestamp" if spec.date and spec.step.seconds % 86400 else "date" if spec.date else "long"
    periods = F.split("index", ", ")
    each = [F.struct(F.lit(h).alias("horizon"), F.get(periods, F.lit(i)).cast(kind).alias("forecast_period"), F.col(n).alias(p)) for i, (h, n) in enumerate(zip(lagged.horizons, names))]
    out = df.select("model", "window_length", "window_number", *spec.groups, F.inline(F.array(*each)))
    return out.select("model", "horizon", "window_length", "window_number", "forecast_period", *spec.groups, p)
