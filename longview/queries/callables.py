"""Queries for models that a caller writes in Python: what they may return, what they may do, and how they may fail."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.lags import create_lagged
from ..operators.models import PandasModel
from ..operators.prediction import predict
from ..operators.training import train
from ..operators.windows import create_windows
from .features import SQL_WEEKS, WEEKS
from .forecasts import _LAGGED, _NONE, _add, _line, _moments
from .registry import query, rounded
from .series import USERS, users


def _lags(spark: SparkSession, sf_dir: str):
    lagged = create_lagged(users(spark, sf_dir), USERS, [7], [1, 7, 14])
    return lagged, create_windows(lagged, start=WEEKS[0], stop=WEEKS[1])


def _band(model, data):
    lag = data["y_lag_7"].astype(float)
    return pd.DataFrame({"a": lag + 10, "b": lag - 10, "c": lag})


@query(f"WITH {_LAGGED}, {SQL_WEEKS} SELECT CAST(window_number AS INTEGER) AS window_number, row_index AS valid_indices, user_id, y_lag_7 AS y_pred, y_lag_7 - 10 AS y_pred_lower, y_lag_7 + 10 AS y_pred_upper FROM lagged JOIN weeks ON day BETWEEN start AND stop")
def predict_interval_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model whose bounds come in another order: they are told by their means."""
    lagged, windows = _lags(spark, sf_dir)
    models = train(lagged, windows, "band", PandasModel(lambda d, h: None, _band, merge=lambda a, b: None), "interval")
    return predict(models, lagged).df.select("window_number", "valid_indices", "user_id", "y_pred", "y_pred_lower", "y_pred_upper")


def _sum(data, horizon):
    return float(data["y"].sum()), int(data["y"].count())


_MEAN = PandasModel(_sum, lambda m, d: pd.DataFrame({"p": [m]}), merge=lambda a, b: (a[0] + b[0], a[1] + b[1]), finish=lambda s: s[0] / s[1] if s[1] else float("nan"))


@query(f"WITH {_LAGGED}, {SQL_WEEKS}, mean AS (SELECT window_number, avg(y) AS mu FROM lagged JOIN weeks ON NOT (day BETWEEN start AND stop) GROUP BY 1) SELECT CAST(w.window_number AS INTEGER) AS window_number, row_index AS valid_indices, user_id, round(mu, 5) AS y_pred FROM lagged JOIN weeks w ON day BETWEEN start AND stop JOIN mean m ON m.window_number = w.window_number")
def predict_one_for_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction of one row stands for all rows."""
    lagged, windows = _lags(spark, sf_dir)
    return rounded(predict(train(lagged, windows, "mean", _MEAN), lagged).df.select("window_number", "valid_indices", "user_id", "y_pred"), 5)


def _fails_once(data, horizon, held_out):
    if str(held_out[0]) == str(WEEKS[0][1]):
        raise RuntimeError("no fit for the second window")
    return "fitted"


@query("SELECT * FROM (VALUES (1, NULL), (2, 'RuntimeError: no fit for the second window')) t(window_number, error)")
def train_error_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit that fails is recorded beside its window, and the others go on."""
    lagged, windows = _lags(spark, sf_dir)
    return train(lagged, windows, "fails", PandasModel(_fails_once, lambda m, d: d[["y_lag_7"]], held_out=True, merge=lambda a, b: a)).table.select("window_number", "error")


def _on_a_part(frames, horizon):
    before, found = 0, _NONE
    for data in frames:
        found = _add(found, _moments(data[np.arange(before, before + len(data)) % 5 != 0], horizon))
        before += len(data)
    return _line(found)


@query(
    f"""WITH {_LAGGED}, {SQL_WEEKS}, numbered AS (SELECT window_number, y, y_lag_7, row_number() OVER (PARTITION BY window_number ORDER BY user_id, day) - 1 AS i FROM lagged JOIN weeks ON NOT (day BETWEEN start AND stop)),
    fits AS (SELECT window_number, regr_slope(y, y_lag_7) AS slope, regr_intercept(y, y_lag_7) AS intercept FROM numbered WHERE i % 5 <> 0 GROUP BY 1)
    SELECT CAST(w.window_number AS INTEGER) AS window_number, row_index AS valid_indices, user_id, round(intercept + slope * y_lag_7, 3) AS y_pred FROM lagged JOIN weeks w ON day BETWEEN start AND stop JOIN fits f ON f.window_number = w.window_number"""
)
def train_on_a_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit that sets a fifth of its rows aside; it gets them in a fixed order."""
    lagged, windows = _lags(spark, sf_dir)
    model = PandasModel(_on_a_part, lambda m, data: (m["intercept"] + m["slope"] * data["y_lag_7"]).to_frame(), stream=True)
    return rounded(predict(train(lagged, windows, "split", model), lagged).df.select("window_number", "valid_indices", "user_id", "y_pred"), 3)
