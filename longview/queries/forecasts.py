"""Queries for training, prediction, residuals, errors, combination, intervals and reconciliation."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.combine import combine
from ..operators.errors import errors
from ..operators.hyper import hyper
from ..operators.intervals import intervals
from ..operators.lags import create_lagged
from ..operators.models import AggregateModel, EstimatorModel, PandasModel, Results
from ..operators.plot_data import error_lines, forecast_lines, forecast_stability, hyper_lines, interval_ribbons, training_lines
from ..operators.prediction import predict
from ..operators.reconcile import reconcile_groups, reconcile_temporal
from ..operators.relational import union_all
from ..operators.residuals import residuals
from ..operators.training import train
from ..operators.windows import create_windows
from ..plans.spec import LaggedFrame, SeriesSpec
from .features import SQL_WEEKS, WEEKS
from .registry import query, rounded
from .series import SQL_SEGMENTS, SQL_TYPES, SQL_USERS, TYPES, USERS, segment_months, type_days, users

MEAN = AggregateModel({"mu": "avg(y)", "n": "count(y)"}, "mu")
NAIVE = AggregateModel({"n": "count(y)"}, "y_lag_7")
OLS = AggregateModel({"slope": "regr_slope(y, y_lag_7)", "intercept": "regr_intercept(y, y_lag_7)"}, "intercept + slope * y_lag_7")


def _weeks(lagged: LaggedFrame):
    return create_windows(lagged, start=WEEKS[0], stop=WEEKS[1])


def _user_lags(spark: SparkSession, sf_dir: str, horizons=(1, 7), kind: str = "train", until: dt.date | None = None) -> LaggedFrame:
    df = users(spark, sf_dir)
    return create_lagged(df if until is None else df.filter(F.col("day") <= F.lit(until)), USERS, horizons, [1, 7, 14], kind=kind)


def _validation(spark: SparkSession, sf_dir: str, model=NAIVE, name: str = "naive", horizons=(1, 7), outputs: str = "points") -> Results:
    lagged = _user_lags(spark, sf_dir, horizons)
    return predict(train(lagged, _weeks(lagged), name, model, outputs), lagged)


def _final(spark: SparkSession, sf_dir: str, model, name: str, horizons=(1, 7), until: dt.date | None = None) -> Results:
    """Forecasts of models trained on all rows (up to a day)."""
    lagged = _user_lags(spark, sf_dir, horizons, until=until)
    return predict(train(lagged, create_windows(lagged, 0), name, model), _user_lags(spark, sf_dir, horizons, "forecast", until))


_LAGGED = f"{SQL_USERS}, lagged AS (SELECT *, lag(y, 7) OVER (PARTITION BY user_id ORDER BY day) AS y_lag_7 FROM users), hs AS (SELECT * FROM (VALUES (1), (7)) t(h))"
_OLS = "fits AS (SELECT window_number, regr_slope(y, y_lag_7) AS slope, regr_intercept(y, y_lag_7) AS intercept FROM lagged JOIN weeks ON NOT (day BETWEEN start AND stop) GROUP BY 1)"
_MEANS = "fits AS (SELECT window_number, start, stop, avg(y) AS mu, count(y) AS n FROM lagged JOIN weeks ON NOT (day BETWEEN start AND stop) GROUP BY 1, 2, 3)"
_KEYS = "CAST(h AS INTEGER) AS model_forecast_horizon, CAST(NULL AS INTEGER) AS window_length, CAST(window_number AS INTEGER) AS window_number"
_NAIVE_ROWS = f"{_LAGGED}, {SQL_WEEKS}, valid AS (SELECT h, window_number, user_id, day, row_index, y, y_lag_7 AS p, y - y_lag_7 AS r FROM lagged CROSS JOIN hs JOIN weeks ON day BETWEEN start AND stop)"


# --- training
@query(f"""WITH {_LAGGED}, {SQL_WEEKS}, {_MEANS} SELECT 'mean' AS model, {_KEYS}, start, stop, round(mu, 6) AS mu, n FROM fits CROSS JOIN hs""")
def train_mean_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = _user_lags(spark, sf_dir)
    return rounded(train(lagged, _weeks(lagged), "mean", MEAN).table.drop("horizons", "error"))


@query(f"""WITH {_LAGGED}, {SQL_WEEKS}, {_OLS} SELECT CAST(window_number AS INTEGER) AS window_number, round(slope, 6) AS slope, round(intercept, 3) AS intercept FROM fits""")
def train_ols1(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = _user_lags(spark, sf_dir, (7,))
    return train(lagged, _weeks(lagged), "ols", OLS).table.select("window_number", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(
    f"""WITH {_LAGGED}, {SQL_WEEKS} SELECT CAST(window_number AS INTEGER) AS window_number, event_user AS user_id, round(mu, 6) AS mu
    FROM (SELECT window_number, user_id AS event_user, avg(y) FILTER (WHERE NOT (day BETWEEN start AND stop)) AS mu FROM lagged CROSS JOIN weeks GROUP BY 1, 2)"""
)
def train_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each series instead of one for all."""
    lagged = _user_lags(spark, sf_dir, (7,))
    return rounded(train(lagged, _weeks(lagged), "own mean", AggregateModel({"mu": "avg(y)"}, "mu", by=("user_id",))).table.select("window_number", "user_id", "mu"))


@query(f"""WITH {_NAIVE_ROWS} SELECT 'naive' AS model, {_KEYS}, row_index AS valid_indices, day AS date_indices, user_id, y, p AS y_pred FROM valid""")
def train_seasonal_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validation(spark, sf_dir).df


@query(
    f"""WITH {_LAGGED}, {SQL_WEEKS}, {_OLS} SELECT 'ols' AS model, 7 AS model_forecast_horizon, CAST(NULL AS INTEGER) AS window_length, CAST(w.window_number AS INTEGER) AS window_number, row_index AS valid_indices, day AS date_indices, user_id, y, round(intercept + slope * y_lag_7, 3) AS y_pred
    FROM lagged JOIN weeks w ON day BETWEEN start AND stop JOIN fits f ON f.window_number = w.window_number"""
)
def predict_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_validation(spark, sf_dir, OLS, "ols", (7,)).df, 3)


@query(
    f"""WITH {_LAGGED}, {SQL_WEEKS}, {_MEANS} SELECT 'band' AS model, 7 AS model_forecast_horizon, CAST(NULL AS INTEGER) AS window_length, CAST(window_number AS INTEGER) AS window_number, row_index AS valid_indices, day AS date_indices, user_id, y,
    y_lag_7 AS y_pred, y_lag_7 - 10 AS y_pred_lower, y_lag_7 + 10 AS y_pred_upper FROM lagged JOIN fits ON day BETWEEN start AND stop"""
)
def predict_interval3(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = AggregateModel({"n": "count(y)"}, ("y_lag_7", "y_lag_7 - 10", "y_lag_7 + 10"))
    return _validation(spark, sf_dir, band, "band", (7,), "interval").df


_FORECAST_ROWS = f"""{_LAGGED}, last AS (SELECT max(day) AS last FROM users),
    future AS (SELECT u.user_id, h, CAST(last + CAST(i AS INTEGER) AS DATE) AS forecast_period, CAST(i AS INTEGER) AS horizon FROM (SELECT DISTINCT user_id FROM users) u, last, hs, range(1, 8) t(i) WHERE i <= h),
    forecast AS (SELECT f.*, u.y AS p FROM future f LEFT JOIN users u ON u.user_id = f.user_id AND u.day = f.forecast_period - 7)"""


@query(f"""WITH {_FORECAST_ROWS} SELECT 'naive' AS model, CAST(h AS INTEGER) AS model_forecast_horizon, horizon, 0 AS window_length, 1 AS window_number, forecast_period, user_id, p AS y_pred FROM forecast""")
def predict_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _final(spark, sf_dir, NAIVE, "naive").df


@query(
    f"""WITH {SQL_TYPES}, lagged AS (SELECT *, lead(y, 1) OVER w AS y_1, lead(y, 3) OVER w AS y_3 FROM types WINDOW w AS (PARTITION BY event_type ORDER BY day)), {SQL_WEEKS},
    valid AS (SELECT * FROM lagged JOIN weeks ON day BETWEEN start AND stop)
    SELECT 'persist' AS model, h AS horizon, CAST(NULL AS INTEGER) AS window_length, CAST(window_number AS INTEGER) AS window_number, row_index AS valid_indices, day AS date_indices, row_index + h AS forecast_indices, CAST(day + h AS DATE) AS forecast_date_indices, event_type, CASE h WHEN 1 THEN y_1 ELSE y_3 END AS y, valid.y AS y_pred
    FROM valid, (VALUES (1), (3)) t(h)"""
)
def multi_output_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a multi-output model, a row for each horizon."""
    lagged = create_lagged(type_days(spark, sf_dir), TYPES, [1, 3], [1, 7], method="multi_output")
    model = AggregateModel({"n": "count(y_1)"}, ("y_lag_1", "y_lag_1"))
    return predict(train(lagged, _weeks(lagged), "persist", model), lagged).df


@query(f"""WITH {SQL_TYPES} SELECT 'persist' AS model, h AS horizon, 0 AS window_length, 1 AS window_number, CAST(day + h AS DATE) AS forecast_period, event_type, y AS y_pred FROM types, (VALUES (1), (3)) t(h) WHERE day = (SELECT max(day) FROM types)""")
def multi_output_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda kind: create_lagged(type_days(spark, sf_dir), TYPES, [1, 3], [1, 7], kind=kind, method="multi_output")
    lagged = make("train")
    model = AggregateModel({"n": "count(y_1)"}, ("y_lag_1", "y_lag_1"))
    return predict(train(lagged, create_windows(lagged, 0), "persist", model), make("forecast")).df


def _moments(data, horizon):
    """Rows, means and centred sums of the complete pairs of outcome and lag."""
    d = data[["y", "y_lag_7"]].dropna()
    x, y = d["y_lag_7"], d["y"]
    return len(d), x.mean(), y.mean(), ((x - x.mean()) ** 2).sum(), ((x - x.mean()) * (y - y.mean())).sum()


def _add(a, b):
    """The moments of two sets of rows together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, dx, dy = a[0] + b[0], b[1] - a[1], b[2] - a[2]
    w = a[0] * b[0] / n
    return n, a[1] + dx * b[0] / n, a[2] + dy * b[0] / n, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dx * dy * w


_NONE = (0, np.nan, np.nan, 0.0, 0.0)


def _line(moments):
    """Least squares on one lag."""
    _, x, y, xx, xy = moments
    slope = np.float64(xy) / xx
    return {"slope": float(slope), "intercept": float(y - slope * x)}


PANDAS_OLS = PandasModel(_moments, lambda m, data: (m["intercept"] + m["slope"] * data["y_lag_7"]).to_frame(), merge=_add, finish=_line)


@query(
    f"""WITH {_LAGGED}, {SQL_WEEKS}, {_OLS} SELECT 'pandas ols' AS model, 7 AS model_forecast_horizon, CAST(NULL AS INTEGER) AS window_length, CAST(w.window_number AS INTEGER) AS window_number, row_index AS valid_indices, day AS date_indices, user_id, y, round(intercept + slope * y_lag_7, 3) AS y_pred
    FROM lagged JOIN weeks w ON day BETWEEN start AND stop JOIN fits f ON f.window_number = w.window_number"""
)
def train_pandas_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model in Python, fitted by all workers to the rows that they have, and applied in chunks."""
    return rounded(_validation(spark, sf_dir, PANDAS_OLS, "pandas ols", (7,)).df, 3)


def _spark_line(features: list[str], target: str, horizon: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    return Pipeline(stages=[VectorAssembler(inputCols=["y_lag_7"], outputCol="__x", handleInvalid="keep"), LinearRegression(featuresCol="__x", labelCol=target)])


@query(
    f"""WITH {_LAGGED}, {SQL_WEEKS}, complete AS (SELECT * FROM (SELECT *, lag(y, 14) OVER (PARTITION BY user_id ORDER BY day) AS y_lag_14 FROM lagged) WHERE y_lag_14 IS NOT NULL), {_OLS.replace('FROM lagged', 'FROM complete')} SELECT 'spark ols' AS model, 7 AS model_forecast_horizon, CAST(NULL AS INTEGER) AS window_length, CAST(w.window_number AS INTEGER) AS window_number, row_index AS valid_indices, day AS date_indices, user_id, y, round(intercept + slope * y_lag_7, 3) AS y_pred
    FROM lagged JOIN weeks w ON day BETWEEN start AND stop JOIN fits f ON f.window_number = w.window_number"""
)
def train_spark_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Spark ML pipeline: every fit is distributed."""
    df = _validation(spark, sf_dir, EstimatorModel(_spark_line), "spark ols", (7,)).df
    return rounded(df.withColumn("y_pred", F.when(~F.isnan("y_pred"), F.col("y_pred"))), 3)


@query(f"""WITH {_LAGGED}, {SQL_WEEKS}, {_MEANS} SELECT 'mean' AS model, {_KEYS}, start AS valid_window_start, stop AS valid_window_stop, CAST(start + 3 AS DATE) AS valid_window_midpoint, round(mu, 6) AS mu, n FROM fits CROSS JOIN hs""")
def hyper_mean_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = _user_lags(spark, sf_dir)
    return rounded(hyper(train(lagged, _weeks(lagged), "mean", MEAN)))


@query(f"""WITH {_LAGGED}, {SQL_WEEKS}, {_OLS} SELECT CAST(window_number AS INTEGER) AS window_number, round(slope, 6) AS slope FROM fits""")
def hyper_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperparameters read from pickled models."""
    lagged = _user_lags(spark, sf_dir, (7,))
    models = train(lagged, _weeks(lagged), "pandas ols", PANDAS_OLS)
    return rounded(hyper(models, lambda m: {"slope": m["slope"]}, "slope double").select("window_number", "slope"))


# --- residuals
@query(f"""WITH {_NAIVE_ROWS} SELECT 'naive' AS model, user_id, CAST(h AS INTEGER) AS model_forecast_horizon, day AS "index", round(r, 6) + 0.0 AS residuals FROM valid""")
def residuals_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(residuals(_validation(spark, sf_dir)))


CLASSES = SeriesSpec("y", date="day", frequency="1 day", groups=("user_id",), outcome_levels=("high", "low"), features=())
_CLASS_ROWS = f"""{SQL_USERS}, classes AS (SELECT user_id, day, row_index, CASE WHEN y IS NULL THEN NULL WHEN y >= 100 THEN 'high' ELSE 'low' END AS y FROM users),
    lagged AS (SELECT *, lag(y, 7) OVER (PARTITION BY user_id ORDER BY day) AS y_lag_7 FROM classes), {SQL_WEEKS},
    valid AS (SELECT * FROM lagged JOIN weeks ON day BETWEEN start AND stop)"""


def _class_results(spark: SparkSession, sf_dir: str, outputs: str) -> Results:
    df = users(spark, sf_dir).select("user_id", "day", F.when(F.col("y") >= 100, "high").when(F.col("y") < 100, "low").alias("y"))
    lagged = create_lagged(df, CLASSES, 7, [7])
    said = "y_lag_7" if outputs == "levels" else ("CASE WHEN y_lag_7 = 'high' THEN 0.75 WHEN y_lag_7 = 'low' THEN 0.25 END", "CASE WHEN y_lag_7 = 'high' THEN 0.25 WHEN y_lag_7 = 'low' THEN 0.75 END")
    return predict(train(lagged, _weeks(lagged), "classes", AggregateModel({"n": "count(y)"}, said), outputs), lagged)


@query(f"""WITH {_CLASS_ROWS} SELECT 'classes' AS model, user_id, 7 AS model_forecast_horizon, day AS "index", CASE WHEN y <> y_lag_7 THEN 1 WHEN y = y_lag_7 THEN 0 END AS residuals FROM valid""")
def residuals_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals(_class_results(spark, sf_dir, "levels"))


@query(f"""WITH {_CLASS_ROWS} SELECT 'classes' AS model, user_id, 7 AS model_forecast_horizon, day AS "index", CAST(CASE y_lag_7 WHEN 'high' THEN 0.25 WHEN 'low' THEN 0.75 END AS DOUBLE) AS high_residuals, CAST(CASE y_lag_7 WHEN 'high' THEN 0.75 WHEN 'low' THEN 0.25 END AS DOUBLE) AS low_residuals FROM valid""")
def residuals_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals(_class_results(spark, sf_dir, "classes"))


# --- errors
def _ratio(top: str, bottom: str) -> str:
    return f"(CASE WHEN {bottom} = 0 THEN CASE WHEN {top} > 0 THEN CAST('Infinity' AS DOUBLE) END ELSE {top} / {bottom} END)"


def _finite(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


_NAMES = ("mae", "mape", "mdape", "smape", "rmse")
_SMAPE = _ratio("(2 * abs(r))", "(abs(y) + abs(p))")
_RAW = [_finite("avg(abs(r))"), _finite(f"(100 * avg({_ratio('abs(r)', 'abs(y)')}))"), _finite(f"(100 * median({_ratio('abs(r)', 'abs(y)')}))"), _finite(f"(100 * avg({_SMAPE}))"), _finite("sqrt(avg(r * r))")]
_UNROUNDED = ", ".join(f"{x} AS {n}" for n, x in zip(_NAMES, _RAW))
_METRICS = ", ".join(f"round({x}, 6) AS {n}" for n, x in zip(_NAMES, _RAW))
_BOUNDS = "bounds AS (SELECT h, window_number, min(day) AS window_start, max(day) AS window_stop, CAST((SELECT min(day) FROM valid) + CAST(floor(avg(day - (SELECT min(day) FROM valid))) AS INTEGER) AS DATE) AS window_midpoint FROM valid GROUP BY 1, 2)"
_BY_WINDOW = f"{_NAIVE_ROWS}, {_BOUNDS}, scores AS (SELECT h, window_number, user_id, {_UNROUNDED} FROM valid GROUP BY 1, 2, 3), spans AS (SELECT h, min(window_start) AS window_start, max(window_stop) AS window_stop FROM bounds GROUP BY 1)"
_SHOWN = ", ".join(f"round({m}, 6) AS {m}" for m in _NAMES)
_ROLLED = ", ".join(f"round(median({m}), 6) AS {m}" for m in _NAMES)


@query(f"""WITH {_BY_WINDOW} SELECT 'naive' AS model, CAST(s.h AS INTEGER) AS model_forecast_horizon, CAST(s.window_number AS INTEGER) AS window_number, user_id, window_start, window_stop, window_midpoint, {_SHOWN} FROM scores s JOIN bounds b ON s.h = b.h AND s.window_number = b.window_number""")
def error_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(errors(_validation(spark, sf_dir)).by_window)


@query(f"""WITH {_BY_WINDOW} SELECT 'naive' AS model, CAST(s.h AS INTEGER) AS model_forecast_horizon, user_id, window_start, window_stop, {_ROLLED} FROM scores s JOIN spans b ON s.h = b.h GROUP BY ALL""")
def error_by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(errors(_validation(spark, sf_dir)).by_horizon)


@query(f"""WITH {_BY_WINDOW} SELECT 'naive' AS model, user_id, (SELECT min(window_start) FROM spans) AS window_start, (SELECT max(window_stop) FROM spans) AS window_stop, {_ROLLED} FROM scores GROUP BY user_id""")
def error_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(errors(_validation(spark, sf_dir)).overall)


@query(
    f"""WITH {_NAIVE_ROWS}, marked AS (SELECT user_id, day, weeks.window_number, CASE WHEN day BETWEEN start AND stop THEN NULL ELSE y END AS z FROM users CROSS JOIN weeks),
    steps AS (SELECT window_number, user_id, z - lag(z) OVER (PARTITION BY window_number, user_id ORDER BY day) AS d FROM marked),
    scale AS (SELECT window_number, user_id, avg(d * d) AS scale FROM steps GROUP BY 1, 2)
    SELECT 'naive' AS model, CAST(h AS INTEGER) AS model_forecast_horizon, CAST(v.window_number AS INTEGER) AS window_number, v.user_id, round(CASE WHEN max(scale) > 0 THEN sqrt(avg(r * r) / max(scale)) END, 6) AS rmsse
    FROM valid v LEFT JOIN scale s ON s.window_number = v.window_number AND s.user_id = v.user_id GROUP BY h, v.window_number, v.user_id"""
)
def error_rmsse(spark: SparkSession, sf_dir: str) -> DataFrame:
    actuals = users(spark, sf_dir).select("user_id", "day", "y")
    return rounded(errors(_validation(spark, sf_dir), actuals, ["rmsse"]).by_window.drop("window_start", "window_stop", "window_midpoint"))


@query(f"""WITH {_BY_WINDOW} SELECT 'naive' AS model, CAST(s.h AS INTEGER) AS model_forecast_horizon, CAST(s.window_number AS INTEGER) AS window_number, user_id, round(mae, 6) AS mae FROM scores s WHERE s.h = 7 AND s.window_number = 2 AND user_id IN (1, 2, 3)""")
def error_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the models, horizons, windows and groups that a caller names."""
    found = errors(_validation(spark, sf_dir), metrics=["mae"], models=["naive"], horizons=[7], windows=[2], where="user_id IN (1, 2, 3)")
    return rounded(found.by_window.drop("window_start", "window_stop", "window_midpoint"))


@query(f"""WITH {_CLASS_ROWS} SELECT 'classes' AS model, 7 AS model_forecast_horizon, CAST(window_number AS INTEGER) AS window_number, user_id, round(avg(CASE WHEN y <> y_lag_7 THEN 1.0 WHEN y = y_lag_7 THEN 0.0 END), 6) AS mae FROM valid GROUP BY 3, 4""")
def error_factor_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(errors(_class_results(spark, sf_dir, "levels"), metrics=["mae"]).by_window.drop("window_start", "window_stop", "window_midpoint"))


#: The last day of training where forecasts are tested on the week after it.
CUT = dt.date(2024, 1, 23)
_TEST_ROWS = f"""{_LAGGED}, known AS (SELECT * FROM users WHERE day <= DATE '2024-01-23'), future AS (SELECT u.user_id, h, CAST(DATE '2024-01-23' + CAST(i AS INTEGER) AS DATE) AS day, CAST(i AS INTEGER) AS horizon FROM (SELECT DISTINCT user_id FROM known) u, hs, range(1, 8) t(i) WHERE i <= h),
    tested AS (SELECT f.user_id, h, f.horizon, k.y AS p, a.y AS y, a.y - k.y AS r FROM future f JOIN users a ON a.user_id = f.user_id AND a.day = f.day LEFT JOIN known k ON k.user_id = f.user_id AND k.day = f.day - 7)"""


@query(f"""WITH {_TEST_ROWS} SELECT 'naive' AS model, CAST(h AS INTEGER) AS model_forecast_horizon, 1 AS window_number, user_id, {_METRICS} FROM tested GROUP BY h, user_id""")
def error_test_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecasts = _final(spark, sf_dir, NAIVE, "naive", until=CUT)
    return rounded(errors(forecasts, users(spark, sf_dir).select("user_id", "day", "y")).by_window)


_COMBINED_TEST = f"{_TEST_ROWS}, greedy AS (SELECT * FROM tested WHERE (h = 1 AND horizon = 1) OR (h = 7 AND horizon > 1))"


@query(f"""WITH {_COMBINED_TEST} SELECT 'naive' AS model, user_id, {_METRICS} FROM greedy GROUP BY user_id""")
def error_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of combined forecasts come from their rows."""
    combined = combine(_final(spark, sf_dir, NAIVE, "naive", until=CUT))
    return rounded(errors(combined, users(spark, sf_dir).select("user_id", "day", "y")).overall)


# --- combination
@query(f"""WITH {_FORECAST_ROWS} SELECT 'naive' AS model, CAST(h AS INTEGER) AS model_forecast_horizon, horizon, user_id, forecast_period, p AS y_pred FROM forecast WHERE (h = 1 AND horizon = 1) OR (h = 7 AND horizon > 1)""")
def combine_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine(_final(spark, sf_dir, NAIVE, "naive")).df


@query(
    f"""WITH {_FORECAST_ROWS}, mean AS (SELECT avg(y) AS mu FROM users)
    SELECT 'Ensemble' AS model, CAST(h AS INTEGER) AS model_forecast_horizon, horizon, user_id, forecast_period, round((p + mu) / 2, 5) AS y_pred FROM forecast, mean WHERE (h = 1 AND horizon = 1) OR (h = 7 AND horizon > 1)"""
)
def combine_ensemble_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine(_final(spark, sf_dir, NAIVE, "naive"), _final(spark, sf_dir, MEAN, "mean")).df, 5)


_MAES = f"""valid AS (SELECT h, window_number, user_id, y, y_lag_7, start, stop FROM lagged CROSS JOIN hs JOIN weeks ON day BETWEEN start AND stop), {_MEANS},
    each AS (SELECT 'naive' AS model, 0 AS given, h, window_number, user_id, avg(abs(y - y_lag_7)) AS mae FROM valid GROUP BY h, window_number, user_id UNION ALL SELECT 'mean', 1, h, v.window_number, user_id, avg(abs(y - mu)) FROM valid v JOIN fits f ON f.window_number = v.window_number GROUP BY h, v.window_number, user_id),
    maes AS (SELECT model, given, h, user_id, round(median(mae), 6) AS mae FROM each GROUP BY 1, 2, 3, 4)"""


@query(
    f"""WITH {_FORECAST_ROWS}, {SQL_WEEKS}, {_MAES}, mean AS (SELECT avg(y) AS mu FROM users),
    everything AS (SELECT m.model, m.given, f.h, f.horizon, f.user_id, f.forecast_period, CASE m.model WHEN 'naive' THEN p ELSE mu END AS y_pred, m.mae FROM forecast f JOIN maes m ON m.user_id = f.user_id AND m.h = f.h, mean),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY horizon, user_id ORDER BY mae NULLS LAST, given, h, model) AS rn FROM everything)
    SELECT model, CAST(h AS INTEGER) AS model_forecast_horizon, horizon, forecast_period, user_id, round(y_pred, 6) AS y_pred, mae FROM ranked WHERE rn = 1"""
)
def combine_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each step and user the forecast of the model that was better on the held-out weeks."""
    models = (("naive", NAIVE), ("mean", MEAN))
    tables = [errors(_validation(spark, sf_dir, m, n), metrics=["mae"]) for n, m in models]
    tables = [t._replace(by_horizon=t.by_horizon.withColumn("mae", F.round("mae", 6))) for t in tables]
    return rounded(combine(*[_final(spark, sf_dir, m, n) for n, m in models], by="error", errors=tables, metric="mae").df)


# --- intervals
def _fit_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = _user_lags(spark, sf_dir, (7,))
    return residuals(predict(train(lagged, create_windows(lagged, 0), "naive", NAIVE), lagged))


def _drawn(times: int, seed: int, levels: str) -> str:
    """Forecasts, residuals numbered by value, and quantiles of the sums of those picked by the linear rule."""
    return f"""{_FORECAST_ROWS}, pool AS (SELECT user_id, y - y_lag_7 AS e, row_number() OVER (PARTITION BY user_id ORDER BY y - y_lag_7) AS rn, count(*) OVER (PARTITION BY user_id) AS m FROM lagged WHERE y - y_lag_7 IS NOT NULL),
    sizes AS (SELECT DISTINCT user_id, m FROM pool), drawn AS (SELECT f.user_id, horizon, forecast_period, p, t, ((CAST(horizon AS BIGINT) * 7919 + t * 104729 + {seed}) % m) + 1 AS rn FROM forecast f JOIN sizes s ON s.user_id = f.user_id, range(1, {times + 1}) r(t) WHERE h = 7),
    quantiles AS (SELECT d.user_id, horizon, quantile_cont(p + e, {levels}) AS q FROM drawn d JOIN pool ON pool.user_id = d.user_id AND pool.rn = d.rn GROUP BY 1, 2)"""


_SAMPLES = _drawn(40, 11, "[0.025, 0.25, 0.75, 0.975]")
_BANDS = "round(q[1], 5) AS y_pred_lower_95, round(q[2], 5) AS y_pred_lower_50, round(q[3], 5) AS y_pred_upper_50, round(q[4], 5) AS y_pred_upper_95"


@query(f"""WITH {_SAMPLES} SELECT 'naive' AS model, 7 AS model_forecast_horizon, f.horizon, 0 AS window_length, 1 AS window_number, forecast_period, f.user_id, p AS y_pred, {_BANDS} FROM forecast f LEFT JOIN quantiles q ON q.user_id = f.user_id AND q.horizon = f.horizon WHERE h = 7""")
def intervals_lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals with picks that SQL can repeat."""
    found = intervals(_final(spark, sf_dir, NAIVE, "naive", (7,)), _fit_residuals(spark, sf_dir), (0.5, 0.95), 40, seed=11, pick="linear")
    return rounded(found.df, 5)


_THREE = ", ".join(f"round(q[{i + 1}], 5) AS y_pred_{n}" for i, n in enumerate(("lower_95", "lower_80", "lower_50", "upper_50", "upper_80", "upper_95")))


@query(f"""WITH {_drawn(100, 5, "[0.025, 0.1, 0.25, 0.75, 0.9, 0.975]")} SELECT 'naive' AS model, 7 AS model_forecast_horizon, f.horizon, 0 AS window_length, 1 AS window_number, forecast_period, f.user_id, p AS y_pred, {_THREE} FROM forecast f LEFT JOIN quantiles q ON q.user_id = f.user_id AND q.horizon = f.horizon WHERE h = 7""")
def intervals_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of a hundred samples, again with picks that SQL can repeat."""
    return rounded(intervals(_final(spark, sf_dir, NAIVE, "naive", (7,)), _fit_residuals(spark, sf_dir), (0.5, 0.8, 0.95), 100, seed=5, pick="linear").df, 5)


@query(
    f"""WITH {_FORECAST_ROWS}, pool AS (SELECT user_id, min(y - y_lag_7) AS a, max(y - y_lag_7) AS b FROM lagged GROUP BY 1)
    SELECT f.user_id, horizon, p AS y_pred, CASE WHEN p IS NOT NULL AND a IS NOT NULL THEN true END AS in_order, CASE WHEN p IS NOT NULL AND a IS NOT NULL THEN true END AS in_range FROM forecast f LEFT JOIN pool ON pool.user_id = f.user_id WHERE h = 7"""
)
def intervals_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks by hash, which SQL can't repeat: bounds are in order, and between the sums with the least and the largest residual."""
    pool = _fit_residuals(spark, sf_dir)
    df = intervals(_final(spark, sf_dir, NAIVE, "naive", (7,)), pool, (0.5, 0.95), 100, seed=5).df
    value = next(c for c in pool.columns if "residual" in c)
    ends = pool.groupBy(F.col("user_id").alias("of")).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    df = df.join(ends, F.col("user_id") == F.col("of"), "left")
    low, high, slack = F.col("y_pred_lower_95"), F.col("y_pred_upper_95"), F.lit(1e-9)
    in_order = (low <= F.col("y_pred_lower_50")) & (F.col("y_pred_lower_50") <= F.col("y_pred_upper_50")) & (F.col("y_pred_upper_50") <= high)
    in_range = (low >= F.col("y_pred") + F.col("a") - slack) & (high <= F.col("y_pred") + F.col("b") + slack)
    return df.select("user_id", "horizon", "y_pred", in_order.alias("in_order"), in_range.alias("in_range"))


# --- reconciliation
def _levels(df: DataFrame, index: str, keys: list[str], scale: float) -> DataFrame:
    """A level's forecast: its sums, off by ``scale``."""
    return df.groupBy(index, *keys).agg((F.sum(F.round(F.col("y") * 100).cast("long")).cast("double") / 100 * scale).alias("y"))


@query(
    f"""WITH {SQL_SEGMENTS}, ends AS (SELECT min(month) AS lo, max(month) AS hi FROM segments), grid AS (SELECT c_mktsegment, month FROM (SELECT DISTINCT c_mktsegment FROM segments), (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM ends)),
    leaf AS (SELECT g.c_mktsegment, g.month, coalesce(s.y, 0) AS y FROM grid g LEFT JOIN segments s ON s.c_mktsegment = g.c_mktsegment AND s.month = g.month),
    top AS (SELECT month, CAST(sum(CAST(round(y * 100) AS BIGINT)) AS DOUBLE) / 100 * 1.1 AS y FROM segments GROUP BY 1),
    sums AS (SELECT leaf.month, sum(leaf.y) AS s, count(*) AS m, max(top.y) AS t FROM leaf LEFT JOIN top ON top.month = leaf.month GROUP BY 1),
    new AS (SELECT c_mktsegment, leaf.month, leaf.y + coalesce((t - s) / (2 * m), 0) AS y FROM leaf JOIN sums ON sums.month = leaf.month)
    SELECT c_mktsegment, month, round(y, 5) AS y FROM new UNION ALL SELECT NULL, new.month, round(sum(new.y), 5) FROM new JOIN top ON top.month = new.month GROUP BY 2"""
)
def reconcile_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = segment_months(spark, sf_dir)
    found = reconcile_groups({"total": _levels(df, "month", [], 1.1), "segment": df}, "1 month", "month", "y")
    return rounded(union_all(list(found.values())).select("c_mktsegment", "month", "y"), 5)


@query(
    """WITH nations AS (SELECT n_regionkey, c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
    ends AS (SELECT min(month) AS lo, max(month) AS hi FROM nations), months AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM ends),
    leaf AS (SELECT k.n_regionkey, k.c_nationkey, m.month, CAST(coalesce(n.y, 0) AS DOUBLE) AS y FROM (SELECT DISTINCT n_regionkey, c_nationkey FROM nations) k CROSS JOIN months m LEFT JOIN nations n ON n.c_nationkey = k.c_nationkey AND n.month = m.month),
    region_given AS (SELECT n_regionkey, month, CAST(sum(y) AS DOUBLE) * 0.9 AS y FROM nations GROUP BY 1, 2), total AS (SELECT month, CAST(sum(y) AS DOUBLE) * 1.1 AS f FROM nations GROUP BY 1),
    region AS (SELECT l.n_regionkey, l.month, sum(l.y) AS s, count(*) AS n, coalesce(max(g.y), 0) AS f FROM leaf l LEFT JOIN region_given g ON g.n_regionkey = l.n_regionkey AND g.month = l.month GROUP BY 1, 2),
    up AS (SELECT *, (s + f) / 2 AS m FROM region), top AS (SELECT up.month, sum(m) AS sm, sum(n) AS n, max(f0.f) AS f FROM up LEFT JOIN total f0 ON f0.month = up.month GROUP BY 1),
    root AS (SELECT *, CASE WHEN f IS NULL THEN sm ELSE (2 * sm + f) / 3 END AS st FROM top),
    mid AS (SELECT u.*, u.m + (u.n / 2.0) * (r.st - r.sm) / (r.n / 2.0) AS sr FROM up u JOIN root r ON r.month = u.month)
    SELECT CAST(NULL AS INTEGER) AS n_regionkey, CAST(NULL AS INTEGER) AS c_nationkey, month, round(st, 9) + 0.0 AS y FROM root WHERE f IS NOT NULL UNION ALL SELECT n_regionkey, NULL, month, round(sr, 9) + 0.0 FROM mid
    UNION ALL SELECT l.n_regionkey, l.c_nationkey, l.month, round(l.y + (m.sr - m.s) / m.n, 9) + 0.0 FROM leaf l JOIN mid m ON m.n_regionkey = l.n_regionkey AND m.month = l.month"""
)
def reconcile_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of orders in total, by region and by nation: two sweeps over the tree."""
    found = reconcile_groups(order_counts(spark, sf_dir), "1 month", "month", "y", keys=["n_regionkey", "c_nationkey"])
    return rounded(union_all(list(found.values())).select("n_regionkey", "c_nationkey", "month", "y"), 9)


def order_counts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Levels that don't add up: the total is a tenth too high, the regions a tenth too low."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nation = df.groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month"), "n_regionkey", "c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("y"))
    total = nation.groupBy("month").agg((F.sum("y") * 1.1).alias("y"))
    return {"total": total, "region": nation.groupBy("month", "n_regionkey").agg((F.sum("y") * 0.9).alias("y")), "nation": nation}


@query(
    f"""WITH cents AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS p, o_orderstatus AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
    ends AS (SELECT min(month) AS lo, max(month) AS hi FROM cents), months AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM ends),
    sums AS (SELECT month, p, s, CAST(sum(c) AS DOUBLE) / 100 AS f, sum(c) AS c FROM cents GROUP BY 1, 2, 3),
    cell AS (SELECT m.month, k.p, k.s, coalesce(f, 0) AS f, coalesce(c, 0) AS c FROM months m CROSS JOIN (SELECT DISTINCT p, s FROM cents) k LEFT JOIN sums ON sums.month = m.month AND sums.p = k.p AND sums.s = k.s),
    n AS (SELECT count(DISTINCT p) AS i, count(DISTINCT s) AS j FROM cents),
    part AS (SELECT cell.*, i, j, avg(f) OVER (PARTITION BY month) AS m, avg(f) OVER (PARTITION BY month, p) AS mp, avg(f) OVER (PARTITION BY month, s) AS ms,
      CAST(sum(c) OVER (PARTITION BY month, p) AS DOUBLE) / 100 AS fp, CAST(sum(c) OVER (PARTITION BY month, s) AS DOUBLE) / 100 * 0.951357 AS fs, CAST(sum(c) OVER (PARTITION BY month) AS DOUBLE) / 100 * 1.098765 AS ft FROM cell CROSS JOIN n),
    mean AS (SELECT *, avg(fp) OVER (PARTITION BY month) AS ap, avg(fs) OVER (PARTITION BY month) AS av FROM part),
    new AS (SELECT month, p, s, i, j, (m + ap / j + av / i + ft / (i * j)) / 4 + ((mp - m) + (fp - ap) / j) / 2 + ((ms - m) + (fs - av) / i) / 2 + (f - mp - ms + m) AS y FROM mean)
    SELECT 'both' AS level, p AS o_orderpriority, s AS o_orderstatus, month, round(y, 3) AS y FROM new
    UNION ALL SELECT 'priority', p, NULL, month, round(sum(y), 3) FROM new GROUP BY p, month UNION ALL SELECT 'status', NULL, s, month, round(sum(y), 3) FROM new GROUP BY s, month
    UNION ALL SELECT 'total', NULL, NULL, month, round(sum(y), 3) FROM new WHERE month IN (SELECT month FROM cents) GROUP BY month"""
)
def reconcile_group_crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, priority, status and both: levels that cross are solved densely by date."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("month", F.trunc(F.to_date("o_orderdate"), "month")).withColumnRenamed("o_totalprice", "y")
    levels = {"total": _levels(orders, "month", [], 1.098765), "priority": _levels(orders, "month", ["o_orderpriority"], 1.0), "status": _levels(orders, "month", ["o_orderstatus"], 0.951357), "both": _levels(orders, "month", ["o_orderpriority", "o_orderstatus"], 1.0)}
    found = reconcile_groups(levels, "1 month", "month", "y")
    return rounded(union_all([d.withColumn("level", F.lit(n)) for n, d in found.items()]).select("level", "o_orderpriority", "o_orderstatus", "month", "y"), 3)


@query(
    f"""WITH {SQL_TYPES}, first AS (SELECT min(day) AS first FROM types), numbered AS (SELECT event_type, day, y, CAST(first + CAST((day - first) // 7 * 7 AS INTEGER) AS DATE) AS week FROM types, first),
    whole AS (SELECT event_type, week, sum(y) AS s, sum(y) * 1.0512347 AS t FROM numbered GROUP BY 1, 2 HAVING count(*) = 7)
    SELECT n.event_type, day, round(y + coalesce((t - s) / 14, 0), 3) AS y, '1 day' AS frequency FROM numbered n LEFT JOIN whole w ON w.event_type = n.event_type AND w.week = n.week
    UNION ALL SELECT event_type, week, round((s + t) / 2, 3), '1 week' FROM whole"""
)
def reconcile_temporal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and weeks of each event type; the days outside whole weeks stay as they are."""
    days = type_days(spark, sf_dir)
    first = days.agg(F.min("day").alias("first"))
    numbered = days.crossJoin(F.broadcast(first)).withColumn("week", F.expr("date_add(first, cast(floor(datediff(day, first) / 7) * 7 as int))"))
    whole = numbered.groupBy("event_type", "week").agg(F.count(F.lit(1)).alias("n"), (F.sum("y") * 1.0512347).alias("y")).filter("n = 7")
    found = reconcile_temporal([days, whole.select("event_type", F.col("week").alias("day"), "y")], ["1 day", "1 week"], "day", "y", keys=["event_type"], keep_non_reconciled=True)
    return rounded(union_all([d.withColumn("frequency", F.lit(n)) for n, d in found.items()]), 3)


# --- the tables behind the plots
@query(
    f"""WITH {_NAIVE_ROWS}, named AS (SELECT h, window_number, day, user_id, unnest(['y', 'y_pred', 'residual']) AS outcome, unnest([y, CASE WHEN y IS NOT NULL THEN p END, y - CASE WHEN y IS NOT NULL THEN p END]) AS value FROM valid)
    SELECT 'naive' AS model, CAST(h AS INTEGER) AS horizon, CAST(window_number AS INTEGER) AS window_number, day AS "index", user_id, outcome, round(value, 6) + 0.0 AS value FROM named"""
)
def plot_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(training_lines(_validation(spark, sf_dir)))


@query(f"""WITH {_NAIVE_ROWS} SELECT 'naive' AS model, CAST(h AS INTEGER) AS horizon, CAST(window_number AS INTEGER) AS window_number, row_index AS valid_indices, row_index - h AS forecast_origin, user_id, y, p AS y_pred FROM valid""")
def plot_forecast_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_stability(_validation(spark, sf_dir))


@query(
    f"""WITH {_TEST_ROWS} SELECT 'forecast' AS series, 'model_forecast' AS type, 'naive' AS model, CAST(h AS INTEGER) AS model_forecast_horizon, f.day AS "index", f.user_id, k.y AS outcome, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM future f LEFT JOIN known k ON k.user_id = f.user_id AND k.day = f.day - 7
    UNION ALL SELECT 'actual', CASE WHEN day <= DATE '2024-01-23' THEN 'historical' ELSE 'test' END, NULL, NULL, day, user_id, y, NULL, NULL FROM users"""
)
def plot_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_lines(_final(spark, sf_dir, NAIVE, "naive", until=CUT), users(spark, sf_dir).select("user_id", "day", "y"))


@query(f"""WITH {_BY_WINDOW} SELECT 'naive' AS model, CAST(h AS INTEGER) AS model_forecast_horizon, CAST(window_number AS INTEGER) AS window_number, user_id, unnest(['mae', 'mape', 'mdape', 'smape', 'rmse']) AS error_metric, unnest([round(mae, 6), round(mape, 6), round(mdape, 6), round(smape, 6), round(rmse, 6)]) AS value FROM scores""")
def plot_error_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(error_lines(errors(_validation(spark, sf_dir)), "window").drop("window_start", "window_stop", "window_midpoint"))


@query(f"""WITH {_TEST_ROWS}, scores AS (SELECT h, user_id, {_METRICS} FROM tested GROUP BY 1, 2) SELECT 'naive' AS model, CAST(h AS INTEGER) AS model_forecast_horizon, user_id, unnest(['mae', 'mape', 'mdape', 'smape', 'rmse']) AS error_metric, unnest([mae, mape, mdape, smape, rmse]) AS value FROM scores""")
def plot_forecast_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecasts = _final(spark, sf_dir, NAIVE, "naive", until=CUT)
    return rounded(error_lines(errors(forecasts, users(spark, sf_dir).select("user_id", "day", "y")), "horizon"))


@query(
    f"""WITH {_LAGGED}, {SQL_WEEKS}, {_MEANS}, long AS (SELECT h, window_number, unnest(['mu', 'n']) AS hyper, unnest([mu, CAST(n AS DOUBLE)]) AS value FROM fits CROSS JOIN hs)
    SELECT 'mean' AS model, {_KEYS}, hyper, round(value, 6) AS value, CAST(NULL AS VARCHAR) AS value_text FROM long"""
)
def plot_hyper(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = _user_lags(spark, sf_dir)
    return rounded(hyper_lines(hyper(train(lagged, _weeks(lagged), "mean", MEAN))))


@query(
    f"""WITH {_LAGGED}, {SQL_WEEKS}, {_MEANS}, long AS (SELECT h, window_number, start, stop, unnest(['mu', 'n']) AS hyper, unnest([mu, CAST(n AS DOUBLE)]) AS value FROM fits CROSS JOIN hs),
    scores AS (SELECT h, window_number, avg(abs(y - mu)) AS mae FROM (SELECT h, f.window_number, user_id, y, mu FROM lagged JOIN fits f ON day BETWEEN start AND stop CROSS JOIN hs) GROUP BY h, window_number, user_id),
    each AS (SELECT h, window_number, round(mae, 6) AS error FROM scores)
    SELECT 'mean' AS model, CAST(l.h AS INTEGER) AS model_forecast_horizon, CAST(NULL AS INTEGER) AS window_length, CAST(l.window_number AS INTEGER) AS window_number, hyper, round(value, 6) AS value, CAST(NULL AS VARCHAR) AS value_text, 'mae' AS error_metric, error
    FROM long l JOIN each e ON e.h = l.h AND e.window_number = l.window_number"""
)
def plot_hyper_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperparameters beside the errors of their models on the held-out weeks, a row for each user's error."""
    lagged = _user_lags(spark, sf_dir)
    models = train(lagged, _weeks(lagged), "mean", MEAN)
    return rounded(hyper_lines(hyper(models), errors(predict(models, lagged), metrics=["mae"])))


@query(
    f"""WITH {_SAMPLES} SELECT 'naive' AS model, f.user_id, 7 AS model_forecast_horizon, f.horizon, forecast_period AS "index", false AS is_filler, unnest(['95', '50']) AS level, unnest([round(q[1], 5), round(q[2], 5)]) AS lower, unnest([round(q[4], 5), round(q[3], 5)]) AS upper
    FROM forecast f LEFT JOIN quantiles q ON q.user_id = f.user_id AND q.horizon = f.horizon WHERE h = 7
    UNION ALL SELECT 'naive', f.user_id, 7, f.horizon, forecast_period, true, unnest(['95', '50']), unnest([round(q[1], 5), round(q[2], 5)]), unnest([round(q[4], 5), round(q[3], 5)])
    FROM forecast f LEFT JOIN quantiles q ON q.user_id = f.user_id AND q.horizon = f.horizon WHERE h = 7 AND f.horizon > 1"""
)
def plot_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = combine(_final(spark, sf_dir, NAIVE, "naive", (7,)))
    return rounded(interval_ribbons(intervals(combined, _fit_residuals(spark, sf_dir), (0.5, 0.95), 40, seed=11, pick="linear")), 5)


# --- the flagship
_FLAGSHIP = f"""WITH {_NAIVE_ROWS}, scores AS (SELECT window_number, user_id, avg(abs(r)) AS mae, 100 * avg({_SMAPE}) AS smape FROM valid WHERE h = 7 GROUP BY 1, 2)
    SELECT CAST(window_number AS INTEGER) AS window_number, count(*) AS users, round(median(mae), 5) AS mae, round(median(smape), 5) AS smape FROM scores GROUP BY 1"""


@query(_FLAGSHIP)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of two held-out weeks the median over users of the error of a seasonal-naive forecast of daily value, a week ahead."""
    found = errors(_validation(spark, sf_dir, horizons=(7,)), metrics=["mae", "smape"]).by_window
    return rounded(found.groupBy("window_number").agg(F.count(F.lit(1)).alias("users"), F.median("mae").alias("mae"), F.median("smape").alias("smape")), 5)
