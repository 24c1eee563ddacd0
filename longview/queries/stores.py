"""Queries that go by way of files: tables with missing values, lagged frames, saved models; and features of dates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.gaps import fill_gaps
from ..operators.hyper import hyper
from ..operators.lags import create_lagged
from ..operators.models import PandasModel
from ..operators.prediction import predict
from ..operators.training import train
from ..operators.windows import create_windows
from ..plans.spec import SeriesSpec
from ..session import shared_dir
from ..sources.tables import read_frames, read_models, read_table, write_frames, write_models, write_table
from .features import SQL_WEEKS, WEEKS
from .forecasts import _LAGGED, _OLS, OLS
from .registry import query, rounded
from .series import SQL_USERS, USERS, users


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/longview/{name}-{uuid.uuid4().hex}"


@query(f"WITH {SQL_USERS} SELECT user_id, day, y, n_events FROM users")
def store_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with gaps as CSV, where NA stands for null, and back."""
    df, path = users(spark, sf_dir).select("user_id", "day", "y", "n_events"), _place(spark, "csv")
    write_table(df, path, "csv")
    return read_table(spark, path, "csv", schema=df.schema)


@query(f"WITH {_LAGGED} SELECT row_index, day, user_id, y, y_lag_7 FROM lagged")
def store_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lagged frames, each horizon in a folder of its own, and back."""
    lagged, path = create_lagged(users(spark, sf_dir), USERS, [1, 7], [1, 7]), _place(spark, "frames")
    write_frames(lagged, path)
    return read_frames(lagged, path).frames[7].select("row_index", "day", "user_id", "y", "y_lag_7")


@query(
    f"""WITH {_LAGGED}, {SQL_WEEKS}, {_OLS} SELECT 'ols' AS model, CAST(w.window_number AS INTEGER) AS window_number, row_index AS valid_indices, user_id, y, round(intercept + slope * y_lag_7, 3) AS y_pred
    FROM lagged JOIN weeks w ON day BETWEEN start AND stop JOIN fits f ON f.window_number = w.window_number"""
)
def store_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models saved, read back and applied."""
    lagged, path = create_lagged(users(spark, sf_dir), USERS, [7], [1, 7, 14]), _place(spark, "models")
    models = train(lagged, create_windows(lagged, start=WEEKS[0], stop=WEEKS[1]), "ols", OLS)
    write_models(models, path)
    return rounded(predict(read_models(models, spark, path), lagged).df.select("model", "window_number", "valid_indices", "user_id", "y", "y_pred"), 3)


def _told(data, horizon, held_out):
    return {"rows": len(data), "first": str(held_out[0]), "last": str(held_out[1])}


@query(f"WITH {_LAGGED}, {SQL_WEEKS} SELECT CAST(window_number AS INTEGER) AS window_number, count(*) AS n_rows, CAST(min(start) AS VARCHAR) AS held_first, CAST(max(stop) AS VARCHAR) AS held_last FROM lagged JOIN weeks ON NOT (day BETWEEN start AND stop) GROUP BY 1")
def train_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit that is told which window it must not see."""
    lagged = create_lagged(users(spark, sf_dir), USERS, [7], [1, 7, 14])
    models = train(lagged, create_windows(lagged, start=WEEKS[0], stop=WEEKS[1]), "told", PandasModel(_told, lambda m, d: d[["y_lag_7"]], held_out=True, merge=lambda a, b: {**a, "rows": a["rows"] + b["rows"]}))
    found = hyper(models, lambda m: {"n_rows": m["rows"], "held_first": m["first"], "held_last": m["last"]}, "n_rows long, held_first string, held_last string")
    return found.select("window_number", "n_rows", "held_first", "held_last")


HOURS = SeriesSpec("y", date="at", frequency="1 hour", groups=("event_type",), dynamic=("hour", "weekday"))


@query(
    """WITH hours AS (SELECT event_type, date_trunc('hour', ts) AS t, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1, 2), ends AS (SELECT event_type, min(t) AS lo, (SELECT max(t) FROM hours) AS hi FROM hours GROUP BY 1),
    grid AS (SELECT event_type, unnest(generate_series(lo, hi + INTERVAL 3 HOUR, INTERVAL 1 HOUR)) AS t, hi FROM ends),
    filled AS (SELECT g.event_type, g.t, g.hi, y FROM grid g LEFT JOIN hours h ON h.event_type = g.event_type AND h.t = g.t),
    lagged AS (SELECT *, lag(y, 3) OVER w AS y_lag_3, lag(y, 24) OVER w AS y_lag_24 FROM filled WINDOW w AS (PARTITION BY event_type ORDER BY t))
    SELECT event_type, CAST(t AS DATE) AS day, CAST(date_diff('hour', hi, t) AS INTEGER) AS horizon, y_lag_3, y_lag_24, CAST(hour(t) AS INTEGER) AS hour, CAST(dayofweek(t) + 1 AS INTEGER) AS weekday FROM lagged WHERE t > hi"""
)
def features_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours and weekdays as dynamic features of an hourly series, known for the steps to forecast."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hours = events.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    parts = lambda df, c: df.withColumns({"hour": F.hour(c), "weekday": F.dayofweek(c)})
    filled = parts(fill_gaps(hours, SeriesSpec("y", date="at", frequency="1 hour", groups=("event_type",))), "at")
    frame = create_lagged(filled, HOURS, 3, [3, 24], kind="forecast", predict_future=lambda df, dates: parts(dates, "index")).frames[3]
    return frame.select("event_type", F.to_date("index").alias("day"), "horizon", "y_lag_3", "y_lag_24", "hour", "weekday")
