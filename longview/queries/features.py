"""Queries for gaps, lagged features and windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.gaps import fill_gaps
from ..operators.lags import create_lagged
from ..operators.relational import union_all
from ..operators.windows import create_windows, expand
from ..plans.spec import SeriesSpec
from .registry import query, rounded
from .series import MONTHS, NATIONS, SQL_MONTHS, SQL_NATIONS, SQL_TYPES, SQL_USERS, TYPES, USERS, nation_months, order_months, type_days, user_days, users


@query(f"WITH {SQL_USERS} SELECT user_id, day, y, n_events FROM users")
def fill_gaps_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_gaps(user_days(spark, sf_dir), USERS).select("user_id", "day", "y", "n_events")


@query(
    f"""WITH {SQL_NATIONS},
    latest AS (SELECT c_nationkey, arg_max(n_regionkey, month) AS n_regionkey, min(month) AS lo FROM nations GROUP BY 1),
    grid AS (SELECT c_nationkey, n_regionkey, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM latest, (SELECT max(month) AS hi FROM nations))
    SELECT g.c_nationkey, g.month, n.y, g.n_regionkey FROM grid g LEFT JOIN nations n ON g.c_nationkey = n.c_nationkey AND g.month = n.month"""
)
def fill_gaps_monthly_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_gaps(nation_months(spark, sf_dir), NATIONS)


_LAGS = "lag(y, 1) OVER w AS y_lag_1, lag(y, 7) OVER w AS y_lag_7, lag(n_events, 1) OVER w AS n_events_lag_1, lag(n_events, 7) OVER w AS n_events_lag_7"


@query(f"WITH {SQL_USERS} SELECT row_index, day, y, user_id, {_LAGS} FROM users WINDOW w AS (PARTITION BY user_id ORDER BY day)")
def lag_train_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_lagged(users(spark, sf_dir), USERS, 1, [1, 7]).frames[1]


@query(
    f"""WITH {SQL_MONTHS}, lagged AS (SELECT row_index, month, y, lag(y, 3) OVER w AS y_lag_3, lag(y, 12) OVER w AS y_lag_12, lag(n_orders, 3) OVER w AS n_orders_lag_3, lag(n_orders, 12) OVER w AS n_orders_lag_12
    FROM months WINDOW w AS (ORDER BY month)) SELECT * FROM lagged WHERE row_index > 12"""
)
def lag_train_ungrouped_drop_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_lagged(order_months(spark, sf_dir), MONTHS, 3, [1, 3, 12]).frames[3]


@query(f"WITH {SQL_USERS} SELECT row_index, day, y, user_id, {_LAGS} FROM users WINDOW w AS (PARTITION BY user_id ORDER BY day)")
def lag_train_split_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long series dealt over tasks in blocks that repeat the rows which their lags reach."""
    return create_lagged(users(spark, sf_dir), USERS, 1, [1, 7], split_series=True, block_rows=11).frames[1]


@query(
    f"""WITH {SQL_TYPES} SELECT row_index, day, lead(y, 1) OVER w AS y_1, lead(y, 3) OVER w AS y_3, event_type, y AS y_lag_1, lag(y, 1) OVER w AS y_lag_2
    FROM types WINDOW w AS (PARTITION BY event_type ORDER BY day)"""
)
def lag_multi_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_lagged(type_days(spark, sf_dir), TYPES, [1, 3], [1, 2], method="multi_output").frames[1, 3]


@query(
    f"""WITH {SQL_USERS}, one AS (SELECT 1 AS h, row_index, day, y, user_id, lag(y, 1) OVER w AS y_lag_1, lag(y, 2) OVER w AS y_lag_2, CAST(NULL AS DOUBLE) AS y_lag_7, lag(n_events, 1) OVER w AS n_events_lag_1
    FROM users WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    seven AS (SELECT 7 AS h, row_index, day, y, user_id, CAST(NULL AS DOUBLE) AS y_lag_1, CAST(NULL AS DOUBLE) AS y_lag_2, lag(y, 7) OVER w AS y_lag_7, CAST(NULL AS BIGINT) AS n_events_lag_1 FROM users WINDOW w AS (PARTITION BY user_id ORDER BY day))
    SELECT * FROM one UNION ALL SELECT * FROM seven"""
)
def lag_lookback_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags of each feature and horizon: those shorter than the horizon go, and None drops a feature."""
    control = {1: {"y": [1, 2], "n_events": [1], "user_id": 0}, 7: {"y": [2, 7], "n_events": None}}
    made = create_lagged(users(spark, sf_dir), USERS, [1, 7], lookback_control=control)
    return union_all([f.withColumn("h", F.lit(h)) for h, f in made.frames.items()])


_FUTURE = """last AS (SELECT max(day) AS last FROM users),
    future AS (SELECT user_id, day, y, n_events, 0 AS horizon FROM users UNION ALL SELECT user_id, CAST(last + CAST(h AS INTEGER) AS DATE), NULL, NULL, CAST(h AS INTEGER) FROM (SELECT DISTINCT user_id FROM users), last, range(1, 8) t(h))"""


@query(
    f"""WITH {SQL_USERS}, {_FUTURE},
    lagged AS (SELECT day AS "index", horizon, user_id, lag(y, 7) OVER w AS y_lag_7, lag(y, 14) OVER w AS y_lag_14, lag(n_events, 7) OVER w AS n_events_lag_7, lag(n_events, 14) OVER w AS n_events_lag_14
    FROM future WINDOW w AS (PARTITION BY user_id ORDER BY day)) SELECT * FROM lagged WHERE horizon > 0"""
)
def lag_forecast_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_lagged(users(spark, sf_dir), USERS, 7, [1, 7, 14], kind="forecast").frames[7]


@query(
    f"""WITH {SQL_TYPES}, lagged AS (SELECT event_type, day, y AS y_lag_1, lag(y, 6) OVER w AS y_lag_7 FROM types WINDOW w AS (PARTITION BY event_type ORDER BY day))
    SELECT concat(CAST(CAST(day + 1 AS DATE) AS VARCHAR), ', ', CAST(CAST(day + 3 AS DATE) AS VARCHAR)) AS "index", '1, 3' AS horizon, event_type, y_lag_1, y_lag_7 FROM lagged WHERE day = (SELECT max(day) FROM types)"""
)
def lag_forecast_multi_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_lagged(type_days(spark, sf_dir), TYPES, [1, 3], [1, 7], kind="forecast", method="multi_output").frames[1, 3]


@query(
    f"""WITH {SQL_NATIONS}, months AS (SELECT DISTINCT c_nationkey, n_regionkey FROM nations), last AS (SELECT max(month) AS last FROM nations),
    bounds AS (SELECT c_nationkey, min(month) AS lo FROM nations GROUP BY 1),
    grid AS (SELECT c_nationkey, CAST(unnest(generate_series(lo, last, INTERVAL 1 MONTH)) AS DATE) AS month FROM bounds, last),
    filled AS (SELECT g.c_nationkey, g.month, n.y FROM grid g LEFT JOIN nations n ON g.c_nationkey = n.c_nationkey AND g.month = n.month),
    future AS (SELECT c_nationkey, month, y, 0 AS horizon FROM filled UNION ALL SELECT c_nationkey, CAST(last + to_months(CAST(h AS INTEGER)) AS DATE), NULL, CAST(h AS INTEGER) FROM months, last, range(1, 4) t(h)),
    lagged AS (SELECT month AS "index", horizon, c_nationkey, lag(y, 12) OVER w AS y_lag_12, lag(y, 3) OVER w AS y_lag_3 FROM future WINDOW w AS (PARTITION BY c_nationkey ORDER BY month))
    SELECT "index", horizon, l.c_nationkey, y_lag_3, y_lag_12, n_regionkey, CAST(month("index") AS INTEGER) AS calendar_month FROM lagged l JOIN months m ON l.c_nationkey = m.c_nationkey WHERE horizon > 0"""
)
def lag_predict_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static features keep their last value, and a dynamic one comes from a function of the future dates."""
    filled = fill_gaps(nation_months(spark, sf_dir), NATIONS).withColumn("calendar_month", F.month("month"))
    spec = SeriesSpec("y", date="month", frequency="1 month", groups=("c_nationkey",), static=("n_regionkey",), dynamic=("calendar_month",))
    future = lambda df, dates: dates.withColumn("calendar_month", F.month("index"))
    return create_lagged(filled, spec, 3, [3, 12], kind="forecast", predict_future=future).frames[3]


@query(f"WITH {SQL_USERS} SELECT row_index, day, y, user_id FROM users")
def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_lagged(users(spark, sf_dir), USERS, 1, [1, 7]).skeleton().frames[1]


@query(
    f"""WITH {SQL_USERS} SELECT 'direct' AS method, h AS horizon, 2 AS n_models, 1 AS n_targets, n AS n_predictors, CAST(min(day) AS VARCHAR) AS data_start, CAST(max(day) AS VARCHAR) AS data_stop, count(*) AS n_rows
    FROM users, (VALUES ('1', 7), ('7', 5)) t(h, n) GROUP BY h, n"""
)
def summary_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_lagged(users(spark, sf_dir), USERS, [1, 7], [1, 7, 14]).summary()


@query(
    """WITH times AS (SELECT h, CAST(t AS INTEGER) AS time FROM (VALUES (1), (3)) x(h), range(-7, 4) r(t) WHERE t <> 0 AND t <= h)
    SELECT h AS horizon, time, CASE WHEN time > 0 THEN 'Forecast' WHEN -time IN (1, 3, 7) AND -time >= h THEN 'Feature' ELSE 'No feature' END AS feature FROM times"""
)
def plot_lag_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.plot_data import lag_map

    return lag_map(create_lagged(order_months(spark, sf_dir), MONTHS, [1, 3], [1, 3, 7]))


# --- windows
def _plain_months(spark: SparkSession, sf_dir: str):
    spec = SeriesSpec("y", order="month")
    return create_lagged(order_months(spark, sf_dir), spec, 1, [1, 3])


@query(
    f"""WITH {SQL_MONTHS}, n AS (SELECT count(*) AS n FROM months), starts AS (SELECT s, n FROM n, (SELECT unnest(range(4, (SELECT n FROM n) + 1, 15)) AS s)),
    full_windows AS (SELECT s, s + 11 AS e FROM starts WHERE s + 11 <= n), rest AS (SELECT coalesce(max(e) + 4, 4) AS s, (SELECT n FROM n) AS e FROM full_windows),
    everything AS (SELECT * FROM full_windows UNION ALL SELECT * FROM rest WHERE s <= e)
    SELECT CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS window_number, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS stop, 12 AS window_length, FALSE AS is_custom FROM everything"""
)
def windows_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_windows(_plain_months(spark, sf_dir), 12, skip=3).table(spark)


def _window_table(lagged, windows) -> DataFrame:
    f = next(iter(lagged.frames.values()))
    return windows.table(f.sparkSession, f.schema[windows.index].dataType)


def _date_windows(step: int, length: int, partial: bool) -> str:
    return f"""WITH {SQL_USERS}, ends AS (SELECT min(day) AS lo, max(day) AS hi FROM users), starts AS (SELECT lo, hi, CAST(lo + CAST(i AS INTEGER) AS DATE) AS s FROM ends, range(0, 100000, {step}) t(i) WHERE lo + CAST(i AS INTEGER) <= hi)
    SELECT CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS window_number, s AS start, CAST(least(s + {length - 1}, hi) AS DATE) AS stop, {length} AS window_length, FALSE AS is_custom FROM starts{'' if partial else f' WHERE s + {length - 1} <= hi'}"""


@query(_date_windows(7, 7, True))
def windows_date_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = create_lagged(users(spark, sf_dir), USERS, 1, [1])
    return _window_table(lagged, create_windows(lagged, 7))


@query(_date_windows(9, 5, False))
def windows_date_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = create_lagged(users(spark, sf_dir), USERS, 1, [1])
    return _window_table(lagged, create_windows(lagged, 5, skip=4, include_partial=False))


#: Two weeks at the end of the events.
WEEKS = ([dt.date(2024, 1, 15), dt.date(2024, 1, 22)], [dt.date(2024, 1, 21), dt.date(2024, 1, 28)])
SQL_WEEKS = "weeks AS (SELECT * FROM (VALUES (1, DATE '2024-01-15', DATE '2024-01-21'), (2, DATE '2024-01-22', DATE '2024-01-28')) t(window_number, start, stop))"


@query(f"WITH {SQL_WEEKS} SELECT CAST(window_number AS INTEGER) AS window_number, start, stop, CAST(NULL AS INTEGER) AS window_length, TRUE AS is_custom FROM weeks")
def windows_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = create_lagged(users(spark, sf_dir), USERS, 1, [1])
    return _window_table(lagged, create_windows(lagged, start=WEEKS[0], stop=WEEKS[1]))


def _expanded(spark: SparkSession, sf_dir: str, validation: bool) -> DataFrame:
    lagged = create_lagged(type_days(spark, sf_dir), TYPES, 1, [1])
    windows = create_windows(lagged, start=WEEKS[0], stop=WEEKS[1])
    return expand(lagged.frames[1], windows, validation).select("event_type", "day", "y", "window_number")


@query(f"WITH {SQL_TYPES}, {SQL_WEEKS} SELECT event_type, day, y, CAST(window_number AS INTEGER) AS window_number FROM types JOIN weeks ON NOT (day BETWEEN start AND stop)")
def train_rows_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, False)


@query(f"WITH {SQL_TYPES}, {SQL_WEEKS} SELECT event_type, day, y, CAST(window_number AS INTEGER) AS window_number FROM types JOIN weeks ON day BETWEEN start AND stop")
def valid_rows_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, True)


@query(
    f"""WITH {SQL_USERS}, {SQL_WEEKS}, ends AS (SELECT min(day) AS lo, max(day) AS hi FROM users), grid AS (SELECT DISTINCT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM users, ends),
    rows_ AS (SELECT g.user_id, g.day, u.y FROM grid g LEFT JOIN users u ON g.user_id = u.user_id AND g.day = u.day),
    near AS (SELECT *, lag(y) OVER w AS before, lead(y) OVER w AS after FROM rows_ WINDOW w AS (PARTITION BY user_id ORDER BY day))
    SELECT day AS "index", CAST(user_id AS VARCHAR) AS series, user_id, y, CAST(window_number AS INTEGER) AS window_number, CASE WHEN start IS NOT NULL THEN CAST(start + 3 AS DATE) END AS window_midpoint, before IS NULL AND after IS NULL AND y IS NOT NULL AS is_point
    FROM near LEFT JOIN weeks ON day BETWEEN start AND stop"""
)
def plot_windows_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.plot_data import windows_grid

    lagged = create_lagged(users(spark, sf_dir), USERS, 1, [1])
    return rounded(windows_grid(lagged, create_windows(lagged, start=WEEKS[0], stop=WEEKS[1])))
