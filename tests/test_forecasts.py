"""Training, errors, combination, intervals and reconciliation on small tables with known results."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from longview.operators.combine import combine
from longview.operators.errors import errors
from longview.operators.hyper import hyper
from longview.operators.intervals import intervals
from longview.operators.lags import create_lagged
from longview.operators.models import AggregateModel, PandasModel, Results
from longview.operators.plot_data import facets, forecast_lines, hyper_lines, interval_ribbons, windows_grid
from longview.operators.prediction import predict
from longview.operators.reconcile import reconcile_groups, reconcile_temporal, solve
from longview.operators.residuals import residuals
from longview.operators.training import train
from longview.operators.windows import create_windows
from longview.plans.spec import SeriesSpec
from longview.sources import tables
from longview.streaming.buckets import bucket_events, forecast_each

D = dt.date
SPEC = SeriesSpec("y", date="d", frequency="1 month", groups=("g",))


def results(spark, rows, kind="training", spec=SPEC, length=None, **more):
    cols = "model string, model_forecast_horizon int, window_length int, window_number int, valid_indices long, date_indices date, g string, y double, y_pred double"
    if kind != "training":
        cols = "model string, model_forecast_horizon int, horizon int, window_length int, window_number int, forecast_period date, g string, y_pred double"
    return Results(spark.createDataFrame(rows, cols), spec, kind, "direct", window_length=length, **more)


def row(y, p, w=1, g="a", i=1, h=1, model="m"):
    return (model, h, None, w, i, D(2020, i, 1), g, y, p)


def test_metric_values(spark):
    names = ["mae", "rmse", "mape", "mdape", "smape"]
    found = errors(results(spark, [row(10.0, 12.0, i=1), row(20.0, 15.0, i=2), row(0.0, 0.0, i=3), row(5.0, 4.0, i=4)]), metrics=names)
    for t in found:
        r = t.first()
        assert [round(r[m], 6) for m in names] == [2.0, 2.738613, 21.666667, 20.0, 22.991823]
    assert [c for c in found.by_window.columns if c not in names] == ["model", "model_forecast_horizon", "window_number", "g", "window_start", "window_stop", "window_midpoint"]
    assert (found.by_window.first().window_start, found.by_window.first().window_stop, found.by_window.first().window_midpoint) == (D(2020, 1, 1), D(2020, 4, 1), D(2020, 2, 15))
    zero = errors(results(spark, [row(0.0, 1.0)])).by_window.first()
    assert zero.mae == 1 and zero.mape is None and zero.mdape is None and zero.smape == 200
    odd = errors(results(spark, [row(float("nan"), 1.0), row(None, 1.0), row(2.0, None), row(2.0, 5.0)])).by_window.first()
    assert odd.mae == 3 and odd.mape == 150
    assert errors(results(spark, [row(None, 1.0)])).by_window.first().mae is None


def test_levels_aggregate_metrics(spark):
    r = results(spark, [row(10.0, 20.0, w=1), row(10.0, 12.0, w=2, i=5), row(10.0, 16.0, w=3, i=9), row(1.0, 1.0, w=3, g="b", i=12)])
    found = errors(r, metrics=["mae"])
    assert {(x.g, x.mae) for x in found.by_horizon.collect()} == {("a", 6.0), ("b", 0.0)}
    assert {(x.window_start, x.window_stop) for x in found.overall.collect()} == {(D(2020, 1, 1), D(2020, 12, 1))}
    assert {(x.g, x.mae) for x in errors(r, metrics=["mae"], aggregate=F.max).overall.collect()} == {("a", 10.0), ("b", 0.0)}
    assert errors(r, metrics=["mae"], windows=[3], where="g = 'b'").by_window.count() == 1
    for bad in (dict(metrics=["mse"]), dict(metrics=[]), dict(metrics=["rmsse"])):
        with pytest.raises(ValueError):
            errors(r, **bad)


def test_rmsse(spark):
    ds = [D(2019 + (5 + i) // 12, (5 + i) % 12 + 1, 1) for i in range(10)]
    actuals = spark.createDataFrame([(d, g, float(i + 1)) for g in "12" for i, d in enumerate(ds)], "d date, g string, y double")
    made = create_lagged(actuals, SPEC, [1, 2], [1, 2])
    w = create_windows(made, start=[D(2020, 1, 1), D(2020, 2, 1)], stop=[D(2020, 1, 1), D(2020, 2, 1)])
    seven = predict(train(made, w, "seven", AggregateModel({"n": "count(y)"}, "7")), made)
    found = errors(seven, actuals, ["rmsse", "mae"]).by_window.collect()
    assert {(r.g, r.model_forecast_horizon, r.window_number, r.rmsse, r.mae) for r in found} == {(g, h, n, float(n), float(n)) for g in "12" for h in (1, 2) for n in (1, 2)}
    flat = actuals.withColumn("y", F.lit(3.0))
    assert {r.rmsse for r in errors(seven, flat, ["rmsse"]).by_window.collect()} == {None}
    whole = predict(train(made, create_windows(made, 0), "seven", AggregateModel({"n": "count(y)"}, "7")), made)
    assert all(math.isclose(r.rmsse, math.sqrt(sum((7 - i) ** 2 for i in range(1, 11)) / 10)) for r in errors(whole, actuals, ["rmsse"]).by_window.collect())


def test_residuals(spark):
    assert [r.residuals for r in residuals(results(spark, [row(10.0, 12.5)])).collect()] == [-2.5]
    with pytest.raises(ValueError):
        residuals(results(spark, [], "forecast"))


@pytest.fixture(scope="module")
def series(spark):
    rows = [(D(2020 + i // 12, i % 12 + 1, 1), g, float(i * k + i % 3)) for g, k in (("a", 1), ("b", 2)) for i in range(24)]
    return spark.createDataFrame(rows, "d date, g string, y double")


def _mean(data, horizon, plus=0.0):
    if plus is None:
        raise RuntimeError("no fit")
    return float(data["y"].mean()) + plus


def test_models_agree(spark, series):
    made = create_lagged(series, SPEC, [1, 3], [1, 3])
    w = create_windows(made, 6)
    sql = predict(train(made, w, "m", AggregateModel({"mu": "avg(y)"}, "mu")), made)
    own = predict(train(made, w, "m", PandasModel(_mean, lambda m, data: [[m]])), made, chunks=3)
    key = lambda r: [sorted((x.model_forecast_horizon, x.window_number, x.g, x.valid_indices, round(x.y_pred, 9)) for x in r.df.collect())]
    assert key(sql) == key(own) and sql.df.columns == own.df.columns and sql.df.count() == 96
    assert sql.df.columns == ["model", "model_forecast_horizon", "window_length", "window_number", "valid_indices", "date_indices", "g", "y", "y_pred"]
    one = sql.df.filter("window_number = 1").first()
    held = [r.y for r in series.collect() if not D(2020, 1, 1) <= r.d <= D(2020, 6, 1)]
    assert math.isclose(one.y_pred, np.mean(held))


def _seen(data, horizon):
    return list(zip(data["y"], data["y_lag_1"].fillna(-1)))


def _seen_in_order(frames, horizon):
    return [x for data in frames for x in _seen(data, horizon)]


def _flat(m):
    return {"rows": [repr(x) for x in m]}


def test_fits_by_parts_and_streams_see_every_row(spark, series, monkeypatch):
    made = create_lagged(series.repartition(5), SPEC, 1, 1)
    w = create_windows(made, 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        told = lambda model: {r.window_number: r.rows for r in hyper(train(made, w, "m", model, on_error="raise"), _flat, "rows array<string>").collect()}
        whole = told(PandasModel(_seen, None))
        stream = told(PandasModel(_seen_in_order, None, stream=True))
        parts = told(PandasModel(_seen, None, merge=lambda a, b: a + b, finish=lambda m: sorted(m)[::-1]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = sorted(made.frames[1].collect(), key=lambda r: (r.g, r.d))
    for i, (start, stop) in enumerate(w.rows):
        want = [(r.y, -1.0 if r.y_lag_1 is None else r.y_lag_1) for r in rows if not start <= r.d <= stop]
        assert whole[i + 1] == stream[i + 1] == _flat(want)["rows"]
        assert parts[i + 1] == _flat(sorted(want)[::-1])["rows"]


def test_failures_of_parts_and_streams(spark, series):
    made = create_lagged(series, SPEC, 1, 1)
    w = create_windows(made, start=[D(2020, 1, 1), D(2021, 7, 1)], stop=[D(2020, 6, 1), D(2021, 12, 1)])

    def fit(data, horizon, held_out):
        if held_out[0] == D(2020, 1, 1):
            raise RuntimeError("no fit")
        return len(data) if hasattr(data, "columns") else next(data).shape[1]

    def never(*_):
        raise RuntimeError("no end")

    error = lambda model: {r.window_number: r.error for r in train(made, w, "m", model).table.collect()}
    failed = {1: "RuntimeError: no fit", 2: None}
    assert error(PandasModel(fit, None, held_out=True, merge=lambda a, b: a + b)) == error(PandasModel(fit, None, held_out=True, stream=True)) == failed
    assert error(PandasModel(fit, None, held_out=True, merge=lambda a, b: a + b, finish=never)) == {1: "RuntimeError: no fit", 2: "RuntimeError: no end"}
    with pytest.raises(Exception, match="no fit"):
        train(made, w, "m", PandasModel(fit, None, held_out=True, merge=lambda a, b: a + b), on_error="raise")
    for bad in (dict(stream=True, merge=max), dict(finish=len)):
        with pytest.raises(ValueError):
            train(made, w, "m", PandasModel(fit, None, **bad))


def test_failed_fits_are_kept(spark, series):
    made = create_lagged(series, SPEC, 1, 1)
    w = create_windows(made, 0)
    models = train(made, w, "bad", PandasModel(_mean, lambda m, data: [[m]], {"plus": None}))
    assert "no fit" in models.table.first().error
    assert {r.y_pred for r in predict(models, made).df.collect()} == {None}
    assert [r.mu for r in hyper(models, lambda m: {"mu": m}, "mu double").collect()] == [None]
    with pytest.raises(Exception, match="no fit"):
        train(made, w, "bad", PandasModel(_mean, lambda m, data: [[m]], {"plus": None}), on_error="raise")
    for bad in (("", PandasModel(_mean, None)), ("m", "a model")):
        with pytest.raises(ValueError):
            train(made, w, *bad)


def test_hyper_and_saved_models(spark, series, tmp_path):
    made = create_lagged(series, SPEC, [1, 3], [1, 3])
    w = create_windows(made, 6)
    models = train(made, w, "m", PandasModel(_mean, lambda m, data: [[m]]))
    found = hyper(models, lambda m: {"mu": m, "kind": "mean"}, "mu double, kind string")
    assert found.columns == ["model", "model_forecast_horizon", "window_length", "window_number", "valid_window_start", "valid_window_stop", "valid_window_midpoint", "mu", "kind"]
    assert found.count() == len(w) * 2 and {r.hyper for r in hyper_lines(found).collect()} == {"mu", "kind"}
    tables.write_models(models, f"{tmp_path}/m")
    again = tables.read_models(models, spark, f"{tmp_path}/m")
    assert sorted(predict(again, made).df.collect()) == sorted(predict(models, made).df.collect())
    tables.write_frames(made, f"{tmp_path}/f")
    assert sorted(tables.read_frames(made, f"{tmp_path}/f").frames[3].collect()) == sorted(made.frames[3].collect())
    sql = train(made, w, "m", AggregateModel({"mu": "avg(y)"}, "mu"))
    tables.write_models(sql, f"{tmp_path}/s")
    assert sorted(predict(tables.read_models(sql, spark, f"{tmp_path}/s"), made).df.collect()) == sorted(predict(sql, made).df.collect())


def test_interval_predictions_are_ordered(spark, series):
    made = create_lagged(series, SPEC, 1, 1)
    band = PandasModel(_mean, lambda m, data: data[["y_lag_1"]].assign(a=data["y_lag_1"] + 2, b=data["y_lag_1"] - 2, c=data["y_lag_1"])[["a", "b", "c"]])
    out = predict(train(made, create_windows(made, 0), "band", band, "interval"), made).df.filter("y_pred IS NOT NULL").collect()
    assert out and all(r.y_pred_lower == r.y_pred - 2 and r.y_pred_upper == r.y_pred + 2 for r in out)


def test_multi_output_models(spark, series):
    make = lambda kind: create_lagged(series, SPEC, [1, 3], [1], kind=kind, method="multi_output")
    made = make("train")
    models = train(made, create_windows(made, 0), "m", PandasModel(lambda data, horizon: len(horizon), lambda m, data: data[["y_lag_1"]].assign(z=data["y_lag_1"])))
    rows = predict(models, made).df.filter("g = 'a' AND valid_indices = 2").orderBy("horizon").collect()
    assert [(r.horizon, r.forecast_indices, r.forecast_date_indices, r.y, r.y_pred) for r in rows] == [(1, 3, D(2020, 3, 1), 4.0, 2.0), (3, 5, D(2020, 5, 1), 5.0, 2.0)]
    future = predict(models, make("forecast"))
    assert {(r.g, r.horizon, r.forecast_period, r.y_pred) for r in future.df.collect()} == {(g, h, D(2022, h, 1), y) for g, y in (("a", 25.0), ("b", 48.0)) for h in (1, 3)}
    assert residuals(predict(models, made)).columns == ["model", "g", "horizon", "index", "residuals"]


def forecast(spark, name, horizons, value, length=0):
    rows = [(name, m, h, length, 1, D(2021, h, 1), "a", value(m, h)) for m in horizons for h in range(1, m + 1)]
    return results(spark, rows, "forecast", length=length, models=(name,), horizons=tuple(horizons), data_stop=D(2020, 12, 1))


def test_combine_by_horizon(spark):
    got = combine(forecast(spark, "x", [1, 3, 6, 12], lambda m, h: float(m))).df.orderBy("horizon").collect()
    assert [(r.horizon, r.model_forecast_horizon) for r in got] == [(h, m) for m, hs in ((1, [1]), (3, [2, 3]), (6, [4, 5, 6]), (12, range(7, 13))) for h in hs]
    two = combine(forecast(spark, "x", [1, 12], lambda m, h: 1.0), forecast(spark, "z", [1, 12], lambda m, h: 3.0))
    got = two.df.orderBy("horizon").collect()
    assert len(got) == 12 and {r.model for r in got} == {"Ensemble"} and {r.y_pred for r in got} == {2.0}
    assert [r.model_forecast_horizon for r in got] == [1] + [12] * 11
    part = combine(forecast(spark, "x", [2], lambda m, h: 1.0), forecast(spark, "z", [2], lambda m, h: None)).df
    assert {r.y_pred for r in part.collect()} == {None}
    with pytest.raises(ValueError):
        combine(forecast(spark, "x", [1], lambda m, h: 1.0, length=3))
    with pytest.raises(ValueError):
        combine(forecast(spark, "x", [1], lambda m, h: 1.0), by="error")
    lines = forecast_lines(two, spark.createDataFrame([(D(2020, 12, 1), "a", 1.0), (D(2021, 1, 1), "a", 1.0)], "d date, g string, y double"))
    assert {(r.series, r.type) for r in lines.collect()} == {("forecast", "model_forecast"), ("actual", "historical"), ("actual", "test")}


def test_combine_by_error(spark):
    table = errors(results(spark, [row(1.0, 100000.0, h=1, model="x"), row(1.0, 2.0, h=12, model="x"), row(1.0, None, h=1, model="z")]), metrics=["mae"])
    got = combine(forecast(spark, "x", [1, 12], lambda m, h: float(m)), forecast(spark, "z", [1], lambda m, h: -1.0), by="error", errors=table, metric="mae").df.collect()
    assert len(got) == 12 and {r.model_forecast_horizon for r in got} == {12} and {r.mae for r in got} == {1.0}


def test_intervals(spark):
    f = forecast(spark, "x", [3], lambda m, h: 10.0 * h)
    same = spark.createDataFrame([("x", "a", 3, D(2020, i, 1), 2.5) for i in range(1, 9)] + [("x", "a", 3, D(2020, 9, 1), None)], "model string, g string, model_forecast_horizon int, index date, residuals double")
    got = intervals(f, same, (0.95, 0.5))
    assert [c for c in got.df.columns if "_lower_" in c or "_upper_" in c] == ["y_pred_lower_95", "y_pred_lower_50", "y_pred_upper_50", "y_pred_upper_95"]
    assert all(r[c] == r.y_pred + 2.5 for r in got.df.collect() for c in got.df.columns if "_lower_" in c or "_upper_" in c)
    spread = same.withColumn("residuals", F.month("index").cast("double"))
    one, two = (sorted(intervals(f, spread, times=50, seed=3).df.repartition(n).collect()) for n in (1, 5))
    assert one == two and all(r.y_pred_lower_95 < r.y_pred_upper_95 for r in one)
    joined = sorted(intervals(f, spread, times=50, seed=3, max_packed=0).df.collect())  # residuals joined by number
    assert joined == one
    out, samples = intervals(f.df.withColumnRenamed("forecast_period", "at"), spread.select("g", "residuals"), times=7, index="at", outcome="y_pred", keys=["g"], keep_samples=True)
    assert samples.count() == 21 and "y_pred_pred_lower_95" in out.columns
    none = intervals(f, spread.filter("g = 'b'")).df.collect()
    assert len(none) == 3 and {r.y_pred_lower_95 for r in none} == {None}
    with pytest.raises(ValueError):
        intervals(f, spread, (1.5,))
    assert {r.level for r in interval_ribbons(combine(f).__class__(**{**combine(f).__dict__, "df": got.df})).collect()} == {"95", "50"}


def test_temporal(spark):
    day = lambda a, n, v: spark.createDataFrame([(a + dt.timedelta(days=i), float(v(i))) for i in range(n)], "d date, y double")
    month = lambda rows: spark.createDataFrame([(D(2020, m, 1), float(y)) for m, y in rows], "d date, y double")
    got = reconcile_temporal([day(D(2020, 1, 1), 60, lambda i: 5 if i < 31 else 7), month([(1, 150), (2, 200)])], ["1 day", "1 month"], "d", "y")
    assert [round(r.y, 6) for r in got["1 month"].orderBy("d").collect()] == [152.5, 201.5]
    assert sorted({round(r.y, 6) for r in got["1 day"].collect()}) == [4.919355, 6.948276]
    year = spark.createDataFrame([(D(2020, 1, 1), 110.0)], "d date, y double")
    got = reconcile_temporal([month([(m, 10) for m in range(1, 13)]), month([(1, 40), (5, 50), (9, 45)]), year], ["1 month", "4 months", "1 year"], "d", "y")
    assert [round(r.y, 6) for r in got["1 year"].collect()] == [121.666667]
    assert [round(r.y, 6) for r in got["4 months"].orderBy("d").collect()] == [38.055556, 43.055556, 40.555556]
    week = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(days=7 * i), 3.0 if i < 5 else 2.0) for i in range(9)], "d date, y double")
    got = reconcile_temporal([week, month([(1, 11), (2, 12)])], ["1 week", "1 month"], "d", "y")
    assert [round(r.y, 6) for r in got["1 month"].orderBy("d").collect()] == [13.0, 10.0]
    hours = spark.createDataFrame([(dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), 3.0 + i % 2 * 2) for i in range(72)], "d timestamp, y double")
    got = reconcile_temporal([hours, day(D(2020, 1, 1), 3, lambda i: (90, 100, 105)[i])], ["1 hour", "1 day"], "d", "y")
    assert [round(r.y, 6) for r in got["1 day"].orderBy("d").collect()] == [93.0, 98.0, 100.5]
    days = day(D(2019, 11, 1), 136, lambda i: 10)
    got = reconcile_temporal([days, month([(1, 150), (2, 200)])], ["1 day", "1 month"], "d", "y", keep_non_reconciled=True)
    assert [round(r.y, 6) for r in got["1 month"].orderBy("d").collect()] == [230.0, 245.0] and got["1 day"].count() == 136
    assert sorted({round(r.y, 6) for r in got["1 day"].collect()}) == [7.419355, 8.448276, 10.0]
    assert reconcile_temporal([days, month([(1, 150)])], ["1 day", "1 month"], "d", "y", keep_all=False).count() == 31
    with pytest.raises(Exception, match="missing steps"):
        reconcile_temporal([day(D(2020, 1, 2), 30, lambda i: 1), month([(1, 30)])], ["1 day", "1 month"], "d", "y")["1 day"].collect()


def levels(spark):
    ds = [D(2020, m, 1) for m in (1, 2, 3)]
    table = lambda rows, cols: spark.createDataFrame([(d, *k, float(v)) for k, vs in rows for d, v in zip(ds, vs)], cols)
    total = table([((), (50, 100, 75))], "d date, y double")
    state = table([(("IL",), (20, 60, 40)), (("WI",), (25, 40, 50))], "d date, state string, y double")
    sex = table([(("M",), (25, 45, 40)), (("F",), (35, 40, 20))], "d date, sex string, y double")
    both = table([(("IL", "M"), (5, 15, 10)), (("IL", "F"), (30, 10, 10)), (("WI", "M"), (25, 30, 20)), (("WI", "F"), (10, 10, 15))], "d date, state string, sex string, y double")
    return total, state, sex, both


def test_groups(spark):
    total, state, sex, both = levels(spark)
    for dense in (False, True):
        got = reconcile_groups({"state": state, "total": total}, "1 month", "d", "y", dense=dense)
        assert list(got) == ["total", "state"]
        assert [round(r.y, 6) for r in got["total"].orderBy("d").collect()] == [47.5, 100.0, 82.5]
        assert [round(r.y, 6) for r in got["state"].orderBy("d", "state").collect()] == [21.25, 26.25, 60.0, 40.0, 36.25, 46.25]
    got = reconcile_groups({"total": total, "sex": sex, "state": state, "both": both}, "1 month", "d", "y")
    march = [got[n].filter("d = '2020-03-01'").orderBy("d", *[c for c in got[n].columns if c not in ("d", "y")]).collect() for n in ("total", "sex", "state", "both")]
    assert [[round(r.y, 6) for r in x] for x in march] == [[70.0], [28.75, 41.25], [28.75, 41.25], [12.5, 16.25, 16.25, 25.0]]
    nested = {"total": total, "state": state, "both": both.filter("NOT (state = 'WI' AND sex = 'F' AND d = '2020-02-01')")}
    sweep, dense = (reconcile_groups(nested, "1 month", "d", "y", dense=x) for x in (False, True))
    for n in nested:
        key = lambda f: sorted((tuple(str(v) for v in r[:-1]), round(r[-1], 8)) for r in f.collect())
        assert key(sweep[n]) == key(dense[n])
    for bad in ({"total": total}, {"a": state, "b": state}, {"a": state, "b": sex}):
        with pytest.raises(ValueError):
            reconcile_groups(bad, "1 month", "d", "y")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=5), st.integers(0, 10**6))
def test_solution_adds_up(sizes, seed):
    leaves = sum(sizes)
    groups = np.repeat(np.eye(len(sizes)), sizes, axis=1)
    s = np.vstack([np.ones((1, leaves)), groups, np.eye(leaves)])
    out = solve(s, np.random.default_rng(seed).normal(size=len(s)) * 100)
    assert np.allclose(out, s @ out[-leaves:])


def test_facets_and_grid(spark, series):
    assert facets(["model", "group"], ("a", "b")) == ["model", "a", "b"]
    with pytest.raises(ValueError):
        facets("colour")
    gappy = series.filter("NOT (g = 'a' AND month(d) IN (2, 4))")
    made = create_lagged(gappy, SPEC, 1, 1)
    grid = windows_grid(made, create_windows(made, 12))
    assert grid.count() == 48 and {(r.g, r["index"]) for r in grid.filter("is_point").collect()} == {("a", D(2020, 3, 1)), ("a", D(2021, 3, 1)), ("a", D(2020, 1, 1))}


def test_sources_and_streams(spark, series, tmp_path):
    for kind in ("csv", "parquet", "json"):
        tables.write_table(series, f"{tmp_path}/{kind}", kind)
        assert sorted(tables.read_table(spark, f"{tmp_path}/{kind}", kind, series.schema).collect()) == sorted(series.collect())
    events = spark.createDataFrame([(dt.datetime(2020, 1, 1, h), "a", 1.0) for h in (1, 5)] + [(dt.datetime(2020, 1, 2, 3), "a", 4.0)], "ts timestamp, k string, v double")
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    got = []
    value = [F.sum("v").alias("y")]
    query = forecast_each(bucket_events(stream, "ts", ["k"], "1 day", value, late="1 day"), lambda df, i: got.extend(df.collect()), f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.date, r.y) for r in got} == {(r.date, r.y) for r in bucket_events(events, "ts", ["k"], "1 day", value).collect()} == {(dt.datetime(2020, 1, 1), 2.0), (dt.datetime(2020, 1, 2), 4.0)}
