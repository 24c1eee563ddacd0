"""Frequencies, gaps, lagged features and windows on small tables with known results."""

import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from longview.operators.gaps import fill_gaps
from longview.operators.lags import create_lagged
from longview.operators.relational import number_rows
from longview.operators.windows import Windows, _dates, _rows, create_windows, expand
from longview.plans.frequency import Frequency
from longview.plans.spec import LagSpec, SeriesSpec

D = dt.date
MONTH = SeriesSpec("outcome", date="date", frequency="1 month")
GROUPED = SeriesSpec("outcome", date="date", frequency="1 month", groups=("group",))


def months(n=72):
    return [D(2015 + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(d, float(i + 1), 2.0 * (i + 1)) for i, d in enumerate(months())], "date date, outcome double, feature double").orderBy(F.desc("date"))


@pytest.fixture(scope="module")
def grouped(spark):
    g = ["A"] * 5 + ["B"] * 60 + ["C"] * 5 + ["B"] * 2
    return spark.createDataFrame([(d, g[i], float(i + 1), 2.0 * (i + 1)) for i, d in enumerate(months())], "date date, group string, outcome double, feature double")


def test_frequency():
    f = Frequency.parse("3 months")
    assert (f.months, f.seconds, f.text) == (3, 0, "3 month")
    assert Frequency.parse("day").seconds == 86400 and Frequency.parse("2 quarters").months == 6 and Frequency.parse("1 week").interval() == "INTERVAL 7 DAY"
    assert f.plus(D(2020, 11, 30), 1) == D(2021, 2, 28)
    assert Frequency.parse("1 month").span(D(2020, 1, 31), D(2020, 4, 1)) == [D(2020, 1, 31), D(2020, 2, 29), D(2020, 3, 31)]
    for bad in ("1 decade", "", "0 days", "-1 day", "fortnight", None):
        with pytest.raises(ValueError):
            Frequency.parse(bad)


def test_frequency_on_columns(spark):
    df = spark.createDataFrame([(D(2020, 1, 31), dt.datetime(2020, 1, 31, 5))], "d date, t timestamp")
    f, h = Frequency.parse("1 month"), Frequency.parse("1 hour")
    row = df.select(f.after(F.col("d"), 1, df.schema["d"].dataType), f.after(F.col("t"), 1, df.schema["t"].dataType), h.after(F.col("t"), 30, df.schema["t"].dataType), f.grid(F.col("d"), F.lit(D(2020, 3, 31)))).first()
    assert list(row) == [D(2020, 2, 29), dt.datetime(2020, 2, 29, 5), dt.datetime(2020, 2, 1, 11), [D(2020, 1, 31), D(2020, 2, 29), D(2020, 3, 31)]]
    with pytest.raises(ValueError):
        h.check(df.schema["d"].dataType)


def test_spec_is_validated():
    for bad in (dict(static=("a",)), dict(groups=("g",)), dict(date="d"), dict(order="o", dynamic=("y",)), dict(order="o", frequency="1 eon")):
        with pytest.raises(ValueError):
            SeriesSpec("y", **bad)


def test_fill_gaps_single(spark, plain):
    gone = [2, *range(20, 36), 71]
    found = fill_gaps(plain.filter(~F.col("outcome").isin([float(i) for i in gone])), MONTH)
    rows = found.orderBy("date").collect()
    assert [r.date for r in rows] == months() and found.columns == ["date", "outcome", "feature"]
    assert {i + 1 for i, r in enumerate(rows) if r.outcome is None and r.feature is None} == set(gone)


def test_fill_gaps_grouped(spark):
    spec = SeriesSpec("y", date="d", frequency="1 day", groups=("g",), static=("s",))
    rows = [("a", D(2020, 1, 1), 1.0, "old"), ("a", D(2020, 1, 3), 3.0, "new"), ("b", D(2020, 1, 2), 5.0, "x"), ("b", D(2020, 1, 4), 6.0, None), (None, D(2020, 1, 4), 7.0, "n")]
    found = fill_gaps(spark.createDataFrame(rows, "g string, d date, y double, s string"), spec).orderBy("g", "d").collect()
    assert [tuple(r) for r in found] == [(None, D(2020, 1, 4), 7.0, "n"), *[("a", D(2020, 1, i), y, "new") for i, y in ((1, 1.0), (2, None), (3, 3.0), (4, None))], *[("b", D(2020, 1, i), y, None) for i, y in ((2, 5.0), (3, None), (4, 6.0))]]


def test_fill_gaps_errors(spark, plain):
    twice = spark.createDataFrame([(D(2020, 1, 1), 1.0), (D(2020, 1, 1), 2.0)], "date date, outcome double")
    off = spark.createDataFrame([(D(2020, 1, 1), 1.0), (D(2020, 1, 9), 2.0)], "date date, outcome double")
    null = spark.createDataFrame([(D(2020, 1, 1), 1.0), (None, 2.0)], "date date, outcome double")
    for df in (twice, off):
        with pytest.raises(ValueError):
            fill_gaps(df, MONTH, strict=True)
    assert fill_gaps(twice, MONTH).count() == 2 and fill_gaps(off, MONTH).count() == 1
    with pytest.raises(Exception, match="null dates"):
        fill_gaps(null, MONTH).collect()
    with pytest.raises(ValueError):
        fill_gaps(plain.withColumn("date", F.col("date").cast("string")), MONTH)
    with pytest.raises(ValueError):
        fill_gaps(plain.drop("date"), MONTH)
    assert fill_gaps(plain.limit(0), MONTH).count() == 0


def test_train_single(plain):
    made = create_lagged(plain, MONTH, 1, 1)
    rows = made.frames[1].orderBy("row_index").collect()
    assert made.frames[1].columns == ["row_index", "date", "outcome", "outcome_lag_1", "feature_lag_1"]
    assert [tuple(r) for r in rows[:2]] == [(2, D(2015, 2, 1), 2.0, 1.0, 2.0), (3, D(2015, 3, 1), 3.0, 2.0, 4.0)] and len(rows) == 71
    assert create_lagged(plain, MONTH, 1, 1, keep_rows=True).frames[1].count() == 72
    assert made.bounds() == (D(2015, 2, 1), D(2020, 12, 1))
    assert "predictors: 2 to 2" in made.describe()


def test_forecast_single(plain):
    row = create_lagged(plain, MONTH, 1, 1, kind="forecast").frames[1].first()
    assert row.asDict() == {"index": D(2021, 1, 1), "horizon": 1, "outcome_lag_1": 72.0, "feature_lag_1": 144.0}
    rows = create_lagged(plain, MONTH, 3, [3, 4], kind="forecast").frames[3].orderBy("horizon").collect()
    assert [(r["index"], r.horizon, r.outcome_lag_3, r.outcome_lag_4) for r in rows] == [(D(2021, 1, 1), 1, 70.0, 69.0), (D(2021, 2, 1), 2, 71.0, 70.0), (D(2021, 3, 1), 3, 72.0, 71.0)]


def test_forecast_without_dates(spark):
    df = spark.createDataFrame([(i, float(100 + i)) for i in range(1, 11)], "at int, y double")
    rows = create_lagged(df, SeriesSpec("y", order="at"), 3, [3, 5], kind="forecast").frames[3].orderBy("horizon").collect()
    assert [(r["index"], r.horizon, r.y_lag_3, r.y_lag_5) for r in rows] == [(11, 1, 108.0, 106.0), (12, 2, 109.0, 107.0), (13, 3, 110.0, 108.0)]
    short = create_lagged(df.limit(2), SeriesSpec("y", order="at"), 3, [3, 4], kind="forecast").frames[3].orderBy("horizon").collect()
    assert [(r.y_lag_3, r.y_lag_4) for r in short] == [(None, None), (101.0, None), (102.0, 101.0)]


def test_forecast_grouped(grouped):
    filled = fill_gaps(grouped, GROUPED)
    rows = create_lagged(filled, GROUPED, 1, [1, 2, 3], kind="forecast").frames[1].orderBy("group").collect()
    want = [("A", None, None, None, None, None, None), ("B", 72.0, 71.0, None, 144.0, 142.0, None), ("C", None, None, 70.0, None, None, 140.0)]
    assert [tuple(r)[2:] for r in rows] == want
    spec = SeriesSpec("outcome", date="date", frequency="1 month", groups=("group",), dynamic=("name",))
    named = filled.withColumn("name", F.date_format("date", "MMMM"))
    assert {r.name for r in create_lagged(named, spec, 1, 1, kind="forecast").frames[1].collect()} == {None}
    future = lambda df, dates: dates.withColumn("name", F.date_format("index", "MMMM"))
    assert {r.name for r in create_lagged(named, spec, 1, 1, kind="forecast", predict_future=future).frames[1].collect()} == {"January"}
    assert {r.name for r in create_lagged(named, spec, [1], 1, kind="forecast", method="multi_output").frames[(1,)].collect()} == {"December"}


def test_train_grouped_keeps_heads(grouped):
    rows = create_lagged(grouped, GROUPED, 1, [1, 2, 3]).frames[1].collect()
    assert len(rows) == 72 and sum(r.outcome_lag_1 is None for r in rows) == 3
    b = sorted((r for r in rows if r.group == "B"), key=lambda r: r.row_index)
    assert (b[-1].outcome, b[-1].outcome_lag_1, b[-1].outcome_lag_2, b[-1].outcome_lag_3) == (72.0, 71.0, 65.0, 64.0)


def test_multi_output(plain):
    made = create_lagged(plain, MONTH, [1, 3], [1, 3], method="multi_output")
    f = made.frames[1, 3]
    assert f.columns == ["row_index", "date", "outcome_1", "outcome_3", "outcome_lag_1", "outcome_lag_3", "feature_lag_1", "feature_lag_3"] and f.count() == 72
    assert tuple(f.filter("row_index = 3").first())[2:] == (4.0, 6.0, 3.0, 1.0, 6.0, 2.0)
    row = create_lagged(plain, MONTH, [1, 3], [1], kind="forecast", method="multi_output").frames[1, 3].first()
    assert (row["index"], row.horizon, row.outcome_lag_1, row.feature_lag_1) == ("2021-01-01, 2021-03-01", "1, 3", 72.0, 144.0)


def test_lookback_control(plain):
    both = create_lagged(plain, MONTH, 1, [3, 4]).frames[1]
    same = create_lagged(plain, MONTH, 1, lookback_control={"outcome": [3, 4], "feature": [3, 4]}).frames[1]
    assert sorted(both.collect()) == sorted(same.collect())
    assert "outcome_lag_3" not in create_lagged(plain, MONTH, 4, lookback_control={"outcome": [3, 4], "feature": None}).frames[4].columns
    assert "outcome_lag_3" in create_lagged(plain, MONTH, [4], lookback_control={"outcome": [3, 4], "feature": None}, method="multi_output").frames[(4,)].columns
    nested = create_lagged(plain, MONTH, [1, 6], lookback_control={1: {"outcome": [1], "feature": 2}, 6: {"outcome": [1, 12], "feature": [6]}})
    assert nested.features(1) == ["outcome_lag_1", "feature_lag_2"] and nested.features(6) == ["outcome_lag_12", "feature_lag_6"]
    assert nested.frames[1].count() == 60  # the greatest lag left, for every horizon


def test_bad_arguments(plain):
    for bad in (dict(lookback=None), dict(lookback=[0]), dict(lookback=1, kind="test"), dict(lookback=1, method="other"), dict(lookback=1, lookback_control={}), dict(lookback_control={"outcome": 1})):
        with pytest.raises(ValueError):
            create_lagged(plain, MONTH, 1, **bad)
    for horizons in (0, [], [1, 1]):
        with pytest.raises(ValueError):
            create_lagged(plain, MONTH, horizons, 1)
    with pytest.raises(ValueError):
        LagSpec.resolve(["y"], [5], [1, 2], None, "direct")
    with pytest.raises(ValueError):
        create_lagged(plain, MONTH, 1, 1, kind="forecast").skeleton()


def test_skeleton(plain):
    s = create_lagged(plain, MONTH, [1, 2], [1, 2]).skeleton()
    assert s.frames[2].columns == ["row_index", "date", "outcome"] and s.is_skeleton and s.horizons == (1, 2)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("aabc"), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=30), st.integers(1, 4))
def test_blocks_are_like_one_window(spark, rows, size):
    data = [(g, D(2020, 1, 1) + dt.timedelta(days=i), None if y is None else float(y)) for i, (g, y) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, d date, y double")
    spec = SeriesSpec("y", date="d", frequency="1 day", groups=("g",))
    kinds = [create_lagged(df, spec, [1, 2], [1, 3], method="multi_output", split_series=s, block_rows=size).frames[1, 2] for s in (False, True, None)]
    rows = [sorted(map(str, f.select(sorted(f.columns)).collect())) for f in kinds]
    assert rows[0] == rows[1] == rows[2]


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    assert [r.n for r in number_rows(df, ["x"], "n").orderBy("x").collect()] == list(range(1, 1001))
    hot = number_rows(df, ["x"], "n", ["g"]).filter("g = 'hot'").orderBy("x").collect()
    assert [r.n for r in hot] == list(range(1, len(hot) + 1))
    assert number_rows(df.limit(0), ["x"], "n").count() == 0


def test_window_layouts():
    assert _rows(1, 10, 3, 0, True) == [(1, 3), (4, 6), (7, 9), (10, 10)]
    assert _rows(1, 10, 3, 1, True) == [(1, 3), (5, 7), (9, 10)] and _rows(1, 10, 3, 1, False) == [(1, 3), (5, 7)]
    assert _rows(3, 20, 5, 2, True) == [(3, 7), (10, 14), (17, 20)]
    wide = _rows(16, 192, 12, 0, True)
    assert len(wide) == 15 and wide[0] == (16, 27) and wide[-2:] == [(172, 183), (184, 192)]
    month = Frequency.parse("1 month")
    assert _dates(D(1970, 4, 1), D(1983, 12, 1), 12, 48, True, month) == [(D(1970 + 5 * i, 4, 1), D(1971 + 5 * i, 3, 1)) for i in range(3)]
    long = _dates(D(1970, 4, 1), D(1984, 12, 1), 12, 0, True, month)
    assert len(long) == 15 and long[-1] == (D(1984, 4, 1), D(1984, 12, 1))
    assert len(_dates(D(1970, 4, 1), D(1984, 12, 1), 12, 0, False, month)) == 14


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 40), st.integers(0, 60), st.integers(1, 15), st.integers(0, 9), st.booleans())
def test_windows_stay_inside(a, more, n, skip, partial):
    b = a + more
    found = _rows(a, b, n, skip, partial)
    assert all(a <= s <= e <= b and e - s < n for s, e in found)
    assert all(y[0] == x[1] + 1 + skip for x, y in zip(found, found[1:]))
    assert found or not partial


def test_windows(spark, plain):
    made = create_lagged(plain, MONTH, 1, 1)
    one = create_windows(made, 0)
    assert one.rows == ((D(2015, 2, 1), D(2020, 12, 1)),) and one.trains_on_all(0)
    assert not create_windows(made, 0, start=D(2016, 1, 1)).trains_on_all(0)
    own = create_windows(made, start=[D(2017, 1, 1), D(2019, 5, 1)], stop=[D(2018, 3, 1), D(2019, 7, 1)])
    assert own.length is None and own.table(spark).columns == ["window_number", "start", "stop", "window_length", "is_custom"]
    assert all(a == b for a, b in create_windows(made, 1).rows)
    for bad in (dict(window_length=-1), dict(skip=-1), dict(start=[D(2017, 1, 1), D(2019, 1, 1)], stop=[D(2018, 1, 1)]), dict(start=D(2019, 1, 1), stop=D(2018, 1, 1)), dict(start=[D(2017, 1, 1), D(2019, 1, 1)])):
        with pytest.raises(ValueError):
            create_windows(made, **bad)


def test_rows_are_trained_on_or_held_out(plain):
    made = create_lagged(plain, MONTH, 1, 1)
    w = create_windows(made, 12, skip=3)
    f = made.frames[1]
    both = [{(r.window_number, r.row_index) for r in expand(f, w, v).select("window_number", "row_index").collect()} for v in (True, False)]
    assert not both[0] & both[1] and len(both[0]) + len(both[1]) == 71 * len(w)
    everything = Windows(((D(2015, 2, 1), D(2020, 12, 1)),), 0, 0, "date", (D(2015, 2, 1), D(2020, 12, 1)))
    assert expand(f, everything, False).count() == expand(f, everything, True).count() == 71
