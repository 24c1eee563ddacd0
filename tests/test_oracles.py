"""Every registered query of the forecasting operators against its SQL; those without SQL make rows."""

from dataclasses import replace

import pytest

from compare import duck_rows, spark_rows
from longview.operators import intervals, prediction, relational, training, windows
from longview.queries import callables, features, forecasts, stores  # noqa: F401
from longview.queries.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    names, rows = spark_rows(QUERIES[name](spark, SF))
    assert rows
    if name in ORACLES:
        want_names, want = duck_rows(SF, ORACLES[name])
        assert names == want_names
        assert len(rows) == len(want)
        assert rows == want


@pytest.mark.parametrize(("name", "module", "what", "value"), [
    ("train_pandas_ols", prediction, "MODEL_BYTES", -1),  # models are shuffled to the rows
    ("error_rmsse", relational, "has_long_series", lambda *_: True),  # series in blocks
    ("intervals_lcg", intervals, "_in_rows", intervals._by_number),  # residuals joined by number
])
def test_the_other_way_gives_the_same(spark, monkeypatch, name, module, what, value):
    monkeypatch.setattr(module, what, value)
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(SF, ORACLES[name])


@pytest.mark.parametrize("name", ["train_ols1", "train_by_group", "predict_valid", "train_pandas_ols", "valid_rows_expand", "train_rows_expand"])
def test_many_windows_give_the_same(spark, monkeypatch, name):
    for module in (windows, training):
        monkeypatch.setattr(module, "LITERAL_WINDOWS", 0)
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(SF, ORACLES[name])


def _few(fit):
    """``fit``, which fails where a frame has more than 20 rows."""

    def checked(frame):
        assert len(frame) <= 20
        return frame

    return lambda data, *args, **more: fit(checked(data) if hasattr(data, "columns") else map(checked, data), *args, **more)


@pytest.mark.parametrize(("module", "name"), [
    (callables, "predict_one_for_all"), (callables, "predict_interval_unordered"), (callables, "train_on_a_split"),
    (forecasts, "train_pandas_ols"), (forecasts, "hyper_pandas"), (stores, "train_held_out"),
])
def test_fits_in_python_hold_a_batch(spark, monkeypatch, module, name):
    train = module.train
    monkeypatch.setattr(module, "train", lambda lagged, windows, name, model, *more: train(lagged, windows, name, replace(model, fit=_few(model.fit)), *more, on_error="raise"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(SF, ORACLES[name])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
