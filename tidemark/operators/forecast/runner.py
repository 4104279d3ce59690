"""Forecasting many series at once: one entry point over all methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.forecast.arima import forecast_ar1, forecast_arima
from tidemark.operators.forecast.ces import forecast_ces
from tidemark.operators.forecast.esn import forecast_esn
from tidemark.operators.forecast.garch import forecast_garch
from tidemark.operators.forecast.gbt import forecast_gbt
from tidemark.operators.forecast.replay import tail_replay

METHODS = {
    "tail_replay": tail_replay,
    "ar1": forecast_ar1,
    "arima": forecast_arima,
    "ces": forecast_ces,
    "garch": forecast_garch,
    "esn": forecast_esn,
    "gbt": forecast_gbt,
}


def forecast_rows(fits: DataFrame, keys: list[str]) -> DataFrame:
    """One row per forecast step: ``keys, step, yhat`` with step 1 right after the training rows."""
    rows = fits.select(*keys, F.posexplode("yhat").alias("_i", "yhat"))
    return rows.select(*keys, (F.col("_i") + 1).alias("step"), "yhat")


def forecast_panel(train: DataFrame, method: str, horizon, keys: list[str], **params) -> DataFrame:
    """Fit and forecast every group of ``train`` (``keys, pos, value``) with a registered method.

    ``horizon`` is a number of steps or a column over ``keys``. One row per group: ``keys, yhat, p, q,
    prepare_ms, fit_ms, predict_ms, error, last_train_pos``; a failed group carries its reason in ``error``.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {sorted(METHODS)}")
    horizon = F.lit(horizon) if isinstance(horizon, int) else horizon
    return METHODS[method](train, keys, horizon, **params)
