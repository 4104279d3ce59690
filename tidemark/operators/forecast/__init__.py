"""Forecast methods. Each turns training rows into one row per group: ``keys, yhat[], p, q, *_ms, error``."""

from tidemark.operators.forecast.runner import METHODS, forecast_panel, forecast_rows

__all__ = ["METHODS", "forecast_panel", "forecast_rows"]
